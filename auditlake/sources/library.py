"""A library of templates: each under a key, one of them active; and the writer of a template's files.

Tables of all templates are partitioned by ``template_key``; putting one down replaces
that key's partitions alone. What is active is a working copy, named by a pointer: rows
that are only ever added, of which the last committed one holds. A working copy gets a
folder of its own, so that switching is one append, and a switch that was killed before
it leaves the old state whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.template import slug
from . import files as X

#: Tables of a template that belong to its version; an archive of practice stays when a version is replaced.
VERSION, KEPT = ("criteria", "standard"), ("archive",)
_ENTRY = "name string, subject string, criteria long, stored timestamp"


class Library:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- files

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, path: str) -> bool:
        p, files = self._path(path)
        return files.exists(p)

    def _delete(self, path: str) -> None:
        p, files = self._path(path)
        files.delete(p, True)

    def _of(self, table: str, key: str) -> str:
        return f"{self.folder}/{table}/template_key={key}"

    def _put(self, df: DataFrame | None, table: str, key: str) -> None:
        """Replaces one key's partition; a table that isn't there or has no rows takes the partition away."""
        if df is None or df.isEmpty():
            self._delete(self._of(table, key))
            return
        rows = df.withColumn("template_key", F.lit(key))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("template_key").parquet(f"{self.folder}/{table}")

    def table(self, name: str, key: str) -> DataFrame | None:
        return self.spark.read.parquet(self._of(name, key)) if self._exists(self._of(name, key)) else None

    def key_of(self, name: str) -> str:
        return self.spark.range(1).select(slug(F.lit(name))).first()[0]

    # ---- the pointer

    def _pointer(self):
        """(key, work) of the last committed switch."""
        if not self._exists(f"{self.folder}/active"):
            return None
        return self.spark.read.schema("n long, key string, work string").json(f"{self.folder}/active").orderBy(F.desc("n")).first()  # a row a switch

    def active(self) -> str | None:
        p = self._pointer()
        return p and p.key

    def work(self, name: str) -> DataFrame | None:
        """A table of the working copy."""
        p = self._pointer()
        path = p and f"{self.folder}/work/{p.work}/{name}"
        return self.spark.read.parquet(path) if path and self._exists(path) else None

    def save_work(self, name: str, df: DataFrame) -> None:
        """Replaces a table of the working copy by a new one."""
        p = self._pointer()
        if p is None:
            raise KeyError("no template is active")
        self._switch(p.key, {**{n: self.work(n) for n in VERSION + KEPT}, name: df})

    def _switch(self, key: str, tables: dict[str, DataFrame | None]) -> None:
        p = self._pointer()
        n = (p.n if p else 0) + 1
        for name, df in tables.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{self.folder}/work/{n}/{name}")
        self.spark.createDataFrame([(n, key, str(n))], "n long, key string, work string").coalesce(1).write.mode("append").json(f"{self.folder}/active")
        for old in range(max(1, n - 3), n - 1):  # the copy before is kept for readers that are at it
            self._delete(f"{self.folder}/work/{old}")

    # ---- templates

    def entries(self) -> DataFrame:
        """(template_key, name, subject, criteria, stored, active), by name."""
        if not self._exists(f"{self.folder}/entries"):
            return self.spark.createDataFrame([], f"template_key string, {_ENTRY}, active boolean")
        rows = self.spark.read.schema(f"{_ENTRY}, template_key string").parquet(f"{self.folder}/entries")
        return rows.select("template_key", "name", "subject", "criteria", "stored", (F.col("template_key") == F.lit(self.active())).alias("active")).orderBy(F.lower("name"), "template_key")

    def back_save(self) -> None:
        """The working copy back into its entry."""
        key = self.active()
        if key and self._exists(self._of("entries", key)):
            for name in VERSION + KEPT:
                self._put(self.work(name), name, key)

    def activate(self, key: str) -> None:
        """Makes a template the working copy, after the one that was is saved."""
        if not self._exists(self._of("entries", key)):
            raise KeyError(f"no template {key}")
        if self.active() != key:
            self.back_save()
            self._switch(key, {name: self.table(name, key) for name in VERSION + KEPT})

    def deposit(self, name: str, subject: str, criteria: DataFrame, standard: DataFrame, activate: bool = False) -> str:
        """Puts a template down under the key of its name; the same name replaces the version, its archive stays."""
        key = self.key_of(name)
        if self.active() == key:
            self.back_save()
        self._put(criteria, "criteria", key)
        self._put(standard, "standard", key)
        entry = self.spark.range(1).select(F.lit(name.strip()).alias("name"), F.lit(subject).alias("subject"), F.lit(criteria.count()).alias("criteria"), F.current_timestamp().alias("stored"))
        self._put(entry, "entries", key)
        if self.active() == key:
            self._switch(key, {"criteria": self.table("criteria", key), "standard": self.table("standard", key), **{n: self.work(n) for n in KEPT}})
        elif activate or self.active() is None:
            self.activate(key)
        return key

    def remove(self, key: str) -> None:
        if self.active() == key:
            raise ValueError("the active template can't be removed; activate another one first")
        for table in (*VERSION, *KEPT, "entries"):
            self._delete(self._of(table, key))


def write_template(criteria: DataFrame, standard: DataFrame, folder: str) -> None:
    """A template as files: the standard as JSON lines, the catalogue as one JSON object of its ordered criteria. Readers see old files or new ones.

    criteria(ord, nr, titel, kapitel, einstufung, abgleichbegriffe array): a catalogue is one object by its format, hundreds of criteria.
    """
    X.write_lines(standard, f"{folder}/standard")
    one = F.struct("ord", "nr", "titel", "kapitel", "einstufung", "abgleichbegriffe")
    catalogue = criteria.agg(F.count("*").cast("int").alias("anzahl"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("ord")).alias("kriterien"))
    X.write_lines(catalogue.select(F.lit("1").alias("version"), "anzahl", "kriterien"), f"{folder}/structure")
