"""Runs over many documents that can be stopped anywhere and go on: each document is judged once, under one set of conditions.

The documents are a stream; its checkpoint knows which files a batch has. A batch's
results are a folder of their own, written before the list of its documents: that list is
the commit. A batch that is run again writes the same folder again, and documents that
another committed batch has are left out, so that every result is there once, whatever
was killed when.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J


class OtherConditions(ValueError):
    """The folder has results under other conditions; ``fields`` names those that differ."""

    def __init__(self, fields: list[str]):
        super().__init__(f"results under other conditions: {', '.join(fields)}")
        self.fields = fields


class Run:
    """A run in a folder. ``conditions`` (model, thresholds, template, level...) hold for all its results."""

    def __init__(self, spark: SparkSession, folder: str, conditions: dict[str, str | None], key: str = "doc_id"):
        self.spark, self.folder, self.conditions, self.key = spark, folder.rstrip("/"), conditions, key

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, name: str) -> bool:
        path, files = self._files(name)
        return files.exists(path)

    def open(self, fresh: bool = False) -> None:
        """Takes the folder for these conditions: a new one, or one of the same. ``fresh`` throws away what is there."""
        if fresh:
            path, files = self._files("")
            files.delete(path, True)
        names = sorted(self.conditions)
        own = self.spark.createDataFrame([("run", *(self.conditions[n] for n in names))], "id string, " + ", ".join(f"`{n}` string" for n in names))
        if not self._exists("conditions/_SUCCESS"):
            own.write.mode("overwrite").parquet(f"{self.folder}/conditions")
            return
        there = self.spark.read.parquet(f"{self.folder}/conditions")
        for n in set(there.columns) ^ set(own.columns):
            own, there = (df if n in df.columns else df.withColumn(n, F.lit(None).cast("string")) for df in (own, there))
        differ = J.differing_conditions(there.select(*own.columns), own, "id").collect()  # one row at most
        if differ:
            raise OtherConditions(differ[0].fields.split(","))

    def _table(self, name: str) -> DataFrame | None:
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}/batch=*") if self._exists(name) else None

    def done(self) -> DataFrame | None:
        """(key, batch): documents of committed batches. The list is written last and as a whole."""
        return self._table("done")

    def results(self) -> DataFrame | None:
        """Results of committed batches."""
        rows, done = self._table("results"), self.done()
        return None if rows is None or done is None else rows.join(F.broadcast(done.select("batch").distinct()), "batch", "left_semi").drop("batch")  # a row a batch

    def judge(self, docs: DataFrame, evaluate: Callable[[DataFrame], DataFrame], **options):
        """Starts a stream of documents through ``evaluate``; with ``availableNow=True`` (the default) it ends with what is there now."""
        self.open()

        def batch(rows: DataFrame, number: int) -> None:
            before = self.done()
            if before is not None:
                others = before.filter(F.col("batch") != number).select(self.key)
                rows = rows.join(others, self.key, "left_anti")
            rows = rows.dropDuplicates([self.key])
            evaluate(rows).write.mode("overwrite").parquet(f"{self.folder}/results/batch={number}")
            rows.select(self.key).write.mode("overwrite").parquet(f"{self.folder}/done/batch={number}")

        stream = docs.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        return stream.trigger(**(options or {"availableNow": True})).start()
