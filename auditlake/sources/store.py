"""Tables that grow by whole appends, keyed by content: vectors of texts and pages of files are made once.

An append is a folder of its own that Spark commits as a whole; readers see the folders
that are committed (those with a ``_SUCCESS`` file), so that a run that was killed leaves
nothing half-read, and runs beside each other don't overwrite one another: a key that two
of them made has the same row twice, and readers take one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import search as S
from . import files as X


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines share; where none is set, on one machine only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "auditlake-checkpoints")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows from a table that they are written to once, for what reads them many times, as a training does."""
    folder = scratch(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


class Store:
    """A table (key string, more columns) in a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _committed(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/append-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
        return [x.getPath().getParent().toString() for x in found or []]

    def rows(self) -> DataFrame:
        """All committed rows; those of a key that was made more than once are equal."""
        parts = self._committed()
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/append-{uuid.uuid4().hex}")

    def missing(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` whose key the store doesn't have."""
        return keys.join(self.rows().select("key"), "key", "left_anti")

    def compact(self) -> None:
        """One append in place of all, one row a key: for stores of many small appends. No other run may append meanwhile."""
        old = self._committed()
        self.append(self.rows().dropDuplicates(["key"]))
        for p in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


VECTORS = "key string, v array<double>"
PAGES = "key string, page int, text string, error string"


def text_key(text: Column, model: str) -> Column:
    """The key of a text under a model: another model has other vectors."""
    return F.sha2(F.concat(F.lit(model + "\x1f"), text), 256)


def embedder(embed: Callable[[list[str]], np.ndarray], counter=None):
    """Rows (key, text, is_contents) -> (key, v): vectors in Arrow batches; lists of contents get zeros, so that they are never the likest. ``counter`` counts the texts that were embedded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.text.tolist()
            v = np.asarray(embed(texts), float) if texts else np.zeros((0, 0))
            if counter is not None:
                counter.add(len(texts))
            v[b.is_contents.to_numpy(bool)] = 0
            yield pd.DataFrame({"key": b.key, "v": list(v)})

    return run


def vectors(texts: DataFrame, store: Store, model: str, embed: Callable[[list[str]], np.ndarray] = S.vectors_of, text_col: str = "text", counter=None) -> DataFrame:
    """``texts`` with ``v``, the vector of each text: from the store, or made once a text and stored. Null texts are as empty ones."""
    keyed = texts.withColumn("key", text_key(F.coalesce(F.col(text_col), F.lit("")), model))
    known = F.coalesce(F.col(text_col), F.lit(""))
    fresh = store.missing(keyed.select("key", known.alias("text")).dropDuplicates(["key"])).withColumn("is_contents", R.is_contents(F.col("text")))
    made = fresh.mapInPandas(embedder(embed, counter), VECTORS)
    store.append(made)
    return keyed.join(store.rows().dropDuplicates(["key"]), "key").drop("key")


def cached_pages(files: DataFrame, store: Store, readers: dict | None = None) -> DataFrame:
    """files.pages() of a folder's files, by the SHA-1 of their content: a file that was read before isn't read again, whatever its name. Files that couldn't be read are tried anew."""
    fresh = store.missing(files.withColumnRenamed("sha1", "key").dropDuplicates(["key"])).withColumn("doc_id", F.col("key"))
    read = X.pages(fresh, readers).filter("error is null").select(F.col("doc_id").alias("key"), "page", "text", "error")
    store.append(read)
    names = files.withColumnRenamed("sha1", "key")
    have = names.select("doc_id", "key").join(store.rows().dropDuplicates(["key", "page"]), "key").select("doc_id", "page", "text", "error")
    return have.unionByName(X.pages(store.missing(names), readers))  # what is still not there can't be read: its error
