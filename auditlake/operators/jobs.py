"""Runs as a table: states, listing, resuming, conditions; selection of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K

# What the last event of a run says of it.
STATES = {"signup": "waiting", "click": "running", "view": "running", "purchase": "done", "error": "error"}


def states(events: DataFrame) -> DataFrame:
    """(run, created, last, state): the state of each run: that of its last event; a running one without a pulse for 60 s (180 s before the first) has crashed."""
    end = events.agg(F.max("ts").alias("end"))  # one row
    r = events.groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("created"), F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("e"), F.count("*").alias("n")).crossJoin(F.broadcast(end))
    said = F.coalesce(*(F.when(F.col("e") == k, v) for k, v in STATES.items()), F.lit("error"))
    silent = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    dead = silent >= F.when(F.col("n") > 1, K.SILENCE_S).otherwise(K.START_S)
    return r.select("run", "created", "last", F.when(said.isin("waiting", "running") & dead, "crashed").otherwise(said).alias("state"))


def newest(runs: DataFrame, n: int = 10) -> DataFrame:
    """The newest runs, a report of ``n`` rows."""
    return runs.orderBy(F.desc("created"), "run").limit(n).select("run", "state")


def folder_names(runs: DataFrame) -> DataFrame:
    """(run, folder): a name of its own for each run of a second: the k-th has the suffix _k."""
    base = F.date_format("created", "yyyyMMdd_HHmm")
    w = Window.partitionBy("base").orderBy("created", "run")
    k = F.row_number().over(w)
    return runs.withColumn("base", base).withColumn("k", k).select("run", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string"))).alias("folder"))


def to_do(all_: DataFrame, done: DataFrame, conditions: list[str]) -> DataFrame:
    """Rows of ``all_`` that are not done under the same conditions: null equals null."""
    same = F.lit(True)
    for c in ["doc_id", *conditions]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"d.{c}"))
    return all_.alias("a").join(done.alias("d"), same, "left_anti")


def differing_conditions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, fields): which settings of two manifests differ, null equal to null."""
    cols = [c for c in a.columns if c != key]
    j = a.alias("a").join(b.alias("b"), key)
    f = F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in cols)), lambda x: x.isNotNull())
    return j.select(key, F.array_join(f, ",").alias("fields")).filter("fields <> ''")


def corpus_part(docs: DataFrame, part: str, held_out: list, sample: list) -> DataFrame:
    """Documents of a part of the corpus: all, training (all but the held-out ones), held_out, sample (some of training)."""
    if part not in ("all", "training", "held_out", "sample"):
        raise ValueError("part must be all, training, held_out or sample")
    ids = lambda some: docs.sparkSession.createDataFrame([(x,) for x in some], "doc_id long")
    if part == "all":
        return docs
    if part == "training":
        return docs.join(F.broadcast(ids(held_out)), "doc_id", "left_anti")
    return docs.join(F.broadcast(ids(held_out if part == "held_out" else sample)), "doc_id", "left_semi")
