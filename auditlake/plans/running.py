"""Queries on runs: streams of events and documents, and what is made once and kept. Each is held against the SQL of the same question on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as K
from ..operators import evidence as V
from ..operators import rules as R
from ..operators import text as T
from ..sources import package, store
from ..sources.standins import table
from ..streaming import heartbeat, resume


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def liveness_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes of runs, found by a stream of all events with a timer a run."""
    package.send(spark)
    events, folder = _stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), store.scratch(spark)
    with heartbeat.timers(spark):
        q = heartbeat.state_changes(events).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("user_id long, at timestamp, state string").parquet(f"{folder}/changes")


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all documents that go to the archive, by a run that can be stopped and go on."""
    package.send(spark)
    run = resume.Run(spark, store.scratch(spark), {"least": str(K.ARCHIVE_MIN_CHARS)})
    run.judge(_stream(spark, sf_dir, "documents"), V.archive).awaitTermination()
    return run.results()


def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with vectors from a store, read in a second round that embeds nothing: which are zero, and how long the others are."""
    package.send(spark)
    sections, kept = T.sections(table(spark, sf_dir, "documents")), store.Store(spark, store.scratch(spark), store.VECTORS)
    for _ in range(2):
        v = store.vectors(sections, kept, "pairs")
    length = F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4)
    return v.select("doc_id", "section_idx", R.is_contents(F.col("text")).alias("is_contents"), length.alias("length"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "liveness_changes": lambda spark, sf_dir: V.state_changes(table(spark, sf_dir, "events")),
    "liveness_stream": liveness_stream,
    "m4_resumed_run": resumed_run,
    "s8_cached_vectors": cached_vectors,
}


def oracles(archive: str, sections: Callable[[str], str], is_contents: Callable[[str], str]) -> dict[str, str]:
    changes = f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events), m AS (SELECT max(us) // 1000 * 1000 AS mark FROM e),
n AS (SELECT user_id, us, mark, row_number() OVER w AS n, lead(us) OVER w AS next FROM e, m WHERE us < mark WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
d AS (SELECT *, us + CASE WHEN n > 1 THEN {K.SILENCE_S} ELSE {K.START_S} END * 1000000 AS stop FROM n),
l AS (SELECT *, lag(stop) OVER (PARTITION BY user_id ORDER BY n) AS was FROM d)
SELECT user_id, make_timestamp(us) AS at, 'running' AS state FROM l WHERE was IS NULL OR was <= us UNION ALL
SELECT user_id, make_timestamp(stop), 'dead' FROM l WHERE stop <= coalesce(next, mark)"""
    vectors = f"WITH {sections('documents')} SELECT doc_id, section_idx, {is_contents('text')} AS is_contents, CASE WHEN {is_contents('text')} OR length(text) < 2 THEN 0.0 ELSE 1.0 END AS length FROM sec"
    return {"liveness_changes": changes, "liveness_stream": changes, "m4_resumed_run": archive, "s8_cached_vectors": vectors}
