"""Streams end up with what the batch queries say, late events and restarts included."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from auditlake.operators import evidence
from auditlake.operators import text as T
from auditlake.sources import store
from auditlake.streaming import heartbeat, resume

SF = "/root/testdata/sf0.001"


def test_sessions(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*").selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts")
    q = heartbeat.sessions(stream, late="0 seconds").writeStream.format("memory").queryName("sessions_of_runs").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    streamed = {(r.user_id, r.n) for r in spark.table("sessions_of_runs").collect()}
    batch = {r.user_id: (r.sessions, r.longest) for r in evidence.sessions(events).collect()}
    assert streamed
    for user, n in streamed:
        assert n <= batch[user][1]


def lives(events, mark, silence=60, start=180):
    """State changes in plain Python, seconds."""
    out = []
    for user in {u for u, _ in events}:
        n, last, dead = 0, 0, True
        for t in sorted(t for u, t in events if u == user and t < mark):
            end = last + (silence if n > 1 else start)
            if n and not dead and end <= t:
                out.append((user, end, "dead"))
                dead = True
            if dead:
                out.append((user, t, "running"))
            n, last, dead = n + 1, t, False
        end = last + (silence if n > 1 else start)
        if n and not dead and end <= mark:
            out.append((user, end, "dead"))
    return sorted(out)


def test_liveness_with_late_events(spark, tmp_path):
    """Files of events in disorder; those within the allowance take their place, one that comes too late is left out."""
    r = random.Random(3)
    events = [(u, t) for u in range(6) for t in r.sample(range(0, 2400, 10), 25)] + [(7, 100), (7, 280), (8, 100), (8, 279), (9, 100), (9, 100), (9, 160), (10, 2399)]
    order = sorted(events, key=lambda e: e[1] + r.randint(0, 110))  # at most 110 s late
    table = lambda rows: spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"), F.monotonically_increasing_id().alias("event_id"))
    for i in range(0, len(order), 30):
        table(order[i : i + 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table([(0, 5)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # hours too late
    stream = spark.readStream.schema("user_id long, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    with heartbeat.timers(spark):
        q = heartbeat.state_changes(stream, "120 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = sorted((x.user_id, int(x.s), x.state) for x in spark.read.parquet(str(tmp_path / "out")).select("user_id", F.unix_seconds("at").alias("s"), "state").collect())
    mark = max(t for _, t in events) - 120
    assert set(got) ^ set(lives(events, mark)) == set() and len(got) == len(lives(events, mark)), [x for x in lives(events, mark) if x[0] == 1][-6:]
    batch = evidence.state_changes(table(events), 120).select("user_id", F.unix_seconds("at").alias("s"), "state")
    assert sorted((x.user_id, x.s, x.state) for x in batch.collect()) == got
    assert {"running", "dead"} == {x[2] for x in got}


def test_run_goes_on_after_a_stop(spark, tmp_path):
    """Stopped in the middle of a batch, restarted: each document's result once; a file that comes twice adds nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    for i in range(6):
        docs.filter(F.col("doc_id") % 6 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sections = lambda d: T.sections(d).select("doc_id", "section_idx")
    folder, batches = str(tmp_path / "run"), []

    def breaks(d):
        batches.append(1)
        if len(batches) == 3:
            sections(d).write.mode("overwrite").parquet(folder + "/results/batch=2")  # killed after its results, before its commit
            raise RuntimeError("killed")
        return sections(d)

    run = resume.Run(spark, folder, {"model": "m", "least": "0.3"})
    q = run.judge(stream(), breaks)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(200)
    half = run.results()
    assert 0 < half.select("doc_id").distinct().count() < docs.count()
    assert run.done().select("batch").distinct().count() == 2
    for again in (0, 1):
        run = resume.Run(spark, folder, {"model": "m", "least": "0.3"})
        assert run.judge(stream(), sections).awaitTermination(200)
        want = sorted(map(tuple, sections(docs).collect()))
        assert sorted(map(tuple, run.results().collect())) == want
        docs.filter(F.col("doc_id") % 6 == 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(resume.OtherConditions) as e:
        resume.Run(spark, folder, {"model": "other", "least": "0.3", "level": "high"}).judge(stream(), sections)
    assert sorted(e.value.fields) == ["level", "model"]
    fresh = resume.Run(spark, folder, {"model": "other", "least": "0.3"})
    fresh.open(fresh=True)
    assert fresh.results() is None


def test_vectors_are_made_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Die Standzeit"), (2, "Die Standzeit"), (3, None), (4, ""), (5, "1 A ..... 3"), (6, "ä" * 100_000)], "i int, text string")
    s, made = store.Store(spark, str(tmp_path / "v"), store.VECTORS), spark.sparkContext.accumulator(0)
    first = {r.i: r.v for r in store.vectors(docs, s, "pairs", counter=made).collect()}
    assert made.value == 4 and first[1] == first[2] and not any(first[5]) and abs(sum(x * x for x in first[1]) - 1) < 1e-6
    assert {r.i: r.v for r in store.vectors(docs, s, "pairs", counter=made).collect()} == first
    assert made.value == 4
    (tmp_path / "v" / f"append-{uuid.uuid4().hex}").mkdir()  # an append that was killed
    more = docs.unionByName(spark.createDataFrame([(7, "neu")], docs.schema))
    assert store.vectors(more, s, "pairs", counter=made).count() == 7 and made.value == 5
    assert store.vectors(docs, s, "other", counter=made).count() == 6 and made.value == 9
    s.compact()
    assert s.rows().count() == s.rows().select("key").distinct().count() == 9
    assert store.vectors(docs.limit(0), s, "pairs", counter=made).count() == 0 and made.value == 9


def test_pages_are_read_once(spark, tmp_path):
    from auditlake.sources import files

    folder, reads = tmp_path / "in", spark.sparkContext.accumulator(0)
    folder.mkdir()
    (folder / "a.txt").write_text("eins\fzwei")
    (folder / "b.txt").write_text("eins\fzwei")
    (folder / "c.docx").write_bytes(b"broken")

    def reader(b):
        reads.add(1)
        return b.decode().split("\f")

    s = store.Store(spark, str(tmp_path / "p"), store.PAGES)
    want = [("a", 1, "eins"), ("a", 2, "zwei"), ("b", 1, "eins"), ("b", 2, "zwei"), ("c", None, None)]
    for _ in range(2):
        got = store.cached_pages(files.folder(spark, str(folder)), s, {"txt": reader}).collect()
        assert sorted(((r.doc_id, r.page, r.text) for r in got), key=str) == sorted(want, key=str)
        assert [r.error.split(":")[0] for r in got if r.error] == ["BadZipFile"]
        assert reads.value == 1


def test_liveness_of_many_runs_asks_for_no_state_one_by_one(spark, tmp_path):
    """State comes with the rows; waiting events are kept for the next batch, and ends at the very watermark count."""
    events = [(u, t) for u in range(300) for t in (u % 50, 100 + u % 7, 100 + u % 7, 400)] + [(300, 0), (301, 220), (302, 340), (302, 280), (303, 399), (304, 400)]
    events = [(u, t + 1000) for u, t in events]
    spark.createDataFrame(events, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    with heartbeat.timers(spark):
        changes = heartbeat.state_changes(stream, "1000 seconds")
        assert "TransformWithState" not in changes._jdf.queryExecution().analyzed().toString()
        q = heartbeat.state_changes(stream, "0 seconds", 60, 180).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = sorted((x.user_id, int(x.s), x.state) for x in spark.read.parquet(str(tmp_path / "out")).select("user_id", F.unix_seconds("at").alias("s"), "state").collect())
    assert got == lives(events, 1400) and (301, 1400, "dead") in got and (302, 1400, "dead") in got
