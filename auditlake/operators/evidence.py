"""Evidence from texts, learned decisions, template tables, liveness of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K
from ..functions.columns import literal_score, padded_words
from . import rules as R
from . import text as T

#: Names and words of license lines, which the documents have where requirement texts name vendors.
NAMES, PRESCRIBES, LEAVES_OPEN = "gnu|apache|mozilla|creative commons|copyright", "licen[sc]ed|license|version|rights|under", "or equivalent|or similar|alternative"


def binding_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence): a known name and a prescribing word and no word that leaves it open."""
    low = F.lower("sentence")
    return T.sentences(docs).filter(low.rlike(NAMES) & low.rlike(PRESCRIBES) & ~low.rlike(LEAVES_OPEN))


def sentence_assignment(docs: DataFrame) -> DataFrame:
    """(doc_id, nr, pos, score): every sentence goes to the criterion it fits best, the first of equal ones; each criterion keeps its first sentence.

    The criteria are a literal array, so no join and no pairs: the best is taken within the row.
    """
    # As the output of a generator, both forms are made once for a sentence and not once for a term.
    s = T.sentences(docs).select("doc_id", "pos", F.explode(F.array(F.struct(F.lower("sentence").alias("low"), padded_words(F.col("sentence")).alias("pad")))).alias("x")).select("doc_id", "pos", "x.*")
    fits = F.array(*(F.struct((-literal_score(F.col("low"), F.col("pad"), t)).alias("minus"), F.lit(nr).alias("nr")) for nr, _, t in K.CATALOGUE))
    best = s.select("doc_id", "pos", F.array_min(fits).alias("b")).filter("b.minus < 0")
    first = best.groupBy("doc_id", F.col("b.nr").alias("nr")).agg(F.min(F.struct("pos", "b.minus")).alias("f"))
    return first.select("doc_id", "nr", "f.pos", F.round(-F.col("f.minus"), 6).alias("score"))


def hard_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_facts, facts): names in capitals and long numbers of a text but everyday ones, each once whatever its case, in order of their first place."""
    return docs.select("doc_id", R.facts_of(F.col("text")).alias("f")).filter(F.size("f") > 0).select("doc_id", F.size("f").alias("n_facts"), F.array_join("f", " ").alias("facts"))


def value_ranges(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, low, high, n): the range of the numbers in good documents of a language."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    v = T.unit_values(docs).filter("value is not null").join(good, "doc_id", "left_semi").join(docs.select("doc_id", "lang"), "doc_id")
    return v.groupBy("lang").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def out_of_range(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, raw, value): the first number of a document outside the range of its language. There is one range a language."""
    r = value_ranges(docs, labels)
    v = T.unit_values(docs).filter("value is not null").join(docs.select("doc_id", "lang"), "doc_id").join(F.broadcast(r), "lang").filter("value < low or value > high")
    return v.groupBy("doc_id").agg(F.min_by(F.struct("raw", "value"), "pos").alias("v")).select("doc_id", "v.raw", "v.value")


def json_answers(events: DataFrame) -> DataFrame:
    """(k, n): the number in the first balanced object of each event's answer, and how many events have it; null for answers that can't be read."""
    got = F.from_json(R.first_object(F.concat(F.lit("answer: "), F.coalesce("props", F.lit("none")), F.lit(" as asked }"))), "k int")
    return events.select(got["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def common_titles(docs: DataFrame) -> DataFrame:
    """(source, title, n): the most frequent first line of a source's documents, of equal ones the shortest, then the first."""
    t = docs.filter("text is not null").select("source", F.substring_index("text", "\n", 1).alias("title")).groupBy("source", "title").agg(F.count("*").alias("n"))
    best = t.groupBy("source").agg(F.min_by(F.struct("title", "n"), F.struct((-F.col("n")).alias("m"), F.length("title").alias("l"), "title")).alias("b"))
    return best.select("source", "b.title", "b.n")


def topic_means(vectors: DataFrame) -> DataFrame:
    """(label, dim, mean): mean vector of a topic, by dimension: partial sums, no vector is gathered."""
    v = vectors.select("label", F.posexplode("embedding").alias("dim", "x"))
    return v.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def archive(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, short, junk): how many sections of a document go to the archive, and why not the rest: too short, or a list of contents."""
    s = T.sections(docs).withColumn("short", F.length(F.trim("text")) < K.ARCHIVE_MIN_CHARS).withColumn("contents", R.is_contents(F.col("text")))
    return s.groupBy("doc_id").agg(F.count_if(~F.col("short") & ~F.col("contents")).alias("kept"), F.count_if("short").alias("short"), F.count_if(~F.col("short") & F.col("contents")).alias("contents"))


def slots(docs: DataFrame) -> DataFrame:
    """(doc_id, sections, slots): candidates that a document of that size may have."""
    return T.sections(docs).groupBy("doc_id").agg(F.count("*").alias("sections")).withColumn("slots", F.greatest(F.lit(K.CANDIDATES), F.least(F.lit(K.CANDIDATES_MAX), F.floor(F.col("sections") / K.SECTIONS_A_SLOT))).cast("int"))


def regulated_by(v: DataFrame) -> DataFrame:
    """(nr, doc_id, n): the documents that regulate a criterion, a row each, with their number; no criterion's documents are gathered."""
    r = v.filter("ref in ('E', 'T', 'A')").select("nr", "doc_id")
    return r.join(F.broadcast(r.groupBy("nr").agg(F.count("*").alias("n"))), "nr").select("nr", "doc_id", "n")


def examples(v: DataFrame, measured: DataFrame, n: int = 3, least: int = 40) -> DataFrame:
    """(doc_id, nr, reason): deviations for a prompt, the first in order of documents, one a criterion at most.

    The reference says A, the reason is longer than ``least`` characters, and the document isn't one of measured(doc_id):
    a prompt must not show the solution of what is measured. Null and empty reasons never count; of repeated rows the least reason does.
    """
    known = v.filter("ref = 'A'").select("doc_id", "nr", F.trim("reason").alias("reason")).filter(F.length("reason") > least)
    one = known.join(measured.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("nr").agg(F.min(F.struct("doc_id", "reason")).alias("x"))
    return one.select("x.doc_id", "nr", "x.reason").orderBy("doc_id", "nr").limit(n)


def renumbered(v: DataFrame) -> DataFrame:
    """(doc_id, nr, chapter, position): chapters by their first criterion, criteria counted within them."""
    first = Window.partitionBy("doc_id", "klass")
    w = v.select("doc_id", "nr", "klass").withColumn("start", F.min("nr").over(first))
    return w.select("doc_id", "nr", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("start")).alias("chapter"), F.row_number().over(first.orderBy("nr")).alias("position"))


def liveness(events: DataFrame) -> DataFrame:
    """(user_id, silent_s, state): state of runs at the end of all events. A pulse is an event after the first one, which starts the run.

    A run is dead after 60 s without a pulse, and before its first pulse after 180 s.
    """
    end = events.agg(F.max("ts").alias("end"))  # one row
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n")).crossJoin(F.broadcast(end))
    s = F.floor((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1_000_000).cast("long")
    return last.select("user_id", s.alias("silent_s"), F.when(s < F.when(F.col("n") > 1, K.SILENCE_S).otherwise(K.START_S), "running").otherwise("dead").alias("state"))


def state_changes(events: DataFrame, late_s: int = 0) -> DataFrame:
    """(user_id, at, state): every change of a run between running and dead up to ``late_s`` before the last event, as the stream of the same events finds them."""
    us = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    mark = us.agg(((F.floor(F.max("us") / 1000) - late_s * 1000) * 1000).cast("long").alias("mark"))  # one row
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = us.crossJoin(F.broadcast(mark)).filter("us < mark").withColumn("n", F.row_number().over(w))
    e = e.withColumn("end", F.col("us") + F.when(F.col("n") > 1, K.SILENCE_S).otherwise(K.START_S) * 1_000_000)
    e = e.withColumns({"next": F.lead("us").over(w), "was": F.lag("end").over(w)})
    dead = e.filter(F.coalesce(F.col("end") <= F.col("next"), F.col("end") <= F.col("mark"))).select("user_id", F.col("end").alias("us"), F.lit("dead").alias("state"))
    running = e.filter("was is null or was <= us").select("user_id", "us", F.lit("running").alias("state"))
    return running.union(dead).select("user_id", F.timestamp_micros("us").alias("at"), "state")


def sessions(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """(user_id, sessions, longest): runs of events without a gap above ``gap_s`` seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = events.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("new", F.when(F.col("s") - F.lag("s").over(w) <= gap_s * 1_000_000, 0).otherwise(1)).withColumn("k", F.sum("new").over(w))
    return step.groupBy("user_id", "k").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
