"""Queries on grounding: quotations, second looks, variants; their SQL compares all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grounding as G
from ..operators import rules as R
from ..sources import package
from ..sources import standins as I
from .rules_sql import _E, _reasoned, is_contents, q, sentences
from .rules_sql import words as all_words


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 90 characters of each verdict's best passage, looked for in all later passages of the document."""
    p = I.passages(spark, sf_dir, by_document=True)
    found = G.quoted(p.filter("rank = 1").select("doc_id", F.substring("text", 1, 90).alias("quote")), p.filter("rank > 1"), ["doc_id"], ["nr", "rank"])
    return found.withColumn("share", F.round("share", 6))


def rechecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second look at each verdict with two passages and more: the answer quotes the second passage, now and then with other words."""
    p = I.passages(spark, sf_dir)
    said = F.when(F.col("nr") % 5 == 0, F.concat(F.lit("ganz andere Worte "), F.substring("text", 1, 60))).otherwise(F.substring("text", 1, 200))
    a = p.filter("rank = 2").select("doc_id", "nr", said.alias("zitat"), F.when(F.col("nr") % 3 == 0, "Ja, klar").otherwise("nein").alias("verbindlich"), F.when(F.col("nr") % 2 == 0, "Keine Abweichung erkennbar").otherwise("anderer Wert als im Standard").alias("abweichung"))
    return G.rechecked(a, p)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each verdict's second passage as variants that name the document, against its first passage."""
    p = I.passages(spark, sf_dir)
    s = p.filter("rank = 2").select("doc_id", F.col("nr").alias("row"), F.posexplode(R.split_sentences(F.col("text"))).alias("i", "t"))
    v = s.select("row", (F.col("doc_id") * 100 + F.col("i")).alias("pos"), F.concat("t", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(").")).alias("text"))
    return G.grounded_variants(v, p.filter("rank = 1").select(F.col("nr").alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "f19_quotations": lambda spark, sf_dir: package.send(spark) or quotations(spark, sf_dir),
    "f19_rechecked": lambda spark, sf_dir: package.send(spark) or rechecked(spark, sf_dir),
    "f22_grounded_variants": lambda spark, sf_dir: package.send(spark) or variants(spark, sf_dir),
}


def oracles() -> dict[str, str]:
    words = lambda t: f"regexp_extract_all(lower(regexp_replace({t}, '-\\s*\\n\\s*', '', 'g')), '[0-9a-zäöüß]{{3,}}')"
    fits = f"length(trim(quote, ' ')) >= {G.QUOTE_CHARS} AND len(w) >= {G.QUOTE_WORDS} AND NOT {is_contents('quote')}"
    part = "len(list_filter(a.w, lambda x: list_contains(b.have, x)))::DOUBLE / len(a.w)"
    quotes = f"""WITH {_E}, a AS (SELECT DISTINCT doc_id, left(text, 90) AS quote, {words('left(text, 90)')} AS w FROM passages WHERE rank = 1), b AS (SELECT doc_id, nr, rank, {words('text')} AS have FROM passages WHERE rank > 1),
j AS (SELECT a.doc_id, a.quote, {part} AS share, b.nr, b.rank FROM (SELECT * FROM a WHERE {fits}) a JOIN b USING (doc_id))
SELECT doc_id, quote, round(share, 6) AS share, nr, rank FROM j WHERE share >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, quote ORDER BY share DESC, nr, rank) = 1"""
    flat = lambda t: f"trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' ')"
    second = f"""WITH {_E}, a0 AS (SELECT doc_id, nr, {flat("CASE WHEN nr % 5 = 0 THEN 'ganz andere Worte ' || left(text, 60) ELSE left(text, 200) END")} AS quote FROM passages WHERE rank = 2),
a AS (SELECT *, {words('quote')} AS w FROM a0), b AS (SELECT doc_id, nr, rank, page, {words('text')} AS have FROM passages),
f AS (SELECT a.doc_id, a.nr, b.page FROM (SELECT * FROM a WHERE {fits}) a JOIN b USING (doc_id, nr) WHERE {part} >= 0.8 QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.nr ORDER BY {part} DESC, b.rank) = 1),
k AS (SELECT a.doc_id, a.nr, page, CASE WHEN length(quote) <= 160 THEN quote ELSE rtrim(left(quote, 157), ' ') || ' …' END AS short FROM a LEFT JOIN f USING (doc_id, nr))
SELECT doc_id, nr, CASE WHEN page IS NULL THEN 'N' WHEN nr % 2 <> 0 THEN 'A' WHEN nr % 3 = 0 THEN 'E' ELSE 'T' END AS status,
       CASE WHEN page IS NULL THEN '' WHEN nr % 2 <> 0 THEN 'anderer Wert als im Standard (Stelle: „' || short || '“)' ELSE 'Geregelt: „' || short || '“' END AS reason, CASE WHEN page IS NULL THEN '' ELSE 'S' || page END AS evidence FROM k"""
    nums = lambda t: f"list_distinct(list_transform(regexp_extract_all({t}, '[0-9]+(?:[.,][0-9]+)*'), lambda x: replace(replace(x, '.', ''), ',', '')))"
    stands = f"""WITH {_E}, s0 AS (SELECT doc_id, nr, {sentences('text')} AS s FROM passages WHERE rank = 2), s AS (SELECT doc_id, nr, s[i] AS t, doc_id * 100 + i - 1 AS pos FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s0)),
j AS (SELECT s.*, lower(p.text) AS source, list_filter({nums('t')}, lambda x: length(x) >= 2) AS n, list_distinct(regexp_extract_all(lower(t), {q('[a-z0-9_äöüß]{4,}')})) AS w FROM s JOIN passages p ON p.doc_id = s.doc_id AND p.nr = s.nr AND p.rank = 1)
SELECT nr AS row, pos, t || ' (' || doc_id || ').' AS text, doc_id::VARCHAR AS doc_id FROM j
WHERE CASE WHEN len(n) > 0 THEN list_has_all({nums('source')}, n) ELSE len(w) > 0 AND 2 * len(list_filter(w, lambda x: contains(source, x))) >= len(w) END"""
    return {"f19_quotations": quotes, "f19_rechecked": second, "f22_grounded_variants": stands}


def readers(v: str, known: dict[str, str]) -> dict[str, str]:
    """SQL of what a reader is told of a verdict and of the hints of two routes, from the SQL of flags, echoes and hints."""
    rs, failed = _reasoned(v), "trim(coalesce(cause, ''), ' ') <> ''"
    cases = f"""{rs}, fl AS ({known["k11_flagged"]}), ec AS ({known["f20_echoes"]}), pn AS (SELECT doc_id, nr, count(*) AS n FROM passages GROUP BY ALL)
SELECT fl.doc_id, fl.nr, CASE WHEN {failed} AND n IS NULL THEN 'nothing found' WHEN {failed} THEN 'call failed' WHEN fl.status_model IS NOT NULL THEN 'flagged afterwards' WHEN coalesce(lifted, false) THEN 'lifted by statistics'
  WHEN rs.ref IS NULL AND coalesce(fl.status, 'N') <> 'E' THEN 'changed by the evidence rule' WHEN echo IS NOT NULL THEN 'reason partly from the prompt' WHEN coalesce(fl.status, 'N') = 'N' AND n > 0 THEN 'passages found, not counted' ELSE 'regular' END AS label
FROM fl LEFT JOIN rs USING (doc_id, nr) LEFT JOIN pn USING (doc_id, nr) LEFT JOIN ec USING (doc_id, nr)"""
    hints = f"""{rs}, h AS (SELECT k.doc_id, k.nr, k.page, k.nr || ' ' || k.words AS text, CASE WHEN rs.p < 0.5 THEN 'read' ELSE 'noted' END AS origin FROM ({known["k13_reason_hints"]}) k JOIN rs USING (doc_id, nr))
SELECT doc_id, nr, page, text, origin FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, array_to_string({all_words('text')}, ' ') ORDER BY nr, page, text) = 1"""
    return {"k14_cases": cases, "u6_hints_of_both": hints}
