"""Queries on the import of templates, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import words as L
from ..operators import importing as M
from ..sources import standins as I
from .rules_sql import _E, _filled, _one_of, q

LISTS = ("docs", "required", "variants", "placeholders", "terms")


def joined(c: DataFrame) -> DataFrame:
    return c.withColumns({x: F.array_join(x, "|") for x in LISTS})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s13_template_import": lambda spark, sf_dir: joined(M.criteria(I.blocks(spark, sf_dir))),
    "s13_import_warnings": lambda spark, sf_dir: M.warnings(M.criteria(I.blocks(spark, sf_dir))),
    "s13_corpus_sizes": lambda spark, sf_dir: M.corpus_sizes(I.blocks(spark, sf_dir)),
    "s13_metadata": lambda spark, sf_dir: M.metadata(I.blocks(spark, sf_dir)),
}


def oracles() -> dict[str, str]:
    blank = "[\\s ]"
    strip = lambda t: f"regexp_replace({t}, {q(f'^{blank}+|{blank}+$')}, '', 'g')"
    some = lambda t: f"list_filter(list_transform({t}, lambda x: {strip('x')}), lambda x: x <> '')"
    found = q(f"belegt{blank}+in{blank}+([0-9]+){blank}+von{blank}+([0-9]+)")
    has = lambda c: f"regexp_matches(lower({c}), {found})"
    carried = "OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    captions = " ".join(f"WHEN lower(rtrim(text, ':')) = {q(words)} THEN {q(name)}" for name, words in L.CAPTIONS.items())
    base = f"""WITH {_E}, b0 AS (SELECT doc_id, i, {_filled(_one_of(I.BLOCKS, 'event_id * 5 % 967'), a='(i // 9 + 1)', b='(i % 9 + 1)', k='k')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) - 1 AS i FROM ev)),
b1 AS (SELECT doc_id, i, left(t, 1) AS kind, CASE WHEN left(t, 1) <> 'T' THEN {strip('substr(t, 2)')} ELSE '' END AS text, CASE WHEN left(t, 1) = 'T' THEN {some("string_split(substr(t, 2), '|')")} ELSE [] END AS cells FROM b0),
b2 AS (SELECT *, kind = 'H' AND regexp_matches(text, {q(f'^[0-9]+([.][0-9]+)?{blank}+[^{blank[1:-1]}]')}) AS numbered, kind = 'H' AND NOT regexp_matches(text, {q(f'^[0-9]+([.][0-9]+)([.][0-9]+)+[.]?{blank}+[^{blank[1:-1]}]')}) AS ends FROM b1 WHERE kind = 'T' OR text <> ''),
b3 AS (SELECT *, CASE WHEN numbered THEN regexp_extract(text, '^[0-9.]+') END AS number, CASE WHEN numbered THEN {strip(f"regexp_replace(text, {q('^[0-9.]+')}, '')")} END AS title,
  CASE WHEN ends THEN '' WHEN kind = 'T' THEN NULL {captions} WHEN starts_with(lower(text), 'abgleichbegriffe:') THEN 'terms' END AS caption FROM b2),
b4 AS (SELECT *, coalesce(last_value(CASE WHEN numbered THEN i WHEN ends THEN -1 END IGNORE NULLS) {carried}, -1) AS start, last_value(caption IGNORE NULLS) {carried} AS block,
  last_value(CASE WHEN numbered AND NOT contains(number, '.') THEN number END IGNORE NULLS) {carried} AS cn, last_value(CASE WHEN numbered AND NOT contains(number, '.') THEN title END IGNORE NULLS) {carried} AS ct FROM b3)"""
    klass = f"list_filter([{', '.join(map(q, L.CLASSES))}], lambda k: lower(k) = lower(cells[1]))[1]"
    lines = lambda name: f"coalesce(list(text ORDER BY i) FILTER (number IS NULL AND kind <> 'T' AND caption IS NULL AND block = '{name}'), [])"
    commas = lambda c: f"string_split(regexp_replace({c}, {q(f',([{blank[1:-1]}A-Za-zÄÖÜ])')}, chr(10) || '\\1', 'g'), chr(10))"
    imported = f"""{base}, hd AS (SELECT doc_id, start, {klass} AS klass, coalesce(TRY_CAST(regexp_extract(lower(list_filter(cells, lambda c: {has('c')})[1]), {found}, 1) AS INTEGER), 0) AS n_in,
  {some(f"flatten(list_transform(list_filter(cells[2:], lambda c: NOT {has('c')}), lambda c: {commas('c')}))")} AS docs
  FROM b4 WHERE start >= 0 AND kind = 'T' AND len(cells) >= 2 AND {klass} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY i) = 1),
g AS (SELECT doc_id, start, max(number) AS number, max(title) AS title, arg_min(cn, i) AS cn, arg_min(ct, i) AS ct, {lines('required')} AS required, {lines('variants')} AS variants, {lines('placeholders')} AS open, arg_max(text, i) FILTER (caption = 'terms') AS t FROM b4 WHERE start >= 0 GROUP BY ALL),
im AS (SELECT doc_id, start AS pos, number AS nr, title, coalesce(cn, number) AS chapter_nr, coalesce(ct, title) AS chapter, klass, n_in, docs, required, variants, {some(f"flatten(list_transform(open, lambda t: regexp_extract_all(t, {q(L.BRACKETED)}, 1)))")} AS placeholders,
  CASE WHEN t IS NULL THEN [] ELSE {some(f"regexp_split_to_array(regexp_replace(t, '^[^:]*:', ''), '[·•;]')")} END AS terms FROM g JOIN hd USING (doc_id, start))"""
    text = lambda x: f"coalesce(array_to_string({x}, '|'), '') AS {x}"
    return {
        "s13_template_import": f"{imported} SELECT doc_id, pos, nr, title, chapter_nr, chapter, klass, n_in, {', '.join(map(text, LISTS))} FROM im",
        "s13_import_warnings": f"""{imported} SELECT doc_id, pos, nr, 'no requirements' AS rule FROM im WHERE len(required) = 0 UNION ALL SELECT doc_id, pos, nr, 'no terms' FROM im WHERE len(terms) = 0
UNION ALL SELECT doc_id, pos, nr, 'number of documents' FROM im WHERE len(docs) > 0 AND n_in > 0 AND len(docs) <> n_in""",
        "s13_corpus_sizes": f"""{base}, m AS (SELECT doc_id, CAST(regexp_extract(lower(c), {found}, 2) AS INTEGER) AS corpus FROM (SELECT doc_id, unnest(cells) AS c FROM b4 WHERE start >= 0 AND kind = 'T') WHERE {has('c')})
SELECT doc_id, corpus FROM (SELECT doc_id, corpus, count(*) AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, corpus) = 1""",
        "s13_metadata": f"""{base}, f AS (SELECT doc_id, min(i) AS first FROM b4 WHERE numbered GROUP BY doc_id), k AS (SELECT doc_id, i, list_filter(cells, lambda x, j: j = 1 OR x <> cells[j - 1]) AS c FROM b4 LEFT JOIN f USING (doc_id) WHERE kind = 'T' AND (first IS NULL OR i < first))
SELECT doc_id, i, c[1] AS key, c[2] AS value FROM k WHERE len(c) >= 2""",
    }
