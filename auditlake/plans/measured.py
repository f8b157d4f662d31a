"""Queries on what is measured against a reference, and on the ranker; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as K
from .. import words as L
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators import prompts as Q
from ..operators import report as P
from ..operators import search as S
from ..sources import standins as I
from ..sources import store
from .rules_sql import _E, _reasoned, q

#: A ranker of our own: features as they are, intercept and coefficients.
FROZEN_RANKER = (-1.25, [0.5, 0.25, 2.0, 0.125, -0.25, 0.0, 1.5, 0.75, -0.5, 0.25, 1.0, -0.75, 0.5, 2.0, -0.125])


def ranker(spark: SparkSession, sf_dir: str) -> D.Model:
    intercept, coefficients = FROZEN_RANKER
    return D.Model(D.RANK_FEATURES, ["-", "A"], [0.0] * 15, [1.0] * 15, [[0.0] * 15, coefficients], [0.0, intercept])


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.passage_features(I.passages(spark, sf_dir), I.with_terms(I.criteria(spark, sf_dir)))


def ranker_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the ranker's training rows."""
    return D.ranker_rows(_features(spark, sf_dir), I.reasoned(spark, sf_dir), I.requirements(spark, sf_dir), I.criteria(spark, sf_dir))


def trained_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows scored by the ranker that they train. The training itself is a step of its own that runs when the query is made."""
    rows = store.written(ranker_features(spark, sf_dir))
    return D.ranked(rows, D.train(rows, D.RANK_FEATURES, ["-", "A"]))


def partly_asked(v: DataFrame) -> DataFrame:
    """Verdicts of which some documents have no probabilities, as if their model gave none: those of an odd number, and most of every third one."""
    return v.withColumn("p", F.when((F.col("doc_id") % 2 == 0) & ((F.col("doc_id") % 3 != 0) | (F.col("nr") == 7)), F.col("p")))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of documents without probabilities, by a frozen ranker."""
    v = I.reasoned(spark, sf_dir)
    rows = D.ranking_rows(_features(spark, sf_dir), partly_asked(v), v, I.requirements(spark, sf_dir), I.criteria(spark, sf_dir))
    return D.ranked(rows, ranker(spark, sf_dir))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations for a prompt; what is measured are the documents with a label that are toxic."""
    return V.examples(I.reasoned(spark, sf_dir), I.table(spark, sf_dir, "labels").filter("toxic = 1"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of each criterion with the document's first passage on the example's page and the reason."""
    v, p = I.reasoned(spark, sf_dir), I.passages(spark, sf_dir)
    text = p.groupBy("doc_id", "page").agg(F.min_by("text", F.struct("nr", "rank")).alias("text"))
    return P.reference_examples(v, p).join(text, ["doc_id", "page"]).join(v.select("doc_id", "nr", "reason"), ["doc_id", "nr"]).select("nr", "place", "status", "text", "reason")


#: Another subject than the measured one.
CABINETS = Q.Subject("a switch cabinet", "switch cabinets", None, False)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each verdict, for another subject, the shared part first."""
    return Q.prompts(I.verdicts(spark, sf_dir), I.criteria(spark, sf_dir), I.passages(spark, sf_dir), shown(spark, sf_dir), Q.rules(CABINETS, stricter=True, lists=True), rules_first=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a5_kpi_deltas": lambda spark, sf_dir: E.kpi_deltas(I.verdicts(spark, sf_dir)),
    "a5_flagging": lambda spark, sf_dir: E.flagging(I.verdicts(spark, sf_dir)),
    "a17_thresholds": lambda spark, sf_dir: E.class_thresholds(I.verdicts(spark, sf_dir)),
    "k3_ranker_features": ranker_features,
    "k3_train_ranker": trained_ranker,
    "k6_ranked": ranked,
    "m11_example_blocks": lambda spark, sf_dir: Q.example_blocks(shown(spark, sf_dir)),
    "p21_passage_blocks": lambda spark, sf_dir: Q.passage_blocks(I.passages(spark, sf_dir)),
    "p22_prompts": prompts,
    "v5_set_gap": lambda spark, sf_dir: E.set_gap(I.criteria(spark, sf_dir), I.verdicts(spark, sf_dir).filter("ref = 'T' and p > 0.9")),
    "x14_examples": examples,
}


def oracles(v: str, reference_examples: str) -> dict[str, str]:
    v = f"WITH {v}"
    rs = _reasoned(v)
    rate = lambda a, of: f"CAST(round(CASE WHEN {of} <> 0 THEN round(({a})::DOUBLE / {of}, 6) END * 1000000) AS BIGINT)"
    count = lambda side, c: ", ".join(f"count(*) FILTER ({c} = '{s}') AS {side}{s.lower()}" for s in "ETA")
    rates = lambda s: {"deviation": rate(f"{s}a + 0.5 * {s}t", f"({s}e + {s}t + {s}a)"), "coverage": rate(f"{s}e + {s}t + {s}a", f"{K.CRITERIA}"), "conformity": rate(f"{s}e", f"({s}e + {s}t + {s}a)")}
    four = lambda d: f"sign({d}) * ((abs({d}) + 50) // 100) / 10000.0::DOUBLE"
    deltas = f"""{v}, g AS (SELECT doc_id, count(*) FILTER (ref IS NOT DISTINCT FROM model_status) + {K.CRITERIA} - count(*) AS hits, {count('f', 'model_status')}, {count('w', 'ref')} FROM ms GROUP BY doc_id),
d AS (SELECT doc_id, hits, {", ".join(f"{a} - {b} AS {x}" for x, a, b in ((x, rates('f')[x], rates('w')[x]) for x in ("deviation", "coverage", "conformity")))} FROM g)
SELECT doc_id, hits, {K.CRITERIA} AS total, round(hits::DOUBLE / {K.CRITERIA}, 6) AS match, {", ".join(f"{four(x)} AS d_{x}" for x in ("deviation", "coverage", "conformity"))} FROM d"""
    terms = "CASE title " + " ".join(f"WHEN {q(t)} THEN [{', '.join(q(x) for x in w)}]" for t, w in K.AUDIT_TERMS.items()) + " END"
    spaced = "' ' || regexp_replace(lower(text), '[^0-9a-zäöüß]', ' ', 'g') || ' '"
    feat = f"""cr AS (SELECT *, {terms} AS terms FROM crit),
lx AS (SELECT doc_id, nr, rank, score AS cos, least(len(list_filter(terms, lambda t: CASE WHEN length(t) <= 3 THEN contains({spaced}, ' ' || t || ' ') ELSE contains(lower(text), t) END)) / 3.0::DOUBLE, 1.0) AS lex FROM passages JOIN cr USING (nr)),
sc AS (SELECT *, CAST(round(round({1 - K.LEXICAL_WEIGHT}::DOUBLE * cos + {K.LEXICAL_WEIGHT}::DOUBLE * lex, 6) * 1000000) AS BIGINT) AS m FROM lx),
ag AS (SELECT doc_id, nr, count(*) AS n, sum(m) FILTER (rank <= 1) AS s1, sum(m) FILTER (rank <= 3) AS s3, sum(m) FILTER (rank <= 10) AS s10, max(cos) AS c, max(lex) AS l, count(*) FILTER (lex > 0) AS t, count(*) FILTER (m >= {round(K.STRONG * 1000000)}) AS g FROM sc GROUP BY ALL),
sz AS (SELECT doc_id, count(*) AS sections FROM passages GROUP BY doc_id),
ft AS (SELECT doc_id, nr, CAST(klass = 'mandatory' AS DOUBLE) AS mandatory, CAST(klass = 'regular' AS DOUBLE) AS regular, CAST(klass = 'optional' AS DOUBLE) AS optional, round(n / 30.0::DOUBLE, 6) AS filled, coalesce(s1, 0)::DOUBLE / 1000000 AS first,
  ((2 * coalesce(s3, 0) + 3) // 6)::DOUBLE / 1000000 AS three, ((coalesce(s10, 0) + 5) // 10)::DOUBLE / 1000000 AS ten, c AS max_cos, round(l, 6) AS max_lex, round(t / 30.0::DOUBLE, 6) AS with_terms, round(g / 30.0::DOUBLE, 6) AS strong, round(ln(1.0::DOUBLE + sections), 6) AS log_sections
  FROM ag JOIN sz USING (doc_id) JOIN crit USING (nr)),
fl AS (SELECT nr, CAST(len(list_filter(placeholders, lambda p: regexp_matches(lower(p), {q(L.PLACEHOLDER)}))) > 0 AS DOUBLE) AS open_product, CAST(nr IN (SELECT nr FROM reqs WHERE regexp_matches(lower(text), {q(L.OPEN_WORDING)})) AS DOUBLE) AS open_wording FROM crit)"""
    training = f"""{rs}, {feat}, r AS (SELECT nr, doc_id, ref FROM v WHERE ref IS NOT NULL), s AS (SELECT nr, count(*) AS n, count(*) FILTER (ref = 'A') AS a FROM r GROUP BY nr)
SELECT doc_id, nr, CASE WHEN ref = 'A' THEN 'A' ELSE '-' END AS ref, round(CASE WHEN n > 1 THEN (a - CASE WHEN ref = 'A' THEN 1 ELSE 0 END)::DOUBLE / (n - 1) ELSE 0.0 END, 4) AS share_a, open_product, open_wording,
  {", ".join(D.FEATURES)} FROM r JOIN s USING (nr) JOIN fl USING (nr) JOIN ft USING (doc_id, nr) WHERE ref <> 'N'"""
    intercept, coefficients = FROZEN_RANKER
    z = f"{intercept}::DOUBLE + " + " + ".join(f"({c})::DOUBLE * {x}" for x, c in zip(D.RANK_FEATURES, coefficients))
    scored = f"""{rs}, {feat}, pv AS (SELECT doc_id, nr, status, CASE WHEN doc_id % 2 = 0 AND (doc_id % 3 <> 0 OR nr = 7) THEN p END AS p FROM v),
s AS (SELECT nr, round(count(*) FILTER (ref = 'A')::DOUBLE / count(*), 4) AS share_a FROM v WHERE ref IS NOT NULL GROUP BY nr)
SELECT doc_id, nr, round(1 / (1 + exp(-greatest(-50.0, least(50.0, {z})))), 4) AS rank_value FROM pv JOIN ft USING (doc_id, nr) JOIN fl USING (nr) JOIN (SELECT fl.nr, coalesce(share_a, 0.0) AS share_a FROM fl LEFT JOIN s USING (nr)) sh USING (nr)
WHERE status IN ('E', 'T') AND doc_id NOT IN (SELECT doc_id FROM pv WHERE p IS NOT NULL)"""
    flat = lambda t: f"trim(regexp_replace(regexp_replace({t}, '(?i)[(]?\\bLHD-[0-9,]+[)]?', '', 'g'), '\\s+', ' ', 'g'), ' ')"
    short = lambda t, n: f"CASE WHEN length({flat(t)}) <= {n} THEN {flat(t)} ELSE regexp_replace(left({flat(t)}, {n}), ' [^ ]*$', '') || ' …' END"
    blocks = f"""{rs}, x AS ({reference_examples}), t AS (SELECT doc_id, page, arg_min(text, nr * 100000 + rank) AS text FROM passages GROUP BY ALL),
ex AS (SELECT nr, string_agg('Example ' || place || ', status ' || x.status || chr(10) || 'Passage: ' || {short('t.text', 320)} || chr(10) || 'Why: ' || {short('rs.reason', 220)}, chr(10) ORDER BY place) AS block FROM x JOIN t USING (doc_id, page) JOIN rs USING (doc_id, nr) GROUP BY nr),
pb AS (SELECT doc_id, nr, string_agg('[page ' || page || ', relevance ' || CAST(round(score * 100) AS INTEGER) || ' %]' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS block FROM passages WHERE rank <= {K.CANDIDATES_MAX} GROUP BY ALL)"""
    ruled = "Step 1: does a passage rule on the point for a switch cabinet? If none of the several documents' wording fits, the status is N.|Step 2: does the document contradict the standard or ask for more than it? Then A.|A prescribed make makes the point concrete and is E.|An item of a list rules on its point, an entry of a list of contents never does.|Answer with {\"status\": \"E\", \"reason\": \"...\", \"evidence\": \"S3\"}."
    return {
        "m11_example_blocks": f"{blocks} SELECT nr, block FROM ex",
        "p21_passage_blocks": f"{blocks} SELECT doc_id, nr, block FROM pb",
        "p22_prompts": f"""{blocks} SELECT v.doc_id, v.nr, concat_ws(chr(10) || chr(10), replace({q(ruled)}, '|', chr(10)), 'Criterion ' || v.nr || ' ' || title || ' [' || crit.klass || ']', coalesce(pb.block, '(no passages)'), ex.block) AS prompt
FROM v JOIN crit ON crit.nr = v.nr LEFT JOIN pb ON pb.doc_id = v.doc_id AND pb.nr = v.nr LEFT JOIN ex ON ex.nr = v.nr""",
        "a5_kpi_deltas": deltas,
        "a5_flagging": f"""{v} SELECT count(*) FILTER (ref = 'A') AS ref_a, count(*) FILTER (ref = 'A' AND status = 'A') AS found_a, count(*) FILTER (flagged) AS marked, count(*) FILTER (flagged AND ref = 'A') AS marked_a,
coalesce(round(count(*) FILTER (flagged)::DOUBLE / nullif(count(DISTINCT doc_id), 0), 6), 0.0) AS per_document FROM ms""",
        "a17_thresholds": f"""{v}, d AS (SELECT count(DISTINCT doc_id) AS m FROM v WHERE ref IS NOT NULL), n AS (SELECT m, unnest(range(0, m + 1)) AS n FROM d)
SELECT m, min(n) FILTER (n * 18 >= 14 * m) AS mandatory_from, min(n) FILTER (n * 18 >= 8 * m) AS regular_from FROM n GROUP BY m""",
        "k3_ranker_features": training,
        "k6_ranked": scored,
        "v5_set_gap": f"""{v}, {_E}, r AS (SELECT DISTINCT nr FROM v WHERE ref = 'T' AND p > 0.9)
SELECT (SELECT count(*) FROM crit) AS n_criteria, (SELECT count(*) FROM r) AS n_reference, (SELECT count(*) FROM ((SELECT nr FROM crit EXCEPT SELECT nr FROM r) UNION ALL (SELECT nr FROM r EXCEPT SELECT nr FROM crit))) AS differing""",
        "x14_examples": f"""{rs}, k AS (SELECT doc_id, nr, trim(reason, ' ') AS reason FROM rs WHERE ref = 'A' AND length(trim(reason, ' ')) > 40 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT * FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY nr ORDER BY doc_id, reason) = 1) ORDER BY doc_id, nr LIMIT 3""",
    }
