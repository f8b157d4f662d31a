"""Key figures against a reference, the ranker and its gate, examples, thresholds and guards, against plain Python."""

import math

import numpy as np
import pytest

from auditlake.operators import decide as D
from auditlake.operators import evaluate as E
from auditlake.operators import evidence as V
from auditlake.operators import search as S

VERDICT = "doc_id long, nr int, klass string, status string, before string, ref string"


def test_kpi_deltas(spark):
    rows = [
        (1, 1, "mandatory", "A", "E", "E"),  # flagged: counts as E
        (1, 2, "mandatory", "T", None, "A"),
        (1, 3, "regular", None, None, None),  # neither has one: a hit
        (2, 1, "mandatory", "N", None, "E"),  # nothing regulated is found
        (3, 1, None, "E", None, "E"),
    ]
    got = {r.doc_id: r for r in E.kpi_deltas(spark.createDataFrame(rows, VERDICT), 4).collect()}
    one = got[1]
    assert (one.hits, one.total, one.match) == (3, 4, 0.75)  # E, the pair of nulls and the criterion without a row
    assert (one.d_deviation, one.d_coverage, one.d_conformity) == (round(0.25 - 0.5, 4), 0.0, 0.0)
    assert (got[2].d_deviation, got[2].d_coverage, got[2].d_conformity) == (None, -0.25, None)
    assert (got[3].hits, got[3].d_deviation) == (4, 0.0)
    assert E.kpi_deltas(spark.createDataFrame([], VERDICT), 4).count() == 0


def test_flagging(spark):
    rows = [(1, 1, "k", "A", "E", "A"), (1, 2, "k", "A", "N", "E"), (1, 3, "k", "A", None, "A"), (2, 1, "k", "T", None, "A"), (2, 2, "k", None, None, None)]
    assert tuple(E.flagging(spark.createDataFrame(rows, VERDICT)).first()) == (3, 2, 2, 1, 1.0)
    assert tuple(E.flagging(spark.createDataFrame([], VERDICT)).first()) == (0, 0, 0, 0, 0.0)


@pytest.mark.parametrize("m", [0, 1, 2, 7, 18, 19, 100])
def test_class_thresholds(spark, m):
    v = spark.createDataFrame([(d, 1, "k", "E", None, "E") for d in range(m)], VERDICT)
    want = (m, *(next((n for n in range(m + 1) if n * 18 >= k * m), None) if m else None for k in (14, 8)))
    assert tuple(E.class_thresholds(v).first()) == want


def test_check_reference(spark):
    some = lambda *n: spark.createDataFrame([(x,) for x in n], "nr int")
    E.check_reference(some(1, 2, 2, None), some(2, 1))
    E.check_reference(some(), some())
    with pytest.raises(ValueError, match="2 against 3 criteria, 3 numbers differ"):
        E.check_reference(some(1, 2, 3), some(2, 5))
    with pytest.raises(ValueError, match="training"):
        E.check_reference(some(1), some(1), "training")


def test_examples(spark):
    long = "x" * 41
    rows = [(1, 5, "A", long), (2, 5, "A", long), (2, 7, "A", " " + "y" * 40 + " "), (3, 4, "A", long), (3, 4, "A", long), (3, 6, "E", long), (4, 8, "A", None), (5, 2, "A", long), (6, 1, "A", long), (7, 9, "A", long), (7, 9, "A", "a" + long)]
    v = spark.createDataFrame(rows, "doc_id long, nr int, ref string, reason string")
    measured = spark.createDataFrame([(1,), (5,), (None,), (5,)], "doc_id long")
    assert [tuple(r) for r in V.examples(v, measured).collect()] == [(2, 5, long), (3, 4, long), (6, 1, long)]
    assert [tuple(r)[:2] for r in V.examples(v, measured, n=9).collect()] == [(2, 5), (3, 4), (6, 1), (7, 9)]
    assert V.examples(v, measured, n=9).collect()[-1].reason == "a" + long
    assert V.examples(v.limit(0), measured).count() == 0


PASSAGES = "doc_id long, nr int, rank int, text string, score double"
CRITERIA = "nr int, klass string, title string, placeholders array<string>, terms array<string>"


def test_passage_features(spark):
    p = [(1, 1, 1, "Druck 7 bar und Kosten", 0.5), (1, 1, 2, None, 0.4), (1, 1, 3, "barren", 0.3), (1, 2, 1, "x", 0.9), (2, 3, 1, "Druck", 0.31)]
    c = [(1, "regular", "t", [], ["druck", "bar"]), (2, None, "t", [], None)]
    got = {(r.doc_id, r.nr): r.asDict() for r in S.passage_features(spark.createDataFrame(p, PASSAGES), spark.createDataFrame(c, CRITERIA)).collect()}
    lex = [2 / 3, 0, 0]
    scores = [round(0.65 * s + 0.35 * x, 6) for s, x in zip((0.5, 0.4, 0.3), lex)]
    one = got[1, 1]
    assert (one["mandatory"], one["regular"], one["optional"]) == (0.0, 1.0, 0.0)
    assert one["first"] == scores[0] and one["three"] == pytest.approx(sum(scores) / 3, abs=1e-6) and one["ten"] == pytest.approx(sum(scores) / 10, abs=1e-6)
    assert (one["max_cos"], one["max_lex"], one["filled"], one["with_terms"], one["strong"]) == (0.5, round(2 / 3, 6), 0.1, round(1 / 30, 6), round(1 / 30, 6))
    assert one["log_sections"] == round(math.log1p(4), 6)
    assert got[1, 2]["max_lex"] == 0.0 and got[1, 2]["first"] == round(0.65 * 0.9, 6)
    assert got[2, 3]["regular"] == 0.0 and got[2, 3]["max_lex"] == 0.0  # not in the catalogue
    assert S.passage_features(spark.createDataFrame([], PASSAGES), spark.createDataFrame(c, CRITERIA)).count() == 0


def _ranker_parts(spark):
    c = spark.createDataFrame([(n, "regular", "t", ["Typ"] if n % 2 else [], ["druck"]) for n in range(6)], CRITERIA)
    r = spark.createDataFrame([(1, 1, "required", "nach Freigabe"), (2, 2, "required", "fest")], "nr int, pos long, field string, text string")
    return c, r


def test_ranking_rows_only_without_probabilities(spark):
    c, r = _ranker_parts(spark)
    p = spark.createDataFrame([(d, n, 1, "Druck", 0.5) for d in (1, 2, 3) for n in range(4)], PASSAGES)
    v = spark.createDataFrame([(1, 0, "E", 0.2), (1, 1, "T", None), (2, 0, "E", None), (2, 1, "A", None), (2, 2, "T", None), (2, 5, "T", None), (3, 3, None, None), (3, 1, "N", None)], "doc_id long, nr int, status string, p double")
    known = spark.createDataFrame([(0, "A"), (0, "E"), (0, "N"), (0, None), (3, "A")], "nr int, ref string")
    got = {(x.doc_id, x.nr): (x.share_a, x.open_product, x.open_wording) for x in D.ranking_rows(S.passage_features(p, c), v, known, r, c).collect()}
    # 1 has a probability, 2/1 is an A, 2/5 has no candidate, 3 has no E or T
    assert got == {(2, 0): (0.3333, 0.0, 0.0), (2, 2): (0.0, 0.0, 0.0)}


def test_trained_ranker_equals_newton(spark):
    c, r = _ranker_parts(spark)
    rng = np.random.default_rng(5)
    pairs = [(d, n) for d in range(40) for n in range(6)]
    p = spark.createDataFrame([(d, n, k, "Druck" if rng.random() < 0.5 else "x", round(0.3 + 0.7 * rng.random(), 3)) for d, n in pairs for k in range(1, 1 + rng.integers(1, 5))], PASSAGES)
    v = spark.createDataFrame([(d, n, "ETAN"[rng.integers(4)]) for d, n in pairs], "doc_id long, nr int, ref string")
    rows = D.ranker_rows(S.passage_features(p, c), v, r, c).cache()
    got = {(x.doc_id, x.nr): x.rank_value for x in D.ranked(rows, D.train(rows, D.RANK_FEATURES, ["-", "A"])).collect()}
    known = rows.collect()
    assert set(got) == {(x.doc_id, x.nr) for x in v.collect() if x.ref != "N"}
    x, y = np.array([[row[f] for f in D.RANK_FEATURES] for row in known]), np.array([row.ref == "A" for row in known], float)
    own = {}
    for row in v.collect():
        own.setdefault(row.nr, []).append((row.doc_id, row.ref))
    for row in known:  # the own document is left out of the share
        rest = [s for d, s in own[row.nr] if d != row.doc_id]
        assert row.share_a == round(rest.count("A") / len(rest) + 1e-12, 4)
    scale = x.std(0)
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / np.where(scale == 0, 1, scale)]
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1]) / 0.5
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + ridge, z.T @ (q - y) + ridge @ w)
    want = 1 / (1 + np.exp(-z @ w))
    assert max(abs(got[row.doc_id, row.nr] - q) for row, q in zip(known, want)) < 2e-4
