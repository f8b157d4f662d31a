"""Searches: what a task holds is bounded, results equal plain Python."""

import numpy as np
import pandas as pd

from auditlake.operators import search as S


def test_products_in_pieces():
    """However many queries there are, a task's matrix is bounded."""
    b = pd.DataFrame({"x": range(10_000)})
    for queries in (0, 1, 6_000, 3 * S.CELLS):
        pieces = list(S._pieces([b, b.iloc[:0]], queries))
        assert pd.concat(pieces).x.tolist() == list(range(10_000))
        assert max(len(p) for p in pieces) * queries <= max(S.CELLS, queries)


def test_statement_references(spark):
    texts = ["Kosten der Nacharbeit trägt der Lieferant", "Die KOSTEN sind hoch", "Druck und bar", "", None, "Kosten der Nacharbeit trägt der Lieferant"]
    s = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts * 3)], "nr int, pos long, text string").repartition(3)
    c = [(0, "Kosten", ["kosten", "bar"]), (1, "Druck", ["bar"]), (2, "Ohne", []), (3, "Nichts", None)]
    got = sorted(map(tuple, S.statement_references(s, spark.createDataFrame(c, "nr int, title string, terms array<string>"), 0.1, 2).collect()))
    want = []
    for nr, title, terms in c[:3]:
        long_, q = [t for t in terms if len(t) >= 4], np.array(S.vector(S.query_text(title, terms)))
        all_ = [(-round(float(np.dot(S.vector(t), q)), 9), i, i % 3) for i, t in enumerate(texts * 3) if i % 3 != nr and (not long_ or any(x in (t or "").lower() for x in long_))]
        want += [(nr, k, other, i, round(-c_, 6)) for k, (c_, i, other) in enumerate(sorted(x for x in all_ if -x[0] >= 0.1)[:2], 1)]
    assert got == sorted(want) and len(got) > 3


def test_statements_meet_criteria_in_batches(spark):
    """All pairs of statements and criteria were rows of a join before."""
    s, c = spark.createDataFrame([(0, 1, "x")], "nr int, pos long, text string"), spark.createDataFrame([(1, "x", ["wort"])], "nr int, title string, terms array<string>")
    assert "Join" not in S.statement_references(s, c)._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_in_slices(monkeypatch):
    """A batch of texts is never laid out whole."""
    seen, inner = [], S._vectors
    monkeypatch.setattr(S, "CHARS", 50)
    monkeypatch.setattr(S, "_vectors", lambda texts: seen.append(sum(len(t or "") for t in texts)) or inner(texts))
    texts = ["abc" * i for i in range(12)] + [None, "", "x"]
    assert np.array_equal(S.vectors_of(texts), inner(texts)) and max(seen) < 50 + 33 and len(seen) > 2
    assert S.vectors_of([]).shape == (0, S.DIM)
