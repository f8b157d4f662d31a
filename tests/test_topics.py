"""Topics, chapters and passages against plain Python over all titles at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import search as S
from auditlake.operators import topics as P
from auditlake.plans import building

SF = "/root/testdata/sf0.001"


def plain_linkage(v, most):
    """The nearest two groups again and again, all distances looked at each time."""
    v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)
    d = np.round(1 - v @ v.T, 12)
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        far = {(a, b): max(d[i, j] for i in groups[a] for j in groups[b]) for a in range(len(groups)) for b in range(a + 1, len(groups))}
        a, b = min(far, key=lambda k: (far[k], groups[k[0]][0], groups[k[1]][0]))
        if far[a, b] >= most:
            break
        groups[a] += groups.pop(b)
        groups[a].sort()
        groups.sort()
    return groups


@pytest.mark.parametrize("n,most", [(0, 0.3), (1, 0.3), (2, 2.5), (40, 0.05), (60, 0.35), (60, 1.2)])
def test_linkage_of_a_component(n, most):
    v = np.random.default_rng(n).normal(size=(n, 4)).round(1)
    g = P.complete_linkage(v, most)
    assert sorted(np.flatnonzero(g == k).tolist() for k in set(g)) == sorted(plain_linkage(v, most))


@pytest.mark.parametrize("block", [7, 2048])
def test_groups_equal_linkage_over_all_titles(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    titles = [r.topic for r in building.first_lines(spark, SF).collect()][:70] + ["", "a", "kerne", "kernzüge", "kern", "e" * 5000]
    titles = sorted(set(titles))
    rows = [(t,) for t in [*titles, titles[3], titles[3], None]]
    df = spark.createDataFrame(rows, "topic string").withColumn("v", S.embedded("topic"))
    got = {r.topic: r.grp for r in P.topic_groups(df.repartition(3), building.saving(spark), 0.2).collect()}
    want = {titles[i]: titles[g[0]] for g in plain_linkage(S.vectors_of(titles), 0.2) for i in g}
    assert got == want
    assert 1 < len(set(want.values())) < len(titles)
    assert P.topic_groups(df.limit(0), building.saving(spark)).collect() == []


def test_a_component_beyond_a_task_says_so(spark, monkeypatch):
    monkeypatch.setattr(P, "LARGEST", 2)
    df = spark.createDataFrame([("aaaa",), ("aaaaa",), ("aaaaaa",)], "topic string").withColumn("v", S.embedded("topic"))
    with pytest.raises(ValueError, match="hang together"):
        P.topic_groups(df, building.saving(spark))


@pytest.mark.parametrize("n,most,digits", [(70, 0.35, 1), (70, 1.2, 0), (40, 2.5, 3)])
def test_linkage_in_rounds(spark, monkeypatch, n, most, digits):
    """Components beyond a task's matrix, with many equal distances: the same groups as one join at a time."""
    monkeypatch.setattr(P, "IN_TASK", 3)
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "AT_ONCE", 5)
    v = np.random.default_rng(n).normal(size=(n, 4)).round(digits)
    titles = [f"t{i:03d}" for i in range(n)]
    df = spark.createDataFrame(list(zip(titles, v.tolist())), "topic string, v array<double>")
    got = {r.topic: r.grp for r in P.topic_groups(df.repartition(3), building.saving(spark), most).collect()}
    assert got == {titles[i]: titles[g[0]] for g in plain_linkage(v, most) for i in g}


@pytest.mark.parametrize("edges,dense", [(1 << 21, 64), (4, 1 << 40), (1 << 21, 0)])
def test_linkage_in_levels(spark, monkeypatch, edges, dense):
    """Many titles near each other: few tables however many joins, where one task links the pairs; the same groups where rounds of jobs do, and where members meet in matrices or one by one."""
    for name, value in {"IN_TASK": 3, "BLOCK": 64, "AT_ONCE": 7, "EDGES_IN_TASK": edges, "DENSE": dense, "ALONE": 9, "PRODUCTS": 50, "LOOKED": 20}.items():
        monkeypatch.setattr(P, name, value, raising=False)
    v = np.abs(np.random.default_rng(8).normal(size=(150, 6))).round(1)
    v[:12] = v[0]
    titles = [f"t{i:03d}" for i in range(len(v))]
    df = spark.createDataFrame(list(zip(titles, v.tolist())), "topic string, v array<double>")
    write, written = building.saving(spark), []

    def saved(rows):
        written.append(rows)
        return write(rows)

    got = {r.topic: r.grp for r in P.topic_groups(df.repartition(3), saved).collect()}
    want = {titles[i]: titles[g[0]] for g in plain_linkage(v, 1 - P.TITLE_LIKENESS) for i in g}
    assert got == want
    assert edges < 150 or len(written) <= 30


def test_farthest_members_of_groups(monkeypatch):
    """Least products by layers of members, in pieces that cut groups: as of all members."""
    r = np.random.default_rng(2)
    u, size = r.normal(size=(40, 5)).astype(np.float32), np.array([17, 9, 9, 3, 1, 1])
    first = np.cumsum(size) - size
    layers = P._layers(size, first)
    want = [[(u[a : a + m] @ u[b : b + n].T).min() for b, n in zip(first, size)] for a, m in zip(first, size)]
    for at_once in (1, 4, 9, 100):
        monkeypatch.setattr(P, "AT_ONCE", at_once)
        assert np.allclose(P._least(u, first, u[np.concatenate(layers)], [len(x) for x in layers]), want, atol=1e-5)


def test_nearest_chapter_in_cells(spark, monkeypatch):
    """Both sides in several blocks and products of a few rows at once, with equal products: the same chapters as over all at once."""
    v = np.random.default_rng(3).integers(-2, 3, size=(90, 3)).astype(float)
    rows = [(f"t{i:03d}", v[i].tolist(), f"c{i}" if i % 3 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "topic string, v array<double>, chapter string")
    known = [i for i in range(90) if i % 3]
    want = {f"t{i:03d}": f"c{i if i % 3 else min(known, key=lambda k: (-(v[i] @ v[k]), k))}" for i in range(90)}
    monkeypatch.setattr(P, "SIDE", 7)
    monkeypatch.setattr(P, "AT_ONCE", 2)
    assert {r.topic: r.chapter for r in P.nearest_chapters(df, 2).collect()} == want


def test_components_of_a_chain(spark):
    names = [f"n{i:03d}" for i in range(64)]
    random.Random(1).shuffle(names)
    edges = spark.createDataFrame([(names[i], names[i + 1]) for i in range(39)] + [(names[i], names[i + 1]) for i in range(41, 63)], "a string, b string")
    got = {r.topic: r.part for r in P.components(edges, spark.createDataFrame([(n,) for n in names], "topic string"), building.saving(spark)).collect()}
    assert set(got.values()) == {min(names[:40]), min(names[40:41]), min(names[41:])}
    assert all(got[n] == min(part) for part in (names[:40], names[40:41], names[41:]) for n in part)


def test_repeats_of_a_document_are_parts(spark):
    h = [(1, "kerne", "Kerne", 0.1), (1, "kernzug", "Kernzug", 0.4), (2, "kerne", "Kerne", 0.2), (3, "kernzug", "Kernzug", 0.3), (3, "anhang", "Anhang", 0.9), (None, "kerne", "Kerne", 0.5)]
    headings = spark.createDataFrame(h, "doc_id int, topic string, title string, position double")
    groups = spark.createDataFrame([("kerne", "kerne"), ("kernzug", "kerne"), ("anhang", "anhang")], "topic string, grp string")
    got = sorted(map(tuple, P.grouped_topics(headings, groups).select("grp", "part", "docs", "middle", "title").collect()))
    assert got == [("kerne", 1, 4, 0.25, "Kerne"), ("kerne", 2, 1, 0.4, "Kernzug")]


def test_chapters_by_the_nearest(spark):
    r = np.random.default_rng(4)
    rows = [(f"t{i:02d}", r.normal(size=5).round(2).tolist(), None if i % 9 == 0 else f"K{i % 4}") for i in range(40)] + [("t98", [1.0] * 5, None), ("t99", [0.0] * 5, None), ("t97", [9.0] * 5, "K1"), ("t96", [9.0] * 5, "K2")]
    df = spark.createDataFrame(rows, "topic string, v array<double>, chapter string")
    known = [x for x in rows if x[2]]
    want = {t: c or min(known, key=lambda x: (-round(float(np.dot(v, x[1])), 9), x[0]))[2] for t, v, c in rows}
    assert want["t98"] == "K2"
    for n in (1, 4):
        assert {x.topic: x.chapter for x in P.chapters(df.repartition(n)).collect()} == want
    few = df.withColumn("chapter", F.when(F.col("topic") < "t30", F.col("chapter")))
    one, other = ({x.topic: x.chapter for x in P.chapters(few.repartition(n)).collect()} for n in (1, 5))
    assert one == other and len(set(one.values())) == 6 and set(one) == set(want)  # 44 topics: 44 / 8, rounded up at the half
    assert P.chapters(df.limit(0)).collect() == []


def test_passages(spark):
    long = "Die Auswerfer sind gehärtet und geschliffen auszuführen. " * 40
    sections = [(1, 0, "Inhaltsverzeichnis\n1 Auswerfer ..... 3"), (1, 1, "1 Auswerfer und Platten"), (1, 2, "zwei"), (1, 3, "drei"), (1, 4, "vier"), (2, 0, "ganz anderes xyz"), (2, 1, long), (2, 2, "nach"), (3, 0, "qqqq wwww"), (4, 0, "ohne Treffer"), (None, 0, long)]
    df = spark.createDataFrame(sections, "doc_id int, section_idx int, text string")
    heads = spark.createDataFrame([("T1", 1, "Auswerfer"), ("T1", 4, "Auswerfer")], "row string, doc_id int, title string")
    got = {r.doc_id: r for r in P.passages([("T1", "Auswerfer")], heads, df).collect()}
    assert got[1].text == "1 Auswerfer und Platten zwei drei" and got[1].weight == 2.0
    assert 3 not in got and (got[4].weight, got[4].shown, got[4].text) == (2.0, False, "")
    if 2 in got:
        assert len(got[2].text) == 1200 and got[2].weight >= 0.55
    many = spark.createDataFrame([(i, 0, "Auswerfer") for i in range(20)], df.schema)
    assert sorted(r.doc_id for r in P.passages([("T1", "Auswerfer")], heads.limit(0), many).collect()) == list(range(8))
    assert P.passages([("T1", "x")], heads, df.limit(0)).collect() == []
