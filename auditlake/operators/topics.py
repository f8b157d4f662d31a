"""Topics of a template: titles grouped by likeness, chapters for them, and the passages of each document.

Groups are those of agglomerative clustering with complete linkage over all titles. A few thousand
are one task's matrix. More are linked in levels: all joins below a distance come before any join
from it on, so for each of some growing distances the pairs of groups that are nearer than it are
looked for once (every two groups meet in one cell of a grid), and linked until none is left.
Two groups are at least as far apart as their means, so most pairs cost one product of means; and
after a level few pairs lie below the next, whatever the number of titles about.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import words as L
from . import rules as R
from . import search as S

# Likeness of titles of one topic, of a passage that shows one; share of topics that a model must have put into chapters.
TITLE_LIKENESS, PASSAGE_LIKENESS, ASSIGNED = 0.65, 0.55, 0.8
# Characters of a passage, passages of a row, sections after a heading's first and after the likest one, weight of a heading.
PASSAGE_CHARS, PASSAGES, AFTER_HEADING, AFTER_LIKEST, OWN_HEADING = 1200, 8, 2, 1, 2.0
#: Titles of a block of the grid where these make six blocks or less, and titles whose distances are one task's matrix (128 MB); more are linked in levels.
BLOCK, IN_TASK = 2048, 4_000
#: Titles at most: what the counts are made for.
LARGEST = 1 << 31
#: Titles or topics of a side of a cell at most, and rows of its products that are made at once.
SIDE, AT_ONCE = 32_768, 512
#: Growth of the distance from level to level, pairs a title below the first, titles that tell how many there are, and pairs of groups that one task links.
STEP, NEAR, LOOKED, EDGES_IN_TASK = 1.3, 4, 128, 1 << 21
#: Products of members that are looked up at once, and from how many on two groups have a product of their own. What single precision may differ by.
PRODUCTS, ALONE, SLACK = 65_536, 64, 1e-5
#: So many products of a matrix take as long as one that is looked up.
DENSE = 64


def complete_linkage(vectors: np.ndarray, most: float) -> np.ndarray:
    """Groups by agglomerative clustering: the nearest two groups join while their farthest members are nearer than ``most`` (1 - cosine); of equal distances the first pair in order."""
    n = len(vectors)
    v = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-10)
    d = np.round(1 - v @ v.T, 12)
    np.fill_diagonal(d, np.inf)
    own, near = np.arange(n), d.argmin(axis=1) if n else np.zeros(0, int)
    least = d[np.arange(n), near]
    while n > 1:
        i = int(least.argmin())
        j = int(near[i])
        if least[i] >= most:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        own[own == j] = i
        stale = np.flatnonzero((near == i) | (near == j) | (np.arange(n) == i))
        near[stale] = d[stale].argmin(axis=1)
        least[stale], least[j] = d[stale, near[stale]], np.inf
    return np.unique(own, return_inverse=True)[1]


def components(edges: DataFrame, nodes: DataFrame, saved) -> DataFrame:
    """(topic, part): the first topic of the component of each node(topic). Labels go to neighbours and on to their own label, until none changes; ``saved`` cuts lineage."""
    both = saved(edges.union(edges.select("b", "a")).distinct())
    labels = saved(nodes.select("topic", F.col("topic").alias("part")))
    while True:
        seen = both.join(labels, both.b == labels.topic).groupBy("a").agg(F.min("part").alias("seen"))
        step = labels.join(seen, labels.topic == seen.a, "left").select("topic", F.least("part", F.coalesce("seen", "part")).alias("new"), F.col("part").alias("old"))
        jump = step.select(F.col("topic").alias("at"), F.col("new").alias("far"))
        moved = saved(step.join(jump, step.new == jump["at"]).select("topic", F.least("new", "far").alias("part"), (F.least("new", "far") < F.col("old")).alias("moved")))
        labels = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return labels


def _units(vectors) -> np.ndarray:
    """Vectors (bytes of doubles) as rows, divided by their lengths as in complete_linkage()."""
    v = np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)


def _pieces(costs: np.ndarray) -> list[np.ndarray]:
    """Places of the costs in pieces of about ``PRODUCTS`` together."""
    return np.split(np.arange(len(costs)), np.flatnonzero(np.diff(np.cumsum(costs) // PRODUCTS)) + 1) if len(costs) else []


def _farthest(u: np.ndarray, first: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of groups those whose farthest members are nearer than ``below``, with that distance; a group's members are the rows of ``u`` from ``first`` on."""
    least, products = np.zeros(len(i)), size[i] * size[j]
    for k in np.flatnonzero(products >= ALONE):
        a, b = (u[first[g] : first[g] + size[g]] for g in (i[k], j[k]))
        least[k] = min((a[r : r + AT_ONCE] @ b.T).min() for r in range(0, len(a), AT_ONCE))
    few = np.flatnonzero(products < ALONE)
    for at in _pieces(products[few]):
        at = few[at]
        n = products[at]
        new = np.cumsum(n) - n
        k, pair = np.arange(n.sum()) - np.repeat(new, n), np.repeat(at, n)
        wide = size[j[pair]]
        least[at] = np.minimum.reduceat(np.einsum("ij,ij->i", u[first[i[pair]] + k // wide], u[first[j[pair]] + k % wide]), new)
    d = np.round(1 - least, 12)
    return i[d < below], j[d < below], d[d < below]


def _layers(size: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of groups with the largest first: the rows of their first members, of the second members of those that have one, and so on."""
    left = np.searchsorted(-size, -np.arange(size[0]) - 1, side="right")
    return [first[:n] + k for k, n in enumerate(left)]


def _least(rows: np.ndarray, first: np.ndarray, others: np.ndarray, wide: list[int]) -> np.ndarray:
    """The least products of groups, whose members are the rows from ``first`` on, and of others, whose members are layers of these widths."""
    out = np.full((len(first), wide[0]), np.inf, np.float32)
    ends, g = np.r_[first[1:], len(rows)], 0
    for r in range(0, len(rows), AT_ONCE):
        d, at = rows[r : r + AT_ONCE] @ others.T, wide[0]
        best = d[:, : wide[0]]
        for n in wide[1:]:
            np.minimum(best[:, :n], d[:, at : at + n], out=best[:, :n])
            at += n
        while g < len(first) and first[g] < r + AT_ONCE:
            np.minimum(out[g], best[max(first[g] - r, 0) : ends[g] - r].min(axis=0), out=out[g])
            if ends[g] > r + AT_ONCE:
                break
            g += 1
    return out


def near_groups(titles: DataFrame, groups: DataFrame, below: float, blocks: int) -> DataFrame:
    """titles(id, v), groups(id, grp) -> (a, b, d), a < b: all pairs of groups whose farthest members are nearer than ``below``.

    Groups are dealt to blocks as a whole, so that each two meet in one cell.
    """
    mine = F.pmod(F.xxhash64("grp"), F.lit(blocks)).cast("int")
    dealt = groups.join(titles.select("id", "v"), "id").select("grp", "v", mine.alias("mine")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = dealt.select(F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "grp", "v")

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=pdf.groupby("grp").grp.transform("size")).sort_values(["mine", "n", "grp"], ascending=[True, False, True], kind="stable")
        u, grp, size = _units(pdf.v.to_numpy()), pdf.grp.to_numpy(), pdf.n.to_numpy()
        first = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
        size, within, found, short = size[first], key[0] == key[1], [], u.astype(np.float32)
        mean = (np.add.reduceat(u, first, axis=0) / size[:, None]).astype(np.float32)
        cut = len(first) if within else int((pdf.mine.to_numpy()[first] == key[0]).sum())
        base = 0 if within else cut  # the first group of the other side
        others = None
        for k in range(0, cut if base < len(first) else 0, AT_ONCE):
            end, start = min(k + AT_ONCE, cut), k if within else cut
            near = np.flatnonzero(mean[k:end] @ mean[start:].T > np.float32(1 - below - SLACK))
            i, j = k + near // (len(first) - start), start + near % (len(first) - start)
            if within:
                i, j = i[i < j], j[i < j]
            products, rows = size[i] * size[j], short[first[k] : first[end] if end < len(first) else len(u)]
            if np.minimum(products, ALONE + products // ALONE).sum() * DENSE > len(rows) * (len(u) - first[base]):
                if others is None:
                    layers = _layers(size[base:], first[base:])
                    others, wide = short[np.concatenate(layers)], [len(x) for x in layers]
                near = _least(rows, first[k:end] - first[k], others, wide)[i - k, j - base] > 1 - below - SLACK
                i, j = i[near], j[near]
            found.append(_farthest(u, first, size, i, j, below))
        i, j, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        a, b = grp[first[i]], grp[first[j]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": d})

    return cells.groupBy("x", "y").applyInPandas(pairs, "a long, b long, d double")


def joins(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a < b, of groups with their distances, all there are below a level -> (gone, keep): the groups that join others below it, and the first of all they join.

    In a round all pairs of groups that are each other's nearest (of equal distances the first pair in order) join. No other
    join can come between them: the farthest members of joined groups are never nearer than those of either, and their name
    is the first of both. So the groups are those of one join at a time. A joined group has a pair where both had one.
    """
    names = np.unique(np.r_[a, b])
    a, b, to = np.searchsorted(names, a), np.searchsorted(names, b), np.arange(len(names))
    while len(a):
        one, other = np.r_[a, b], np.r_[b, a]
        order = np.lexsort((other, np.r_[d, d], one))
        one, other = one[order], other[order]
        first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
        near = np.full(len(names), -1)
        near[one[first]] = other[first]
        keep = one[first]
        keep = keep[(near[near[keep]] == keep) & (keep < near[keep])]
        name, halves = np.arange(len(names)), np.ones(len(names), int)
        name[near[keep]], halves[keep] = keep, 2
        to, a, b = name[to], *np.sort([name[a], name[b]], axis=0)
        order = np.lexsort((b, a))
        order = order[a[order] != b[order]]
        a, b, d = a[order], b[order], d[order]
        if not len(a):
            break
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        d, n, a, b = np.maximum.reduceat(d, first), np.diff(np.r_[first, len(a)]), a[first], b[first]
        both = n == halves[a] * halves[b]
        a, b, d = a[both], b[both], d[both]
    gone = np.flatnonzero(to != np.arange(len(names)))
    return names[gone], names[to[gone]]


def joined(edges: DataFrame, saved) -> DataFrame:
    """edges(a, b, d) -> (gone, keep), as joins(): where they are more than one task links, rounds of jobs do so until they are few enough."""
    named = None
    while edges.count() > EDGES_IN_TASK:
        both = edges.union(edges.select("b", "a", "d"))
        near = saved(both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("n")).select("a", "n.b"))
        back = near.select(F.col("b").alias("x"), F.col("a").alias("y"))
        pairs = saved(near.filter("a < b").join(back, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select(F.col("b").alias("gone"), F.col("a").alias("keep")))
        name = saved(pairs.select(F.col("gone").alias("old"), "keep").union(pairs.select("keep", "keep")))
        ends = [name.select(F.col("old").alias(x), F.col("keep").alias(f"{x}_new")) for x in "ab"]
        new = {x: F.coalesce(f"{x}_new", x) for x in "ab"}
        halves = F.when(F.col("a_new").isNull(), 1).otherwise(2) * F.when(F.col("b_new").isNull(), 1).otherwise(2)
        e = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.least(*new.values()).alias("a"), F.greatest(*new.values()).alias("b"), "d", halves.alias("halves")).filter("a <> b")
        edges = saved(e.groupBy("a", "b").agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("halves").alias("halves")).filter("n = halves").select("a", "b", "d"))
        named = pairs if named is None else saved(_renamed(named, "keep", pairs).select("gone", "keep").union(pairs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone, keep = joins(pdf.a.to_numpy(), pdf.b.to_numpy(), pdf.d.to_numpy())
        return pd.DataFrame({"gone": gone, "keep": keep})

    rest = edges.groupBy(F.lit(0).alias("all")).applyInPandas(run, "gone long, keep long")
    return rest if named is None else _renamed(named, "keep", rest := saved(rest)).select("gone", "keep").union(rest)


def _renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Groups in a column by names(gone, keep), where they have one."""
    n = names.select(F.col("gone").alias("_gone"), F.col("keep").alias("_keep"))
    return df.join(n, F.col(column) == F.col("_gone"), "left").withColumn(column, F.coalesce("_keep", column)).drop("_gone", "_keep")


def levels(titles: DataFrame, n: int, most: float) -> list[float]:
    """Growing distances up to ``most``: below the first are about ``NEAR`` pairs for each of the ``n`` titles(id, v), as some of them tell. The groups don't depend on it."""
    few = _units([bytes(r.v) for r in titles.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(LOOKED).collect()])
    ends = most * 1.1 ** np.arange(-150.0, 1)

    def counts(batches):
        for pdf in batches:
            if len(pdf):
                d = 1 - _units(pdf.v.to_numpy()) @ few.T
                k = np.bincount(np.searchsorted(ends, d[d < most], side="right"), minlength=len(ends))
                yield pd.DataFrame({"k": np.flatnonzero(k), "n": k[k > 0]})

    found = np.zeros(len(ends))
    for r in titles.select("v").mapInPandas(counts, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # 151 rows at most
        found[r.k] = r.n
    pairs = (found.cumsum() - len(few)) * n / len(few) / 2
    start = ends[max(0, int((pairs <= NEAR * n).sum()) - 1)]
    return [most / STEP**k for k in range(math.ceil(math.log(most / start) / math.log(STEP)), -1, -1)]


def topic_groups(titles: DataFrame, saved, most: float = 1 - TITLE_LIKENESS) -> DataFrame:
    """titles(topic, v) -> (topic, grp): the group of each title, named by its first one; null titles are left out, repeated ones count once.

    Works at once (levels are some jobs each); ``saved`` writes a table and reads it back.
    """
    packed = F.pandas_udf(lambda v: pd.Series([np.asarray(x, float).tobytes() for x in v], dtype=object), "binary")
    once = titles.filter("topic is not null").groupBy("topic").agg(F.min("v").alias("v"))
    t = saved(once.orderBy("topic").select(F.monotonically_increasing_id().alias("id"), "topic", packed("v").alias("v")))  # ids are in the order of the titles
    n = t.count()
    if n > LARGEST:
        raise ValueError(f"{n} titles may hang together within {most}; at most {LARGEST} can be linked")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        g = complete_linkage(np.frombuffer(b"".join(pdf.v)).reshape(len(pdf), -1), most)
        first = pdf.topic.to_numpy()[np.unique(g, return_index=True)[1]]
        return pd.DataFrame({"topic": pdf.topic.to_numpy(), "grp": first[g]})

    if n <= IN_TASK:
        return t.groupBy(F.lit(0).alias("all")).applyInPandas(run, "topic string, grp string")
    groups = t.select("id", F.col("id").alias("grp"))
    blocks = max(-(-n // SIDE), min(6, -(-n // BLOCK)))
    for below in levels(t, n, most):
        edges = saved(near_groups(t, groups, below, blocks))
        if not edges.isEmpty():
            groups = saved(_renamed(groups, "grp", joined(edges, saved)))
    names = t.select(F.col("id").alias("grp"), F.col("topic").alias("name"))
    return groups.join(t.select("id", "topic"), "id").join(names, "grp").select("topic", F.col("name").alias("grp"))


def grouped_topics(headings: DataFrame, groups: DataFrame) -> DataFrame:
    """headings(doc_id, topic, title, position) -> (grp, part, docs, middle, title): a document's k-th heading of a group is in the group's k-th part.

    Parts of generic titles alone are left out; the name is the most frequent title, of equal ones the shortest, then the first.
    """
    k = F.row_number().over(Window.partitionBy("doc_id", "grp").orderBy("position", "title"))
    h = headings.join(groups, "topic").withColumn("part", k)
    names = h.groupBy("grp", "part", "title").agg(F.count("*").alias("n"), F.count_if(~F.array_join(R.words_of(F.col("title")), " ").isin(L.GENERIC_TITLES)).alias("own"))
    best = names.groupBy("grp", "part").agg(F.min_by("title", F.struct((-F.col("n")).alias("m"), F.length("title").alias("l"), "title")).alias("title"), F.sum("own").alias("own")).filter("own > 0").drop("own")
    return h.groupBy("grp", "part").agg(F.count("*").alias("docs"), F.round(F.percentile("position", 0.5), 6).alias("middle")).join(best, ["grp", "part"])


# --------------------------------------------------------------------------- chapters


def nearest_chapters(topics: DataFrame, blocks: int = 16) -> DataFrame:
    """topics(topic, v, chapter) -> (topic, chapter): topics without a chapter get that of the nearest topic with one (dot product to 9 digits, of equal ones the first topic).

    Both kinds are dealt to blocks of at most about ``SIDE`` topics (those with a chapter to ``blocks`` at least) and each two blocks
    meet in a cell, which makes the products of some rows at once; one maximum a topic decides.
    """
    n = topics.agg(F.count("*").alias("all"), F.count("chapter").alias("some")).first()
    x, y = max(1, -(-(n["all"] - n.some) // SIDE)), max(blocks, -(-n.some // SIDE))
    dealt = lambda n: F.pmod(F.xxhash64("topic"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = topics.filter("chapter is not null").withColumn("y", dealt(y)).withColumn("x", every(x))
    open_ = topics.filter("chapter is null").select("topic", "v", dealt(x).alias("x"), every(y).alias("y"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"topic": a.topic[:0], "near": a.topic[:0], "chapter": a.topic[:0], "dot": np.zeros(0)})
        b = b.sort_values("topic", kind="stable")
        va, vb = np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy()).T
        at, dot = np.zeros(len(va), np.int64), np.zeros(len(va))
        for k in range(0, len(va), AT_ONCE):
            dots = np.round(va[k : k + AT_ONCE] @ vb, 9)
            at[k : k + AT_ONCE] = own = dots.argmax(axis=1)
            dot[k : k + AT_ONCE] = dots[np.arange(len(dots)), own]
        return pd.DataFrame({"topic": a.topic.to_numpy(), "near": b.topic.to_numpy()[at], "chapter": b.chapter.to_numpy()[at], "dot": dot})

    each = open_.groupBy("x", "y").cogroup(known.groupBy("x", "y")).applyInPandas(best, "topic string, near string, chapter string, dot double")
    found = each.groupBy("topic").agg(F.min_by("chapter", F.struct((-F.col("dot")).alias("d"), "near")).alias("chapter"))
    return topics.filter("chapter is not null").select("topic", "chapter").unionByName(found)


def lloyd(topics: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """topics(topic, v) -> (topic, chapter): k-means from the topics farthest apart, the first topic first; centres to 9 digits, so that the layout does not matter. k centres are on the driver."""

    def nearest(centres: np.ndarray) -> Column:
        return F.pandas_udf(lambda v: pd.Series(list(map(list, zip(*((d := ((np.stack(v.to_numpy())[:, None] - centres) ** 2).sum(2).round(9)).argmin(1).astype(float), d.min(1)))))) if len(v) else pd.Series([], dtype=object), "array<double>")("v")

    centres = [topics.orderBy("topic").select("v").first().v]
    while len(centres) < k:
        far = topics.withColumn("d", nearest(np.array(centres))).orderBy(F.desc(F.col("d")[1]), "topic").first()
        if far.d[1] == 0:
            break
        centres.append(far.v)
    c = np.array(centres)
    for _ in range(rounds):
        means = topics.withColumn("c", nearest(c)[0].cast("int")).select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.round(F.avg("x"), 9).alias("x")).collect()  # k rows a dimension
        new = c.copy()
        for r in means:
            new[r.c, r.i] = r.x
        if np.array_equal(new, c):
            break
        c = new
    return topics.select("topic", F.format_string("Kapitel %d", nearest(c)[0].cast("int") + 1).alias("chapter"))


def chapters(topics: DataFrame) -> DataFrame:
    """topics(topic, v, chapter: what a model said, or null) -> (topic, chapter): by the nearest topic where four fifths have a chapter, else by k-means (an eighth of the topics, three at least, ten at most)."""
    n = topics.agg(F.count("*").alias("all"), F.count("chapter").alias("some"), F.count_distinct("chapter").alias("kinds")).first()
    if not n.all:
        return topics.select("topic", "chapter")
    if n.kinds >= 2 and n.some >= ASSIGNED * n.all:
        return nearest_chapters(topics)
    return lloyd(topics, max(1, min(n.all, 10, max(3, round(n.all / 8)))))


# --------------------------------------------------------------------------- passages


def normal(text: Column) -> Column:
    return F.array_join(R.words_of(text), " ")


def passages(rows: list[tuple[str, str]], headings: DataFrame, sections: DataFrame) -> DataFrame:
    """(row, doc_id, weight, shown, text): for each row (id, title) of a template the documents that show it, and the passages of the eight likest.

    headings(row, doc_id, title): the documents' headings of a row. sections(doc_id, section_idx, text). A document with a
    heading of the row shows it: the first section, not a list of contents, that has one of its titles, and the two after it.
    Else its likest section, from 0.55 on, and the one after. ``shown`` is false where a heading has no text to show.
    Rows are configuration; scores are made within a section, one maximum a document and row decides.
    """
    w = Window.partitionBy("doc_id").orderBy("section_idx")
    s = sections.withColumns({"one": F.lead("text", 1).over(w), "two": F.lead("text", 2).over(w), "contents": R.is_contents(F.col("text"))})
    s = s.withColumn("cos", S.cosines(F.col("text"), [t for _, t in rows])).withColumn("cos", F.transform("cos", lambda c: F.when(F.col("contents"), 0.0).otherwise(F.round(c, 6))))
    join = lambda *c: F.concat_ws(" ", *c)
    each = s.select("doc_id", "section_idx", "contents", join("text", "one").alias("text"), F.posexplode(F.arrays_zip(F.array(*(F.lit(r) for r, _ in rows)).alias("row"), F.col("cos").alias("cos"))).alias("i", "z")).select("doc_id", "section_idx", "contents", "text", "z.*")
    likest = each.groupBy("row", "doc_id").agg(F.max_by(F.struct("cos", "contents", "text"), F.struct("cos", (-F.col("section_idx")).alias("at"))).alias("b")).select("row", "doc_id", "b.*")
    own = headings.select("row", "doc_id", normal(F.col("title")).alias("title")).distinct()
    at = s.filter(~F.col("contents")).select("doc_id", "section_idx", normal(F.col("text")).alias("norm"), join("text", "one", "two").alias("text"))
    hits = own.filter("title <> ''").join(at, "doc_id").filter(F.contains("norm", F.col("title")))
    first = hits.groupBy("row", "doc_id").agg(F.min_by("text", "section_idx").alias("head"))
    j = likest.join(own.select("row", "doc_id").distinct().withColumn("has", F.lit(True)), ["row", "doc_id"], "left").join(first, ["row", "doc_id"], "left")
    like = F.when((F.col("cos") >= PASSAGE_LIKENESS) & ~F.col("contents"), F.col("text"))
    text = F.substring(F.trim(F.regexp_replace(F.coalesce("head", like), r"\s+", " ")), 1, PASSAGE_CHARS)
    j = j.select("row", "doc_id", F.when(F.col("has"), OWN_HEADING).otherwise(F.col("cos")).alias("weight"), text.alias("text"), "has").filter("text is not null or has")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("text").isNull(), F.desc("weight"), "doc_id"))
    return j.withColumn("place", place).filter((F.col("place") <= PASSAGES) | F.col("text").isNull()).select("row", "doc_id", "weight", F.col("text").isNotNull().alias("shown"), F.coalesce("text", F.lit("")).alias("text"))
