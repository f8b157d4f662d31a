"""Near-duplicate detection with BagMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles (words: runs of bytes that are
not ASCII white space, A-Z as a-z). The likeness of two texts is the weighted
Jaccard index of their multisets, sum of minima over sum of maxima.

*Signature.* The weight of a shingle is its count; the discretisation of weights
is 1, 2, 3, ... Each shingle has one Poisson process of rate 1 for each unit of
weight. The units are held in a hierarchy of intervals (0,1], (1,2], (2,4],
(4,8], ...; the process of an interval has the summed rate of its units, its
points come in ascending order, and each point draws the unit it falls on and
the component of the signature it belongs to. A shingle of weight w keeps the
points that fall on its first w units, so that it costs the logarithm of w
intervals and not w processes. A component is the smallest point of all
shingles; two texts agree in a component with the probability of their weighted
Jaccard index. Points beyond the value at which all components are surely filled
are never drawn.

*Groups.* Texts with equal words (by 128 bits of a hash) are one node. Nodes that agree
in a whole band share a bucket. The centre of a bucket is its least node; since keys of
nodes are hashes, the buckets of a node mostly have the same few centres. A node is first
compared with its likeliest centre, by sketches of the signatures (one byte a component)
and then on the exact multisets, then with the centres of groups that are still apart.
The nodes of a bucket that are not in the group of most of its nodes are held against all
its nodes of other groups, in blocks: every pair whose sketches are close enough is
compared exactly, the likeliest first, unless its groups have met in the block already.
The pairs of a block stay within its row and are never listed; what leaves a block are
links of groups, at most one less than the groups it has. A pair of several buckets is
compared in the first. A text is sent once to each comparison with a centre or block, a
centre once for each ``SIDE`` nodes. Groups are the connected components of the links
found, by contraction: each round only what is left of the graph is joined.

A pair at the threshold has no common band with probability 5e-5, and its sketches
fall below ``SKETCH_LEAST`` with probability 5e-5; both fall quickly above it.

Defined cases: null and empty texts, and texts of white space, have no shingles;
all of them are copies of each other. A text of one to four words has one
shingle. Repeated rows are copies. Null ids are ids like others, after them. Very long
texts are compared whole. Columns besides id and text aren't read, whatever their names.
Ties go to the smallest id, then node. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Least share of equal sketch bytes of a pair that is compared.
SKETCH_LEAST = 0.66
#: Nodes of one side of a block, and bytes of their texts.
SIDE, SIDE_BYTES = 512, 4 << 20


def _multiset(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts, ordered by text."""
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return s[at], doc[at], np.diff(np.append(at, len(s)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(s: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) BagMinHash values of the weighted sets given as (shingle, text, weight); infinite for empty sets."""
    sig = np.full(n_docs * m, np.inf)
    total = np.bincount(doc, weight, n_docs)
    todo = total > 0
    reach = np.log(m) + 6.0
    while todo.any():
        limit = np.where(todo, m / np.maximum(total, 1) * reach, 0)
        level, low, high = 0, 0, 1
        live = np.flatnonzero(todo[doc])
        while len(live):
            rate, key, d, w = float(high - low), C.mix64(s[live] + np.uint64((level * 0x632BE59BD9B4E019) & C._M64)), doc[live], weight[live]
            x = np.zeros(len(live))
            while len(key):
                key = C.mix64(key + np.uint64(0x9E3779B97F4A7C15))
                x = x - np.log(_uniform(key)) / rate
                go = x <= limit[d]
                key, d, w, x = key[go], d[go], w[go], x[go]
                where = C.mix64(key ^ np.uint64(0xA0761D6478BD642F))
                part = ((where >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                hit = slice(None)
                if high > w.min(initial=high):
                    unit = low + (((where & np.uint64(0xFFFFFFFF)) * np.uint64(high - low)) >> np.uint64(32)).astype(np.int64)
                    hit = unit < w
                np.minimum.at(sig, d[hit] * m + part[hit].astype(np.int64), x[hit])
            level, low, high = level + 1, high, high * 2
            live = live[weight[live] > low]
        todo &= np.isinf(sig.reshape(n_docs, m)).any(axis=1)
        reach *= 2
    return sig.reshape(n_docs, m)


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """(n, n_bands) hashes of the bands of signatures."""
    bits = sig.view(np.uint64).reshape(len(sig), n_bands, rows)
    h = np.zeros((len(sig), n_bands), np.uint64)
    h += np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        h = C.mix64(h.ravel() ^ C.mix64(bits[:, :, j].ravel())).reshape(h.shape)
    return h


def _sketch(sig: np.ndarray) -> np.ndarray:
    """A byte of each component: equal components have equal bytes, others by chance of 1 in 256."""
    return (C.mix64(sig.view(np.uint64).ravel()) >> np.uint64(56)).astype(np.uint8).reshape(sig.shape)


def text_key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _keys(texts: pa.Array) -> pa.Array:
    return pa.array([text_key(t.as_buffer().to_pybytes().lower().split() if t.is_valid else []) for t in texts.cast(pa.large_binary())], pa.binary())


def _sign(n_bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            texts = b.column("text")
            _, _, _, h, per = C.words_of(texts)
            s, doc = C.shingles(h, per, k)
            s, doc, w = _multiset(s, doc)
            sig = signatures(s, doc, w, len(per), n_bands * rows)
            out = bands(sig, n_bands, rows)
            full = np.bincount(doc, minlength=len(per)) > 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), _keys(texts), C.lists(C.signed(out[full].ravel()), np.where(full, n_bands, 0), pa.int64()), pa.array([r.tobytes() for r in _sketch(sig)], pa.binary()), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())],
                names=["doc_id", "node", "bands", "sketch", "size"],
            )

    return run


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two (sorted values, counts)."""
    both = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][both[1]], b[1][both[2]]).sum()
    return float(low) / max(1, a[1].sum() + b[1].sum() - low)


def _sets(texts: pa.Array, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    _, _, _, h, per = C.words_of(texts)
    s, doc, w = _multiset(*C.shingles(h, per, k))
    edge = np.searchsorted(doc, np.arange(len(per) + 1))
    return [(s[x:y], w[x:y]) for x, y in zip(edge, edge[1:])]


def _share(a, b):
    """Share of equal bytes of the sketches of pairs (binary columns)."""
    import pandas as pd

    x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _with_centre(k: int, threshold: float):
    """Links of nodes to the centre whose row stands before theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own, size = None, None, 0
        for b in C.blocks(batches):
            found = []
            for node, role, to, (s, w) in zip(b.column("node").to_pylist(), b.column("role").to_pylist(), b.column("centre").to_pylist(), _sets(b.column("text"), k)):
                if role == 0:
                    centre, own, size = node, (s, w), w.sum()
                elif centre == to and min(size, w.sum()) >= threshold * max(size, w.sum()) and jaccard(own, (s, w)) >= threshold:
                    found.append((node, to))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], names=["a", "b"])

    return run


def _candidates(m: int, n_bands: int):
    """For each block of ``rest`` and ``nodes``: the nodes and groups of all pairs to compare, and the pairs as places in these, the likeliest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(nodes: pa.Array):
            x = nodes.values.flatten()
            sketch = np.frombuffer(b"".join(x[2].to_pylist()), np.uint8).reshape(-1, m)
            return np.array(x[0].to_pylist(), object), np.array(x[1].to_pylist(), object), sketch, x[3].flatten().to_numpy().reshape(-1, n_bands)

        for batch in batches:
            for band, r, c, most, centre, rest, nodes in zip(*(batch.column(k) for k in ("band", "r", "c", "most", "centre", "rest", "nodes"))):
                (a, own, sa, ba), (b, other, sb, bb) = side(rest), side(nodes)
                centre, most, found = centre.as_py(), most.as_py(), []
                outside = (b != centre) & (other == most)
                for i in np.flatnonzero(a != centre):
                    # Pairs with the centre have been compared; a pair that both sides list is taken once.
                    ok = np.flatnonzero((other != own[i]) & (outside | ((b != centre) & (b > a[i]))))
                    share = (sb[ok] == sa[i]).mean(axis=1)
                    ok, share = ok[share >= SKETCH_LEAST], share[share >= SKETCH_LEAST]
                    here = ba[i][(bb[ok] == ba[i]).argmax(axis=1)] == band.as_py()
                    found.append((np.full(here.sum(), i), ok[here], share[here]))
                if not sum(len(x[0]) for x in found):
                    continue
                i, j, share = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((j, i, -share))
                (u, i), (v, j) = np.unique(i[order], return_inverse=True), np.unique(j[order], return_inverse=True)
                column = lambda *x: pa.array([np.concatenate(x).tolist()], pa.list_(pa.binary()))
                pairs = np.stack([i, j + len(u)]).astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([band.as_py()]), pa.array([r.as_py()], pa.int32()), pa.array([c.as_py()], pa.int32()), column(a[u], b[v]), column(own[u], other[v]), pa.array([pairs], pa.binary())], names=["band", "r", "c", "nodes", "labels", "pairs"])

    return run


def _links(k: int, threshold: float):
    """Links of the groups of a block that have a pair of texts alike, until they have met."""

    def run(unit: pa.Table, texts: pa.Table) -> pa.Table:
        sets = dict(zip(texts.column("node").to_pylist(), (x for b in texts.select(["text"]).to_batches() for y in C.blocks(iter([b])) for x in _sets(y.column("text"), k))))
        nodes, labels = (unit.column(c)[0].as_py() for c in ("nodes", "labels"))
        sets = [sets[n] for n in nodes]
        sizes = [int(w.sum()) for _, w in sets]
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        out = []
        for i, j in np.frombuffer(unit.column("pairs")[0].as_py(), "<u2").reshape(2, -1).T.tolist():
            x, y = top(labels[i]), top(labels[j])
            if x != y and min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]) and jaccard(sets[i], sets[j]) >= threshold:
                up[y] = x
                out.append((labels[i], labels[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of links(a, b): a node of its connected component that is the same for all.

    Each round every node points to its least neighbour or itself, and the graph of
    the nodes pointed to goes on; keys are hashes, so a share of all nodes goes each
    round. Ties, loops and repeated links change nothing; no links give an empty result.
    """
    edges = C.saved(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = C.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "up")
        rounds.append(up)
        left, right = up.select(F.col("node").alias("a"), F.col("label").alias("x")), up.select(F.col("node").alias("b"), F.col("label").alias("y"))
        met = edges.join(left, "a").join(right, "b").filter("x <> y")
        rest = C.saved(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        C.dropped(edges)
        edges = rest
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = rounds[-1]
    for up in reversed(rounds[:-1]):
        label = up.join(label.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    out = C.saved(label, "labels")
    C.dropped(edges, *rounds)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, copy_id (smallest id with the same words), group_id (smallest id of the near-duplicate group), node, label.

    ``label`` is the key of a group: groups of different texts can have the same smallest id, or none.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = C.saved(slim.mapInArrow(_sign(n_bands, rows, k), "doc_id long, node binary, bands array<long>, sketch binary, size long"), "signed")

    # One row for each different text; its bands are those of any copy.
    nodes = C.saved(signed.groupBy("node").agg(F.min("doc_id").alias("copy_id")), "nodes")
    reps = signed.join(nodes, (signed.node == nodes.node) & signed.doc_id.eqNullSafe(nodes.copy_id), "left_semi")
    bucket = C.saved(reps.select("node", "size", F.explode("bands").alias("band")).groupBy("node", "band").agg(F.max("size").alias("size")), "bands")
    centres = bucket.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter("n > 1").select("band", "centre")
    shared = C.saved(bucket.join(centres, "band"), "shared")
    C.dropped(bucket)
    # What the nodes that share a bucket have; most texts share none.
    some = C.saved(shared.select("node").distinct(), "some")
    sketches = C.saved(reps.join(some, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "sketches")
    texts = C.saved(_texts_of(slim, some.join(nodes, "node")), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        salts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / SIDE).alias("salts"))
        dealt = C.saved(pairs.join(salts, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), "salts").alias("salt")), "pairs")
        mine = dealt.join(texts, "node").select("centre", "salt", F.lit(1).alias("role"), "node", "text")
        to = dealt.select("centre", "salt").distinct().join(texts.withColumnRenamed("node", "of"), F.col("centre") == F.col("of")).select("centre", "salt", F.lit(0).alias("role"), F.col("of").alias("node"), "text")
        rows_ = to.unionByName(mine).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
        return C.saved(rows_.mapInArrow(_with_centre(k, threshold), "a binary, b binary"), "links")

    def of_groups(pairs: DataFrame) -> DataFrame:
        of = lambda end, name: label.select(F.col("node").alias(end), F.col("label").alias(name))
        return pairs.join(of("node", "la"), "node", "left").join(of("centre", "lb"), "centre", "left").withColumns({"la": F.coalesce("la", "node"), "lb": F.coalesce("lb", "centre")})

    # Each node and its likeliest centre, then the centres of groups that are still apart.
    of_centres = sketches.select(F.col("node").alias("centre"), F.col("sketch").alias("centre_sketch"))
    pairs = shared.filter("node <> centre").select("node", "centre").distinct().join(sketches.select("node", "sketch"), "node").join(of_centres, "centre")
    share = F.pandas_udf(_share, "double")(F.col("sketch"), F.col("centre_sketch"))
    stars = C.saved(pairs.select("node", "centre", share.alias("share")).filter(F.col("share") >= SKETCH_LEAST), "stars")
    first = C.saved(stars.groupBy("node").agg(F.max_by("centre", F.struct("share", "centre")).alias("centre")), "first")
    links = linked(first)
    label = components(links)
    more = linked(C.saved(of_groups(stars.join(first, ["node", "centre"], "left_anti")).filter("la <> lb").select("node", "centre"), "more"))
    if more.limit(1).count():
        label = components(links.unionByName(more))

    # Buckets with nodes of different groups: the others against all, in blocks.
    now = C.saved(shared.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    sizes = now.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("most"))
    open_ = C.saved(now.join(sizes.filter("groups > 1 and n > 2").select("band", "most"), "band"), "open")
    C.dropped(now, shared)
    room = open_.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("band", F.greatest(F.ceil(F.col("n") / SIDE), F.ceil(F.col("bytes") / SIDE_BYTES)).alias("blocks"))
    full = C.saved(open_.drop("size").join(room, "band").join(sketches, "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "full")
    gathered = lambda df, at: df.groupBy("band", F.col("block").alias(at), "most", "centre").agg(F.collect_list(F.struct("node", "label", "sketch", "bands")).alias("nodes"))
    rest = gathered(full.filter("label <> most"), "r").withColumnRenamed("nodes", "rest")
    met = rest.join(gathered(full, "c").select("band", "c", "nodes"), "band")
    units = C.saved(met.mapInArrow(_candidates(n_bands * rows, n_bands), "band long, r int, c int, nodes array<binary>, labels array<binary>, pairs binary"), "units")
    of_units = units.select(F.col("band").alias("band2"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.explode(F.array_distinct("nodes")).alias("node")).join(texts, "node")
    found = C.saved(units.groupBy("band", "r", "c").cogroup(of_units.groupBy("band2", "r2", "c2")).applyInArrow(_links(k, threshold), "a binary, b binary"), "links")
    groups = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if found.limit(1).count():  # links between groups: few
        far = components(found).select(F.col("node").alias("label"), F.col("label").alias("far"))
        groups = groups.join(far, "label", "left").select("node", "copy_id", F.coalesce("far", "label").alias("label"))
    groups = C.saved(groups, "groups")
    C.dropped(texts, sketches, some, stars, first, links, more, open_, full, units, found)

    least = groups.groupBy("label").agg(F.min("copy_id").alias("group_id"))
    named = groups.join(least, "label").select(F.col("node").alias("n2"), "copy_id", "group_id", "label")
    ids = signed.select("doc_id", "node")
    return ids.join(named, ids.node == named.n2).select("doc_id", "copy_id", "group_id", "node", "label")


def _texts_of(slim: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, text) of the nodes of ``ends``, one row each."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _keys(b.column("text")), b.column("text")], names=["doc_id", "node", "text"])

    all_ = slim.mapInArrow(keyed, "doc_id long, node binary, text string")
    ends = ends.select(F.col("node").alias("n2"), "copy_id")
    return all_.join(ends, (all_.node == ends.n2) & all_.doc_id.eqNullSafe(ends.copy_id), "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without all but one of each near-duplicate group: the row with the smallest id stays (of equal ids, that of the smallest node; of equal rows, one)."""
    groups = near_duplicates(docs, id_col, text_col, **options)
    least = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least"))
    key, keep_id, keep_node = C.free_names(docs, "key", "keep_id", "keep_node")
    stay = least.select(F.col("least.doc_id").alias(keep_id), F.col("least.node").alias(keep_node))

    def keys(texts):
        import pandas as pd

        return pd.Series(_keys(pa.array(texts, pa.large_string(), from_pandas=True)).to_pylist())

    named = docs.withColumn(key, F.pandas_udf(keys, "binary")(F.col(text_col).cast("string")))
    kept = named.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(keep_id)) & (F.col(key) == F.col(keep_node)), "left_semi")
    return kept.dropDuplicates([id_col, key]).drop(key)
