"""Source divergence audit: how far the sources of each language are apart in their words, and which words set each apart.

Words are counted by (lang, source, term) with partial sums before the shuffle; the kept
terms, one row each with the counts of its sources, are written once. Shares of terms and
their distances are whole numbers throughout.

* ``pair``: each term's row gives the distances of the sources that have it, added up in
  the task by pair, so that no pair of a term becomes a row. What a source's terms add
  where the other has none depends on its counts alone and comes from their histogram.
* ``term``: of a group's terms, one that ten others dominate (at least its count in the
  group, at most its count in the language, earlier in UTF-8) can't be among the first
  ten, as the distance grows with the one and falls with the other. Each partition keeps
  the skyband of its terms, the skybands of a group are merged by the same pass, and what
  is left is ranked exactly.

Defined cases: null text, lang and source are as empty ones; repeated rows are rows, and
documents, of their own; equal distances go by the item's UTF-8; a language without kept
terms has pairs of value 0 and no terms; texts of any length are worked on whole; other
columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Documents of a language that must have a term, and terms that are listed for each group.
DOCUMENTS, TOP = 10, 10
#: Shares are counted in parts of this.
WHOLE = 1_000_000_000
#: Pairs of sources that a task adds up before it hands them on, and pairs of entries worked on at once.
SUMS, AT_ONCE = 1 << 20, 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --------------------------------------------------------------------------- counts


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of a block in order, A-Z as a-z, and how many each text has."""
    solid = np.zeros(len(buf) + 2, np.int8)
    solid[1:-1] = _LETTER[buf]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.append(0, np.cumsum(ends - starts))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LOWER[buf[solid[1:-1] == 1]])])
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, off))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.blocks(batches):
        words, per = _terms(*C.joined(b.column("text")))
        if not len(words):
            continue
        group = pc.binary_join_element_wise(b.column("lang").cast(pa.binary()), b.column("source").cast(pa.binary()), pa.scalar(b"\x00", pa.binary()))  # only told apart by it
        group = group.dictionary_encode()
        codes, size = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        doc = np.repeat(np.arange(len(per)), per)
        pairs, n = np.unique(doc * size + codes, return_counts=True)
        of = group.indices.to_numpy().astype(np.int64)[pairs // size] * size + pairs % size
        keys, where, docs = np.unique(of, return_inverse=True, return_counts=True)
        count = np.zeros(len(keys), np.int64)
        np.add.at(count, where, n)
        row = np.zeros(len(group.dictionary), np.int64)
        row[group.indices.to_numpy()] = np.arange(len(per))
        lang, source = (b.column(c).take(pa.array(row[keys // size])) for c in ("lang", "source"))
        term = words.dictionary.take(pa.array(keys % size)).cast(pa.binary()).cast(pa.string(), safe=False)
        yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(count), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "count", "docs"])


def kept_terms(docs: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """docs(lang, source, text) -> (lang, term, all, by array<(source, count)>): terms of at least ``least`` documents of their language, with their counts."""
    counts = docs.mapInArrow(_counted, "lang string, source string, term string, count long, docs long").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("by"))
    return terms.filter(F.col("docs") >= least).drop("docs")


# --------------------------------------------------------------------------- shares and distances


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + 2) / (total + 2 * terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(27,0)")
    return F.lit(1) + F.call_function("div", wide((count + 2).cast("decimal(27,0)") * F.lit(WHOLE).cast("decimal(10,0)")), wide(total + 2 * terms))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def with_shares(terms: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups with v, n, none: terms of the language, the group's count, the share of a term that it hasn't; terms by group with p and q)."""
    each = terms.select("lang", "term", "all", F.explode("by").alias("x")).select("lang", "term", "all", "x.*")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n_all"))
    sums = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    g = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "n", "n_all"])
    g = g.withColumn("none", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))))
    return g, each


# --------------------------------------------------------------------------- pairs


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, by: sources with p and none) -> (lang, a, b, value): what the terms that both have add to the distance beyond what the histograms say; a < b."""
    sums: dict[tuple[str, str, str], int] = {}

    def out() -> pa.RecordBatch:
        keys = list(sums)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(list(sums.values()), pa.int64())], names=["lang", "a", "b", "value"])

    for batch in batches:
        by = batch.column("by")
        per = pc.list_value_length(by).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = by.flatten()
        source, lang = pc.struct_field(flat, "source").dictionary_encode(), batch.column("lang").dictionary_encode()
        names, langs = source.dictionary.to_pylist(), lang.dictionary.to_pylist()
        s, p, none = source.indices.to_numpy().astype(np.int64), *(pc.struct_field(flat, c).to_numpy() for c in ("p", "none"))
        row = np.repeat(np.arange(len(per)), per)
        code = lang.indices.to_numpy().astype(np.int64)[row]
        first, size = (np.cumsum(per) - per)[row], per[row]
        done = np.cumsum(size)
        lo = 0
        while lo < len(s):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            m = size[lo:hi]
            i = np.repeat(np.arange(lo, hi), m)
            j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + first[i]
            once = j > i  # each pair of a term once
            i, j = i[once], j[once]
            value = _far(p[i], p[j]) - _far(p[i], none[j]) - _far(none[i], p[j]) + _far(none[i], none[j])
            keys, where = np.unique((code[i] * len(names) + s[i]) * len(names) + s[j], return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, where, value)
            for k, x in zip(keys.tolist(), total.tolist()):
                a, b = names[k // len(names) % len(names)], names[k % len(names)]
                at = (langs[k // len(names) ** 2], min(a, b), max(a, b))
                sums[at] = sums.get(at, 0) + x
            if len(sums) >= SUMS:
                yield out()
                sums.clear()
            lo = hi
    if sums:
        yield out()


def pair_part(g: DataFrame, each: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language.

    The sum over all kept terms is split: as if neither source had any term, then what a
    source's own terms change, by the histogram of their shares, then what terms of both do.
    """
    shares = each.join(g, ["lang", "source"]).select("lang", "term", "source", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "none")
    both = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("by")).filter(F.size("by") > 1)
    found = both.select("lang", "by").mapInArrow(_pairs, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))
    others = g.select("lang", F.col("source").alias("item"), F.col("none").alias("none_item"))
    own = shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("m"))
    own = own.join(others, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (distance(F.col("p"), F.col("none_item")) - distance(F.col("none"), F.col("none_item")))).alias("own"))
    pairs = g.join(others, "lang").filter("source <> item").select("lang", "source", "item", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), (F.col("v") * distance(F.col("none"), F.col("none_item"))).alias("base"))
    turned = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("own_item"))
    j = pairs.join(found, ["lang", "a", "b"], "left").join(own, ["lang", "source", "item"], "left").join(turned, ["lang", "source", "item"], "left")
    return j.select("lang", "source", "item", sum((F.coalesce(c, F.lit(0)) for c in ("own", "own_item", "both")), F.coalesce("base", F.lit(0))).alias("value"))


# --------------------------------------------------------------------------- terms


def skyband(count: np.ndarray, total: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Indices of the rows that fewer than k others dominate: at least the count, at most the total, an earlier name (names are places in UTF-8 order, all different).

    Rows are taken so that those that dominate a row come before it; it is enough to
    count dominating rows that are in the skyband themselves.
    """
    order = np.lexsort((name, total, -count))
    held = np.zeros(0, np.int64)
    for lo in range(0, len(order), 512):
        new = order[lo : lo + 512]
        t, s = total[new], name[new]
        over = ((total[held][None, :] <= t[:, None]) & (name[held][None, :] < s[:, None])).sum(1) if len(held) else np.zeros(len(new), np.int64)
        left = np.flatnonzero(over < k)
        new, over = new[left], over[left]
        t, s = total[new], name[new]
        own = np.tril((t[None, :] <= t[:, None]) & (s[None, :] < s[:, None]), -1)
        # Within the chunk all earlier rows may be counted: whoever has k of them has k in the skyband.
        held = np.concatenate([held, new[over + own.sum(1) < k]])
    return held


def _skybands(k: int):
    """Rows (lang, source, term, count, all) -> those in the skyband of their group among the rows of the partition."""
    names = ["lang", "source", "term", "count", "all"]

    def reduced(t: pa.Table) -> pa.Table:
        group = pc.binary_join_element_wise(t["lang"].cast(pa.binary()), t["source"].cast(pa.binary()), pa.scalar(b"\x00", pa.binary())).combine_chunks().dictionary_encode()
        of = group.indices.to_numpy()
        place = np.empty(len(of), np.int64)
        place[pc.sort_indices(t["term"].cast(pa.binary())).to_numpy()] = np.arange(len(of))
        count, total = t["count"].to_numpy(), t["all"].to_numpy()
        by = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by], np.arange(len(group.dictionary) + 1))
        parts = [by[a:z] for a, z in zip(edges, edges[1:])]
        return t.take(pa.array(np.concatenate([x[skyband(count[x], total[x], place[x], k)] for x in parts])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                fresh += b.num_rows
            if fresh >= 1 << 16:
                held, fresh = reduced(pa.Table.from_batches(held)).combine_chunks().to_batches(), 0
        if held:
            yield from reduced(pa.Table.from_batches(held)).select(names).to_batches()

    return run


def term_part(g: DataFrame, each: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value): terms of a group above their language's share, the ``top`` first of each group and those that no pass could rule out."""
    rows, kind = each.select("lang", "source", "term", "count", "all"), "lang string, source string, term string, count long, all long"
    band = rows.mapInArrow(_skybands(top), kind)
    merged = band.repartition("lang", "source").mapInArrow(_skybands(top), kind)
    j = merged.join(g, ["lang", "source"]).withColumns({"p": share(F.col("count"), F.col("n"), F.col("v")), "q": share(F.col("all"), F.col("n_all"), F.col("v"))})
    return j.filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source to the others of its language, and the terms that set it apart."""
    C.prepare(docs.sparkSession)
    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    terms = C.saved(kept_terms(slim, least), "terms")
    g, each = with_shares(terms, slim.select("lang", "source").distinct())
    g = C.saved(g, "groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [("pair", pair_part(g, each), F.lit(True)), ("term", term_part(g, each, top), F.col("rank") <= top)]
    out = [df.withColumn("rank", rank).filter(keep).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df, keep in parts]
    return out[0].union(out[1])
