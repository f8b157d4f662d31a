"""Best-fit packing of documents into sequences of fixed length, by minimum bin slack.

Lengths are whole numbers up to the length of a sequence, so the pieces of a
corpus of any size are a histogram of that many counts. The plan is made from
the histogram: the longest length left takes a sequence, and a dynamic programme
over bitsets (bit s: a sum of s can be reached by the lengths available) finds
the fullest feasible completion. That combination is taken out as often as the
counts allow at once; each step uses up most of a length, so there are at most
some thousands of steps however many pieces there are. The plan is then a table
of intervals of ranks: the pieces of one length, in any order, fill the places
for that length. Ranks come from counts by length and salt, so a length that
holds most pieces is counted and numbered by many tasks; there are as many salts
as keep a length and salt to ``SALT_ROWS`` rows on average.

Defined cases: null and empty texts are the end id alone, one piece; repeated
rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import encode

LENGTH = 1024
SALT_ROWS = 50_000


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only longer ones are cut, the first piece is the shorter one."""
    first = n % length or min(n, length)
    return [(0, first)] + [(a, length) for a in range(first, n, length)] if n else []


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """The lengths, longest first, of a multiset within ``counts`` with the largest sum up to ``room``.

    Longer lengths are preferred in ties, so that short ones stay for later.
    """
    if room <= 0:
        return []
    full = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for n in range(room, 0, -1):
        left, take = min(int(counts[n]), room // n), 1
        while left > 0:  # binary parts of the multiplicity
            k = min(take, left)
            new = (reach | reach << (n * k)) & full
            layers.append((n, k, reach))
            reach, left, take = new, left - k, take * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for n, k, before in reversed(layers):
        if not before >> at & 1:  # reached by this layer alone
            out += [n] * k
            at -= n * k
    return sorted(out, reverse=True)


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (length, first rank, end of ranks, first sequence, copies in a sequence, offset in it)."""
    counts, used, rows, sequence = np.zeros(length + 1, np.int64), np.zeros(length + 1, np.int64), [], 0
    for n, k in histogram.items():
        counts[n] = k
    for top in range(length, 0, -1):
        while counts[top]:
            counts[top] -= 1
            chosen = [top, *fullest(counts, length - top)]
            counts[top] += 1
            need: dict[int, int] = {}
            for n in chosen:
                need[n] = need.get(n, 0) + 1
            times, offset = min(int(counts[n]) // k for n, k in need.items()), 0
            for n, k in need.items():
                rows.append((n, int(used[n]), int(used[n]) + k * times, sequence, k, offset))
                used[n] += k * times
                counts[n] -= k * times
                offset += k * n
            sequence += times
    return rows


def _pieces(tokenizer: str, end: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            ids, off = encode.encoder(tokenizer).flat(b.column("text"), end)
            size = np.diff(off)
            first = np.where(size > 0, np.where(size % length > 0, size % length, np.minimum(size, length)), 0)  # only longer ones are cut, the first piece is the shorter one
            n = np.where(size > 0, 1 + (size - first) // length, 0)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
            start = np.where(piece > 0, first[doc] + (piece - 1) * length, 0)
            room = np.where(piece > 0, length, first[doc])
            raw = ids.astype("<u4").data.cast("B") if len(ids) else b""
            at = (off[doc] + start) * 4
            crc = np.array([zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + room * 4).tolist())], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(room, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def _placed(sent, length: int):
    """Sequence and offset of numbered pieces: the interval of the plan that a piece's rank is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, first, copies, at = sent.value
        key = n << 40 | low
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, size << 40 | rank, side="right") - 1
            own = rank - low[i]
            cols = [*(b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[i] + own // copies[i]), pa.array(at[i] + own % copies[i] * size)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document; other columns of ``docs`` are left out."""
    spark = docs.sparkSession
    C.prepare(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = C.saved(slim.mapInArrow(_pieces(tokenizer, end, length), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    salts = max(16, max(histogram.values(), default=0) // SALT_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = C.saved(counts.selectExpr("length", "salt", "sum(n) over (partition by length order by salt) - n as before"), "before")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, piece, ids_crc32) - 1 as own").join(before, ["length", "salt"]).withColumn("rank", F.expr("before + own"))
    rows = np.array(plan(histogram, length) or [(length, 0, 0, 0, 1, 0)], np.int64)
    n, low, _, first, copies, at = rows[np.lexsort((rows[:, 1], rows[:, 0]))].T  # some thousand rows
    sent = spark.sparkContext.broadcast((n, low, first, copies, at))
    kept = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return kept.mapInArrow(_placed(sent, length), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
