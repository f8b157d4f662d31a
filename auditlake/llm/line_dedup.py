"""Line dedup: lines that many documents have, found in one sorted stream of hashes, kept as bitmaps.

Each line becomes a key of 128 bits. (key, document, position) is partitioned by range
and sorted by all three, so that a key that fills partitions alone is cut between its
documents. Each partition is one stream: the documents of a key stand together, and as
soon as the last one needed has come the key is decided. Only the keys at the two ends of
a partition go on in another; their counts, two rows a partition, are added up afterwards.

What comes out is no text but a compressed bitmap of the lines to keep, for each document
that loses any; ``without_lines`` applies it.

Defined cases: a null text is as an empty one: one empty line, kept. Keys without a
character never count. A document is an id with its text: rows that repeat both are one
document and get the same result each; rows of one id with other texts, and rows
without an id, are documents of their own by their texts. Ties there are none: the order
is by document and position alone. A text of any length is worked on whole. Other
columns are left out, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Documents that must have a line so that all of them lose it.
DOCUMENTS = 10
_AT = ["h", "g", "doc_id", "t", "pos"]
_SPACE = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(line: Column) -> Column:
    """A line without the white space at its ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _CAPITALS, _CAPITALS.lower())


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("t", F.xxhash64("text"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, g, doc_id, t, pos, n): hashes of the key of every line that has one; n lines has the document."""
    s = _slim(docs, id_col, text_col).withColumn("l", F.split("text", "\n", -1))
    k = s.select("doc_id", "t", F.size("l").alias("n"), F.posexplode("l").alias("pos", "line")).withColumn("k", key(F.col("line"))).filter("k <> ''")
    return k.select(F.xxhash64("k").alias("h"), F.shiftleft(F.hash("k").cast("long"), 32).bitwiseOR(F.crc32(F.col("k").cast("binary"))).alias("g"), "doc_id", "t", "pos", "n")


def _new(cols: list[np.ndarray]) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return out


_OUT = "kind int, h long, g long, doc_id long, no_id boolean, t long, pos int, n int, last_id long, last_none boolean, last_t long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
#: Kinds of rows that a stream gives: a line of a key that is decided, one of a key that may go on in another partition, and such a key's first and last document and their number (in ``n``).
LOST, OPEN, ENDS = 0, 1, 2


def _rows(kind: int, rows: list[np.ndarray]) -> pa.RecordBatch:
    m = len(rows[0])
    cols = [np.full(m, kind, np.int32), *rows]
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, _KINDS)), *(pa.nulls(m, k) for k in _KINDS[8:])], names=_NAMES)


class _Key:
    """The key that a stream is at: its documents so far, and its lines as long as they are too few to decide (those of fewer than ``least`` documents)."""

    def __init__(self, least: int, begins: bool):
        self.least, self.begins, self.count, self.held, self.first, self.last = least, begins, 0, [], None, None

    def add(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        here = tuple(r[0] for r in rows[:5])
        self.count += int(_new(rows[2:5]).sum()) - (here == self.last)
        self.first, self.last = self.first or here, tuple(r[-1] for r in rows[:5])
        self.held.append(rows)
        if self.count >= self.least:
            yield from (_rows(LOST, x) for x in self.held)
            self.held = []

    def close(self, at_edge: bool) -> Iterator[pa.RecordBatch]:
        if at_edge:
            yield from (_rows(OPEN, x) for x in self.held)
            one = [ENDS, *self.first, None, self.count, *self.last[2:]]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one, _KINDS)], names=_NAMES)


def _streamed(least: int):
    """Sorted rows of a partition -> lines of the keys that ``least`` documents have, and what must be known of the first and the last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, None  # the key that the stream is at, and the last row
        for b in batches:
            if not b.num_rows:
                continue
            doc = b.column(2)
            rows = [*(b.column(i).to_numpy() for i in (0, 1)), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), *(b.column(i).to_numpy() for i in (3, 4, 5))]
            fresh = _new(rows[:6])  # rows that repeat id and text have the same lines once more
            fresh[0] = tuple(r[0] for r in rows[:6]) != seen
            seen = tuple(r[-1] for r in rows[:6])
            rows = [r[fresh] for r in rows]
            total = len(rows[0])
            if not total:
                continue
            cuts = np.append(np.flatnonzero(_new(rows[:2])), total)
            part = lambda lo, hi: [r[lo:hi] for r in rows]
            k = 0
            if at and at.last[:2] == (rows[0][0], rows[1][0]):
                yield from at.add(part(0, cuts[1]))
                k = 1
            if cuts[k] == total:
                continue
            if at:
                yield from at.close(at.begins)
            elif len(cuts) > 2:  # the first key of the partition ends in this batch
                at = _Key(least, True)
                yield from at.add(part(0, cuts[1]))
                yield from at.close(True)
                k = 1
            inner = part(cuts[k], cuts[-2])  # keys that begin and end here
            if len(inner[0]):
                key = np.cumsum(_new(inner[:2])) - 1
                many = (np.bincount(key, _new(inner[:5])) >= least)[key]
                if many.any():
                    yield _rows(LOST, [r[many] for r in inner])
            at = _Key(least, at is None)
            yield from at.add(part(cuts[-2], total))
        if at:
            yield from at.close(True)

    return run


def common_lines(found: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """lines() -> (doc_id, no_id, t, pos, n): the lines whose key at least ``least`` documents have."""
    order = [F.col(c).asc_nulls_first() for c in _AT]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = C.saved(ranged.mapInArrow(_streamed(least), _OUT), "streamed")
    # At most two rows a partition: documents of a key in all its parts; one that two parts share counts once.
    by = Window.partitionBy("h", "g").orderBy(F.desc("no_id"), "doc_id", "t", F.desc("last_none"), "last_id", "last_t")
    before = F.lag(F.struct("last_id", "last_none", "last_t")).over(by)
    ends = rows.filter(F.col("kind") == ENDS).select("h", "g", (F.col("n") - F.coalesce((before == F.struct("doc_id", "no_id", "t")).cast("int"), F.lit(0))).alias("docs"))
    many = ends.groupBy("h", "g").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = ["doc_id", "no_id", "t", "pos", "n"]
    late = rows.filter(F.col("kind") == OPEN).join(many, ["h", "g"], "left_semi").select(*kept)
    return rows.filter(F.col("kind") == LOST).select(*kept).union(late)


def pack(n: int, lost: np.ndarray) -> bytes:
    """A bitmap of n lines, a bit for each that stays, compressed."""
    keep = np.ones(n, np.uint8)
    keep[lost] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = [pack(n, lost.values.to_numpy()) for n, lost in zip(b.column("n").to_pylist(), b.column("lost"))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "no_id", "t", "n")), pa.array(maps, pa.binary())], names=["doc_id", "no_id", "t", "n", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = DOCUMENTS) -> DataFrame:
    """(doc_id, no_id, t, n, keep): for each document that loses lines, its number of lines and the compressed bitmap of those it keeps.

    t is the 64-bit hash of its text. A document that isn't listed keeps all.
    """
    C.prepare(docs.sparkSession)
    lost = common_lines(lines(docs, id_col, text_col), least)
    by_doc = lost.groupBy("doc_id", "no_id", "t", "n").agg(F.collect_set("pos").alias("lost"))
    return by_doc.mapInArrow(_packed, "doc_id long, no_id boolean, t long, n int, keep binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.blocks(batches):
        buf, off = C.joined(b.column("text"), b"\n")
        ends = np.flatnonzero(buf == 10)  # each text ends in one more
        n = np.diff(np.searchsorted(ends, off))
        at, keep = np.cumsum(n) - n, np.ones(len(ends), bool)
        for i, bitmap in enumerate(b.column("keep")):
            if bitmap.is_valid:
                keep[at[i] : at[i] + n[i]] = unpack(bitmap.as_py(), n[i])
        left = buf[np.repeat(keep, np.diff(ends, prepend=-1))]
        sizes = np.add.reduceat(np.where(keep, np.diff(ends, prepend=-1), 0), at)
        edge = np.append(0, np.cumsum(sizes))
        data = left.tobytes()
        texts = [data[x : max(x, y - 1)] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - np.add.reduceat(keep, at, dtype=np.int64), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "n_lines", "n_dropped", "text"])


def without_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every document with the lines that its bitmap keeps, joined by \\n."""
    C.prepare(docs.sparkSession)
    known = bitmaps.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("_id"), F.col("t").alias("_t"), "keep").hint("shuffle_hash")
    s = _slim(docs, id_col, text_col)
    j = s.join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    return j.select("doc_id", "text", "keep").mapInArrow(_applied, "doc_id long, n_lines long, n_dropped long, text string")
