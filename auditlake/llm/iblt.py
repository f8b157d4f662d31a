"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is what lies between line feeds or ends of sentences (words that end in
``.``, ``!`` or ``?``), ``WORDS`` words at most (longer ones are cut, so that texts of
one line compare too); words are runs of bytes that are not ASCII white space. The
k-th occurrence of a paragraph in a text has a digest of its own, so that a text is
a set of digests. A sketch has three blocks of cells; a digest goes to one cell of
each block, which keeps a count, the sum of digests and that of their check values,
modulo 2**64. The difference of two sketches, cell by cell, holds only the digests in
which the texts differ; cells with one digest are peeled until none is left. Where
peeling fails, both sketches are made again with four times the cells and other
places, so that a failure doesn't repeat itself. The likeness of two texts is the
share of common digests, (a + b - d) / (a + b + d) for a and b digests and d
differing ones. All texts of a block are sketched, and all pairs peeled, at once.

The fingerprint is the first sketch (``CELLS`` cells) as text, with the number of
digests in front; equal texts have equal fingerprints.

Defined cases: null and empty texts have no paragraphs; two texts without any are
alike (1.0); the next of rows with one id is fixed by the hash of the text, then the
text; repeated rows are neighbours of each other; the neighbour of the last row is the
first; a single row is its own neighbour; very long texts are sets of digests like all
others; an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CELLS, BLOCKS, WORDS = 48, 3, 12
_CHECK = np.uint64(0xFF51AFD7ED558CCD)
_ENDS = np.zeros(256, bool)
_ENDS[[0x21, 0x2E, 0x3F]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _check(d: np.ndarray) -> np.ndarray:
    return C.mix64(d ^ _CHECK)


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit digests of the paragraphs, one for each occurrence, one text after the other; number of each text)."""
    buf, off = C.joined(texts, b"\n")
    starts, ends = C.word_spans(buf)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    feeds = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    first = np.ones(len(starts), bool)
    first[1:] = _ENDS[buf[ends[:-1] - 1]] | (feeds[starts[1:]] > feeds[ends[:-1]])
    index = np.arange(len(starts))
    place = (index - np.maximum.accumulate(np.where(first, index, 0))) % WORDS
    at = np.flatnonzero(place == 0)
    h = C.mix64(C.word_hashes(buf, starts, ends, C.BYTE_VALUES) + place.astype(np.uint64) * _STEP)
    d = C.mix64(np.add.reduceat(h, at) + np.diff(np.append(at, len(starts))).astype(np.uint64))
    text = np.searchsorted(off, starts[at], side="right") - 1
    # The place among equal paragraphs of a text makes each occurrence another one.
    own = d ^ C.mix64(text.astype(np.uint64) + _STEP)
    order = np.argsort(own, kind="stable")
    new = np.r_[True, own[order][1:] != own[order][:-1]]
    begin = np.flatnonzero(new)
    rank = np.empty(len(d), np.uint64)
    rank[order] = np.arange(len(d)) - np.repeat(begin, np.diff(np.append(begin, len(d))))
    return C.mix64(d + C.mix64(rank + np.uint64(0x51ED270B))), np.bincount(text, minlength=len(off) - 1)


def places(d: np.ndarray, cells: int, attempt: int) -> np.ndarray:
    """(blocks, digests): the cell of a digest in each block of a sketch of so many cells."""
    block = cells // BLOCKS
    h = [C.mix64(d + np.uint64(((attempt * BLOCKS + j) * 0x632BE59BD9B4E019 + 1) & C._M64)) >> np.uint64(32) for j in range(BLOCKS)]
    return np.stack([(x * np.uint64(block) >> np.uint64(32)).astype(np.int64) + j * block for j, x in enumerate(h)])


class Sketches:
    """Sketches of many texts, a row each: counts, sums of digests, sums of check values."""

    def __init__(self, count: np.ndarray, keys: np.ndarray, checks: np.ndarray, attempt: int = 0):
        self.count, self.keys, self.checks, self.attempt = count, keys, checks, attempt

    @classmethod
    def of(cls, d: np.ndarray, per: np.ndarray, cells: int, attempt: int = 0) -> Sketches:
        base = np.repeat(np.arange(len(per)) * cells, per)
        count, keys, checks = np.zeros(len(per) * cells, np.int64), *np.zeros((2, len(per) * cells), np.uint64)
        check = _check(d)
        for at in places(d, cells, attempt):
            at = at + base
            np.add.at(count, at, 1)
            np.add.at(keys, at, d)
            np.add.at(checks, at, check)
        return cls(*(x.reshape(len(per), cells) for x in (count, keys, checks)), attempt)

    def minus(self, a: np.ndarray, b: np.ndarray) -> Sketches:
        """A row for each pair of rows: what is in a and not in b counts 1, the contrary -1."""
        return Sketches(self.count[a] - self.count[b], self.keys[a] - self.keys[b], self.checks[a] - self.checks[b], self.attempt)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, 1 or -1) of all digests found, and which rows are whole: nothing is left of them."""
        n, cells = self.count.shape
        count, keys, checks = (x.ravel().copy() for x in (self.count, self.keys, self.checks))
        zero, found = np.uint64(0), []
        look = np.arange(len(count))
        while len(look):
            look = look[np.abs(count[look]) == 1]
            plus = count[look] > 0
            d = np.where(plus, keys[look], zero - keys[look])
            ok = np.where(plus, checks[look], zero - checks[look]) == _check(d)
            look, d, plus = look[ok], d[ok], plus[ok]
            if not len(look):
                break
            row = look // cells
            _, first = np.unique(C.mix64(d + C.mix64(row.astype(np.uint64))), return_index=True)
            row, d, sign = row[first], d[first], np.where(plus[first], 1, -1)
            found.append((row, d, sign))
            back, check = np.where(sign > 0, d, zero - d), np.where(sign > 0, _check(d), zero - _check(d))
            touched = []
            for at in places(d, cells, self.attempt):
                at = at + row * cells
                np.subtract.at(count, at, sign)
                np.subtract.at(keys, at, back)
                np.subtract.at(checks, at, check)
                touched.append(at)
            look = np.unique(np.concatenate(touched))
        whole = ~((count != 0) | (keys != 0) | (checks != 0)).reshape(n, cells).any(axis=1)
        row, d, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return row, d, sign, whole

    def text(self, i: int, n: int) -> str:
        raw = self.count[i].astype("<i4").tobytes() + self.keys[i].astype("<u8").tobytes() + self.checks[i].astype("<u4").tobytes()
        return f"{n}:{base64.b64encode(raw).decode()}"


def differences(d: np.ndarray, per: np.ndarray, a: np.ndarray, b: np.ndarray, first: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, 1 or -1) of the digests in only one text of each pair (a[i], b[i]) of texts; first small sketches, then larger ones where peeling fails."""
    todo, cells, attempt, out = np.arange(len(a)), CELLS, 0, []
    off = np.concatenate([[0], np.cumsum(per)])
    while len(todo):
        # A pair that differs in more digests than cells can't be peeled.
        able = np.flatnonzero(np.abs(per[a[todo]] - per[b[todo]]) <= cells)
        row_of, sketches = np.arange(len(per)), first
        if attempt or first is None:
            used = np.unique(np.concatenate([a[todo[able]], b[todo[able]]]))
            row_of = np.full(len(per), -1)
            row_of[used] = np.arange(len(used))
            mine = np.repeat(off[used] - (np.cumsum(per[used]) - per[used]), per[used]) + np.arange(int(per[used].sum()))
            sketches = Sketches.of(d[mine], per[used], cells, attempt)
        pair = todo[able]
        row, found, sign, whole = sketches.minus(row_of[a[pair]], row_of[b[pair]]).peel()
        keep = whole[row]
        out.append((pair[row[keep]], found[keep], sign[keep]))
        todo = np.setdiff1d(todo, pair[whole], assume_unique=True)
        cells, attempt = cells * 4, attempt + 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def likenesses(d: np.ndarray, per: np.ndarray, a: np.ndarray, b: np.ndarray, first: Sketches | None = None) -> np.ndarray:
    n = per[a] + per[b]
    k = np.bincount(differences(d, per, a, b, first)[0], minlength=len(a))
    return np.where(n > 0, (n - k) / np.maximum(n + k, 1), 1.0)


def edited(text: str, other: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


def _block(ids: list, texts: list[str], last: str) -> pa.RecordBatch:
    """Results of texts that follow each other; ``last``: the next of the last one."""
    new = [edited(t, o) for t, o in zip(texts, [*texts[1:], last])]
    n = len(texts)
    d, per = digests(pa.array([*texts, last, *new], pa.large_string()))
    sketches, k = Sketches.of(d, per, CELLS), np.arange(n)
    near_edited, near_next = np.split(likenesses(d, per, np.concatenate([k, k]), np.concatenate([k + n + 1, k + 1]), sketches), 2)
    cols = (
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), [hashlib.sha256(t.encode()).hexdigest() for t in new],
        [sketches.text(i, per[i]) for i in range(n)], [sketches.text(i + n + 1, per[i + n + 1]) for i in range(n)], pa.array(near_edited), pa.array(near_next),
    )
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in cols], names=_NAMES)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts = [], []
    for b in C.blocks(batches, limit=C.BLOCK_BYTES // 2):
        tail = b.column("tail").to_pylist()
        n = tail.index(1) if 1 in tail else len(tail)
        new = b.column("text").slice(0, n + 1).to_pylist()
        if ids and new:
            yield _block(ids, texts, new[0])
        ids, texts = b.column("doc_id").slice(0, n).to_pylist(), new[:n]
        if n < len(tail):
            if ids:
                yield _block(ids, texts, new[n])
            return  # what follows is the same row, sent more than once
        if len(ids) > 1:
            yield _block(ids[:-1], texts[:-1], texts[-1])
            ids, texts = ids[-1:], texts[-1:]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, tail): partitions of rows in order, each with the first row of the next partition (tail = 1) at its end; the last one has the first row.

    Rows are dealt to ranges of ids, so that no range needs another and every text moves once.
    """
    C.prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts, n = C.in_ranges(slim)
    parts = parts.withColumn("h", F.xxhash64("text"))
    low = F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "h")).alias("low")
    first = {r.part: r.low for r in parts.groupBy("part").agg(low).collect()}  # one row a range
    used = sorted(first)
    if not used:
        return slim.withColumn("tail", F.lit(0))
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first range: the last one
    lows = docs.sparkSession.createDataFrame([(p, before[p], first[p].doc_id, first[p].h) for p in used], "part int, before int, low long, low_h long")
    is_first = F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("h") == F.col("low_h"))
    both = parts.join(F.broadcast(lows), "part")
    to = lambda part, tail: F.struct(F.col(part).alias("part"), F.lit(tail).alias("tail"))
    sent = both.withColumn("to", F.explode(F.when(is_first, F.array(to("part", 0), to("before", 1))).otherwise(F.array(to("part", 0)))))
    rows = sent.select("doc_id", "text", "h", F.col("to.part").alias("part"), F.col("to.tail").alias("tail"))
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("tail", F.col("doc_id").asc_nulls_first(), "h", "text").select("doc_id", "text", "tail")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    return in_order(docs, id_col, text_col).mapInArrow(_fingerprints, _SCHEMA)
