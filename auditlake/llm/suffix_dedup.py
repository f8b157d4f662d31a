"""Removal of long repeated byte strings, with hash-compared suffix sorting.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere
else too, in the same text or another; strings are judged on the input.

1. *Anchors.* In every window of ``length`` bytes the substring of ``GRAM`` bytes
   with the smallest hash, the leftmost of equal ones, is its anchor. Equal
   windows have equal anchors at equal places. A text is so cut into runs of
   windows with one anchor; a run with its windows' bytes is a span. Texts above
   ``PART`` bytes are cut into runs in parts that overlap by a window.
2. *Spans.* Equal spans meet by a cryptographic digest of 128 bits: those of a block of
   texts in one row that lists their places, so that a passage that a third of all texts
   hold is one row a block in every join, and blocks with partial sums. The digest
   only routes: two occurrences of each span that occurs twice are suffix-sorted,
   their common extension is found by binary search on prefix polynomial hashes, and
   their bytes are compared (collision verification). Spans so found repeated are
   repeated as a whole, wherever they occur.
3. *Edges.* Anchors with different spans are the edges of repeated passages. One
   occurrence of each such span is cut into runs of ``RUN`` offsets; the bytes that all
   windows of a run share (its core) are the bucket. In a bucket the suffixes that
   start the windows are sorted by mergesort, compared as above. Neighbours with a
   common extension of ``length`` or more are repeated, after verification.
   A bucket of more than ``BUCKET`` runs is dealt in parts of about so many and split by the
   longest cores there are, whole windows: these meet by digest as the spans do, those of a
   part in one row, and two of each are sorted and compared, so that no task gets a hot bucket.

Defined cases: null and empty texts and texts shorter than ``length`` keep all
bytes; a text that occurs twice loses all its bytes in both places; repeated
rows are texts that occur twice; very long texts are like all others; equal texts
(ties) lose the same bytes; an empty table gives an empty result. remove_repeats()
reads id and text alone; without_repeats() keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM, RUN, BUCKET = 400, 100, 32, 256
#: Bytes of a text that are worked on at once, and least length of what a passage of over 50 words has.
PART, PASSAGE = 4 << 20, 200
_BASES = (0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_PLACE = np.uint64((1 << 26) - 1)


class Prefix:
    """Prefix polynomial hashes of a byte array; ``of`` gives the hash of spans."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        n = len(buf)
        self.which = which
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(C.BYTE_VALUES[buf] * C.powers(_BASES[which], n), out=self.sums[1:])
        self.inverse = C.powers(_INVERSES[which], n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Exact up to collisions of a polynomial modulo 2**64 over random byte values."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: list[bytes] | None = None) -> pa.Array:
    """128 bits of a cryptographic digest of each span of bytes."""
    raw, of = memoryview(buf), hashlib.blake2b
    if salt is None:
        return pa.array([of(raw[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), end.tolist())], pa.binary())
    return pa.array([of(raw[a:z], digest_size=16, salt=s).digest() for a, z, s in zip(start.tolist(), end.tolist(), salt)], pa.binary())


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` values: prefix and suffix minima of blocks."""
    n = len(v)
    m = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    m[:n] = v
    m = m.reshape(-1, width)
    left = np.minimum.accumulate(m, axis=1).ravel()
    right = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs_of_windows(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor) of the runs of windows with one anchor; places in ``buf``."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if n < length:
        return (empty,) * 4
    h = C.mix64(Prefix(buf).of(np.arange(n - gram + 1), np.arange(gram, n + 1)))
    place = np.arange(len(h), dtype=np.uint64)
    owner = (_least((h & ~_PLACE) | place, length - gram + 1) & _PLACE).astype(np.int64)
    sizes = np.diff(off) - 1  # each text is followed by one separator
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    first = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
    window = off[:-1][text] + np.arange(len(text)) - first[text]
    if not len(window):
        return (empty,) * 4
    a = owner[window]
    new = np.ones(len(window), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(window)) - 1
    return text[at], window[at], window[last], a[at]


def _text_keys(b: pa.RecordBatch) -> pa.Array:
    """A key for each row from its id and its text: equal rows share it."""
    out = [
        hashlib.blake2b(t.as_buffer() if t.is_valid else b"", digest_size=16, key=str(d).encode()).digest()
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()))
    ]
    return pa.array(out, pa.binary())


def _spans(length: int, gram: int):
    def found(keys: pa.Array, buf: np.ndarray, off: np.ndarray, start: int) -> pa.RecordBatch | None:
        text, low, high, anchor = runs_of_windows(buf, off, length, gram)
        if not len(text):
            return None
        base = off[text] - start
        grams = C.signed(C.mix64(Prefix(buf).of(anchor, anchor + gram)))
        cols = [pa.array(x - base, pa.int32()) for x in (low, high, anchor)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(text)), *cols, pa.array(grams), _digests(buf, low, high + length)], names=_SPAN_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            buf, off = C.joined(b.column("text"))
            keys = _text_keys(b)
            pieces = [(keys, buf, off, 0)]
            if len(buf) > PART:  # with a very long text: row by row, windows start in one part each
                rows_ = ((i, buf[off[i] : off[i + 1] - 1]) for i in range(b.num_rows))
                pieces = ((keys.slice(i, 1), np.append(t[a : a + PART + length - 1], np.uint8(0)), a) for i, t in rows_ for a in range(0, max(len(t), 1), PART))
                pieces = ((k, x, np.array([0, len(x)]), a) for k, x, a in pieces)
            for keys, x, o, a in pieces:
                out = found(keys, x, o, a)
                if out is not None:
                    yield out

    return run


_SPAN_NAMES = ["doc", "low", "high", "anchor", "gram", "h"]
_SPAN_SCHEMA = "doc binary, low int, high int, anchor int, gram long, h binary"
_PLACE_TYPE = pa.struct([("doc", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])
_GROUP_SCHEMA = f"{_SPAN_SCHEMA}, more array<struct<doc:binary,low:int,high:int>>"


def _halves(x: pa.Array) -> list[np.ndarray]:
    """Digests of 128 bits as two columns of numbers that sort like their bytes, the last first."""
    both = np.frombuffer(b"".join(x.to_pylist()), ">u8").reshape(-1, 2)
    return [both[:, 1], both[:, 0]]


def _grouped(spans):
    """One row for the equal spans of a block: the least place, and the others in ``more``, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans(batches):
            h = _halves(b.column("h"))
            order = np.lexsort([b.column("low").to_numpy(), *_halves(b.column("doc")), *h])
            new = np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in h], axis=0)]
            at = np.flatnonzero(new)
            first, rest = b.take(pa.array(order[at])), b.take(pa.array(order[~new]))
            places = pa.StructArray.from_arrays([rest.column(k) for k in ("doc", "low", "high")], fields=list(_PLACE_TYPE))
            ends = np.append(at[1:], len(order)) - np.arange(1, len(at) + 1)
            more = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), places)
            yield pa.RecordBatch.from_arrays([*first.columns, more], names=[*_SPAN_NAMES, "more"])

    return run


# --------------------------------------------------------------------------- suffix sorting


def common_extension(p: Prefix, a: np.ndarray, b: np.ndarray, limit: int | np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``limit``: binary search on prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64) + limit
    for _ in range(int(high.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        same = p.of(a, a + mid) == p.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, np.minimum(high, mid - 1))
        high = np.maximum(high, low)
    return low


def _compare(buf: np.ndarray, p: Prefix, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """-1, 0 or 1 as the suffix at a is less than, equal to (in ``limit`` bytes) or greater than that at b."""
    n = common_extension(p, a, b, limit)
    at = np.minimum(n, limit - 1)
    return np.where(n >= limit, 0, np.sign(buf[a + at].astype(np.int64) - buf[b + at]))


def suffix_sort(buf: np.ndarray, p: Prefix, starts: np.ndarray, segment: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes at ``starts`` by (segment, first ``limit`` bytes); ``segment`` must be ascending.

    Bottom-up mergesort: all pairs of runs of all segments are merged at once,
    each suffix finding its place in the other run by binary search.
    """
    order = np.arange(len(starts))
    if not len(starts):
        return order
    head = np.r_[True, segment[1:] != segment[:-1]]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    last = np.append(np.flatnonzero(head)[1:], len(starts))[np.cumsum(head) - 1]
    width, longest = 1, int((last - first).max())
    while width < longest:
        where = np.flatnonzero((last - first) > width)  # places of segments that still have runs to merge
        run = (where - first[where]) // width
        right = (run & 1).astype(bool)
        low = np.where(right, first[where] + (run - 1) * width, np.minimum(first[where] + (run + 1) * width, last[where]))
        high = np.minimum(low + width, last[where])
        begin = low.copy()
        mine = starts[order[where]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            c = _compare(buf, p, starts[order[mid]], mine[open_], limit)
            before = (c < 0) | ((c == 0) & right[open_])  # stable: equal ones of the left run come first
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        place = np.where(right, first[where] + (run - 1) * width, first[where] + run * width) + (where - first[where] - run * width) + (low - begin)
        new = order.copy()
        new[place] = order[where]
        order, width = new, width * 2
    return order


def repeated(buf: np.ndarray, starts: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share their first ``length`` bytes with another of their segment."""
    p = Prefix(buf)
    order = suffix_sort(buf, p, starts, segment, length)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((segment[a] == segment[b]) & (common_extension(p, starts[a], starts[b], length) >= length))
    out = np.zeros(len(starts), bool)
    span = np.arange(length)
    for k in range(0, len(near), 20_000):  # collision verification: bytes against bytes
        x, y = a[near[k : k + 20_000]], b[near[k : k + 20_000]]
        ok = (buf[starts[x][:, None] + span] == buf[starts[y][:, None] + span]).all(axis=1)
        out[x[ok]] = out[y[ok]] = True
        for s in np.unique(segment[x[~ok]]):  # hashes agree, bytes don't: the segment by its bytes
            seen: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(segment == s):
                seen.setdefault(buf[starts[i] : starts[i] + length].tobytes(), []).append(i)
            for group in seen.values():
                if len(group) > 1:
                    out[group] = True
    return out


def same(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Whether all strings of each segment (two, of ``sizes`` bytes, ``length`` at least) are one: sorted, extended, and compared byte by byte."""
    p = Prefix(buf)
    order = suffix_sort(buf, p, starts, segment, length)
    a, b = order[:-1], order[1:]
    ok = np.ones(int(segment.max(initial=-1)) + 1, bool)
    pair = np.flatnonzero(segment[a] == segment[b])
    a, b = a[pair], b[pair]
    limit = np.minimum(sizes[a], sizes[b])
    equal = (sizes[a] == sizes[b]) & (common_extension(p, starts[a], starts[b], limit) >= limit)
    raw = memoryview(buf)
    equal[equal] = [raw[x : x + n] == raw[y : y + n] for x, y, n in zip(starts[a[equal]].tolist(), starts[b[equal]].tolist(), limit[equal].tolist())]
    ok[segment[a[~equal]]] = False
    return ok


# --------------------------------------------------------------------------- edges of repeated passages


def _cores(length: int, run_length: int):
    """Runs of windows with the digests of their cores, from texts and their open spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            buf, off = C.joined(b.column("text"))
            spans = b.column("spans")
            flat = spans.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(spans.offsets.to_numpy()))
            base = off[row]
            low, high, anchor, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("low", "high", "anchor", "n"))
            least, most = (anchor - high) // run_length, (anchor - low) // run_length  # runs of offsets from the window's start to its anchor
            each = most - least + 1
            i = np.repeat(np.arange(len(low)), each)
            k = least[i] + np.arange(len(i)) - (np.cumsum(each) - each)[i]
            core_a, core_z = anchor[i] - k * run_length, anchor[i] - k * run_length - run_length + 1 + length
            w_low, w_high = np.maximum(low[i], core_a - run_length + 1), np.minimum(high[i], core_a)
            salt = [x.to_bytes(8, "little", signed=True) for x in k.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc").take(pa.array(row[i])), pa.array(w_low, pa.int32()), pa.array(w_high, pa.int32()), pa.array(anchor[i], pa.int32()), pa.array(n[i] > 1, pa.bool_()),
                    _digests(buf, base[i] + core_a, base[i] + core_z, salt),
                ],
                names=["doc", "low", "high", "anchor", "whole", "core"],
            )

    return run


def _cut_out(length: int):
    """The bytes of runs of windows, from texts and their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            buf, off = C.joined(b.column("text"))
            raw, runs = buf.tobytes(), b.column("runs")
            flat = runs.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(runs.offsets.to_numpy()))
            low, high = (off[row] + flat.field(k).to_numpy().astype(np.int64) for k in ("low", "high"))
            for c in range(0, len(row), 2048):
                part = slice(c, c + 2048)
                bytes_ = pa.array([raw[x:z] for x, z in zip(low[part].tolist(), (high[part] + length).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row[part])), *(flat.field(k)[part] for k in _CUT_NAMES[1:-1]), bytes_], names=_CUT_NAMES)

    return run


_CUT_NAMES = ["doc", "low", "high", "anchor", "whole", "core", "k", "bytes"]
_CUT_SCHEMA = "doc binary, low int, high int, anchor int, whole boolean, core binary, k long, bytes binary"


def _edges(keys: list, before) -> list[int]:
    """Places where another key than the one before begins."""
    return [i for i, (x, y) in enumerate(zip(keys, [before, *keys])) if x != y]


def _gathered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Record batches of whole buckets, about a block each, from rows sorted by ``key``."""
    held, size, last = [], 0, None
    for b in batches:
        keys, a = b.column(key).to_pylist(), 0
        for z in _edges(keys, last):
            if z > a:
                held.append(b.slice(a, z - a))
                size += pc.sum(pc.binary_length(held[-1].column("bytes"))).as_py()
            if size > C.BLOCK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            a = z
        if a < b.num_rows:
            held.append(b.slice(a))
            size += pc.sum(pc.binary_length(held[-1].column("bytes"))).as_py()
            last = keys[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    C.trimmed()


def _numbered(keys: list) -> np.ndarray:
    out, n, last = np.zeros(len(keys), np.int64), -1, None
    for i, x in enumerate(keys):
        if i == 0 or x != last:
            n, last = n + 1, x
        out[i] = n
    return out


def _verified(length: int):
    """Keys of the groups whose two occurrences are one string; rows sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, "h"):
            buf, off = C.joined(t.column("bytes"), b"\0")
            keys = t.column("h").to_pylist()
            segment = _numbered(keys)
            ok = same(buf, off[:-1], np.diff(off) - 1, segment, length)
            first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in first[ok].tolist()], pa.binary())], names=["h"])

    return run


def _windows(b: pa.RecordBatch, length: int):
    """Of all windows of a batch of cut runs: place in the buffer, row, offset to the anchor."""
    buf, off = C.joined(b.column("bytes"), b"\0")
    low, high, anchor = (b.column(k).to_numpy().astype(np.int64) for k in ("low", "high", "anchor"))
    each = high - low + 1
    row = np.repeat(np.arange(len(low)), each)
    step = np.arange(len(row)) - (np.cumsum(each) - each)[row]
    return buf, off[row] + step, row, anchor[row] - low[row] - step, low[row] + step


def _found(docs: pa.Array, row: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """Repeated windows as (doc, low, high) of runs of neighbours; ``row``: places in ``docs``."""
    order = np.lexsort((window, row))
    row, window = row[order], window[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (window[1:] > window[:-1] + 1)] if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1 if len(row) else at
    return pa.RecordBatch.from_arrays([docs.take(pa.array(row[at], pa.int64())), pa.array(window[at], pa.int32()), pa.array(window[last], pa.int32())], names=["doc", "low", "high"])


def _sorted_buckets(length: int):
    """Repeated windows of buckets; the rows of a bucket come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, "core"):
            buf, start, row, offset, window = _windows(t, length)
            core = _numbered(t.column("core").to_pylist())[row]
            order = np.lexsort((offset, core))
            start, row, offset, window, core = (x[order] for x in (start, row, offset, window, core))
            new = np.r_[True, (core[1:] != core[:-1]) | (offset[1:] != offset[:-1])]
            twice = repeated(buf, start, np.cumsum(new), length)
            twice &= ~t.column("whole").to_numpy(zero_copy_only=False)[row]
            yield _found(t.column("doc"), row[twice], window[twice])

    return run


def _window_digests(length: int):
    """One row for the equal windows of a block of runs: how many, the least and the last place, and the places that are not yet known repeated, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches, "bytes"):
            buf, start, row, _, window = _windows(b, length)
            digests = _digests(buf, start, start + length)
            h = _halves(digests)
            order = np.lexsort([window, *(x[row] for x in _halves(b.column("doc"))), *h])
            at = np.flatnonzero(np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in h], axis=0)])
            last = np.append(at[1:], len(order)) - 1
            place = lambda i: pa.StructArray.from_arrays([b.column("doc").take(pa.array(row[i])), pa.array(window[i], pa.int32())], fields=list(_START_TYPE))
            open_ = ~b.column("whole").to_numpy(zero_copy_only=False)[row][order]
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(open_)[last]], pa.int32()), place(order[open_]))
            yield pa.RecordBatch.from_arrays([digests.take(pa.array(order[at])), pa.array(last - at + 1, pa.int64()), place(order[at]), place(order[last]), places], names=["h", "n", "at", "other", "places"])

    return run


_START_TYPE = pa.struct([("doc", pa.binary()), ("low", pa.int32())])
_WINDOW_SCHEMA = "h binary, n long, at struct<doc:binary,low:int>, other struct<doc:binary,low:int>, places array<struct<doc:binary,low:int>>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows as runs of neighbours, from rows of their places."""
    for b in batches:
        flat = b.column("places").flatten()
        docs = flat.field("doc").dictionary_encode()
        yield _found(docs.dictionary, docs.indices.to_numpy().astype(np.int64), flat.field("low").to_numpy().astype(np.int64))


# --------------------------------------------------------------------------- the operator


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, run_length: int = RUN, bucket: int = BUCKET) -> DataFrame:
    """(doc, low, high): first and last start of runs of repeated windows; texts(doc_id, text), doc: the key of a row."""
    spans_all = C.saved(texts.mapInArrow(_grouped(_spans(length, gram)), _GROUP_SCHEMA), "spans")
    here = F.struct("doc", "low", "high")
    last = F.coalesce(F.try_element_at("more", F.lit(-1)), here)
    spans = C.saved(spans_all.groupBy("h").agg(F.sum(F.size("more") + 1).alias("n"), F.min(F.struct("doc", "low", "high", "anchor")).alias("at"), F.max(last).alias("other"), F.first("gram").alias("gram")), "distinct")
    open_ = spans.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram")
    edges = C.saved(spans.join(open_, "gram", "left_semi").select("at.*", "n"), "edges")
    twice = spans.filter("n > 1").select("h", "at", "other")
    by_text = edges.groupBy("doc").agg(F.collect_list(F.struct("low", "high", "anchor", "n")).alias("spans"))
    # Texts of the occurrences that are looked at: one of an edge, two of a span that occurs twice.
    needed = edges.select("doc").unionByName(twice.select("at.doc")).unionByName(twice.select("other.doc")).distinct()
    some = C.saved(_keyed(texts).join(needed, "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text")), "some")

    def verified(groups: DataFrame) -> DataFrame:
        """h of the groups(h, at, other) whose two occurrences have equal bytes; one place alone is equal to itself."""
        two = groups.select("h", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"{x}.doc").alias("doc"), F.col(f"{x}.low").alias("low"), F.col(f"{x}.high").alias("high")) for x in ("at", "other"))))).alias("x")).select("h", "x.*")
        by = two.groupBy("doc").agg(F.collect_list(F.struct("low", "high", F.lit(0).alias("anchor"), F.lit(True).alias("whole"), F.col("h").alias("core"), F.lit(0).cast("long").alias("k"))).alias("runs"))
        cut_ = some.join(by, "doc").select("doc", "text", "runs").mapInArrow(_cut_out(length), _CUT_SCHEMA).select(F.col("core").alias("h"), "bytes")
        return C.saved(cut_.repartition("h").sortWithinPartitions("h").mapInArrow(_verified(length), "h binary"), "verified")

    whole = spans_all.join(verified(twice), "h", "left_semi")
    found = C.saved(whole.select(F.explode(F.concat(F.array(here), "more")).alias("x")).select("x.*"), "whole")
    runs = C.saved(some.join(by_text, "doc").mapInArrow(_cores(length, run_length), "doc binary, low int, high int, anchor int, whole boolean, core binary"), "runs")
    C.dropped(spans_all, spans)
    shared = runs.groupBy("core").agg(F.count("*").alias("k"), F.min("whole").alias("all_whole")).filter("k > 1 and not all_whole").select("core", "k")
    left = runs.join(shared, "core")
    cut = some.join(left.groupBy("doc").agg(F.collect_list(F.struct("low", "high", "anchor", "whole", "core", "k")).alias("runs")), "doc")
    cut = C.saved(cut.select("doc", "text", "runs").mapInArrow(_cut_out(length), _CUT_SCHEMA), "cut")
    small = C.saved(cut.filter(F.col("k") <= bucket).repartition("core").sortWithinPartitions("core").mapInArrow(_sorted_buckets(length), "doc binary, low int, high int"), "small")
    out = found.unionByName(small)
    if cut.filter(F.col("k") > bucket).limit(1).count():
        # Runs of a bucket come together in parts of about ``bucket``: an equal window is one row a part, in the shuffles and in the join.
        part = F.pmod(F.xxhash64("doc", "low"), F.ceil(F.col("k") / bucket))
        hot = cut.filter(F.col("k") > bucket).withColumn("part", part).repartition("core", "part").sortWithinPartitions("core", "part").drop("part")
        windows = C.saved(hot.mapInArrow(_window_digests(length), _WINDOW_SCHEMA), "windows")
        place = lambda x: x.withField("high", x["low"])
        groups = C.saved(windows.groupBy("h").agg(F.sum("n").alias("n"), place(F.min("at")).alias("at"), place(F.max("other")).alias("other")).filter("n > 1"), "groups")
        open_ = windows.filter(F.size("places") > 0).join(verified(groups), "h", "left_semi").select("places")
        first = F.col("places")[0]
        large = C.saved(open_.repartition(first["doc"]).sortWithinPartitions(first).mapInArrow(_merged, "doc binary, low int, high int"), "large")
        C.dropped(windows, groups)
        out = out.unionByName(large)
    C.dropped(edges, some, runs, cut)
    return out


def _keyed(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            yield pa.RecordBatch.from_arrays([_text_keys(b), b.column("text")], names=["doc", "text"])

    return texts.mapInArrow(run, "doc binary, text string")


def covered(low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start from low to high, ends exclusive."""
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(high[order] + length)
    new = np.flatnonzero(np.r_[True, low[1:] > end[:-1]]) if len(low) else np.zeros(0, np.int64)
    return list(zip(low[new].tolist(), end[np.append(new[1:], len(low)) - 1].tolist())) if len(low) else []


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    C.prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """One row a document: doc_id, n_bytes, kept (the bytes left), spans (array of (start, end) removed)."""
    texts = _slim(docs, id_col, text_col)
    windows = repeated_windows(texts, length, **options).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("windows"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _text_keys(b), b.column("text")], names=["doc_id", "doc", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            size, kept, spans = [], [], []
            for text, w in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("windows")):
                x = w.values.flatten() if w.is_valid else None
                gone = covered(x[0].to_numpy().astype(np.int64), x[1].to_numpy().astype(np.int64), length) if x else []
                size.append(len(text))
                spans.append([{"start": a, "end": z} for a, z in gone])
                kept.append(b"".join(text[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(text)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_bytes", "kept", "spans"])

    both = texts.mapInArrow(keyed, "doc_id long, doc binary, text string").join(windows, "doc", "left").select("doc_id", "text", "windows")
    return both.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from remove_repeats()."""
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """The rows and columns of ``docs`` with the repeated bytes taken out of the texts.

    Bytes of a character that is cut through go with it. ``n_chars``, where the
    column is there, is counted anew. Rows whose text is all repeated stay, empty.
    """
    texts = _slim(docs, id_col, text_col)
    of, found, key = C.free_names(docs, "windows_of", "windows", "row_key")
    windows = repeated_windows(texts, length, **options).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias(found)).withColumnRenamed("doc", of)

    def keys(ids: pd.Series, values: pd.Series) -> pd.Series:
        b = pa.RecordBatch.from_arrays([pa.array([None if pd.isna(i) else int(i) for i in ids], pa.int64()), pa.array(values, pa.large_string(), from_pandas=True)], names=["doc_id", "text"])
        return pd.Series(_text_keys(b).to_pylist())

    def cut(values: pd.Series, windows_: pd.Series) -> pd.Series:
        out = []
        for text, w in zip(values, windows_):
            if w is not None and len(w) and text:
                raw = text.encode()
                gone = covered(np.array([x["low"] for x in w], np.int64), np.array([x["high"] for x in w], np.int64), length)
                text = b"".join(raw[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(raw)])).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    # Ids as text: a column of numbers with nulls would reach Python as floating point.
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.withColumn(key, F.pandas_udf(keys, "binary")(F.col(id_col).cast("long").cast("string"), text))
    joined = named.join(windows, F.col(key) == F.col(of), "left")
    out = joined.withColumn(text_col, F.pandas_udf(cut, "string")(F.col(text_col).cast("string"), F.col(found)))
    if "n_chars" in docs.columns and "n_chars" not in (id_col, text_col):
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
