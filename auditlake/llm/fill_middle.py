"""Fill-in-middle: documents rearranged so that a model learns to write what stands between two passages.

A text is cut into tokens, ``[A-Za-z]+|[^A-Za-z]`` over code points, and at two of their
edges into prefix, middle and suffix. No list of tokens is made: each byte has one of six
classes, the classes of a block of texts lie in a wavelet matrix, rank queries of the
classes that begin a token add up to the number of tokens before any byte, and bisection
on that number finds both cuts of all texts of the block at once.

Defined cases: a null text is as an empty one, which is plain (n = 0); a null id draws as
the empty text does; repeated rows are rows of their own with the same result; equal
draws (an empty middle) and cuts at either end are kept as they are; texts of any length
are worked on whole; other columns are left out, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Marks of the prefix, suffix and middle in an output.
MARKS = (b"<P>", b"<S>", b"<M>")
#: Of 100 documents, those that are rearranged, and of 100 such the ones that begin with the suffix.
RATE, SPM = 90, 20

# Classes of bytes. Those from RUN on begin a token, those from LETTER on a code point.
TAIL, LETTER, RUN, WHITE, SIGN, WIDE = range(6)
BITS = 3
_OF_BYTE = np.full(256, SIGN, np.uint8)
_OF_BYTE[0x80:0xC0], _OF_BYTE[0xC0:] = TAIL, WIDE
_OF_BYTE[65:91] = _OF_BYTE[97:123] = LETTER
_OF_BYTE[C.WHITE] = WHITE


class WaveletMatrix:
    """Symbols of a few bits: at each level one bit of every symbol, those with a zero bit stably before the others on the next level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for at in reversed(range(bits)):
            bit = (symbols >> at) & 1
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((at, words, before, len(bit) - int(bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in each [lo, hi)."""
        for at, words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            lo, hi = (zeros + a, zeros + b) if symbol >> at & 1 else (lo - a, hi - b)
        return hi - lo


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte; a letter after no letter begins a run."""
    out = _OF_BYTE[buf]
    first = out == LETTER
    first[1:] &= ~first[:-1]
    out[first] = RUN
    return out


class Edges:
    """Counts of tokens and code points in the texts of a block, by rank queries alone."""

    def __init__(self, buf: np.ndarray):
        self.matrix = WaveletMatrix(classes(buf), BITS)

    def _count(self, least: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, lo, hi) for c in range(least, WIDE + 1))

    def tokens(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Tokens that begin in each [lo, hi)."""
        return self._count(RUN, lo, hi)

    def chars(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self._count(LETTER, lo, hi)

    def cut(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where the first k tokens of each text [start, end) end: the last place with at most k tokens begun before it."""
        lo, hi = start, end
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            fits = self.tokens(start, mid) <= k
            lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid - 1)
        return lo


def draws(doc_id: Column, seed: int = 1) -> Column:
    """(h1, h2, h3, h4): the first four groups of eight digits of the SHA-256 of ``seed:id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.struct(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)))


def _rearranged(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            texts = pc.fill_null(b.column("text"), "")
            buf, off = C.joined(texts)
            start, end = off[:-1], off[1:] - 1
            h = [pc.struct_field(b.column("h"), i).to_numpy(zero_copy_only=False) for i in range(4)]
            edges = Edges(buf)
            n = edges.tokens(start, end)
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            first, last = (edges.cut(start, end, k) for k in (np.minimum(one, two), np.maximum(one, two)))
            plain = (start == end) | (h[2] % 100 >= rate)
            for m in MARKS:
                plain |= pc.match_substring(texts, m.decode()).to_numpy(zero_copy_only=False)
            suffix_first = h[3] % 100 < spm
            outs, data = [], buf.tobytes()
            for s, f, l, e, as_is, turned in zip(start.tolist(), first.tolist(), last.tolist(), end.tolist(), plain.tolist(), suffix_first.tolist()):
                if as_is:
                    outs.append(data[s:e])
                    continue
                p, x = (MARKS[0], data[s:f]), (MARKS[1], data[l:e])
                outs.append(b"".join([*(x + p if turned else p + x), MARKS[2], data[f:l]]))
            form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
            chars = [pa.array(edges.chars(x, y), pa.int64(), mask=plain) for x, y in ((start, first), (first, last))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *chars, pa.array(outs, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each document's tokens, its form (plain, psm, spm), the lengths of its parts (null: plain) and its new text.

    Rows stay where they are: no shuffle.
    """
    C.prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), draws(F.col(id_col), seed).alias("h"))
    return slim.mapInArrow(_rearranged(rate, spm), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with a mark stay plain, so that every mark of another output is one of its three."""
    parts = F.split(output, "|".join(m.decode() for m in MARKS), -1)
    psm, spm = (F.concat(*(F.get(parts, i) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
