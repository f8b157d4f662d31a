"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in a plain form: lower case, and each run of
characters that are neither letters nor digits as one space. An item of n
characters may be hit with up to k = floor(n x ``ERRORS``) edits. It is split into
k + 1 pieces; k edits leave one piece untouched, so every hit holds a piece
exactly, near its place. One automaton (Aho-Corasick) finds the pieces in a text
in one pass; each piece hit gives a window of the text, in which Myers'
bit-parallel algorithm finds the least edit distance of the item to a substring.

The benchmark is the stated query set. It is taken in blocks of at most
``BLOCK`` characters (by a hash of the item), so that one block's automaton fits in
a task whatever the size of the benchmark; each block goes over all texts.

Defined cases: null and empty texts have no hits; items that are null or have no
letter or digit match nothing; items too short for an edit must occur exactly;
items with equal plain forms are all reported; repeated rows are reported each.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ERRORS = 0.05
#: Characters of test items in one block.
BLOCK = 4_000_000
_PLAIN = re.compile(r"[\W_]+")
HIT = "array<struct<item_id:long,distance:int,end:long>>"


def plain(text: str | None) -> str:
    return _PLAIN.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(place, piece) of the k + 1 pieces of an item, of nearly equal lengths."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:])]


class Pattern:
    """One item for Myers' algorithm: a bit a character, the columns of the distance matrix as two bit vectors."""

    def __init__(self, item: str, k: int):
        self.n, self.k, self.item = len(item), k, item
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, window: str) -> tuple[int, int]:
        """(least distance of the item to a substring of the window, end of the first such substring)."""
        at = window.find(self.item)
        if at >= 0:
            return 0, at + self.n
        full, top, get = (1 << self.n) - 1, 1 << (self.n - 1), self.masks.get
        plus, minus, score, least, end = full, 0, self.n, self.n, 0
        for j, c in enumerate(window, 1):
            eq = get(c, 0)
            diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (full & ~(diagonal | plus))
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1 & full, down << 1 & full  # a match may start anywhere: the first row is zero
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            if score < least:
                least, end = score, j
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        import ahocorasick

        self.items, found = [], {}
        for item_id, text in items:
            p = plain(text)
            if p:
                found.setdefault(p, []).append(item_id)
        where: dict[str, list[tuple[int, int]]] = {}
        for p, ids in found.items():
            k = int(len(p) * errors)
            for at, piece in pieces(p, k):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((ids, Pattern(p, k)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, end in the plain text) of each item that occurs, its best occurrence, the first of equal ones."""
        if not text or not self.any:
            return []
        p = plain(text)
        starts: dict[int, list[int]] = {}
        for end, (n, places) in self.automaton.iter(p):
            for i, at in places:
                starts.setdefault(i, []).append(end + 1 - n - at)
        out = []
        for i, guesses in starts.items():
            ids, pattern = self.items[i]
            least, place, done, k = pattern.k + 1, 0, -1, pattern.k
            guesses.sort()
            j = 0
            while j < len(guesses):
                # Guesses that differ by no more than the edits share one window.
                a, z = guesses[j] - k, guesses[j] + pattern.n + k
                j += 1
                while j < len(guesses) and guesses[j] - k <= a + 4 * k + 1:
                    z = max(z, guesses[j] + pattern.n + k)
                    j += 1
                a = max(a, 0)
                d, e = pattern.best(p[a:z])
                if d < least:
                    least, place = d, a + e
                if not least:
                    break
            if least <= k:
                out += [(item, least, place) for item in ids]
        return sorted(out)


_built: dict[int, Matcher] = {}


def matcher(sent) -> Matcher:
    """The automaton of a block, built once in each worker."""
    if sent.id not in _built:
        _built.clear()
        _built[sent.id] = Matcher(*sent.value)
    return _built[sent.id]


class _Sent:
    """A broadcast block with an identity that outlives pickling."""

    def __init__(self, context, value):
        import uuid

        self.id, self._broadcast = uuid.uuid4().hex, context.broadcast(value)

    @property
    def value(self):
        return self._broadcast.value


def blocks(benchmark: DataFrame, errors: float = ERRORS):
    """UDFs text -> hits, one for each block of the benchmark."""
    spark = benchmark.sparkSession
    C.prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // BLOCK))
    for b in range(n if size else 0):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        sent = _Sent(spark.sparkContext, ([(r.item_id, r.text) for r in part.collect()], errors))

        yield F.pandas_udf(_hits(sent), HIT)


def _hits(sent: _Sent):
    def hits(texts: pd.Series) -> pd.Series:
        m = matcher(sent)
        return pd.Series([[{"item_id": i, "distance": d, "end": e} for i, d, e in m.hits(t)] for t in texts], dtype=object)

    return hits


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """(doc_id, item_id, distance, end) of every item found in a document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for udf in blocks(benchmark, errors):
        hit = slim.select("doc_id", udf(F.col("text")).alias("hits")).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, end long")


def keep_clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns."""
    for udf in blocks(benchmark, errors):
        docs = docs.filter(F.size(udf(F.col("text").cast("string"))) == 0)
    return docs
