"""Language identification with interpolated Kneser-Ney character models.

A word is a run of letters, lower case, with a mark before and after; its
characters are predicted from up to ``ORDER`` - 1 characters before them in the
word. Each language has a model: at the highest order absolute discounting of
counts, below it of continuation counts (in how many contexts an n-gram was
seen), interpolated down to the uniform distribution. The n-grams of all languages
are held in one sorted array of hashes for each order, with a column for each
language, so a look-up is a binary search for many characters at once. Each
distinct word of a block of texts is looked up once.

A text gets the language with the lowest cross-entropy for a character. The
score is that language's posterior among all, with a temperature fitted on the
training texts. ``known`` is false where the cross-entropy is above the level that
all but one in a thousand training texts of that language stay below: such text
is like none of the languages.

Fitted on at most ``SAMPLE`` rows of each language, whole texts. Defined cases:
null and empty texts and texts without letters get ``und`` and score 0; without
training rows all do; one language alone gets score 1; of equally likely languages
(ties) the first by name is taken; repeated rows are predicted each; very long texts are
read whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import labelled

SAMPLE, ORDER, DISCOUNT = 300, 4, 0.75
#: Bytes of text that the sample of a language has at most.
SAMPLE_BYTES = 16 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_LETTER = np.zeros(0x110000, np.int8)  # 0: not known yet, 1: letter, 2: none


def _letters(codes: np.ndarray) -> np.ndarray:
    kind = _LETTER[codes]
    if (kind == 0).any():
        new = np.unique(codes[kind == 0])
        _LETTER[new] = [1 if chr(c).isalpha() else 2 for c in new.tolist()]
        kind = _LETTER[codes]
    return kind == 1


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, starts and ends of their words (runs of letters), and the number of words of each text."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
    off = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]).astype(np.int64)
    solid = np.zeros(len(codes) + 1, np.int8)
    solid[:-1] = _letters(codes)
    d = np.diff(solid, prepend=0)
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return codes, starts, ends, np.diff(np.searchsorted(starts, off))


def _prefix(codes: np.ndarray) -> np.ndarray:
    v = C.mix64(codes.astype(np.uint64) + np.uint64(11))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(v * C.powers(_BASE, len(codes)), out=out[1:])
    return out


def _span(sums: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    h = (sums[z] - sums[a]) * C.powers(_INV, len(sums))[a]
    return C.mix64(h + (z - a).astype(np.uint64))


def _marked(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with 0 before and after each given word; for each predicted character its place and how many characters of its word come before it."""
    size = ends - starts + 2
    total = int(size.sum())
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    back = np.arange(total) - first[word]
    inner = (back > 0) & (back < size[word] - 1)
    out = np.zeros(total, np.uint32)
    out[inner] = codes[(starts[word] + back - 1)[inner]]
    at = np.flatnonzero(back > 0)
    return out, at, back[at]


class Models:
    """p(c | context) = a[context c] + b[context] x p(c | shorter context), by order and language."""

    def __init__(self, langs: list[str], order: int = ORDER):
        self.langs, self.order = langs, order
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # per order: sorted hashes, a
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []  # per order: sorted hashes of contexts, b
        self.floor = 1e-4
        self.temperature = 1.0
        self.limits = np.full(len(langs), np.inf)

    def fit(self, texts: list[list[str]]) -> Models:
        seen = []
        for t in texts:
            codes, starts, ends, _ = words(t)
            seen.append(_marked(codes, starts, ends))
        alphabet = len(np.unique(np.concatenate([np.unique(c) for c, _, _ in seen]))) + 1
        self.floor = 1.0 / alphabet
        for n in range(1, self.order + 1):
            per = []
            for codes, at, back in seen:
                sums, top = _prefix(codes), n == self.order
                here = back >= n - 1
                p = at[here]
                gram, context = _span(sums, p - n + 1, p + 1), _span(sums, p - n + 1, p)
                if not top:
                    # Continuations: distinct longer n-grams (or word starts) that end in this one.
                    longer = back[here] >= n
                    full = np.where(longer, _span(sums, np.maximum(p - n, 0), p + 1), gram)
                    _, one = np.unique(full, return_index=True)
                    gram, context = gram[one], context[one]
                g, first, count = np.unique(gram, return_index=True, return_counts=True)
                ctx = context[first]
                count = count.astype(float)
                u, inverse = np.unique(ctx, return_inverse=True)
                total, kinds = np.bincount(inverse, count), np.bincount(inverse)
                a = np.maximum(count - DISCOUNT, 0) / total[inverse]
                per.append((g, a, u, np.minimum(1.0, DISCOUNT * kinds / total)))
            self.grams.append(self._joined([(g, a) for g, a, _, _ in per], 0.0))
            self.contexts.append(self._joined([(u, b) for _, _, u, b in per], 1.0))
        return self

    @staticmethod
    def _joined(parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts]))
        out = np.full((len(keys), len(parts)), missing, np.float32)
        for j, (k, v) in enumerate(parts):
            out[np.searchsorted(keys, k), j] = v
        return keys, out

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return at, table[0][at] == keys

    def costs(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, languages): minus log2 of the probability of each word."""
        marked, at, back = _marked(codes, starts, ends)
        sums = _prefix(marked)
        p = np.full((len(at), len(self.langs)), self.floor, np.float32)
        for n in range(1, self.order + 1):
            here = np.flatnonzero(back >= n - 1)
            x = at[here]
            c, known = self._found(self.contexts[n - 1], _span(sums, x - n + 1, x))
            here, x, c = here[known], x[known], c[known]
            g, known = self._found(self.grams[n - 1], _span(sums, x - n + 1, x + 1))
            q = p[here] * self.contexts[n - 1][1][c]
            q[known] += self.grams[n - 1][1][g[known]]
            p[here] = q
        size = ends - starts + 1
        return np.add.reduceat(-np.log2(np.maximum(p, 1e-12)), np.cumsum(size) - size, axis=0)

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages): bits a character; characters of each text."""
        codes, starts, ends, per = words(texts)
        chars = np.bincount(np.repeat(np.arange(len(per)), per), ends - starts + 1, len(per))
        out = np.zeros((len(per), len(self.langs)))
        if len(starts):
            _, first, inverse = np.unique(_span(_prefix(codes), starts, ends), return_index=True, return_inverse=True)
            cost = self.costs(codes, starts[first], ends[first])[inverse]
            has = np.flatnonzero(per)
            out[has] = np.add.reduceat(cost, (np.cumsum(per) - per)[has], axis=0)
        return out / np.maximum(chars, 1)[:, None], chars

    def calibrate(self, texts: list[list[str]]) -> Models:
        """Temperature by the likelihood of the training languages; rejection levels by their cross-entropies."""
        h, y = [], []
        for j, t in enumerate(texts):
            e, chars = self.entropy(t)
            e = e[chars > 0]
            if len(e):
                self.limits[j] = np.quantile(e[:, j], 0.999) + 0.05
            h.append(e)
            y.append(np.full(len(e), j))
        h, y = np.concatenate(h), np.concatenate(y)
        best = None
        for t in (0.02, 0.05, 0.1, 0.2, 0.4, 0.8):
            z = -h / t
            z -= z.max(axis=1, keepdims=True)
            loss = -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean() if len(y) else 0.0
            if best is None or loss < best:
                best, self.temperature = loss, t
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        h, chars = self.entropy(texts)
        best = h.argmin(axis=1)
        p = np.exp(-(h - h.min(axis=1, keepdims=True)) / self.temperature)
        score = np.where(chars > 0, 1 / p.sum(axis=1), 0.0)
        known = (chars > 0) & (h[np.arange(len(h)), best] <= self.limits[best])
        return [self.langs[b] if c else "und" for b, c in zip(best, chars)], score, known


def sample(docs: DataFrame, bound: int = SAMPLE, fold: int = 2, of: int = 4) -> tuple[list[str], list[list[str]]]:
    """Languages and at most ``bound`` different training texts of each, of ``SAMPLE_BYTES`` together (the first may be larger), the same ones each time. Rows that repeat id and text count once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    rows = rows.filter(~labelled.held_out(F.col("doc_id"), fold, of)).withColumn("h", F.xxhash64("text"))
    # The smallest hashes of each language; tasks cut to ``bound`` rows a language before anything is exchanged.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    ids = rows.groupBy("lang", "doc_id", "h").agg(F.min(F.octet_length("text")).alias("size")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= bound)
    ids = ids.withColumn("bytes", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("k") == 1) | (F.col("bytes") <= SAMPLE_BYTES))
    picked = ids.select(F.col("lang"), F.col("doc_id").alias("_id"), F.col("h"))
    same = (rows.lang == picked.lang) & (rows.h == picked.h) & rows.doc_id.eqNullSafe(picked["_id"])
    got = rows.join(F.broadcast(picked), same, "left_semi").groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text")).collect()  # bound rows a language
    got.sort(key=lambda r: (r.lang, r.doc_id is not None, r.doc_id or 0, r.text))
    langs = sorted({r.lang for r in got})
    return langs, [[r.text for r in got if r.lang == lang] for lang in langs]


def train(docs: DataFrame) -> Models:
    langs, texts = sample(docs)
    keep = [j for j, t in enumerate(texts) if any(any(c.isalpha() for c in x) for x in t)]
    langs, texts = [langs[j] for j in keep], [texts[j] for j in keep]
    return Models(langs).fit(texts).calibrate(texts) if langs else Models([])


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known of every row."""
    spark = docs.sparkSession
    C.prepare(spark)
    sent = spark.sparkContext.broadcast(train(docs))  # bounded by the sample

    def run(texts: pd.Series) -> pd.DataFrame:
        parts, held, size = [], [], 0

        def done() -> None:
            lang, score, known = sent.value.predict(held)
            parts.append(pd.DataFrame({"lang_pred": lang, "score": score, "known": known}))

        for t in texts:
            held.append(t if isinstance(t, str) else None)
            size += len(held[-1] or "")
            if size > C.BLOCK_BYTES // 2:
                done()
                held, size = [], 0
        if held:
            done()
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": pd.Series([], dtype=str), "score": pd.Series([], dtype=float), "known": pd.Series([], dtype=bool)})

    udf = F.pandas_udf(run, "lang_pred string, score double, known boolean")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(F.col("doc_id"), 2, 4).alias("held_out"), udf(F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.*")
