"""Toxicity: averaged subword-bag embeddings in a linear softmax, trained jointly in numpy.

A word (run of bytes that are not ASCII white space, A-Z as a-z) is a bag of its
character n-grams of ``GRAMS`` bytes, with a mark at either end, and of the whole
word; each is hashed to one of ``BUCKETS`` embeddings. A misspelling shares most
n-grams, hence most of its vector, with the word. A window of ``WINDOW`` words is
the average of its bags and goes through a linear softmax of two classes;
windows overlap by half and together cover the text. A text is as toxic as its
most toxic window, so a long text does not dilute one insult. Embeddings and
softmax are fitted together, each text by its most toxic window at the time.

In use, an embedding counts only by its product with the softmax weights: a
table of one number a bucket.

Fitted on at most ``SAMPLE`` labelled rows, whole texts. Defined cases: null,
empty and white texts have one empty window and get the score of the bias;
without labelled rows, or with one class, the score is that class's share; equal
texts have equal scores (ties), repeated rows are scored each, very long texts are
scored whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import labelled

SAMPLE = 3000
GRAMS, BUCKETS, DIM, WINDOW = (3, 4, 5), 1 << 16, 12, 4
EPOCHS, BATCH, RATE = 12, 64, 0.03
PASS = 0.3


def _marked(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes with a white byte before, starts and ends of words, words of each text, buckets of whole words, prefix hashes."""
    buf, off = C.joined(texts)
    buf = np.concatenate([np.array([32], np.uint8), buf])
    starts, ends = C.word_spans(buf)
    per = np.diff(np.searchsorted(starts, off + 1))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * C.powers(C._BASE, len(buf)), out=sums[1:])
    whole = _bucket((sums[ends] - sums[starts]) * C.powers(C._INV, len(buf) + 1)[starts], 1)
    return buf, starts, ends, per, whole, sums


#: Hash values of bytes; all white space is one mark.
_VALUES = np.where(C.WHITE, np.uint64(0x8A5CD789635D2DFF), C.LOWER_VALUES)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """The top bits of an odd multiple."""
    return ((h + np.uint64(kind * 0x9E3779B97F4A7C15 & C._M64)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)


def _grams(sums: np.ndarray, g: int) -> np.ndarray:
    """Bucket of the g bytes from each place."""
    n = len(sums) - g
    return _bucket((sums[g:] - sums[:n]) * C.powers(C._INV, len(sums))[:n], g)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, number of features of each word, number of words of each text), features by word."""
    _, starts, ends, per, whole, sums = _marked(texts)
    each = [np.maximum(ends - starts + 3 - g, 0) for g in GRAMS]
    total = 1 + sum(each)
    out = np.empty(int(total.sum()), np.int32)
    at = np.cumsum(total) - total
    out[at] = whole
    at = at + 1
    for g, m in zip(GRAMS, each):
        w = np.repeat(np.arange(len(m)), m)
        k = np.arange(len(w)) - np.repeat(np.cumsum(m) - m, m)
        out[at[w] + k] = _grams(sums, g)[starts[w] - 1 + k]
        at = at + m
    return out, total, per


def word_sums(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the table over the features of each word, number of them, words of each text), without listing features."""
    _, starts, ends, per, whole, sums = _marked(texts)
    out, total = table[whole].astype(np.float64), np.ones(len(starts), np.int64)
    for g in GRAMS:
        s = np.zeros(max(len(sums) - g, 0) + 1)
        if len(s) > 1:
            np.cumsum(table[_grams(sums, g)], out=s[1:])
        last = np.maximum(ends + 2 - g, starts - 1)
        out += s[np.minimum(last, len(s) - 1)] - s[np.minimum(starts - 1, len(s) - 1)]
        total += last - starts + 1
    return out, total, per


def windows(per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and text of the half-overlapping windows of all texts; one at least for each text."""
    half = WINDOW // 2
    n = np.maximum(1, -(-(per - half) // half))
    text = np.repeat(np.arange(len(per)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(per) - per)[text] + k * half
    return first, np.minimum(first + WINDOW, np.cumsum(per)[text]), text


class Model:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.out = r.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.constant: float | None = None

    def table(self) -> np.ndarray:
        return (self.emb @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)

    def logits(self, values: np.ndarray, total: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Toxic minus clean logit of windows, from sums and numbers of features of words."""
        s, n = np.concatenate([[0.0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(total)])
        return (s[end] - s[first]) / np.maximum(n[end] - n[first], 1) + float(self.bias[1] - self.bias[0])

    def scores(self, texts: pa.Array, table: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        values, total, per = word_sums(texts, table)
        first, end, text = windows(per)
        z = np.maximum.reduceat(self.logits(values, total, first, end), np.flatnonzero(np.r_[True, text[1:] != text[:-1]]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 3) -> Model:
    m = Model(seed)
    y = np.array([v for _, v in rows], np.float32)
    if len(y) == 0 or y.min() == y.max():
        m.constant = float(y[0]) if len(y) else 0.5
        return m
    r = np.random.default_rng(seed)
    whole = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string())], names=["text"])
    made = [features(b.column("text")) for b in C.blocks(iter([whole]), limit=C.BLOCK_BYTES // 4)]
    total, per = (np.concatenate([x[k] for x in made]) for k in (1, 2))
    f, at = np.empty(int(total.sum()), np.int32), 0
    while made:  # part by part, so that the features are held once
        part = made.pop(0)[0]
        f[at : at + len(part)] = part
        at += len(part)
    first, end, text = windows(per)
    edge = np.concatenate([[0], np.cumsum(total)])
    cuts = np.searchsorted(edge, np.arange(0, len(f) + 1, 1 << 21)).tolist() + [len(total)]

    def sums(table: np.ndarray) -> np.ndarray:
        return np.concatenate([np.add.reduceat(table[f[edge[x] : edge[z]]], edge[x:z] - edge[x]) for x, z in zip(cuts, cuts[1:]) if z > x] or [np.zeros(0)])

    begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.append(begin, len(text)))
    g2, o2, b2 = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for e in range(max(epochs, min(60, 30_000 // len(y)))):
        z = m.logits(sums(m.table()), total, first, end)
        # The most toxic window of each text; at first, windows at random as well.
        top = np.lexsort((z, text))[begin + count - 1]
        chosen = np.concatenate([top, begin + (r.random(len(begin)) * count).astype(np.int64)]) if e < 3 else top
        for part in np.array_split(r.permutation(chosen), max(1, len(chosen) // BATCH)):
            n = edge[end[part]] - edge[first[part]]
            w = np.repeat(np.arange(len(part)), n)
            ids = f[np.repeat(edge[first[part]], n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)]
            scale = (1 / np.maximum(n, 1)).astype(np.float32)
            hidden = np.zeros((len(part), DIM), np.float32)
            np.add.at(hidden, w, m.emb[ids])
            hidden *= scale[:, None]
            logit = hidden @ m.out + m.bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[text[part]].astype(int)] -= 1
            d_out, d_bias = hidden.T @ p / len(part) + 1e-5 * m.out, p.mean(axis=0)
            d_hidden = (p @ m.out.T) * scale[:, None]
            order = np.argsort(ids, kind="stable")
            ids, rows_ = ids[order], d_hidden[w[order]]
            at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
            if len(at):
                g = np.add.reduceat(rows_, at)
                i = ids[at]
                g2[i] += (g * g).mean(axis=1)  # a step size of its own for each embedding
                m.emb[i] -= 10 * RATE * g / np.sqrt(g2[i])[:, None]
            o2 += d_out * d_out
            b2 += d_bias * d_bias
            m.out -= RATE * d_out / np.sqrt(o2)
            m.bias -= RATE * d_bias / np.sqrt(b2)
    return m


def scorer(m: Model, spark):
    """text column -> score column. The table in use is a quarter of a megabyte whatever the corpus."""
    C.prepare(spark)
    sent, bias, constant = spark.sparkContext.broadcast(m.table()), m.bias, m.constant

    def score(texts: pd.Series) -> pd.Series:
        own = Model.__new__(Model)
        own.bias, own.constant = bias, constant
        whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
        parts = [own.scores(b.column("text"), sent.value) for b in C.blocks(iter([whole]), limit=C.BLOCK_BYTES // 4)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return F.pandas_udf(score, "double")


def predict(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = PASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = scorer(fit(labelled.sample(docs, labels, label, SAMPLE)), docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(F.col("doc_id"), 2, 4).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
