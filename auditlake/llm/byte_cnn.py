"""Quality classifier: a convolutional network over bytes, trained and applied in numpy.

Each byte has a learned vector; filters of ``WIDTH`` bytes slide over the text in
steps of ``STRIDE``. A chunk is two neighbouring half chunks, so chunks overlap by
half and together cover the whole text; a filter's value in a chunk is its
maximum there. The mean and the maximum over all chunks feed one logistic unit.
For a text in use, the filters are tables of (place in filter, byte) and the
convolution is a sum of table rows.

The network is fitted on at most ``SAMPLE`` labelled rows, whole texts.

Defined cases: null and empty texts, as all texts, are followed by one filter's
width of zero bytes and so have one chunk; without labelled rows, or with one
class only, the score is that class's share (0.5 without rows). Equal texts have equal
scores (ties), repeated rows are scored each, very long texts are scored whole, and the
score of a text doesn't depend on the texts around it. Other columns are kept by
keep_good() and not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import labelled

SAMPLE = 3000
WIDTH, STRIDE, FILTERS, DEPTH, HALF = 8, 2, 16, 6, 128
EPOCHS, BATCH, RATE = 8, 32, 0.01
PASS = 0.7


def _laid_out(texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole half chunks (two at least), and the number of half chunks of each."""
    if not isinstance(texts, list):
        texts = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    step = HALF * STRIDE
    halves = np.array([max(2, -(-(len(t) + WIDTH) // step)) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(n * step, b"\0") for t, n in zip(texts, halves.tolist())), np.uint8), halves


def _convolved(buf: np.ndarray, halves: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Values of all filters at all places; those that would reach into the next text are out of the running (the zeros before them have the same value)."""
    padded = np.concatenate([buf, np.zeros(WIDTH, np.uint8)])
    n = len(buf) // STRIDE
    out = tables[0][padded[: n * STRIDE : STRIDE]]
    for o in range(1, WIDTH):
        out += tables[o][padded[o : o + n * STRIDE : STRIDE]]
    end = np.cumsum(halves) * HALF
    for k in range(1, WIDTH // STRIDE):
        out[end - k] = -np.inf
    return out


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "bytes": r.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
            "filters": r.normal(0, 0.3, (WIDTH, DEPTH, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "last": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def tables(self) -> np.ndarray:
        return np.einsum("bd,odf->obf", self.p["bytes"], self.p["filters"]).astype(np.float32)

    def _features(self, half: np.ndarray, halves: np.ndarray):
        """Chunk values and their mean and maximum for each text, from the values of half chunks."""
        chunk = np.maximum(half[:-1], half[1:])
        first = np.cumsum(halves) - halves
        keep = np.ones(len(half), bool)
        keep[first + halves - 1] = False  # a chunk does not reach into the next text
        chunk = np.maximum(chunk[keep[:-1]] + self.p["bias"], 0)
        n = halves - 1
        at = np.cumsum(n) - n
        return chunk, keep, at, n, np.add.reduceat(chunk, at) / n[:, None], np.maximum.reduceat(chunk, at)

    def scores(self, texts, tables: np.ndarray | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        buf, halves = _laid_out(texts)
        half = _convolved(buf, halves, self.tables() if tables is None else tables).reshape(-1, HALF, FILTERS).max(axis=1)
        *_, mean, top = self._features(half, halves)
        z = np.concatenate([mean, top], axis=1) @ self.p["out"] + self.p["last"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict:
        buf, halves = _laid_out(texts)
        values = _convolved(buf, halves, self.tables()).reshape(-1, HALF, FILTERS)
        where = values.argmax(axis=1)
        half = np.take_along_axis(values, where[:, None], 1)[:, 0]
        chunk, keep, at, n, mean, top = self._features(half, halves)
        x = np.concatenate([mean, top], axis=1)
        p = 1 / (1 + np.exp(-np.clip(x @ self.p["out"] + self.p["last"], -30, 30)))
        d = ((p - y) / len(y)).astype(np.float32)
        dx = d[:, None] * self.p["out"]
        text = np.repeat(np.arange(len(n)), n)
        dc = dx[text, :FILTERS] / n[text, None]
        best = chunk == top[text]
        dc += best * dx[text, FILTERS:] / np.maximum(np.add.reduceat(best, at), 1)[text]
        dc *= chunk > 0
        left = np.flatnonzero(keep)
        second = half[left + 1] > half[left]
        h = left[:, None] + second
        f = np.broadcast_to(np.arange(FILTERS), h.shape)
        place = (h * HALF + where[h, f]) * STRIDE
        live = dc != 0
        g, place, f = dc[live], place[live], f[live]
        padded = np.concatenate([buf, np.zeros(WIDTH, np.uint8)])
        dt = np.zeros((WIDTH, 256, FILTERS), np.float32)
        for o in range(WIDTH):
            np.add.at(dt[o], (padded[place + o], f), g)
        return {
            "bytes": np.einsum("obf,odf->bd", dt, self.p["filters"]),
            "filters": np.einsum("obf,bd->odf", dt, self.p["bytes"]),
            "bias": dc.sum(axis=0),
            "out": (d[:, None] * x).sum(axis=0) + 1e-4 * self.p["out"],
            "last": d.sum(keepdims=True),
        }


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 5) -> Network:
    net = Network(seed)
    y = np.array([v for _, v in rows], np.float32)
    if len(y) == 0 or y.min() == y.max():
        net.constant = float(y[0]) if len(y) else 0.5
        return net
    texts, r = [t.encode() for t, _ in rows], np.random.default_rng(seed)
    opt = labelled.Adam(net.p, RATE)
    steps = max(1, len(texts) // BATCH)
    epochs = max(epochs, -(-200 // steps))  # small samples: as many steps at least
    for e in range(epochs):
        opt.rate = RATE * (1 - e / epochs) + RATE / 20
        order = r.permutation(len(texts))
        for k in range(steps):
            i = order[k * BATCH : (k + 1) * BATCH]
            opt.step(net.gradients([texts[j] for j in i], y[i]))
    return net


def scorer(net: Network, spark) -> callable:
    """text column -> score column; the network is some kilobytes and sent with the tasks."""
    C.prepare(spark)

    def score(texts: pd.Series) -> pd.Series:
        tables, out, held, size = net.tables(), [], [], 0
        for t in texts:
            held.append((t or "").encode())
            size += len(held[-1])
            if size > C.BLOCK_BYTES // 2:
                out.append(net.scores(held, tables))
                held, size = [], 0
        if held:
            out.append(net.scores(held, tables))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return F.pandas_udf(score, "double")


def predict(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = PASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    net = fit(labelled.sample(docs, labels, label, SAMPLE))
    score = scorer(net, docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(F.col("doc_id"), 2, 4).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = PASS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns."""
    net = fit(labelled.sample(docs, labels, label, SAMPLE))
    score: Column = scorer(net, docs.sparkSession)(F.col("text").cast("string"))
    return docs.filter(score >= threshold)
