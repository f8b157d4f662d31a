"""Hidden Markov language model: Baum-Welch over partitions, exact likelihoods by scaled forward recursion.

Tokens are words (runs of bytes that are not ASCII white space, A-Z as a-z) and
one end for each text. All training tokens are counted. States emit symbols: the
``HEAD`` - 1 most frequent words and the end are symbols of their own, every other
word, seen or not, belongs to one of ``CLASSES`` classes by its last two bytes; the
model is so of a fixed size whatever the vocabulary. A word of a class has the
probability of the class's symbol times (c + 1) / (N' + V' + 1), with the counts of
the class. Expected counts of transitions and emissions are added up by symbol in
the cluster in each of ``ROUNDS`` rounds over all training texts, each of them whole
(stretches of ``STRETCH`` tokens are only worked on side by side: what stands before and
after them in the text comes in as the product of its steps). The first round starts from
clusters of ``START_TEXTS`` different texts by hash, which only breaks the symmetry of the
states. Nothing depends on the order or the layout of the rows but the last digits of sums.

Counts of the words outside the head never leave the cluster: texts and counts
meet in a join by word, a text with the words it has, not with its tokens.

Defined cases: null, empty and white texts are the end alone; without training
texts all counts are 0 and the states emit all symbols alike; repeated rows count
and are scored each; equal texts have equal scores (ties); very long texts are scored
and trained on whole; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

STATES, HEAD, CLASSES, ROUNDS, STRETCH = 8, 49_152, 16_384, 4, 128
#: Different training texts that the states' first emissions are clustered from, and symbols used for that.
START_TEXTS, START_SYMBOLS = 400, 2048
PRIOR = 200.0
END = 1  # stands for the end among the hashes of words
_SYMBOLS = HEAD + CLASSES


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of the tokens of all texts, ends included, and the number of tokens of each text."""
    buf, starts, ends, h, per = C.words_of(texts)
    last = buf[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, buf[np.maximum(ends - 2, 0)], 32).astype(np.uint64) if len(ends) else last
    low = lambda b: np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
    kind = ((low(last) * np.uint64(256) + low(before)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(CLASSES)
    at = np.cumsum(per)  # an end after each text
    return np.insert(h, at, np.uint64(END)), np.insert(kind.astype(np.int32), at, -1), per + 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.blocks(batches):
        h, kind, _ = _tokens(b.column("text"))
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(C.signed(u)), pa.array(kind[first], pa.int32()), pa.array(n, pa.int64())], names=["h", "kind", "n"])


class Vocabulary:
    """The head's words and counts, the classes' totals, and the totals of all."""

    def __init__(self, head: list[tuple[int, int]], classes: list[tuple[int, int, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        h = np.array([x for x, _ in head], np.int64).view(np.uint64)
        order = np.argsort(h)
        self.hashes, self.symbols = h[order], order.astype(np.int64) + 1  # symbol 0: the end
        self.counts = np.zeros(_SYMBOLS)  # of the symbols
        self.counts[1 : len(head) + 1] = [n for _, n in head]
        self.kinds = np.zeros(CLASSES)
        self.room = np.ones(CLASSES)  # N' + V' + 1 of the classes
        for kind, n, v in classes:
            if kind < 0:
                self.counts[0] = n
            else:
                self.counts[HEAD + kind] = n
                self.room[kind] = n + v + 1

    def symbol(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = HEAD + kind.astype(np.int64)
        out[h == END] = 0
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            out[known] = self.symbols[at[known]]
        return out

    def unigram(self) -> np.ndarray:
        u = self.counts + 0.1
        return u / u.sum()


def vocabulary(training: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The bounded part of the counts, and (h, n) of all words."""
    counts = C.saved(training.select("text").mapInArrow(_counted, "h long, kind int, n long").groupBy("h").agg(F.sum("n").alias("n"), F.first("kind").alias("kind")), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    head = [(r.h, r.n, r.kind) for r in counts.filter("kind >= 0").orderBy(F.desc("n"), "h").limit(HEAD - 1).collect()]
    classes = {r.kind: [r.n, r.v] for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    for _, n, kind in head:
        classes[kind][0] -= n
        classes[kind][1] -= 1
    return Vocabulary([(h, n) for h, n, _ in head], [(k, n, v) for k, (n, v) in classes.items()], total.n or 0, total.v), counts.select("h", "n")


def _encoded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        base = np.log10((v.counts + 1) / (v.total + v.distinct + 1))
        room = np.log10(v.room)
        for b in C.blocks(batches):
            h, kind, per = _tokens(b.column("text"))
            s = v.symbol(h, kind)
            text = np.repeat(np.arange(len(per)), per)
            in_head = s < HEAD
            sums = lambda x: np.bincount(text, x, len(per))
            tail = np.flatnonzero(~in_head)
            order = tail[np.lexsort((h[tail], text[tail]))]
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])] if len(order) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order)))
            each = np.bincount(text[order][at], minlength=len(per))
            off = np.concatenate([[0], np.cumsum(per)])
            raw = s.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array([raw[2 * x : 2 * y] for x, y in zip(off, off[1:])], pa.binary()), pa.array(per, pa.int64()),
                    pa.array(sums(in_head & (v.counts[s] > 0)).astype(np.int64)), pa.array(sums(np.where(in_head, base[np.minimum(s, _SYMBOLS - 1)], 0.0))),
                    pa.array(sums(np.where(in_head, 0.0, room[np.maximum(s - HEAD, 0)]))), pa.array(sums(~in_head).astype(np.int64)),
                    C.lists(C.signed(h[order][at]), each, pa.int64()), C.lists(n, each, pa.int64()),
                ],
                names=_ENCODED,
            )

    return run


_ENCODED = ["row", "doc_id", "held_out", "symbols", "n_tokens", "known", "base", "room", "n_tail", "tail", "times"]
_ENCODED_SCHEMA = "row long, doc_id long, held_out boolean, symbols binary, n_tokens long, known long, base double, room double, n_tail long, tail array<long>, times array<long>"


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: (symbols, states)

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of symbol sequences: scaled forward recursion, all sequences a step at a time."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        flat, first = np.concatenate([texts[i] for i in order]).astype(np.int64), np.concatenate([[0], np.cumsum(size[order])])[:-1]
        live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
        out, a = np.zeros(len(texts)), None
        for t, n in enumerate(live.tolist()):
            a = (self.start if a is None else a[:n] @ self.move) * self.emit[flat[first[:n] + t]]
            c = a.sum(axis=1)
            a /= c[:, None]
            out[:n] += np.log10(c)
        back = np.empty(len(texts))
        back[order] = out
        return back

    def _ends(self, parts: list[np.ndarray], doc: np.ndarray, place: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch the scaled forward vector at the end of the one before it, and the backward vector at its own end.

        The steps of a stretch are one matrix, so that all stretches are multiplied side by side; the vectors then go from stretch to stretch.
        """
        k, inner = len(self.start), np.flatnonzero(place > 0)
        before, after = np.zeros((len(parts), k)), np.ones((len(parts), k))
        if not len(inner):
            return before, after
        size = np.array([len(parts[i]) for i in inner], np.int64)
        order = np.argsort(-size, kind="stable")
        first, flat = np.cumsum(size[order]) - size[order], np.concatenate([parts[inner[i]] for i in order]).astype(np.int64)
        live = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left").tolist()
        product = np.broadcast_to(np.eye(k, dtype=self.emit.dtype), (len(inner), k, k)).copy()
        for t, n in enumerate(live):
            e = self.emit[flat[first[:n] + t]]
            step = (product[:n].reshape(n * k, k) @ self.move).reshape(n, k, k) * (e / e.max(axis=1, keepdims=True))[:, None, :]
            product[:n] = step / step.sum(axis=(1, 2), keepdims=True) if t % 4 == 3 else step
        steps = np.zeros((len(parts), k, k))
        steps[inner[order]] = product
        at = np.searchsorted(doc, np.arange(len(many)))  # the first stretch of each text
        long = np.flatnonzero(many > 1)
        long = long[np.argsort(-many[long], kind="stable")]
        a = np.zeros((len(long), k))
        heads = [parts[i] for i in at[long]]
        for t in range(STRETCH):  # all of them are full
            e = self.emit[np.array([h[t] for h in heads], np.int64)]
            a = (self.start if t == 0 else a @ self.move) * e
            a = a / a.sum(axis=1, keepdims=True)
        left = np.searchsorted(-many[long], -np.arange(int(many.max()) + 1), side="left").tolist()  # texts with more than s stretches
        for s in range(1, int(many.max())):
            n = left[s]
            i = at[long[:n]] + s
            before[i] = a[:n]
            a = (a[:n, None, :] @ steps[i])[:, 0]
            a /= a.sum(axis=1, keepdims=True)
        for s in range(int(many.max()) - 1, 0, -1):
            i = at[long[: left[s]]] + s
            b = (steps[i] @ after[i][:, :, None])[:, :, 0]
            after[i - 1] = b / (before[i] * b).sum(axis=1, keepdims=True)
        return before, after

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of whole texts (forward-backward). Texts are worked on in stretches side by side, a step at a time, with the vectors that the rest of the text gives their ends."""
        k = len(self.start)
        many = np.array([-(-len(t) // STRETCH) for t in texts], np.int64)
        parts = [t[x : x + STRETCH] for t in texts for x in range(0, len(t), STRETCH)]
        doc = np.repeat(np.arange(len(texts)), many)
        place = np.arange(len(parts)) - np.repeat(np.cumsum(many) - many, many)
        before, after = self._ends(parts, doc, place, many)
        size = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(-size, kind="stable")
        before, after, inner = before[order].astype(self.emit.dtype), after[order].astype(self.emit.dtype), place[order] > 0
        first = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        flat = np.concatenate([parts[i] for i in order]).astype(np.int64)
        live = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left").tolist()
        alphas, probs, a = [], [], np.where(inner[:, None], before @ self.move, self.start)
        for t, n in enumerate(live):
            e = self.emit[flat[first[:n] + t]]
            a = (a if t == 0 else a[:n] @ self.move) * e
            c = a.sum(axis=1, keepdims=True)
            a = a / c
            alphas.append(a)
            probs.append(e / c)
        moves, gamma = np.zeros((k, k)), np.empty((len(flat), k), self.emit.dtype)
        beta = after[: live[-1]]
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            if t + 1 < len(live):
                m = live[t + 1]
                w = probs[t + 1] * beta
                moves += alphas[t][:m].T @ w
                beta = np.concatenate([w @ self.move.T, after[m:n]])
            gamma[first[:n] + t] = alphas[t] * beta
        moves += before[inner].T @ (probs[0] * beta)[inner]
        emits = np.stack([np.bincount(flat, gamma[:, j], _SYMBOLS) for j in range(k)], axis=1)
        return gamma[first[~inner]].sum(axis=0), moves * self.move, emits

    def better(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray) -> Model:
        s, m = starts + 1, moves + 1
        e = emits + PRIOR * unigram[:, None]
        return Model((s / s.sum()).astype(np.float32), (m / m.sum(axis=1, keepdims=True)).astype(np.float32), (e / e.sum(axis=0)).astype(np.float32))


def _held(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about so many tokens."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column("symbols").nbytes // 2
        if n >= tokens:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n or held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _expected(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        sums = None
        for b in _held(batches, 1 << 18):
            new = model.expected([np.frombuffer(raw, "<u2") for raw in b.column("symbols").to_pylist()])
            sums = new if sums is None else tuple(x + y for x, y in zip(sums, new))
        if sums is not None:
            starts, moves, emits = sums
            used = np.flatnonzero(emits.any(axis=1))
            ids = np.concatenate([used, _SYMBOLS + np.arange(STATES), [_SYMBOLS + STATES]])
            values = np.concatenate([emits[used], moves, starts[None]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(values[:, j], pa.float64()) for j in range(STATES))], names=["id", *_G])

    return run


_G = [f"g{j}" for j in range(STATES)]
_G_SCHEMA = "id int, " + ", ".join(f"{g} double" for g in _G)


def _start_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [np.bincount(x[x < START_SYMBOLS], minlength=START_SYMBOLS).astype("<i4").tobytes() for x in (np.frombuffer(raw, "<u2") for raw in b.column("symbols").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(rows, pa.binary())], names=["h", "counts"])


def start_sample(training: DataFrame) -> np.ndarray:
    """Counts of the first symbols of the ``START_TEXTS`` different texts with the smallest hashes, a row a text: the same ones whatever the layout."""
    hashed = training.select(F.xxhash64("symbols").alias("h"), "symbols")
    few = hashed.select("h").distinct().orderBy("h").limit(START_TEXTS)
    rows = hashed.join(F.broadcast(few), "h").mapInArrow(_start_counts, "h long, counts binary").groupBy("h").agg(F.min("counts").alias("counts")).orderBy("h").collect()  # START_TEXTS rows of 8 KB
    return np.stack([np.frombuffer(r.counts, "<i4") for r in rows]).astype(float) if rows else np.zeros((0, START_SYMBOLS))


def first_model(rows: np.ndarray, unigram: np.ndarray) -> Model:
    """States from clusters of the sample's counts: farthest texts first, then means."""
    share = (rows + unigram[:START_SYMBOLS] * 5) / (rows + unigram[:START_SYMBOLS] * 5).sum(axis=1, keepdims=True)
    root = np.sqrt(share)
    centres = root[[int(rows.sum(axis=1).argmax())]]
    while len(centres) < STATES:
        near = (root @ centres.T).max(axis=1)
        centres = np.concatenate([centres, root[[int(near.argmin())]]])
    for _ in range(10):
        own = (root @ centres.T).argmax(axis=1)
        centres = np.stack([root[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(STATES)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    emit = np.tile(unigram[:, None], (1, STATES))
    emit[:START_SYMBOLS] *= 0.3 + 0.7 * (centres.T**2) / np.maximum((unigram[:START_SYMBOLS] / unigram[:START_SYMBOLS].sum())[:, None], 1e-12)
    emit /= emit.sum(axis=0)
    move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    return Model(np.full(STATES, 1 / STATES, np.float32), move.astype(np.float32), emit.astype(np.float32))


def train(encoded: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts."""
    spark = encoded.sparkSession
    training = encoded.filter("not held_out").select("symbols")
    few = start_sample(training)
    unigram = v.unigram()
    if not len(few):
        return Model(np.full(STATES, 1 / STATES, np.float32), np.full((STATES, STATES), 1 / STATES, np.float32), np.tile(unigram[:, None], (1, STATES)).astype(np.float32))
    model = first_model(few, unigram)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        sums = training.select("symbols").mapInArrow(_expected(sent), _G_SCHEMA).groupBy("id").agg(*(F.sum(g).alias(g) for g in _G)).toArrow()  # a row a symbol: bounded
        ids = sums.column("id").to_numpy()
        values = np.zeros((_SYMBOLS + STATES + 1, STATES))
        values[ids] = np.stack([sums.column(g).to_numpy() for g in _G], axis=1)
        model = model.better(values[-1], values[_SYMBOLS:-1], values[:_SYMBOLS], unigram)
    return model


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for b in _held(batches, 1 << 21):
            score = model.log10([np.frombuffer(x, "<u2") for x in b.column("symbols").to_pylist()])
            keep = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "room", "n_tail"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(score)], names=[*keep, "model"])

    return run


def likelihoods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, of: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    C.prepare(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("held_out", C.crc_bucket(F.col("doc_id"), of) == fold)
    v, counts = vocabulary(slim.filter("not held_out"))
    encoded = slim.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_encoded(spark.sparkContext.broadcast(v)), _ENCODED_SCHEMA)
    encoded = C.saved(encoded, "encoded")
    model = train(encoded, v)

    words = encoded.select("row", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("row", F.col("w.tail").alias("h"), F.col("w.times").alias("times"))
    met = words.join(counts.hint("shuffle_hash"), "h").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("times").alias("seen"))
    met = C.saved(met.withColumnRenamed("row", "met_row"), "met")
    scored = encoded.drop("tail", "times").mapInArrow(_scored(spark.sparkContext.broadcast(model)), "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, room double, n_tail long, model double")
    both = scored.join(met, F.col("row") == F.col("met_row"), "left")
    logs, seen = F.coalesce("logs", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + seen).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tail") * F.lit(float(np.log10(v.total + v.distinct + 1)))).alias("base_score"),
        (F.col("model") + logs - F.col("room")).alias("score"),
    )
