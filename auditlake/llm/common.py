"""Shared pieces: shared scratch tables, Arrow batches of texts, vectorised hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import package

#: Bytes of text that a task works on at once, and of the Arrow batches that it gets.
BLOCK_BYTES, BATCH_BYTES = 1 << 19, 2 << 20
_M64 = (1 << 64) - 1
#: Shuffle files go when the query that made them ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# --------------------------------------------------------------------------- scratch


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names.

    Only on one machine (tests), where none is named, is a local temporary folder
    taken; a cluster that names none is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "auditlake-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/auditlake-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of saved() that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors and keeps Arrow batches small: long texts must not add up to gigabytes."""
    package.send(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``docs`` does not have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_of(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


# --------------------------------------------------------------------------- batches


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices record batches so that each slice has about ``limit`` bytes of text, one row at least."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        edges = [0, *cuts.tolist(), n]
        for a, z in zip(edges, edges[1:]):
            yield b.slice(a, z - a)
    trimmed()


def trimmed() -> None:
    """Gives memory that is free back to the machine: workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def joined(texts: pa.Array, sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a block as one byte array, each followed by ``sep`` (null: empty); offsets of their starts and the end."""
    arr = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.binary_join_element_wise(arr, pa.scalar(b"", pa.large_binary()), pa.scalar(sep, pa.large_binary()))
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


# --------------------------------------------------------------------------- hashing


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), in place on a copy."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & _M64], np.uint64))[0])


def _table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_VALUES = _table(77)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[_LOWER]
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5851F42D4C957F2D | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base & _M64, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    solid = np.zeros(len(buf) + 2, np.int8)
    solid[1:-1] = ~WHITE[buf]
    d = np.diff(solid)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER_VALUES) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z (or by other values of bytes): polynomial over random byte values from prefix sums."""
    n = len(buf)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(values[buf] * powers(_BASE, n), out=c[1:])
    h = (c[ends] - c[starts]) * powers(_INV, n + 1)[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes) of the words of a block and the number of words of each text."""
    buf, off = joined(texts)
    starts, ends = word_spans(buf)
    per = np.diff(np.searchsorted(starts, off))
    return buf, starts, ends, word_hashes(buf, starts, ends), per


def shingles(hashes: np.ndarray, per: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and the index of the text of each.

    A text of 1 to k-1 words has one shingle of all its words; an empty one has none.
    """
    total = len(hashes)
    doc = np.repeat(np.arange(len(per)), per)
    first = np.cumsum(per) - per
    left = first[doc] + per[doc] - np.arange(total)  # words from here to the end of the text
    take = (left >= k) | ((np.arange(total) == first[doc]) & (per[doc] < k))
    at = np.flatnonzero(take)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        out += np.where(left[at] > j, padded[at + j], np.uint64(0)) * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) & _M64)
        out = mix64(out) if j == k - 1 else out ^ (out >> np.uint64(29))
    return out, doc[at]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, per: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose i-th list has the next per[i] values."""
    off = np.zeros(len(per) + 1, np.int32)
    np.cumsum(per, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


# --------------------------------------------------------------------------- ranges of ids

#: Text bytes that one range of ids should have.
RANGE_BYTES = 8 << 20
_NULL_ID = -(2**63)


def in_ranges(docs: DataFrame, target: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """docs(doc_id long, text string) with ``part``, the number of the range that the row is in, and the number of ranges.

    Rows ascend with ``part`` by (doc_id, null first). Bounds come from approximate
    quantiles of the ids alone, so no text is read twice for them. An id that fills
    ranges alone (or null) is a range of its own, dealt on by the hash of the text to
    as many parts as its bytes need. Ranges are ``target`` bytes on average, larger
    beyond 20,000 of them.
    """
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = max(1, min(size.n, -(-(size.b or 0) // target), 20_000))
    cuts = list(map(int, docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    alone = {a for a, b in zip(cuts, cuts[1:]) if a == b and a < 2**63 - 1}
    bounds = np.array(sorted({*cuts, *(a + 1 for a in alone), _NULL_ID + 1}), np.int64)
    sent = spark.sparkContext.broadcast(bounds)

    def part(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(sent.value, ids.to_numpy(), side="right"), dtype="int32")

    ranged = docs.withColumn("part", F.pandas_udf(part, "int")(F.coalesce("doc_id", F.lit(_NULL_ID))))
    hot = [0, *(int(np.searchsorted(bounds, a, side="right")) for a in alone)]
    shares: dict[int, int] = {}
    if n > 1:
        ids = F.col("doc_id").isNull() | F.col("doc_id").isin(sorted(alone)) if alone else F.col("doc_id").isNull()
        sizes = docs.filter(ids).groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("b")).collect()  # at most as many rows as bounds
        for r in sizes:
            k = hot[0] if r.doc_id is None else int(np.searchsorted(bounds, r.doc_id, side="right"))
            shares[k] = max(1, -(-(r.b or 0) // target))
    room = np.ones(len(bounds) + 1, np.int64)
    for k, m in shares.items():
        room[k] = m
    first = np.cumsum(room) - room
    if shares:
        table = spark.sparkContext.broadcast((first.astype(np.int32), room.astype(np.int32)))

        def spread(parts, hashes):
            import pandas as pd

            f, r = table.value
            p = parts.to_numpy()
            return pd.Series(f[p] + hashes.to_numpy() % r[p], dtype="int32")

        ranged = ranged.withColumn("part", F.pandas_udf(spread, "int")("part", F.xxhash64("text").bitwiseAND((1 << 31) - 1)))
    return ranged, int(room.sum())
