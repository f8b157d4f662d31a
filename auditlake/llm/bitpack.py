"""Token ids in files of fixed-width packed bits.

A file holds the documents of one range of ids, ascending:

    magic "ALTB", then little-endian: u32 bits an id, u32 ids a block, u64 documents, u64 ids,
    i64[documents] ids of documents, u8[documents] 1 where that id is null,
    u64[documents + 1] places of the documents' first ids,
    u64[blocks + 1] byte offsets of the blocks,
    the blocks: each id in the fewest bits that the vocabulary needs, lowest bit first, a block padded to bytes.

The offsets let a reader fetch and unpack only the blocks of a span of ids. A
writer replaces a file as a whole, so a repeated task writes the same file again.

Defined cases: null and empty texts are the end id alone; repeated rows are
repeated documents, in the order of their texts; null ids come first; an empty
table gives no file and an empty result; very long texts are documents like all
others, in one file; other columns of the input are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import encode

BLOCK = 1 << 16
#: Bytes of ids after which a range goes on in another file.
FILE_BYTES = 16 << 20
_HEAD = struct.Struct("<4sIIQQ")
_MAGIC = b"ALTB"


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (unsigned 32-bit) as packed bits."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    each = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bits: each id is cut out of the 64-bit word that starts at its first byte."""
    if not n:
        return np.zeros(0, np.uint32)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    at = np.arange(n, dtype=np.int64) * bits
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def serialize(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if len(ids) and int(ids.max()) >= 1 << bits:
        raise ValueError(f"an id needs more than {bits} bits")
    body = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    return b"".join(
        [
            _HEAD.pack(_MAGIC, bits, block, len(doc_ids), len(ids)),
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            np.array([i is None for i in doc_ids], np.uint8).tobytes(),
            np.cumsum([0, *lengths]).astype("<u8").tobytes(),
            np.cumsum([0, *map(len, body)]).astype("<u8").tobytes(),
            *body,
        ]
    )


class Reader:
    """Random access to one file; ``file`` has seek and read."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, self.block, self.n_docs, self.n_ids = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != _MAGIC:
            raise ValueError("not a file of packed token ids")
        blocks = -(-self.n_ids // self.block)
        raw = self._read(_HEAD.size, 9 * self.n_docs + 8 * (self.n_docs + 1) + 8 * (blocks + 1))
        n = self.n_docs
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.starts = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, 9 * n + 8 * (n + 1)).astype(np.int64)
        self.data = _HEAD.size + len(raw)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, z = start // self.block, -(-stop // self.block)
        raw = self._read(self.data + int(self.offsets[a]), int(self.offsets[z] - self.offsets[a]))
        base = int(self.offsets[a])
        parts = [unpack(raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(a, z)]
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id, ids) of all documents, reading some blocks at a time."""
        k = 0
        while k < self.n_docs:
            z = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + ids_at_once, side="right")) - 1)
            ids, base = self.span(int(self.starts[k]), int(self.starts[z])), int(self.starts[k])
            for j in range(k, z):
                yield None if self.null[j] else int(self.doc_ids[j]), int(self.starts[j]), ids[int(self.starts[j]) - base : int(self.starts[j + 1]) - base]
            k = z


def _write(folder: str, tokenizer: str, end: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size, names, lengths, held = None, 0, 0, [], [], []
        for b in C.blocks(batches):
            ids, off = encode.encoder(tokenizer).flat(b.column("text"), end)
            parts, doc_ids = b.column("part").to_numpy(), b.column("doc_id").to_pylist()
            edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True]).tolist()
            for a, z in zip(edges, edges[1:]):
                if names and (parts[a] != part or size >= FILE_BYTES):
                    yield _stored(folder, part, seq, names, lengths, held, bits)
                    seq, size, names, lengths, held = seq + 1 if parts[a] == part else 0, 0, [], [], []
                part = int(parts[a])
                names += doc_ids[a:z]
                lengths += np.diff(off[a : z + 1]).tolist()
                held.append(ids[off[a] : off[z]].astype("<u2" if bits <= 16 else "<u4"))
                size += held[-1].nbytes
        if names:
            yield _stored(folder, part, seq, names, lengths, held, bits)

    return run


def _stored(folder: str, part: int, seq: int, names: list, lengths: list, held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Writes one file under a name of its own, then moves it in place: what a stopped task leaves is never read."""
    import uuid

    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    own, name = f"{base}/_{uuid.uuid4().hex}", f"part-{part:05d}-{seq:04d}.altb"
    with files.open_output_stream(own) as f:
        f.write(serialize(names, lengths, np.concatenate(held).astype(np.uint32), bits))
    files.move(own, f"{base}/{name}")
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_ids": pa.array([sum(lengths)], pa.int64())})


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents, ascending by id, to files in ``folder`` (a URI that all machines reach).

    Returns (part, file, start, n_ids): the files in order and the number of ids before each.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts, n = C.in_ranges(slim)
    dealt = parts.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    bits = width(encode.vocabulary(tokenizer))
    listing = C.saved(dealt.mapInArrow(_write(folder, tokenizer, end, bits), "part int, seq int, file string, n_ids long"), "listing")
    rows, start = [], 0
    for r in listing.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).orderBy("part").collect():  # a row a range: C.in_ranges bounds them
        rows.append((r.part, start))
        start += r.n_ids
    starts = spark.createDataFrame(rows, "part int, before long")
    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    here = listing.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(starts), "part")
    return here.select("part", F.concat(F.lit(f"{folder}/"), "file").alias("file"), (F.col("before") + F.col("earlier")).alias("start"), "n_ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for b in batches:
        for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
            files, path = fs.FileSystem.from_uri(file)
            with files.open_input_file(path) as f:
                rows = [(d, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in Reader(f).documents()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that write() lists."""
    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
