"""Bounded samples of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def held_out(doc_id, fold: int, of: int):
    """Rows of the held-out fold: crc32 of the id as text, modulo ``of``."""
    return C.crc_bucket(doc_id, of) == fold


#: Bytes of text that a sample has at most (the first text may be larger).
SAMPLE_BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, fold: int = 2, of: int = 4) -> list[tuple[str, int]]:
    """(text, label) of at most ``bound`` labelled rows and ``SAMPLE_BYTES`` outside the held-out fold, the same ones each time.

    Labels that are null are left out; of several labels of one id the largest holds.
    Repeated ids are rows of their own. Only ids, sizes and the sample's texts come to the driver, ``bound`` rows at most.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    picked = picked.filter(~held_out(F.col("doc_id"), fold, of)).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = texts.join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("text"))
    first = known.select("doc_id", "h", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(bound).collect()
    total, keep = 0, []
    for r in first:
        total += r.size
        if keep and total > SAMPLE_BYTES:
            break
        keep.append((r.doc_id, r.h))
    if not keep:
        return []
    ids = docs.sparkSession.createDataFrame(sorted(set(keep)), "doc_id long, h long")
    rows = known.join(F.broadcast(ids), ["doc_id", "h"], "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(len(keep)).collect()
    return [(r.text, r.y) for r in rows]


class Adam:
    """Adam steps on a dictionary of arrays."""

    def __init__(self, p: dict, rate: float):
        import numpy as np

        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        import numpy as np

        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
