"""Registered queries of the subpackage: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bitpack, byte_cnn, common, decontaminate, fill_middle, hmm_lm, iblt, langid_kn, line_dedup, packing, source_audit, subword_toxicity, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("node", "label")


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document under a hidden Markov model and under its unigram base."""
    return hmm_lm.likelihoods(_table(spark, sf_dir, "documents"))


def op3_invertible_bloom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with likenesses."""
    return iblt.fingerprints(_table(spark, sf_dir, "documents"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return byte_cnn.predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files of packed bits and read back from them."""
    files = bitpack.write(_table(spark, sf_dir, "documents"), common.scratch_dir(spark) + "/token-files", public_tokenizers.path("word_bpe_49k.json"), end=1)
    return bitpack.read_index(files)


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return subword_toxicity.predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pigeonhole_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with their edit distances."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid_kn.predict(_table(spark, sf_dir, "documents"))


def op9_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left after strings of 400 bytes that occur elsewhere are removed."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and the text rebuilt from that."""
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that set each apart."""
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents have."""
    docs = _table(spark, sf_dir, "documents")
    kept = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bagminhash": op1_bagminhash,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_invertible_bloom_sketch": op3_invertible_bloom_sketch,
    "op4_byte_cnn": op4_byte_cnn,
    "op5_bit_packed_ids": op5_bit_packed_ids,
    "op6_subword_toxicity": op6_subword_toxicity,
    "op7_pigeonhole_edit_matching": op7_pigeonhole_edit_matching,
    "op8_kneser_ney_language": op8_kneser_ney_language,
    "op9_minimum_bin_slack": op9_minimum_bin_slack,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_source_divergence": op12_source_divergence,
    "op13_line_dedup": op13_line_dedup,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op1_bagminhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, w, array_to_string(w, ' ') AS words FROM w),
c AS (SELECT words, min(doc_id) AS node, any_value(w) AS w FROM t GROUP BY words),
s AS (SELECT node, array_to_string(w[i : i + 4], ' ') AS s, count(*) AS n
      FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM c WHERE len(w) > 0) GROUP BY ALL),
z AS (SELECT node, sum(n) AS n FROM s GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS n FROM s a JOIN s b ON a.s = b.s AND a.node <> b.node GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON a = x.node JOIN z y ON b = y.node WHERE p.n >= 0.8 * (x.n + y.n - p.n)),
r AS (SELECT node, node AS other FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
g AS (SELECT node, min(other) AS group_id FROM r GROUP BY node)
SELECT t.doc_id, c.node AS copy_id, g.group_id FROM t JOIN c USING (words) JOIN g ON c.node = g.node""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256(concat('1:', coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
d AS (SELECT doc_id, t, w, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS h1, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS h2,
             ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM t),
c AS (SELECT doc_id, t, n, array_to_string(w[1 : least(h1, h2)], '') AS p, array_to_string(w[least(h1, h2) + 1 : greatest(h1, h2)], '') AS m, array_to_string(w[greatest(h1, h2) + 1 :], '') AS s,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 2) // (coalesce(n.n, 0) + 2 * l.v) AS p, 1 + 1000000000 * (k.c + 2) // (l.n + 2 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 10""",
    "op13_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT doc_id, t, l, list_transform(l, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k FROM d),
b AS (SELECT key FROM (SELECT doc_id, t, unnest(k) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(DISTINCT {'d': doc_id, 't': t}) >= 10),
u AS (SELECT doc_id, t, l, unnest(k) AS key, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM k),
m AS (SELECT u.doc_id, u.t, count(DISTINCT i) AS n_lines, count(DISTINCT i) FILTER (b.key IS NOT NULL) AS n_dropped,
             coalesce(array_to_string(list_transform(list_sort(list(DISTINCT {'i': i, 'l': line}) FILTER (b.key IS NULL)), lambda x: x.l), chr(10)), '') AS kept FROM u LEFT JOIN b USING (key) GROUP BY u.doc_id, u.t)
SELECT d.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN m ON d.doc_id IS NOT DISTINCT FROM m.doc_id AND d.t = m.t""",
}
