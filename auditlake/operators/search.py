"""Retrieval: hybrid search of criteria over sections, and searches over stored vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K
from ..functions.columns import l2_normal, lexical_score, literal_score, padded_words
from . import rules as R
from . import text as T

DIM = 64
#: Characters of texts that are made to vectors at once: what a task holds does not depend on how full its batches are.
CHARS = 1 << 18


def vectors_of(texts) -> np.ndarray:
    """Stand-in for an embedding model: counts of character pairs in ``DIM`` buckets, of length 1 (0 for one character), a row a text."""
    texts = list(texts)
    out, first, held = np.zeros((len(texts), DIM)), 0, 0
    for i, t in enumerate(texts, 1):
        held += len(t or "")
        if held >= CHARS or i == len(texts):
            out[first:i], first, held = _vectors(texts[first:i]), i, 0
    return out


def _vectors(texts: list[str | None]) -> np.ndarray:
    codes = [np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32).astype(np.int64) for t in texts]
    sizes = np.array([max(len(c) - 1, 0) for c in codes], np.int64)
    pairs = np.concatenate([(c[:-1] * 31 + c[1:]) % DIM for c in codes if len(c) > 1] or [np.zeros(0, np.int64)])
    rows = np.repeat(np.arange(len(codes)), sizes)
    v = np.bincount(rows * DIM + pairs, minlength=len(codes) * DIM).reshape(len(codes), DIM).astype(float)
    return v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-10)


def vector(text: str | None) -> list[float]:
    return vectors_of([text])[0].tolist()


def embedded(text: str):
    """The vectors of a text column, in Arrow batches."""
    return F.pandas_udf(lambda texts: pd.Series(list(vectors_of(texts)), dtype=object), "array<double>")(F.col(text))


def cosines(text: Column, queries: list[str]) -> Column:
    """Cosine of a text and each query text: one matrix product for each batch; only the products leave Python."""
    q = vectors_of(queries).T
    return F.pandas_udf(lambda texts: pd.Series(list(vectors_of(texts) @ q), dtype=object), "array<double>")(text)


def terms_of(title: str, nr: int, terms: list[str], dictionary: bool = True) -> list[str]:
    """Terms of a criterion and those the dictionary adds, if its entry has the criterion's title."""
    more = K.DICTIONARY.get(nr) if dictionary else None
    return [*terms, *(more[1] if more and more[0] == title else [])]


def query_text(title: str, terms: list[str], prepared: str | None = None) -> str:
    """The prepared text, else title and terms."""
    return prepared or (f"{title}. {', '.join(terms)}" if terms else title)


def slots(n_sections: Column, n: int = K.CANDIDATES) -> Column:
    """Candidates that a document of that size may have."""
    return F.greatest(F.lit(n), F.least(F.lit(K.CANDIDATES_MAX), F.floor(n_sections / K.SECTIONS_A_SLOT))).cast("int")


def scored_sections(docs: DataFrame, weight: float = K.LEXICAL_WEIGHT, drop_contents: bool = True, least_chars: int = 0) -> DataFrame:
    """(doc_id, n_sections, section_idx, page, scores array<struct<nr, cos, lex, score>>): every section against every criterion, within the row.

    The catalogue is configuration and bounded; its terms are literals, so that the search is compiled. Lists of contents are left out.
    """
    parts = T.sectioned(docs)
    if least_chars:
        parts = parts.filter(F.length(F.trim("text")) >= least_chars)
    if drop_contents:
        parts = parts.filter(~R.is_contents(F.col("text")))
    parts = parts.withColumn("cos", cosines(F.col("text"), [query_text(t, w) for _, t, w in K.CATALOGUE]))
    # As the output of a generator, both forms of a text are made once and not once for a term.
    one = parts.select("doc_id", "n_sections", "section_idx", "page", "cos", F.explode(F.array(F.struct(F.lower("text").alias("low"), padded_words(F.col("text")).alias("pad")))).alias("x"))
    one = one.select("doc_id", "n_sections", "section_idx", "page", "cos", "x.low", "x.pad")
    lex = F.array(*(literal_score(F.col("low"), F.col("pad"), terms_of(t, nr, w)) for nr, t, w in K.CATALOGUE))
    both = one.select("doc_id", "n_sections", "section_idx", "page", F.arrays_zip(F.array(*(F.lit(nr) for nr, *_ in K.CATALOGUE)).alias("nr"), F.col("cos").alias("cos"), lex.alias("lex")).alias("z"))
    score = lambda x: F.struct(x["nr"].alias("nr"), x["cos"].alias("cos"), x["lex"].alias("lex"), ((1 - weight) * x["cos"] + weight * x["lex"]).alias("score"))
    return both.select("doc_id", "n_sections", "section_idx", "page", F.transform("z", score).alias("scores"))


def candidates(docs: DataFrame, min_score: float = K.MIN_SCORE, n: int = K.CANDIDATES, weight: float = K.LEXICAL_WEIGHT) -> DataFrame:
    """(doc_id, nr, rank, section_idx, cos, lex, score): the best sections of every document for every criterion; large documents have more.

    Texts and scores below the least stay out of the ranking.
    """
    s = scored_sections(docs, weight).select("doc_id", "n_sections", "section_idx", F.explode(F.filter("scores", lambda x: x["score"] >= min_score)).alias("x")).select("doc_id", "n_sections", "section_idx", "x.*")
    w = Window.partitionBy("doc_id", "nr").orderBy(F.round("score", 9).desc(), "section_idx")
    top = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= K.CANDIDATES_MAX).filter(F.col("rank") <= slots(F.col("n_sections"), n))
    return top.select("doc_id", "nr", "rank", "section_idx", F.round("cos", 6).alias("cos"), F.round("lex", 6).alias("lex"), F.round("score", 6).alias("score"))


def features(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, nr) and the twelve features of a verdict, for every criterion of every document with sections.

    The class, filled places of 30, scores of the first, three and ten candidates with fixed divisors, maxima of cosine and
    lexical score, shares with terms and with a strong score, the logarithm of the number of all sections.
    Sums are of millionths, so that their order doesn't matter.
    """
    size = T.sectioned(docs).groupBy("doc_id").agg(F.max("n_sections").alias("sections"))
    klass = lambda k: F.when(F.col("nr") % 3 == k, 1.0).otherwise(0.0)
    every = size.withColumn("nr", F.explode(F.array(*(F.lit(nr) for nr, *_ in K.CATALOGUE)))).withColumns({"mandatory": klass(0), "regular": klass(1), "optional": klass(2)})
    return _features(every, found)


def passage_features(passages: DataFrame, criteria: DataFrame) -> DataFrame:
    """The twelve features of each (doc_id, nr) with passages, from what a search has found: passages(doc_id, nr, rank, text, score), criteria(nr, klass, terms).

    ``score`` is the cosine; terms score as in the hybrid search. A criterion without terms or class has zeros there, a null text has no
    term. The number of sections is that of the document's passages. The catalogue is broadcast: a row a criterion.
    """
    text = F.coalesce("text", F.lit(""))
    j = passages.join(F.broadcast(criteria.select("nr", "klass", "terms")), "nr", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    lex = lexical_score(F.lower(text), padded_words(text), F.col("terms"))
    scored = j.select("doc_id", "nr", "klass", "rank", F.col("score").alias("cos"), lex.alias("lex"))
    found = scored.withColumn("score", F.round((1 - K.LEXICAL_WEIGHT) * F.col("cos") + K.LEXICAL_WEIGHT * F.col("lex"), 6))
    size = passages.groupBy("doc_id").agg(F.count("*").alias("sections"))
    klass = lambda k: F.when(F.col("klass") == k, 1.0).otherwise(0.0)
    every = found.groupBy("doc_id", "nr").agg(F.max("klass").alias("klass")).join(size, "doc_id").select("doc_id", "nr", "sections", *(klass(k).alias(k) for k in ("mandatory", "regular", "optional")))
    return _features(every, found)


def _features(every: DataFrame, found: DataFrame) -> DataFrame:
    """The twelve features of every(doc_id, nr, sections, mandatory, regular, optional) from found(doc_id, nr, rank, score, cos, lex)."""
    millionths = F.round(F.col("score") * 1_000_000).cast("long")
    top = lambda k, name: F.coalesce(F.sum(F.when(F.col("rank") <= k, millionths)), F.lit(0)).alias(name)
    agg = found.groupBy("doc_id", "nr").agg(F.count("*").alias("n"), top(1, "s1"), top(3, "s3"), top(10, "s10"), F.max("cos").alias("c"), F.max("lex").alias("l"), F.count_if(F.col("lex") > 0).alias("t"), F.count_if(F.col("score") >= K.STRONG).alias("g"))
    return every.join(agg, ["doc_id", "nr"], "left").na.fill(0, ["n", "s1", "s3", "s10", "c", "l", "t", "g"]).select(
        "doc_id", "nr", "mandatory", "regular", "optional", F.round(F.col("n") / 30.0, 6).alias("filled"), (F.col("s1") / 1e6).alias("first"),
        (F.floor((2 * F.col("s3") + 3) / 6) / 1e6).alias("three"), (F.floor((F.col("s10") + 5) / 10) / 1e6).alias("ten"), F.col("c").alias("max_cos"), F.round("l", 6).alias("max_lex"),
        F.round(F.col("t") / 30.0, 6).alias("with_terms"), F.round(F.col("g") / 30.0, 6).alias("strong"), F.round(F.log1p(F.col("sections").cast("double")), 6).alias("log_sections"),
    )


def residual_sections(docs: DataFrame, found: DataFrame, n: int = K.RESIDUAL_SECTIONS) -> DataFrame:
    """(doc_id, section_idx, n_chars): the longest sections that no criterion has found. A table has no order: sort by section_idx where the document's is wanted."""
    hit = found.select("doc_id", "section_idx").distinct()
    left = T.sections(docs).select("doc_id", "section_idx", F.length("text").alias("n_chars")).join(hit, ["doc_id", "section_idx"], "left_anti")
    w = Window.partitionBy("doc_id").orderBy(F.desc("n_chars"), "section_idx")
    return left.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")


def mean_similarity(docs: DataFrame) -> DataFrame:
    """(doc_id, mean_cos, class): mean cosine of all sections and criteria and the class of the document's quality."""
    c = cosines(F.col("text"), [query_text(t, w) for _, t, w in K.CATALOGUE])
    parts = T.sections(docs).filter(~R.is_contents(F.col("text"))).select("doc_id", c.alias("c"))
    m = parts.groupBy("doc_id").agg((F.sum(F.aggregate("c", F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size("c"))).alias("m"))
    k = F.when(F.col("m") < K.QUALITY_WEAK, "weak").when(F.col("m") < K.QUALITY_MEDIUM, "medium").otherwise("good")
    return m.select("doc_id", F.round("m", 6).alias("mean_cos"), k.alias("class"))


def archive_passages(docs: DataFrame, min_score: float = K.ARCHIVE_MIN_SCORE, n: int = K.ARCHIVE_N, weight: float = K.ARCHIVE_WEIGHT, per_doc: int = K.ARCHIVE_PER_DOC, only: str | None = None) -> DataFrame:
    """(nr, rank, doc_id, section_idx, score): the best sections of the archive for every criterion, by hybrid score, at most ``per_doc`` of a document.

    The archive has sections of 120 characters on that are no list of contents. ``only`` keeps one document. The best of a
    document are found first, then the best of all: the ranking keeps ``n`` rows a task before anything is shuffled.
    """
    s = scored_sections(docs, weight, least_chars=K.ARCHIVE_MIN_CHARS)
    if only is not None:
        s = s.filter(F.col("doc_id") == F.lit(only))
    hits = s.select("doc_id", "section_idx", F.explode(F.filter("scores", lambda x: x["score"] >= min_score)).alias("x")).select("doc_id", "section_idx", "x.nr", F.round("x.score", 9).alias("s"))
    own = Window.partitionBy("nr", "doc_id").orderBy(F.desc("s"), "section_idx")
    all_ = Window.partitionBy("nr").orderBy(F.desc("s"), "doc_id", "section_idx")
    best = hits.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= per_doc)
    return best.withColumn("rank", F.row_number().over(all_)).filter(F.col("rank") <= n).select("nr", "rank", "doc_id", "section_idx", F.round("s", 6).alias("score"))


def statement_references(statements: DataFrame, criteria: DataFrame, least: float = K.CROSS_MIN, n: int = K.CROSS_N) -> DataFrame:
    """(nr, rank, other, pos, cos): for every criterion the nearest statements of others that have one of its terms.

    Terms of four characters on filter, if the criterion has any; (nr, title, terms) are bounded and go to the tasks with their
    vectors. A batch of statements meets them in one matrix product, each text once, and ``n`` of it for each criterion go on.
    """
    long_ = F.transform(F.filter("terms", lambda t: F.length(t) >= K.CROSS_TERM), lambda t: F.lower(t)).alias("long")
    rows = [r for r in criteria.select("nr", "title", "terms", long_).collect() if r.nr is not None and r.long is not None]
    q = vectors_of([query_text(r.title, r.terms) for r in rows]).T
    every = sorted({t for r in rows for t in r.long})
    of = [[every.index(t) for t in r.long] for r in rows]
    none = -(1 << 63)
    s = statements.filter("nr is not null").select(F.col("nr").cast("int").alias("other"), F.coalesce(F.col("pos").cast("long"), F.lit(none)).alias("pos"), F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))

    def run(batches):
        for b in batches:
            code, texts = pd.factorize(b.text)
            low = b.low.to_numpy()[np.unique(code, return_index=True)[1]]
            cos = np.round(vectors_of(texts) @ q, 9)
            has = np.array([[t in x for t in every] for x in low], bool).reshape(len(low), len(every))
            other, pos = b.other.to_numpy(), b.pos.to_numpy()
            for k, (r, terms) in enumerate(zip(rows, of)):
                ok = (cos[:, k] >= least) & (has[:, terms].any(axis=1) if terms else True)
                i = np.flatnonzero(ok[code] & (other != r.nr))
                c = cos[code[i], k]
                best = np.lexsort((pos[i], -c))[:n]
                if len(best):
                    yield pd.DataFrame({"nr": r.nr, "other": other[i[best]], "pos": pos[i[best]], "cos": c[best]})

    j = s.mapInPandas(run, "nr int, other int, pos long, cos double").withColumn("pos", F.when(F.col("pos") != none, F.col("pos")).cast(dict(statements.dtypes)["pos"]))
    w = Window.partitionBy("nr").orderBy(F.desc("cos"), "pos")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("nr", "rank", "other", "pos", F.round("cos", 6).alias("cos"))


# --------------------------------------------------------------------------- stored vectors

#: Bytes of query vectors that one scan of the rows works on.
QUERY_BYTES = 64 << 20
#: Products of rows and queries that a task works on at once, and hits that wait in it until the best are taken.
CELLS, WAITING = 1 << 20, 1 << 18


def _normal(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1; rows without an id or a whole vector are left out."""
    v = vectors.filter("vec_id is not null and embedding is not null").filter(~F.exists("embedding", lambda x: x.isNull()))
    return v.select("vec_id", "label", l2_normal(F.col("embedding")).alias("v"))


def _blocks(rows: DataFrame, every: int):
    """The stated query set, every row whose id is divisible by ``every``, in blocks of bounded size, as broadcasts (ids, labels, matrix)."""
    queries = rows.filter(F.col("vec_id") % every == 0)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    k = max(1, -(-size.n * (size.d or 1) * 8 // QUERY_BYTES))
    for i in range(k if size.n else 0):
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(k)) == i).orderBy("vec_id").toPandas()
        if len(got):
            yield rows.sparkSession.sparkContext.broadcast((got.vec_id.to_numpy(), got.label.to_numpy(), np.stack(got.v.to_numpy())))


def _pieces(batches, queries: int):
    """Batches in pieces of so many rows that their products with all queries are bounded, however many queries there are."""
    rows = max(1, CELLS // max(queries, 1))
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


_HIT = "query_id long, query_label int, vec_id long, label int, cos double"


def best_hits(vectors: DataFrame, least: float, n: int, foreign: bool, per_label: bool = False, every: int = 100) -> DataFrame:
    """(query_id, query_label, vec_id, label, cos): the ``n`` best rows from ``least`` on of every query (with ``per_label`` of every query and label), for each task of the scan.

    ``foreign``: rows of other labels only, else all but the query itself. One scan for each block of queries; what leaves a
    task is bounded by the queries and not by the rows.
    """
    rows = _normal(vectors)

    def task(sent):
        def run(batches):
            ids, labels, q = sent.value
            by = ["query_id", "label"] if per_label else ["query_id"]
            held, waiting = [], 0

            def best():
                """The best of all that wait, in the order of the final ranking."""
                all_ = pd.concat(held).sort_values(["query_id", "s", "vec_id"], ascending=[True, False, True], kind="stable")
                return all_.groupby(by, sort=False).head(n)

            for b in _pieces(batches, len(ids)):
                cos = np.round(np.stack(b.v.to_numpy()) @ q.T, 12)
                own = b.label.to_numpy()[:, None] == labels if foreign else b.vec_id.to_numpy()[:, None] == ids
                i, j = np.nonzero((cos >= least) & ~own)
                held.append(pd.DataFrame({"query_id": ids[j], "query_label": labels[j], "vec_id": b.vec_id.to_numpy()[i], "label": b.label.to_numpy()[i], "cos": cos[i, j], "s": np.round(cos[i, j], 9)}))
                waiting += len(i)
                if waiting > WAITING:
                    held, waiting = [best()], 0
            if held:
                yield best().drop(columns="s")

        return run

    parts = [rows.mapInPandas(task(sent), _HIT) for sent in _blocks(rows, every)]
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], _HIT)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("s", F.round("cos", 9))


def archive_search(vectors: DataFrame, least: float = K.ARCHIVE_MIN_SCORE) -> DataFrame:
    """Top hits of every query, at most one of each document: rank within the document, then over all."""
    hits = best_hits(vectors, least, K.ARCHIVE_PER_DOC, foreign=False, per_label=True)
    own, all_ = Window.partitionBy("query_id", "label").orderBy(F.desc("s"), "vec_id"), Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    top = hits.withColumn("own", F.row_number().over(own)).filter(F.col("own") <= K.ARCHIVE_PER_DOC).withColumn("rank", F.row_number().over(all_)).filter(F.col("rank") <= K.ARCHIVE_N)
    return top.select("query_id", "rank", "vec_id", "label", F.round("cos", 6).alias("cos"))


def cross_references(vectors: DataFrame, least: float = K.CROSS_MIN) -> DataFrame:
    """Top hits of every query among the statements of others."""
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    hits = best_hits(vectors, least, K.CROSS_N, foreign=True)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= K.CROSS_N).select("query_id", "rank", "vec_id", "label", F.round("cos", 6).alias("cos"))


def best_pairs(vectors: DataFrame, least: float = K.PAIR_MIN, n: int = K.PAIR_MAX) -> DataFrame:
    """(query_id, vec_id, cos): the best counterpart of every query in another document, the best pairs first."""
    best = best_hits(vectors, least, 1, foreign=True).groupBy("query_id").agg(F.min_by(F.struct("vec_id", "cos", "s"), F.struct((-F.col("s")).alias("s"), "vec_id")).alias("b"))
    return best.orderBy(F.col("b.s").desc(), "query_id").limit(n).select("query_id", F.col("b.vec_id").alias("vec_id"), F.round(F.col("b.cos"), 6).alias("cos"))


def comparable(vectors: DataFrame, least: float = K.PAIR_MIN) -> DataFrame:
    """(query_label, queries, comparable): of each document's queries, how many have a counterpart elsewhere; counted before anything is filtered."""
    rows = _normal(vectors).filter("vec_id % 100 = 0").groupBy(F.col("label").alias("query_label")).agg(F.count("*").alias("queries"))
    hit = best_hits(vectors, least, 1, foreign=True).select("query_id", "query_label").distinct().groupBy("query_label").agg(F.count("*").alias("comparable"))
    return rows.join(hit, "query_label", "left").na.fill(0, ["comparable"])


def _label_maxima(vectors: DataFrame) -> DataFrame:
    """(kind, id, own, other, best): best match of each row among the queries of each label ('row'), and of each query among a task's rows of each label ('query'); never with itself."""
    rows = _normal(vectors)

    def task(sent):
        def run(batches):
            ids, labels, q = sent.value
            order = np.argsort(labels, kind="stable")
            ids, labels, q = ids[order], labels[order], q[order]
            kinds, first = np.unique(labels, return_index=True)
            best: dict[int, np.ndarray] = {}
            for b in _pieces(batches, len(ids)):
                cos = np.stack(b.v.to_numpy()) @ q.T
                cos[b.vec_id.to_numpy()[:, None] == ids] = -np.inf
                top, own = np.maximum.reduceat(cos, first, axis=1), b.label.to_numpy()
                i, j = np.nonzero(top > -np.inf)
                yield pd.DataFrame({"kind": "row", "id": b.vec_id.to_numpy()[i], "own": own[i], "other": kinds[j], "best": top[i, j]})
                for k in np.unique(own):
                    best[k] = np.maximum(best.get(k, -np.inf), cos[own == k].max(axis=0))
            for k, x in best.items():
                ok = x > -np.inf
                yield pd.DataFrame({"kind": "query", "id": ids[ok], "own": labels[ok], "other": k, "best": x[ok]})

        return run

    parts = [rows.mapInPandas(task(sent), "kind string, id long, own int, other int, best double") for sent in _blocks(rows, 100)]
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], "kind string, id long, own int, other int, best double")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "id", "own", "other").agg(F.max("best").alias("best"))


def document_ranking(vectors: DataFrame, exclude: int | None = None) -> DataFrame:
    """(query_label, label, forward, backward, raw, strong, size, rank): the documents most like each document's queries, both ways.

    Forward: mean over the queries of the best match in the other document. Backward: mean over that document's sections of the
    best match among the queries, less what is usual: the mean of the section's best matches among the queries of all
    other documents (0 without others). The rank is by the mean of both; ``raw`` has no usual match taken off.
    ``exclude`` takes one document out of list and usual matches. Only maxima leave the scan, never pairs.
    """
    m = _label_maxima(vectors).filter(F.col("own") != F.col("other"))
    if exclude is not None:
        m = m.filter((F.col("own") != exclude) & (F.col("other") != exclude))
    forward = m.filter("kind = 'query'").groupBy(F.col("own").alias("query_label"), F.col("other").alias("label")).agg(F.avg("best").alias("forward"), F.count_if(F.col("best") >= K.PAIR_MIN).alias("strong"))
    row = m.filter("kind = 'row'").select("id", F.col("own").alias("label"), F.col("other").alias("query_label"), "best")
    total = row.groupBy("id").agg(F.sum("best").alias("total"), F.count("*").alias("n"))
    usual = F.coalesce(F.try_divide(F.col("total") - F.col("best"), F.col("n") - 1), F.lit(0.0))
    backward = row.join(total, "id").groupBy("label", "query_label").agg(F.avg(F.col("best") - usual).alias("backward"), F.avg("best").alias("back"), F.count("*").alias("size"))
    j = forward.join(backward, ["label", "query_label"]).withColumn("value", (F.col("forward") + F.col("backward")) / 2)
    w = Window.partitionBy("query_label").orderBy(F.round("value", 9).desc(), "label")  # one row a document of the archive
    return j.withColumn("rank", F.row_number().over(w)).select("query_label", "label", F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward"), F.round((F.col("forward") + F.col("back")) / 2, 6).alias("raw"), "strong", "size", "rank")


def pair_summary(judged: DataFrame) -> DataFrame:
    """(doc_id, agreement, unrated, identical, similar, different, unrelated): judged(doc_id, value 0..100 or null) of pairs; unrated pairs don't count as 0."""
    v = F.col("value")
    # The mean is rounded in whole numbers, half up, so that no representation of a half decides.
    mean = F.expr("try_divide((20000 * sum(value) + count(value)) div nullif(2 * count(value), 0), 1000000.0D)")
    return judged.groupBy("doc_id").agg(
        mean.alias("agreement"), F.count_if(v.isNull()).alias("unrated"), F.count_if(v >= 90).alias("identical"), F.count_if((v >= 60) & (v < 90)).alias("similar"),
        F.count_if((v >= 25) & (v < 60)).alias("different"), F.count_if(v < 25).alias("unrelated"),
    )
