"""Reports as tables: cover, criteria, deviations, hints, practice, model comparison; evidence excerpts and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K
from . import evaluate as E
from . import rules as R


def excerpts(v: DataFrame, passages: DataFrame, n: int = 300) -> DataFrame:
    """(doc_id, nr, page, excerpt): the best candidate on a page that the evidence names, else the best of all."""
    named = R.page_numbers(F.col("evidence"))
    j = passages.join(v.select("doc_id", "nr", named.alias("named")), ["doc_id", "nr"]).withColumn("off", (~F.array_contains("named", F.col("page").cast("string"))).cast("int"))
    best = j.groupBy("doc_id", "nr").agg(F.min_by(F.struct("page", "text"), F.struct("off", "rank")).alias("b"))
    return best.select("doc_id", "nr", "b.page", F.substring("b.text", 1, n).alias("excerpt"))


def cover(v: DataFrame) -> DataFrame:
    """(doc_id, part, name, value): the cover of each document's report: key figures, shares of statuses, classes by status, counts of what is open."""
    k = E.kpis(v)
    ratios = ["deviation", "coverage", "conformity"]
    figures = k.select("doc_id", F.explode(F.map_from_arrays(F.array(*(F.lit(x) for x in ratios)), F.array(*(F.col(x) for x in ratios)))).alias("name", "value")).withColumn("part", F.lit("ratio"))
    total = F.col("n_e") + F.col("n_t") + F.col("n_a") + F.col("n_n")
    shares = k.select("doc_id", F.explode(F.map_from_arrays(F.array(*(F.lit(s) for s in "ETAN")), F.array(*(F.round(F.try_divide(F.col(f"n_{s.lower()}"), total), 6) for s in "ETAN")))).alias("name", "value")).withColumn("part", F.lit("status"))
    classes = E.model_status(v).filter("model_status is not null").groupBy("doc_id", F.concat_ws(" ", "klass", "model_status").alias("name")).agg(F.count("*").cast("double").alias("value")).withColumn("part", F.lit("class"))
    open_ = k.select("doc_id", F.lit("unrated").alias("name"), F.col("unrated").cast("double").alias("value"), F.lit("open").alias("part"))
    cols = ["doc_id", "part", "name", "value"]
    return figures.select(cols).unionByName(shares.select(cols)).unionByName(classes.select(cols)).unionByName(open_.select(cols))


def criteria_list(v: DataFrame, passages: DataFrame, criteria: DataFrame) -> DataFrame:
    """(doc_id, nr, title, chapter, status, evidence, excerpt): every criterion of every document, with its excerpt."""
    j = v.select("doc_id", "nr", "status", "evidence").join(F.broadcast(criteria.select("nr", "title", "chapter")), "nr", "left").join(excerpts(v, passages).drop("page"), ["doc_id", "nr"], "left")
    return j.select("doc_id", "nr", "title", "chapter", "status", "evidence", "excerpt")


def practice(v: DataFrame) -> DataFrame:
    """(doc_id, place, nr, placed, share): placement in the archive, notable ones first, then by share."""
    p = E.placement(v)
    w = Window.partitionBy("doc_id").orderBy((~F.col("placed").isin("gap", "rare")).cast("int"), F.desc("share"), "nr")
    return p.withColumn("place", F.row_number().over(w)).select("doc_id", "place", "nr", "placed", "share")


def reference_distribution(v: DataFrame) -> DataFrame:
    """(doc_id, nr, e, t, a): statuses of the references of the *other* documents that regulate a criterion."""
    r = v.filter("ref in ('E', 'T', 'A')")
    all_ = r.groupBy("nr").agg(*(F.count_if(F.col("ref") == s).alias(f"all_{s.lower()}") for s in "ETA"))
    j = v.select("doc_id", "nr", "ref").join(F.broadcast(all_), "nr", "left")
    return j.select("doc_id", "nr", *((F.coalesce(f"all_{s.lower()}", F.lit(0)) - F.when(F.col("ref") == s, 1).otherwise(0)).alias(s.lower()) for s in "ETA"))


def model_comparison(v: DataFrame) -> DataFrame:
    """(run, n, hits, match, rank, only_best, only_this): runs by exact match, the best one held against each other run on the same verdicts.

    Only verdicts that both runs rate count, as two runs share documents.
    """
    r = v.filter("ref is not null and status is not null and other is not null").select((F.col("status") == F.col("ref")).alias("first run"), (F.col("other") == F.col("ref")).alias("second run"), (F.col("ref") == "E").alias("always E"))
    names = ["first run", "second run", "always E"]
    hits = r.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"`{x}`")).alias(x) for x in names), *(F.count_if(F.col(f"`{x}`") & ~F.col(f"`{y}`")).alias(f"{x}|{y}") for x in names for y in names))
    each = hits.select("n", F.explode(F.array(*(F.struct(F.lit(x).alias("run"), F.col(f"`{x}`").alias("hits"), F.map_from_arrays(F.array(*(F.lit(y) for y in names)), F.array(*(F.col(f"`{x}|{y}`") for y in names))).alias("only"), F.map_from_arrays(F.array(*(F.lit(y) for y in names)), F.array(*(F.col(f"`{y}|{x}`") for y in names))).alias("other")) for x in names))).alias("s"))
    ranked = each.select("n", "s.*").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "run")))  # one row a run
    best = ranked.filter("rank = 1").select(F.col("run").alias("best"))
    return ranked.crossJoin(F.broadcast(best)).select("run", "n", "hits", F.round(F.try_divide(F.col("hits").cast("double"), F.col("n")), 6).alias("match"), "rank", F.try_element_at("other", F.col("best")).alias("only_best"), F.try_element_at("only", F.col("best")).alias("only_this"))


def reference_examples(v: DataFrame, passages: DataFrame, n: int = 3) -> DataFrame:
    """(nr, place, doc_id, status, page): examples of each criterion: one each of E, T and A, then the first others, up to ``n``.

    The passage is that on a page of the evidence that shares most words of five letters and more with the reason, one at least; no list of contents.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-zäöüß]{5,}"), 0))
    r = v.filter("ref in ('E', 'T', 'A') and reason <> ''").select("doc_id", "nr", F.col("ref").alias("status"), words(F.col("reason")).alias("w"), F.explode(F.transform(F.regexp_extract_all("evidence", F.lit("[0-9]+"), 0), lambda x: x.try_cast("int"))).alias("page"))
    p = passages.filter(~R.is_contents(F.col("text"))).select("doc_id", F.col("nr").alias("of"), "rank", "page", words(F.col("text")).alias("t"))
    shared = r.join(p, ["doc_id", "page"]).withColumn("k", F.size(F.array_intersect("w", "t"))).filter("k > 0")
    best = shared.groupBy("doc_id", "nr", "status").agg(F.min_by("page", F.struct((-F.col("k")).alias("k"), "page", "of", "rank")).alias("page"))
    kind = Window.partitionBy("nr", "status").orderBy("doc_id")
    # Whoever has n of its own kind before it can't be among the first n: tasks cut to n a kind before anything is exchanged.
    first = best.withColumn("k", F.row_number().over(kind)).filter(F.col("k") <= n)
    place = F.when(F.col("k") == 1, F.when(F.col("status") == "E", 0).when(F.col("status") == "T", 1).otherwise(2)).otherwise(3)
    ordered = first.withColumn("g", place).withColumn("place", F.row_number().over(Window.partitionBy("nr").orderBy("g", "doc_id")))
    return ordered.filter(F.col("place") <= n).select("nr", "place", "doc_id", "status", "page")


def violations(v: DataFrame, criteria: DataFrame) -> DataFrame:
    """(doc_id, nr, rule): what is wrong with a result: missing and unknown numbers, no legal status, N with a reason or evidence, a verdict without either, unrated ones by document."""
    docs = v.select("doc_id").distinct()
    of = lambda df, rule: df.select("doc_id", "nr", F.lit(rule).alias("rule"))
    known = criteria.select("nr")  # the catalogue: bounded
    missing = docs.crossJoin(F.broadcast(known)).join(v, ["doc_id", "nr"], "left_anti")
    unknown = v.join(F.broadcast(known), "nr", "left_anti")
    illegal = v.filter("status is null or status not in ('E', 'T', 'A', 'N')")
    full = v.filter("status = 'N' and (reason <> '' or evidence <> '')")
    rated = v.filter("status in ('E', 'T', 'A')")
    unrated = v.filter("cause <> '' and cause <> 'kein Kandidat'").groupBy("doc_id").agg(F.lit(None).cast("int").alias("nr"))
    parts = [(missing, "missing"), (unknown, "unknown"), (illegal, "illegal status"), (full, "N with a reason or evidence"), (rated.filter("trim(reason) = ''"), "no reason"), (rated.filter("trim(evidence) = ''"), "no evidence"), (unrated, "unrated")]
    out = of(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(of(*p))
    return out


def hints_of_both(read: DataFrame, noted: DataFrame) -> DataFrame:
    """(doc_id, nr, page, text, origin): hints of two routes; the second doesn't repeat criteria that the first has reported; of equal texts the first stays."""
    new = noted.join(read.select("doc_id", "nr").distinct(), ["doc_id", "nr"], "left_anti")
    both = read.select("doc_id", "nr", "page", "text", F.lit("read").alias("origin")).unionByName(new.select("doc_id", "nr", "page", "text", F.lit("noted").alias("origin")))
    key = F.array_join(R.words_of(F.col("text")), " ")
    w = Window.partitionBy("doc_id", "key").orderBy("nr", "page", "text")
    return both.withColumn("key", key).withColumn("k", F.row_number().over(w)).filter("k = 1").select("doc_id", "nr", "page", "text", "origin")


def run_sets(v: DataFrame) -> DataFrame:
    """(nr, only_in): criteria that only one of the two runs rates: the symmetric difference."""
    a, b = v.filter("status is not null").select("nr").distinct(), v.filter("p >= 0.985").select("nr").distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def common_documents(v: DataFrame) -> DataFrame:
    """doc_id of the documents that both runs have rated."""
    return v.filter("status is not null").select("doc_id").intersect(v.filter("p >= 0.5").select("doc_id"))


def corpus(v: DataFrame) -> DataFrame:
    """(nr, doc_id): union of the documents that regulate a criterion by reference and those the matrix of frequencies names, each once; the corpus is their union."""
    a = v.filter("ref in ('E', 'T', 'A')").select("nr", "doc_id")
    b = v.filter("other in ('E', 'T', 'A') and p < 0.2").select("nr", "doc_id")
    return a.unionByName(b).distinct()


def context(passages: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, nr, rank, text): each passage with the next ones of its criterion, ``n`` in all."""
    w = Window.partitionBy("doc_id", "nr").orderBy("rank").rowsBetween(0, n - 1)
    return passages.select("doc_id", "nr", "rank", F.array_join(F.collect_list("text").over(w), " ").alias("text"))


def density(passages: DataFrame) -> DataFrame:
    """(doc_id, nr, n, strong, pages, level): how well a criterion is covered: candidates, strong ones, pages."""
    g = passages.groupBy("doc_id", "nr").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= K.STRONG).alias("strong"), F.count_distinct("page").alias("pages"))
    return g.withColumn("level", F.when(F.col("strong") == 0, "marginal").when(F.col("strong") >= 3, "treated").otherwise("some"))
