"""Key figures of audits and their evaluation against a reference: one fact table of verdicts, grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K
from .. import words as L
from ..functions import statistics as ST
from ..functions.columns import share

STATUSES = ["E", "T", "A", "N"]


def model_status(v: DataFrame) -> DataFrame:
    """Adds flagged and model_status: a status A that a sign set keeps what the model said before."""
    flagged = (F.col("status") == "A") & F.col("before").isNotNull() & (F.col("before") != "A")
    return v.withColumn("flagged", F.coalesce(flagged, F.lit(False))).withColumn("model_status", F.when(F.col("flagged"), F.col("before")).otherwise(F.col("status")))


def kpis(v: DataFrame, criteria: int = K.CRITERIA) -> DataFrame:
    """Counts by model status, regulated, deviation, coverage, conformity, marked, of every document."""
    n = {s: F.count_if(F.col("model_status") == s) for s in STATUSES}
    out = model_status(v).groupBy("doc_id").agg(*(n[s].alias(f"n_{s.lower()}") for s in STATUSES), F.count_if(F.col("status").isNull()).alias("unrated"), F.count_if("flagged").alias("marked"))
    out = out.withColumn("regulated", F.col("n_e") + F.col("n_t") + F.col("n_a"))
    return out.withColumns({"deviation": share(F.col("n_a") + 0.5 * F.col("n_t"), F.col("regulated")), "coverage": share(F.col("regulated"), F.lit(criteria)), "conformity": share(F.col("n_e"), F.col("regulated"))})


def by_class(v: DataFrame) -> DataFrame:
    """Status by class, all cells present."""
    full = v.sparkSession.createDataFrame([(k,) for k in ("mandatory", "regular", "optional")], "klass string")
    table = model_status(v).groupBy("klass").pivot("model_status", STATUSES).count()
    return full.join(table, "klass", "left").na.fill(0, STATUSES).select("klass", *(F.col(s).alias(f"n_{s.lower()}") for s in STATUSES))


def why_not(v: DataFrame) -> DataFrame:
    """Of every document, how many criteria are not specified by the model, without a candidate, or unrated for another cause."""
    return v.groupBy("doc_id").agg(
        F.count_if((F.col("status") == "N") & (F.col("cause") == "")).alias("by_model"), F.count_if(F.col("cause") == "kein Kandidat").alias("no_candidate"), F.count_if(~F.col("cause").isin("", "kein Kandidat")).alias("error"),
    )


def failures(v: DataFrame) -> DataFrame:
    """Of every document, how many calls found no connection, how many verdicts are unrated, and how many had no candidate."""
    return v.groupBy("doc_id").agg(
        F.count_if(F.contains(F.lower("cause"), F.lit(L.CONNECTION_FAILED))).alias("connection"), F.count_if(~F.col("cause").isin("", "kein Kandidat")).alias("unrated"), F.count_if(F.col("cause") == "kein Kandidat").alias("no_candidate"),
    )


def confusion(v: DataFrame) -> DataFrame:
    """Reference by model status ('-' where there is none)."""
    return model_status(v).filter("ref is not null").groupBy("ref", F.coalesce("model_status", F.lit("-")).alias("found")).agg(F.count("*").alias("n"))


def regulated_scores(v: DataFrame) -> DataFrame:
    """Precision, recall and F1 of 'regulated', exact hits, for everything, every class and every document in one pass."""
    m = model_status(v).filter("ref is not null").select("doc_id", "klass", (F.col("ref") != "N").alias("want"), F.coalesce(F.col("model_status") != "N", F.lit(False)).alias("got"), F.coalesce(F.col("ref") == F.col("model_status"), F.lit(False)).alias("hit"))
    g = m.groupingSets([[], ["klass"], ["doc_id"]], "klass", "doc_id").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if(F.col("want") & F.col("got")).alias("tp"), F.count_if(~F.col("want") & F.col("got")).alias("fp"), F.count_if(F.col("want") & ~F.col("got")).alias("fn")
    )
    precision, recall = (F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    out = g.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumns({"f1": F.round(f1, 6), "precision": F.round("precision", 6), "recall": F.round("recall", 6), "match": share(F.col("hits"), F.col("n"))}).drop("level")


def kpi_deltas(v: DataFrame, criteria: int = K.CRITERIA) -> DataFrame:
    """(doc_id, hits, total, match, d_deviation, d_coverage, d_conformity): a document's exact hits over all criteria, and its key figures less those of its reference.

    A criterion that has neither a status nor a reference is a hit. Differences have 4 digits, half away from zero, and are null where one
    side has no regulated criterion; they are taken between figures of 6 digits, in whole millionths.
    """
    m = model_status(v)
    n = lambda c, s: F.count_if(F.col(c) == s)
    sides = {"found": "model_status", "want": "ref"}
    g = m.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("ref").eqNullSafe(F.col("model_status"))).alias("same"), *(n(c, s).alias(f"{side}_{s.lower()}") for side, c in sides.items() for s in "ETA"))
    micro = lambda a, b: F.round(share(a, b) * 1_000_000).cast("long")
    for side in sides:
        e, t, a = (F.col(f"{side}_{s}") for s in "eta")
        regulated = e + t + a
        g = g.withColumns({f"{side}_deviation": micro(a + 0.5 * t, regulated), f"{side}_coverage": micro(regulated, F.lit(criteria)), f"{side}_conformity": micro(e, regulated)})
    hits = F.col("same") + criteria - F.col("rows")
    delta = lambda name: F.col(f"found_{name}") - F.col(f"want_{name}")
    four = lambda d: F.signum(d) * F.floor((F.abs(d) + 50) / 100) / 10_000
    return g.select("doc_id", hits.alias("hits"), F.lit(criteria).alias("total"), share(hits, F.lit(criteria)).alias("match"), *(four(delta(x)).alias(f"d_{x}") for x in ("deviation", "coverage", "conformity")))


def flagging(v: DataFrame) -> DataFrame:
    """(ref_a, found_a, marked, marked_a, per_document), one row: references A, those that stand as A in the result, flags, flags on a reference A, flags a document (0 without documents)."""
    m = model_status(v)
    a = F.coalesce(F.col("ref") == "A", F.lit(False))
    g = m.agg(F.count_if(a).alias("ref_a"), F.count_if(a & (F.col("status") == "A")).alias("found_a"), F.count_if("flagged").alias("marked"), F.count_if(a & F.col("flagged")).alias("marked_a"), F.count_distinct("doc_id").alias("documents"))
    return g.select("ref_a", "found_a", "marked", "marked_a", F.coalesce(share(F.col("marked"), F.col("documents")), F.lit(0.0)).alias("per_document"))


def baselines(v: DataFrame) -> DataFrame:
    """Exact match of always E and always N."""
    return v.filter("ref is not null").agg(share(F.count_if(F.col("ref") == "E"), F.count("*")).alias("always_e"), share(F.count_if(F.col("ref") == "N"), F.count("*")).alias("always_n"))


def mcnemar(v: DataFrame) -> DataFrame:
    """Paired test of two runs on raw statuses: both right, one alone, none, chi-square with continuity and its p, exact binomial p, whether the difference is significant (by the exact p below 25 differing cases)."""
    right, other = F.coalesce(F.col("status") == F.col("ref"), F.lit(False)), F.coalesce(F.col("other") == F.col("ref"), F.lit(False))
    c = v.filter("ref is not null").agg(F.count_if(right & other).alias("both"), F.count_if(right & ~other).alias("only_a"), F.count_if(~right & other).alias("only_b"), F.count_if(~right & ~other).alias("neither"))
    a, b = F.col("only_a"), F.col("only_b")
    gap = F.greatest(F.abs(a - b) - 1, F.lit(0)).cast("double")
    chi2 = F.coalesce(F.try_divide(gap * gap, a + b), F.lit(0.0))
    exact = F.when(a + b == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * ST.binomial_tail(a + b, F.least(a, b))))
    out = c.withColumn("chi2", chi2).withColumns({"p": ST.chi_square_p(F.col("chi2")), "p_exact": exact})
    return out.withColumns({"significant": (a + b > 0) & (F.when(a + b < 25, F.col("p_exact")).otherwise(F.col("p")) < 0.05), **{x: F.round(x, 6) for x in ("chi2", "p", "p_exact")}})


def weights(v: DataFrame) -> DataFrame:
    return v.sparkSession.createDataFrame([(r, f, w) for (r, f), w in K.DAMAGE.items()], "ref string, found string, weight double")


def damage(v: DataFrame) -> DataFrame:
    """Damage of all verdicts, per case, against the worst case, and goodness."""
    w = weights(v)
    worst = w.groupBy("ref").agg(F.max("weight").alias("worst"))
    cells = model_status(v).filter("ref is not null and model_status is not null").groupBy("ref", F.col("model_status").alias("found")).agg(F.count("*").alias("n"))
    s = cells.join(F.broadcast(w), ["ref", "found"]).join(F.broadcast(worst), "ref").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("damage"), F.sum(F.col("n") * F.col("worst")).alias("worst"))
    return s.select("n", F.round("damage", 6).alias("damage"), share(F.col("damage"), F.col("n")).alias("per_case"), F.round("worst", 6).alias("worst"), F.round(1 - F.coalesce(F.try_divide("damage", "worst"), F.lit(0.0)), 6).alias("goodness"))


def damage_classes(v: DataFrame) -> DataFrame:
    """(kind, n, points, share): damage by kind of error, of kinds that occur; share of all damage."""
    kinds = [(cell[0], cell[1], kind) for kind, cells_ in K.ERROR_KINDS.items() for cell in cells_]
    table = v.sparkSession.createDataFrame(kinds, "ref string, found string, kind string")
    cells = model_status(v).filter("ref is not null and model_status is not null").groupBy("ref", F.col("model_status").alias("found")).agg(F.count("*").alias("n"))
    g = cells.join(F.broadcast(weights(v)), ["ref", "found"]).join(F.broadcast(table), ["ref", "found"]).groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("points"))
    total = g.agg(F.sum("points").alias("total"))  # five rows at most
    return g.crossJoin(F.broadcast(total)).select("kind", "n", F.round("points", 2).alias("points"), F.round(F.coalesce(F.try_divide("points", "total"), F.lit(0.0)), 6).alias("share"))


def damage_baselines(v: DataFrame) -> DataFrame:
    """(found, damage, goodness): damage if every verdict were the same, and what it is short of the worst case."""
    w = weights(v)
    worst = w.groupBy("ref").agg(F.max("weight").alias("worst"))
    refs = model_status(v).filter("ref is not null and model_status is not null").groupBy("ref").agg(F.count("*").alias("n"))
    g = refs.join(F.broadcast(w), "ref").join(F.broadcast(worst), "ref").groupBy("found").agg(F.sum(F.col("n") * F.col("weight")).alias("d"), F.sum(F.col("n") * F.col("worst")).alias("w"))
    return g.select("found", F.round("d", 6).alias("damage"), F.round(1 - F.coalesce(F.try_divide("d", "w"), F.lit(0.0)), 6).alias("goodness"))


def sensitivity(v: DataFrame) -> DataFrame:
    """(fa, fn, ranking): how three strategies rank by goodness when deviations (row A) and invented rules (row N) count for more or less; weights stay up to 1."""
    spark = v.sparkSession
    factors = spark.createDataFrame([(a, n) for a in K.EMPHASIS for n in K.EMPHASIS], "fa double, fn double")
    m = model_status(v).filter("ref is not null and model_status is not null")
    runs = m.select("ref", F.explode(F.array(*(F.struct(F.lit(name).alias("run"), F.col(c).alias("found")) for name, c in (("a model", "model_status"), ("b other", "other"))), F.struct(F.lit("c always E").alias("run"), F.lit("E").alias("found")))).alias("r"))
    cells = runs.groupBy("ref", "r.run", "r.found").agg(F.count("*").alias("n"))
    scaled = F.least(F.lit(1.0), F.col("weight") * F.when(F.col("ref") == "A", F.col("fa")).when(F.col("ref") == "N", F.col("fn")).otherwise(1.0))
    d = cells.join(F.broadcast(weights(v)), ["ref", "found"]).crossJoin(F.broadcast(factors)).groupBy("fa", "fn", "run").agg(F.round(F.sum(F.col("n") * scaled), 6).alias("damage"))
    # All runs have the same references, so less damage is more goodness.
    return d.groupBy("fa", "fn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("damage", "run"))), lambda x: x["run"]), " < ").alias("ranking"))


def stability(v: DataFrame) -> DataFrame:
    """(variants, rankings, stable, winners): whether the ranking is the same under all emphases, and how often each strategy is first."""
    r = sensitivity(v)
    first = r.groupBy(F.substring_index("ranking", " < ", 1).alias("run")).agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "run", F.col("n").cast("string")))), ", ").alias("winners"))
    return r.agg(F.count("*").alias("variants"), F.count_distinct("ranking").alias("rankings")).withColumn("stable", F.col("rankings") == 1).crossJoin(first)


def deviation_share(v: DataFrame) -> DataFrame:
    """(doc_id, nr, share_a): share of A among the other documents' references, documents left out one at a time; 0 without others.

    Sums by criterion are broadcast (a row a criterion), so no criterion's verdicts meet in one task.
    """
    r = v.filter("ref is not null").select("doc_id", "nr", F.when(F.col("ref") == "A", 1).otherwise(0).alias("own"))
    sums = r.groupBy("nr").agg(F.sum("own").alias("a"), F.count("*").alias("n"))
    return r.join(F.broadcast(sums), "nr").select("doc_id", "nr", F.round(F.coalesce(F.try_divide((F.col("a") - F.col("own")).cast("double"), F.col("n") - 1), F.lit(0.0)), 4).alias("share_a"))


def placement(v: DataFrame) -> DataFrame:
    """(doc_id, nr, regulating, corpus, share, placed): how usual it is among the other documents that a criterion is regulated."""
    docs = v.filter("ref is not null and ref <> 'N'").select("doc_id").distinct().agg(F.count("*").alias("corpus"))
    per = v.filter("ref is not null and ref <> 'N'").groupBy("nr").agg(F.count("*").alias("all_regulating"))
    own = v.select("doc_id", "nr", "status", F.coalesce(F.when(F.col("ref") != "N", 1), F.lit(0)).alias("own"))
    j = own.join(F.broadcast(per), "nr", "left").crossJoin(F.broadcast(docs)).withColumn("regulating", F.coalesce("all_regulating", F.lit(0)) - F.col("own")).withColumn("corpus", F.col("corpus") - 1)
    s = F.coalesce(F.try_divide(F.col("regulating").cast("double"), F.col("corpus")), F.lit(0.0))
    placed = F.when(F.col("status").isNull(), "unremarkable").when((F.col("status") == "N") & (s >= K.ESTABLISHED), "gap").when((F.col("status") != "N") & (s <= K.RARE), "rare").when((F.col("status") != "N") & (s >= K.ESTABLISHED), "usual").otherwise("unremarkable")
    return j.select("doc_id", "nr", "status", "regulating", "corpus", F.round(s, 6).alias("share"), placed.alias("placed"))


def placement_summary(v: DataFrame) -> DataFrame:
    p = placement(v)
    return p.groupBy("doc_id").agg(*(F.count_if(F.col("placed") == k).alias(k) for k in ("gap", "rare", "usual", "unremarkable")), F.count_if(F.col("placed").isin("gap", "rare")).alias("notable"))


def class_from_frequency(v: DataFrame) -> DataFrame:
    """(nr, n, m, klass): mandatory from 14 of 18 documents on, regular from 8 of 18, in proportion."""
    m = v.filter("ref is not null").agg(F.count_distinct("doc_id").alias("m"))
    n = v.groupBy("nr").agg(F.count_if(F.col("ref").isin("E", "T", "A")).alias("n"))
    k = F.when(F.col("n") * 18 >= 14 * F.col("m"), "mandatory").when(F.col("n") * 18 >= 8 * F.col("m"), "regular").otherwise("optional")
    return n.crossJoin(F.broadcast(m)).select("nr", "n", "m", k.alias("klass"))


def class_thresholds(v: DataFrame) -> DataFrame:
    """(m, mandatory_from, regular_from), one row: documents with a reference, and the fewest regulating ones that make a criterion mandatory or at least regular; null without documents."""
    m = v.filter("ref is not null").agg(F.count_distinct("doc_id").alias("m"))
    least = lambda k: F.when(F.col("m") > 0, F.floor((k * F.col("m") + 17) / 18))
    return m.select("m", least(14).alias("mandatory_from"), least(8).alias("regular_from"))


def set_gap(criteria: DataFrame, reference: DataFrame) -> DataFrame:
    """(n_criteria, n_reference, differing), one row: numbers of both sets, and those that only one of them has; null numbers count as none."""
    both = criteria.select("nr").distinct().filter("nr is not null").withColumn("c", F.lit(1)).join(reference.select("nr").distinct().filter("nr is not null").withColumn("r", F.lit(1)), "nr", "full")
    return both.agg(F.count("c").alias("n_criteria"), F.count("r").alias("n_reference"), F.count_if(F.col("c").isNull() | F.col("r").isNull()).alias("differing"))


def check_reference(criteria: DataFrame, reference: DataFrame, part: str = "all") -> None:
    """Guards the evaluation against a reference of one's own: parts of the built-in corpus don't apply, and both must have the same criteria. Runs one small job."""
    if part != "all":
        raise ValueError(f"part {part} is one of the built-in reference; another one is measured over all its documents")
    gap = set_gap(criteria, reference).first()
    if gap["differing"]:
        raise ValueError(f"the reference doesn't fit the template: {gap['n_reference']} against {gap['n_criteria']} criteria, {gap['differing']} numbers differ")


def fingerprint(v: DataFrame) -> DataFrame:
    """(doc_id, print): the first 16 hex digits of a digest of all verdicts in order."""
    cell = F.concat_ws("=", F.lpad(F.col("nr").cast("string"), 3, "0"), F.coalesce("status", F.lit("-")))
    return v.groupBy("doc_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(cell)), ";"), 256), 1, 16).alias("print"))


def run_differences(v: DataFrame) -> DataFrame:
    """(doc_id, nr, change): verdicts that one run has and the other has not, or that changed, from a full outer join."""
    a = v.filter("status is not null").select("doc_id", "nr", F.col("status").alias("old"))
    b = v.filter("p >= 0.05").select("doc_id", "nr", F.col("other").alias("new"))
    j = a.join(b, ["doc_id", "nr"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return j.select("doc_id", "nr", "old", "new", change.alias("change"))
