"""Decisions on verdicts: signs of a deviation, flagging, learned decider and ranker, cases for the reader."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K
from .. import words as L
from . import rules as R

#: Signs in their order.
SIGNS = ["model", "hint", "probability", "statistics", "vendor", "accumulation", "cost", "value", "material", "opposite", "procurement", "number", "duty", "contradiction"]
# The signs that count at each level, and those of two earlier versions; signs that bring their own evidence.
LEVELS = {
    "off": [],
    "targeted": ["cost", "contradiction", "material", "opposite"],
    "thorough": ["cost", "contradiction", "material", "opposite", "duty", "probability"],
}
LEVELS_1_2 = {"off": [], "targeted": ["accumulation", "contradiction"], "thorough": ["accumulation", "duty", "cost", "contradiction"]}
LEVELS_1_1 = {
    "off": [],
    "targeted": ["accumulation"],
    "cautious": ["hint", "accumulation"],
    "medium": ["hint", "procurement", "accumulation"],
    "thorough": ["hint", "procurement", "vendor", "probability", "statistics", "accumulation"],
    "high": ["hint", "procurement", "number", "duty", "accumulation"],
}
FROM_PASSAGES = ["cost", "value", "material", "opposite"]


# --------------------------------------------------------------------------- shares


def regulated_share(v: DataFrame) -> DataFrame:
    """(nr, share_a): share of A among the regulated references of a criterion, 4 digits."""
    return v.filter("ref in ('E', 'T', 'A')").groupBy("nr").agg(F.round(F.count_if(F.col("ref") == "A") / F.count("*"), 4).alias("share_a"))


def share_attached(v: DataFrame) -> DataFrame:
    """Verdicts E and T with the share of A of their criterion: (doc_id, nr, status, share_a)."""
    return v.filter("status in ('E', 'T')").join(F.broadcast(regulated_share(v)), "nr").select("doc_id", "nr", "status", "share_a")


# --------------------------------------------------------------------------- signs


def evidence_of_verdicts(v: DataFrame, passages: DataFrame, requirements: DataFrame, criteria: DataFrame) -> DataFrame:
    """Verdicts with what speaks for a deviation: vendor, cost (sentence, page), value, material (found, known, page), hint, opposite, share_a.

    Sentences and values count only where the model was asked and has answered (``cause`` is empty). All joins are
    by (doc_id, nr), so the facts of a verdict meet in one place; tables by criterion are bounded and broadcast.
    """
    signs = R.sentence_signs(passages)
    asked = v.filter("cause = ''").select("doc_id", "nr")
    of = lambda df, name, *cols: df.join(asked, ["doc_id", "nr"], "left_semi").select("doc_id", "nr", F.struct(*cols).alias(name))
    preferred = R.bought_in_criteria(criteria).withColumn("kind", F.lit("binding")).union(R.cost_criteria(requirements).withColumn("kind", F.lit("cost")))
    found = R.assigned_each(signs, preferred, only=("binding",)).join(asked, ["doc_id", "nr"], "left_semi")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.struct("sentence", "page")))
    sentences = found.groupBy("doc_id", "nr").agg(one("binding").alias("vendor"), one("cost").alias("cost"))
    values = R.value_signs(passages, requirements)
    value, material = (of(values.filter(F.col("sign") == k), k, "found", "known", "page") for k in ("value", "material"))
    hint = R.reason_hints(v, passages, criteria, v.limit(0)).select("doc_id", "nr", F.struct("page", "words").alias("hint"))
    affected = requirements.filter((F.col("field") == "required") & R.matches(F.col("text"), L.AFFECTED)).groupBy("nr").agg(F.min_by("text", "pos").alias("against"))
    out = v.join(F.broadcast(regulated_share(v)), "nr", "left").join(F.broadcast(affected), "nr", "left")
    for t in (sentences, value, material, hint):
        out = out.join(t, ["doc_id", "nr"], "left")
    return out.withColumn("opposite", F.when(F.coalesce("opposed", F.lit(False)), F.col("against")))


def _signs(top: Column, has_p: Column) -> Column:
    s, text = F.col("status"), R.reason_signs(F.col("reason"))
    held = s.isin("E", "T")
    own = F.when(held & ~F.coalesce("lifted", F.lit(False)), text).otherwise(F.array().cast("array<string>"))
    first = F.array(
        F.when(s == "A", "model"), F.when(F.col("hint").isNotNull(), "hint"), F.when(top & held, F.when(has_p, "probability").otherwise("statistics")), F.when(held & F.col("vendor").isNotNull(), "vendor"),
        F.when(held & (F.coalesce("share_a", F.lit(0.0)) >= K.ACCUMULATION), "accumulation"), F.when(s.isin("E", "T", "N") & F.col("cost").isNotNull(), "cost"), F.when(s.isin("E", "T", "N") & F.col("value").isNotNull(), "value"),
        F.when(s.isin("E", "T", "N") & F.col("material").isNotNull(), "material"), F.when(held & F.col("opposite").isNotNull(), "opposite"),
    )
    return F.concat(F.filter(first, lambda x: x.isNotNull()), own)


def with_signs(facts: DataFrame) -> DataFrame:
    """Adds signs: all signs of a verdict but those that come from being among the likeliest."""
    return facts.withColumn("signs", _signs(F.lit(False), F.lit(True)))


def _placed(signed: DataFrame, level: list[str]) -> DataFrame:
    """Adds open, has_p, v, place: the order of a document's E and T that nothing else flags, by windows alone, so that the facts are made once."""
    counts = F.array(*(F.lit(x) for x in [*level, "model"]))
    open_ = F.coalesce(F.col("status").isin("E", "T") & ~F.arrays_overlap("signs", counts), F.lit(False))
    has = F.coalesce(F.max(F.when(F.col("open"), F.col("p").isNotNull())).over(Window.partitionBy("doc_id")), F.lit(False))
    value = F.when(F.col("open"), F.when(F.col("has_p"), F.col("p")).otherwise(F.col("ranked")))
    w = Window.partitionBy("doc_id").orderBy(F.coalesce(F.col("v") > 0, F.lit(False)).desc(), F.desc("v"), "nr")
    return signed.withColumn("open", open_).withColumn("has_p", has).withColumn("v", value).withColumn("place", F.when(F.col("v") > 0, F.row_number().over(w)))


def likeliest(signed: DataFrame, level: list[str], n: int = K.TOP_FLAGS) -> DataFrame:
    """(doc_id, nr, place, p, has_p): of every document the E and T nearest to A that nothing else flags; by probabilities where the document has any, else by the ranker's value."""
    return _placed(signed, level).filter(F.col("place") <= n).select("doc_id", "nr", "place", F.col("v").alias("p"), "has_p")


def flagged(facts: DataFrame, level: str = "thorough", levels: dict[str, list[str]] = LEVELS) -> DataFrame:
    """(doc_id, nr, status, status_model, origin, reason, evidence, reason_model): verdicts with signs of the level become A and keep what the model said.

    N with a hint takes the hint's words; N, or signs all from passages, take the passage as reason. A status A keeps its origin only.
    """
    if level not in levels:
        raise ValueError(f"level must be one of {', '.join(levels)}")
    counts = levels[level]
    signed = with_signs(facts)
    if "probability" in counts or "statistics" in counts:
        signed = _placed(signed, counts).withColumn("signs", _signs(F.coalesce(F.col("place") <= K.TOP_FLAGS, F.lit(False)), F.col("has_p"))).drop("open", "has_p", "v", "place")
    enough = F.array(*(F.lit(x) for x in counts)).cast("array<string>")
    s = signed.withColumn("hit", F.size(F.array_intersect("signs", enough)) > 0).withColumn("origin", F.filter("signs", lambda x: (x == "model") | x.isin(counts or [""])))
    raised = F.col("hit") & F.coalesce(F.col("status") != "A", F.lit(True))
    own = F.filter("origin", lambda x: x.isin(FROM_PASSAGES))
    kind = F.element_at(own, 1)
    page = lambda c: F.concat(F.lit("S"), F.col(f"{c}.page").cast("string"))
    text = (
        F.when(kind == "cost", F.concat(F.lit("Cost in the document: "), F.col("cost.sentence"))).when(kind == "value", F.concat(F.lit("Value outside the standard: "), F.col("value.found"), F.lit(" ("), F.col("value.known"), F.lit(")")))
        .when(kind == "material", F.concat(F.lit("Material outside the standard: "), F.col("material.found"))).when(kind == "opposite", F.concat(F.lit("Opposite of: "), F.col("opposite")))
    )
    where = F.when(kind == "cost", page("cost")).when(kind == "value", page("value")).when(kind == "material", page("material")).otherwise(F.col("evidence"))
    by_hint = raised & (F.col("status") == "N") & F.array_contains("origin", "hint")
    by_passage = raised & ~by_hint & ((F.col("status") == "N") | (F.size(F.array_except("origin", F.array(*(F.lit(x) for x in FROM_PASSAGES)))) == 0)) & kind.isNotNull()
    keeps = F.col("hit") | (F.col("status") == "A")
    return s.select(
        "doc_id", "nr", F.when(raised, "A").otherwise(F.col("status")).alias("status"), F.when(raised, F.coalesce("status", F.lit("N"))).alias("status_model"), F.when(F.coalesce(keeps, F.lit(False)), F.array_join("origin", ",")).alias("origin"),
        F.when(by_hint, F.concat(F.lit("Laid down: "), F.col("hint.words"))).when(by_passage, text).otherwise(F.col("reason")).alias("reason"),
        F.when(by_hint, F.col("hint.page")).when(by_passage, where).otherwise(F.col("evidence")).alias("evidence"), F.when(by_passage & (F.col("reason") != ""), F.col("reason")).alias("reason_model"),
    )


def case_of(flagged_: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, nr, label): what the reader is told about a verdict, the first that fits of eight cases.

    asked(doc_id, nr, cause, said_status, candidates, lifted, echo): what is known of the call.
    """
    j = flagged_.join(asked, ["doc_id", "nr"], "left")
    n, cause = F.coalesce("candidates", F.lit(0)), F.trim(F.coalesce("cause", F.lit("")))
    label = (
        F.when((cause != "") & (n == 0), "nothing found").when(cause != "", "call failed").when(F.col("status_model").isNotNull(), "flagged afterwards").when(F.coalesce("lifted", F.lit(False)), "lifted by statistics")
        .when(F.col("said_status").isNotNull() & (F.col("said_status") != F.coalesce("status", F.lit("N"))), "changed by the evidence rule").when(F.col("echo").isNotNull(), "reason partly from the prompt")
        .when((F.coalesce("status", F.lit("N")) == "N") & (n > 0), "passages found, not counted").otherwise("regular")
    )
    return j.select("doc_id", "nr", label.alias("label"))


# --------------------------------------------------------------------------- learned models

FEATURES = ["mandatory", "regular", "optional", "filled", "first", "three", "ten", "max_cos", "max_lex", "with_terms", "strong", "log_sections"]
RANK_FEATURES = ["open_product", "open_wording", "share_a", *FEATURES]
CLASSES = ["E", "T", "A", "N"]


@dataclass
class Model:
    """A softmax model on standardised features; a class that was never seen has the intercept -1e9."""

    features: list[str]
    classes: list[str]
    mean: list[float]
    scale: list[float]
    coefficients: list[list[float]]
    intercepts: list[float]
    cases: int = 0
    search: dict = field(default_factory=dict)

    def moved(self, fingerprint: str) -> Model:
        """The model for another template: same coefficients, with where it is from."""
        return Model(self.features, self.classes, self.mean, self.scale, self.coefficients, self.intercepts, self.cases, {**self.search, "template": fingerprint, "from": self.search.get("template")})

    def state(self, search: dict) -> str:
        """'active', or why the model doesn't count for a search with other settings."""
        other = [k for k in sorted({*self.search, *search} - {"template", "from"}) if self.search.get(k) != search.get(k)]
        return f"not active: {', '.join(other)}" if other else "active"


def train(rows: DataFrame, features: list[str], classes: list[str], label: str = "ref", c: float = 0.5) -> Model:
    """Multinomial logistic regression with L2 of C-form on standardised features (population deviation, 1 for none).

    The objective of Spark ML is a mean, so regParam = 1 / (C n). Without rows all classes are alike; with one class it alone is likely.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    known = rows.filter(F.col(label).isin(classes)).select(*(F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in features), label)
    stats = known.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(label)).alias("seen"), *(F.avg(x).alias(f"m_{x}") for x in features), *(F.stddev_pop(x).alias(f"s_{x}") for x in features)).first()
    mean, scale = [stats[f"m_{x}"] or 0.0 for x in features], [stats[f"s_{x}"] or 1.0 for x in features]
    seen = [k for k in classes if k in stats["seen"]]
    zero = [[0.0] * len(features) for _ in classes]
    if len(seen) < 2:
        return Model(features, classes, mean, scale, zero, [0.0 if not seen or k in seen else -1e9 for k in classes], stats["n"])
    scaled = known.select(*((F.col(x) - F.lit(m)) / F.lit(s) for x, m, s in zip(features, mean, scale)), F.array_position(F.array(*(F.lit(k) for k in seen)), F.col(label)).cast("double").alias("y")).toDF(*features, "y").withColumn("y", F.col("y") - 1)
    data = VectorAssembler(inputCols=features, outputCol="x").transform(scaled).select("x", "y")
    fitted = LogisticRegression(featuresCol="x", labelCol="y", family="binomial" if len(seen) == 2 else "multinomial", regParam=1 / (c * stats["n"]), elasticNetParam=0.0, standardization=False, maxIter=300, tol=1e-9).fit(data)
    coefficients, intercepts = zero, [-1e9] * len(classes)
    if len(seen) == 2:  # one row: the second class against the first
        intercepts[classes.index(seen[0])] = 0.0
        coefficients[classes.index(seen[1])], intercepts[classes.index(seen[1])] = fitted.coefficients.toArray().tolist(), float(fitted.intercept)
    else:
        for i, k in enumerate(seen):
            coefficients[classes.index(k)], intercepts[classes.index(k)] = fitted.coefficientMatrix.toArray()[i].tolist(), float(fitted.interceptVector[i])
    return Model(features, classes, mean, scale, coefficients, intercepts, stats["n"])


def logits(model: Model) -> list[Column]:
    z = [(F.coalesce(F.col(x).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s) for x, m, s in zip(model.features, model.mean, model.scale)]
    return [F.lit(b) + sum((F.lit(w) * x for w, x in zip(row, z)), F.lit(0.0)) for row, b in zip(model.coefficients, model.intercepts)]


def probabilities(rows: DataFrame, model: Model, *keys: str) -> DataFrame:
    """Keys and p_<class> of each row, 4 digits; most: the likeliest class, the first of equal ones."""
    names = [f"p_{k.lower()}" for k in model.classes]
    z = rows.select(*keys, *(e.alias(f"z{i}") for i, e in enumerate(logits(model))))
    top = F.greatest(*(f"z{i}" for i in range(len(names))))
    e = z.select(*keys, *(F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in range(len(names))))
    total = sum((F.col(f"e{i}") for i in range(1, len(names))), F.col("e0"))
    out = e.select(*keys, *(F.round(F.col(f"e{i}") / total, 4).alias(n) for i, n in enumerate(names)))
    best = F.greatest(*names)
    return out.withColumn("most", F.coalesce(*(F.when(F.col(n) == best, F.lit(k)) for n, k in zip(names, model.classes))))


def lifted(v: DataFrame, p: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, nr, status, evidence, p): verdicts N with candidates, asked without a failure, that the decider takes for E or T; evidence is the best page."""
    best = passages.groupBy("doc_id", "nr").agg(F.min_by("page", "rank").alias("page"))
    j = v.filter("status = 'N' and cause = ''").join(best, ["doc_id", "nr"]).join(p, ["doc_id", "nr"]).filter(F.col("most").isin("E", "T"))
    return j.select("doc_id", "nr", F.col("most").alias("status"), F.concat(F.lit("S"), F.col("page").cast("string")).alias("evidence"), F.when(F.col("most") == "E", F.col("p_e")).otherwise(F.col("p_t")).alias("p"))


def _standard_flags(requirements: DataFrame, criteria: DataFrame) -> DataFrame:
    """(nr, open_product, open_wording): whether the standard leaves the product or the wording open; a row a criterion."""
    product, wording = R.placeholders(criteria, wide=False).select("nr", F.lit(1.0).alias("open_product")), R.open_criteria(requirements).select("nr", F.lit(1.0).alias("open_wording"))
    return criteria.select("nr").distinct().join(product, "nr", "left").join(wording, "nr", "left").na.fill(0.0, ["open_product", "open_wording"])


def ranker_rows(features: DataFrame, v: DataFrame, requirements: DataFrame, criteria: DataFrame) -> DataFrame:
    """Features of the ranker for verdicts with a regulated reference: two flags of the standard, the share of A in the other documents, and the features of the search."""
    from . import evaluate as E

    j = v.filter("ref in ('E', 'T', 'A')").select("doc_id", "nr", "ref").join(E.deviation_share(v), ["doc_id", "nr"]).join(F.broadcast(_standard_flags(requirements, criteria)), "nr", "left").join(features, ["doc_id", "nr"])
    return j.withColumn("ref", F.when(F.col("ref") == "A", "A").otherwise("-"))


def ranking_rows(features: DataFrame, v: DataFrame, known: DataFrame, requirements: DataFrame, criteria: DataFrame) -> DataFrame:
    """Features of the ranker for the verdicts that it scores: E and T with candidates, in documents of which no verdict has a probability.

    v(doc_id, nr, status, p); known(nr, ref): references of all documents, of which the share of A (4 digits, 0 for a
    criterion without any) is taken. A document with one probability is ordered by probabilities and has no row here.
    """
    share = known.filter("ref is not null").groupBy("nr").agg(F.round(F.count_if(F.col("ref") == "A") / F.count("*"), 4).alias("share_a"))
    has = F.max(F.col("p").isNotNull()).over(Window.partitionBy("doc_id"))
    asked = v.select("doc_id", "nr", "status", has.alias("has_p")).filter("not has_p and status in ('E', 'T')").select("doc_id", "nr")
    of_nr = F.broadcast(_standard_flags(requirements, criteria).join(share, "nr", "full"))
    return features.join(asked, ["doc_id", "nr"], "left_semi").join(of_nr, "nr", "left").na.fill(0.0, ["share_a", "open_product", "open_wording"])


def ranked(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, nr, rank_value): probability of A by the ranker, its logit held within 50, 4 digits."""
    a, other = model.classes.index("A"), model.classes.index("-")
    z = logits(model)
    logit = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z[a] - z[other]))
    return rows.select("doc_id", "nr", F.round(1 / (1 + F.exp(-logit)), 4).alias("rank_value"))
