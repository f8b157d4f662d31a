"""Operators that ask a model, behind a provider: any callable from a prompt to (text, ok, cause).

A failed call is data. No call is made for a criterion without candidates; after three failures of the connection in
a row a task asks no more, and says so. Providers are objects that Python can send to the workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K
from .. import words as L
from . import rules as R

Provider = Callable[[str], tuple[str, bool, str]]
#: Failures of the connection in a row after which a task stops asking.
IN_A_ROW = 3
NOT_ASKED, NO_CANDIDATE = "not asked: no connection", "no candidate"


def ask(prompts: DataFrame, provider: Provider, in_a_row: int = IN_A_ROW) -> DataFrame:
    """Columns of ``prompts`` with text, ok, cause: the answers. A null prompt isn't asked (no candidate)."""
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema if f.name != "prompt"]
    names = [f.name for f in prompts.schema if f.name != "prompt"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for b in batches:
            out = []
            for p in b.prompt:
                if p is None or p != p:
                    out.append(("", False, NO_CANDIDATE))
                elif failed >= in_a_row:
                    out.append(("", False, NOT_ASKED))
                else:
                    text, ok, cause = provider(p)
                    failed = failed + 1 if not ok and L.CONNECTION_FAILED in cause.lower() else 0
                    out.append((text, ok, cause))
            yield pd.concat([b[names].reset_index(drop=True), pd.DataFrame(out, columns=["text", "ok", "cause"])], axis=1)

    return prompts.mapInPandas(run, ", ".join([*keys, "text string, ok boolean, cause string"]))


def verdict_prompts(criteria: DataFrame, docs: DataFrame, passages: DataFrame, n: int = K.CANDIDATES) -> DataFrame:
    """(doc_id, nr, prompt): one prompt for every criterion of every document: title and passages with their pages; null without candidates."""
    top = passages.filter(F.col("rank") <= n).groupBy("doc_id", "nr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("[S"), F.col("page").cast("string"), F.lit("] "), F.col("text")).alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    every = docs.select("doc_id").distinct().crossJoin(F.broadcast(criteria.select("nr", "title")))
    return every.join(top, ["doc_id", "nr"], "left").select("doc_id", "nr", F.when(F.col("t").isNotNull(), F.concat_ws("\n", "title", "t")).alias("prompt"))


def verdicts(prompts: DataFrame, passages: DataFrame, provider: Provider) -> DataFrame:
    """(doc_id, nr, status, reason, evidence, cause): verdicts of the model under the evidence rule; without an answer N and the cause."""
    answers = R.parsed(ask(prompts, provider), "text")
    cause = F.when(~F.col("ok"), F.col("cause")).when(F.col("unreadable"), "answer can't be read").otherwise("")
    # One pass: what can't be judged goes on without a verdict, so that the model is not asked again for the causes.
    j = R.with_evidence(answers.select("doc_id", "nr", F.when(F.col("ok") & ~F.col("unreadable"), F.col("said")).alias("said"), cause.alias("cause")), passages, ("cause",))
    return j.select("doc_id", "nr", F.coalesce("status", F.lit("N")).alias("status"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce(F.when(F.col("status").isNotNull(), F.col("evidence")), F.lit("")).alias("evidence"), "cause")


def hints(open_: DataFrame, passages: DataFrame, provider: Provider, most: int = 2) -> DataFrame:
    """(doc_id, nr, page, text): hints on open criteria (nr, wording): at most two a criterion, not negated, in the words of the passages, each text once."""
    p = passages.join(F.broadcast(open_), "nr").groupBy("doc_id", "nr").agg(F.concat_ws("\n", F.first("wording"), F.array_join(F.array_sort(F.collect_list("text")), "\n")).alias("prompt"))
    got = ask(p, provider).filter("ok")
    items = F.from_json(R.first_object(F.col("text"), "["), "array<struct<text:string,fundstelle:string>>")
    h = got.select("doc_id", "nr", F.posexplode(F.slice(items, 1, most)).alias("k", "h")).select("doc_id", "nr", "k", F.trim("h.text").alias("hint"), F.regexp_replace(F.coalesce("h.fundstelle", F.lit("")), "^[Ss]", "").alias("said"))
    h = h.filter((F.col("hint") != "") & ~R.matches(F.col("hint"), L.NEGATED_HINT))
    ok = R.grounded(h.select("doc_id", "nr", "hint").distinct(), passages).filter("ok").select("doc_id", "nr").distinct()
    best = passages.groupBy("doc_id", "nr").agg(F.min_by("page", "rank").alias("best"), F.collect_set(F.col("page").cast("string")).alias("pages"))
    page = F.when(F.array_contains("pages", F.col("said")), F.col("said")).otherwise(F.col("best").cast("string"))
    j = h.join(ok, ["doc_id", "nr"], "left_semi").join(best, ["doc_id", "nr"]).withColumn("key", F.array_join(R.words_of(F.col("hint")), " "))
    w = Window.partitionBy("doc_id", "key").orderBy("nr", "k")
    return j.withColumn("first", F.row_number().over(w)).filter("first = 1").select("doc_id", "nr", F.concat(F.lit("S"), page).alias("page"), F.col("hint").alias("text"))


def opposites(affected: DataFrame, passages: DataFrame, finder: Provider, judge: Provider, depth: int = 12, most: int = 5) -> DataFrame:
    """(doc_id, nr, sentence, against): quotations that say the opposite of a requirement (nr, pos, text): found in twelve passages, five at most, each held against each requirement, the first confirmed one."""
    p = passages.filter(F.col("rank") <= depth).join(F.broadcast(affected.select("nr").distinct()), "nr", "left_semi").groupBy("doc_id", "nr").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("prompt"))
    quotes = F.from_json(R.first_object(F.col("text"), "["), "array<string>")
    found = ask(p, finder).filter("ok").select("doc_id", "nr", F.posexplode(F.slice(quotes, 1, most)).alias("k", "quote"))
    pairs = found.join(F.broadcast(affected.select("nr", "pos", F.col("text").alias("against"))), "nr").select("doc_id", "nr", "k", "quote", "pos", "against", F.concat_ws("\n", "quote", "against").alias("prompt"))
    said = ask(pairs, judge).filter("ok").filter(F.get_json_object(R.first_object(F.col("text")), "$.opposite") == "true")
    best = said.groupBy("doc_id", "nr").agg(F.min_by(F.struct("quote", "against"), F.struct("k", "pos")).alias("b"))
    return best.select("doc_id", "nr", F.col("b.quote").alias("sentence"), F.col("b.against").alias("against"))


def extras(residual: DataFrame, provider: Provider) -> DataFrame:
    """(doc_id, pos, text): requirements that no criterion covers, from the longest sections left over (doc_id, section_idx, text), in document order."""
    p = residual.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("prompt"))
    items = F.from_json(R.first_object(F.col("text"), "["), "array<string>")
    return ask(p, provider).filter("ok").select("doc_id", F.posexplode(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "text"))


def judged_pairs(pairs: DataFrame, provider: Provider) -> DataFrame:
    """Columns of ``pairs`` (with prompt) and value 0..100, note of 400 characters at most, error: a pair that can't be judged has no value."""
    # From a generator, so that the object is found once and not once for each use.
    got = ask(pairs, provider).select("*", F.explode(F.array(R.first_object(F.col("text")))).alias("_blob"))
    blob = F.col("_blob")
    value = F.round(F.get_json_object(blob, "$.wert").try_cast("double")).cast("int")
    error = F.when(~F.col("ok"), F.col("cause")).when(blob.isNull(), "no JSON").when(value.isNull(), "no number").otherwise("")
    return got.select(*[c for c in pairs.columns if c != "prompt"], F.when(error == "", F.greatest(F.lit(0), F.least(F.lit(100), value))).alias("value"), F.substring(F.coalesce(F.get_json_object(blob, "$.unterschied"), F.lit("")), 1, 400).alias("note"), error.alias("error"))


def stances(requirements: DataFrame, provider: Provider, stored: DataFrame) -> DataFrame:
    """(nr, stance): what the standard says on the choice of a product: stored labels (nr, print, stance) where their fingerprint is that of the texts, else by the model, else open wording."""
    t = requirements.groupBy("nr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "pos", "text"))), lambda x: x["text"]), "\n").alias("prompt"))
    t = t.withColumn("print", F.substring(F.sha2("prompt", 256), 1, 16))
    known = t.join(stored.select("nr", "print", "stance"), ["nr", "print"], "left")
    new = ask(known.filter("stance is null").select("nr", "prompt"), provider).select("nr", F.when(F.col("ok"), F.lower(F.trim("text"))).alias("said"))
    j = known.join(new, "nr", "left").join(R.open_criteria(requirements), "nr", "left")
    legal = F.when(F.col("said").isin("open", "bound", "silent"), F.col("said"))
    return j.select("nr", F.coalesce("stance", legal, F.when(F.col("wording").isNotNull(), "open"), F.lit("silent")).alias("stance"))


class ByLength:
    """A stand-in for a model: its answer depends on the prompt's length alone; every n-th length fails."""

    def __init__(self, fails_every: int = 0, cause: str = "LLM-Aufruf fehlgeschlagen"):
        self.fails_every, self.cause = fails_every, cause

    def __call__(self, prompt: str) -> tuple[str, bool, str]:
        n = len(prompt)
        if self.fails_every and n % self.fails_every == 0:
            return "", False, self.cause
        return '{"status": "%s", "begruendung": "length %d", "fundstelle": "S%d", "wert": %d, "unterschied": "none"}' % ("ETAN"[n % 4], n, n % 40 + 1, n % 140 - 20), True, ""
