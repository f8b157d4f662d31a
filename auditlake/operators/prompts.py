"""Prompts as columns: rules with switches, transfer to another field, passages and examples as blocks.

The wording is our own. Rules are made on the driver: one text for all verdicts; blocks are made where their rows are.
Defined cases: null texts are empty; a verdict without passages says so; a criterion without examples has no block;
of equal ranks the smaller page and text come first; empty tables give empty ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as K
from .. import words as L


@dataclass(frozen=True)
class Subject:
    """What the template is about, one and many, and from how many documents it comes (None: unknown)."""

    one: str = "a casting die"
    many: str = "casting dies"
    corpus: int | None = 18
    measured: bool = True  # whether what was found in the corpus holds for it


MEASURED = Subject()
_CONTRADICTS = "Step 2: does the document contradict the standard? Then A."
_STEPS = {
    "stricter": "Step 2: does the document contradict the standard or ask for more than it? Then A.",
    "beyond": "Step 2: does the customer ask for something that the standard doesn't? Then A.",
    "narrow": "Step 2: does the customer choose a product where the standard leaves it open? Then A, unless the standard names one.",
}
_FIRST = "Step 1: does a passage rule on the point for a casting die? If none of the 18 documents' wording fits, the status is N."
_MAKE = {True: "A prescribed make is A.", False: "A prescribed make makes the point concrete and is E."}
_FOUND = " It is the most frequent case in the corpus."
_LISTS = "An item of a list rules on its point, an entry of a list of contents never does."
_ANSWER = 'Answer with {"status": "E", "reason": "...", "evidence": "S3"}.'


def rules(subject: Subject = MEASURED, *, beyond: bool = False, narrow: bool = False, stricter: bool = False, lists: bool = False, make_deviates: bool = False, neutral_example: bool = False) -> str:
    """The rules of a prompt. ``beyond`` and ``narrow`` each replace the second step and exclude one another; what was found in the corpus is left out for another subject."""
    if beyond and narrow:
        raise ValueError("beyond and narrow exclude one another: both replace the second step")
    step = _STEPS["narrow" if narrow else "beyond" if beyond else "stricter"] if narrow or beyond or stricter else _CONTRADICTS
    found = _FOUND if subject.measured else ""
    make = [] if narrow or beyond else [_MAKE[make_deviates]]
    answer = _ANSWER.replace('"E"', '"<E, T, A or N>"').replace("S3", "S<page>") if neutral_example else _ANSWER
    return transferred("\n".join([_FIRST, step + found, *make, *([_LISTS] if lists else []), answer]), subject)


def transferred(text: str, subject: Subject, criteria: int | None = None) -> str:
    """A text about the measured subject for another one: literal replacements of subject, corpus and number of criteria."""
    if criteria is not None:
        text = text.replace(f"{K.CRITERIA} criteria", f"{criteria} criteria")
    if subject.corpus != MEASURED.corpus:
        text = text.replace(f"{MEASURED.corpus} documents", f"{subject.corpus} documents" if subject.corpus else "several documents")
    return text.replace(MEASURED.many, subject.many).replace(MEASURED.one, subject.one)


def shortened(text: Column, n: int) -> Column:
    """White space collapsed and ids of documents gone; longer texts are cut at the last blank before ``n`` characters, with a mark."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), L.DOCUMENT_MARK, ""), r"\s+", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n), " [^ ]*$", ""), F.lit(" …")))


def passage_blocks(passages: DataFrame, n: int = K.CANDIDATES_MAX) -> DataFrame:
    """(doc_id, nr, block): the passages of a verdict with page and relevance in percent, in order of rank; at most ``n``, as many as a search finds."""
    one = F.concat(F.lit("[page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(", relevance "), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit(" %]\n"), F.coalesce("text", F.lit("")))
    g = passages.filter(F.col("rank") <= n).groupBy("doc_id", "nr").agg(F.array_sort(F.collect_list(F.struct("rank", "page", one.alias("t")))).alias("all"))
    return g.select("doc_id", "nr", F.array_join(F.transform("all", lambda x: x["t"]), "\n---\n").alias("block"))


def example_blocks(examples: DataFrame, passage: int = 320, reason: int = 220) -> DataFrame:
    """(nr, block): examples(nr, place, status, text, reason) of a criterion as one block; a handful a criterion, as ``reference_examples`` gives them."""
    one = F.concat(F.lit("Example "), F.col("place").cast("string"), F.lit(", status "), F.col("status"), F.lit("\nPassage: "), shortened(F.col("text"), passage), F.lit("\nWhy: "), shortened(F.col("reason"), reason))
    g = examples.groupBy("nr").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))).alias("all"))
    return g.select("nr", F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("block"))


def prompts(verdicts: DataFrame, criteria: DataFrame, passages: DataFrame, examples: DataFrame, rules_: str, rules_first: bool = False) -> DataFrame:
    """(doc_id, nr, prompt): rules, criterion, passages and examples of each verdict(doc_id, nr) of the catalogue.

    With ``rules_first`` the part that all prompts share comes first, so that a server can keep it. Criteria and examples are broadcast: a row a criterion.
    """
    c = criteria.join(example_blocks(examples), "nr", "left").select("nr", F.concat(F.lit("Criterion "), F.col("nr").cast("string"), F.lit(" "), F.coalesce("title", F.lit("")), F.lit(" ["), F.coalesce("klass", F.lit("-")), F.lit("]")).alias("head"), F.col("block").alias("shown"))
    j = verdicts.select("doc_id", "nr").join(F.broadcast(c), "nr").join(passage_blocks(passages), ["doc_id", "nr"], "left")
    parts = [F.lit(rules_), F.col("head")] if rules_first else [F.col("head"), F.lit(rules_)]
    return j.select("doc_id", "nr", F.concat_ws("\n\n", *parts, F.coalesce("block", F.lit("(no passages)")), "shown").alias("prompt"))
