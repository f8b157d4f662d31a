"""Column builders: everything here stays in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits that make up words; everything else parts them.
WORD_CLASS = "[^0-9a-zäöüß]"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normal(v: Column) -> Column:
    """v / (|v| + 1e-10) in double."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + F.lit(1e-10)
    return F.transform(v, lambda x: x.cast("double") / norm)


def padded_words(text: Column) -> Column:
    """Lower-case text with single-space marks around every word, to look whole words up by substring."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), WORD_CLASS, " "), F.lit(" "))


def lexical_score(lower: Column, padded: Column, terms: Column) -> Column:
    """min(hits / 3, 1): a term of up to three characters must be a whole word, a longer one a substring."""
    hit = lambda t: F.when(F.length(t) <= 3, F.contains(padded, F.concat(F.lit(" "), t, F.lit(" ")))).otherwise(F.contains(lower, t))
    return F.least(F.size(F.filter(terms, hit)) / F.lit(3.0), F.lit(1.0))


def literal_score(lower: Column, padded: Column, terms: list[str]) -> Column:
    """The lexical score for terms known beforehand: a sum that is compiled, without a lambda for each term."""
    hit = lambda t: F.contains(padded, F.lit(f" {t} ")) if len(t) <= 3 else F.contains(lower, F.lit(t))
    return F.least(sum((hit(t).cast("int") for t in terms), F.lit(0)) / F.lit(3.0), F.lit(1.0))


def share(n: Column, of: Column, digits: int = 6) -> Column:
    """n / of, null for a denominator of 0."""
    return F.round(F.try_divide(n.cast("double"), of.cast("double")), digits)
