"""Distribution functions that SQL doesn't have, as columns: folds of fixed or linear length within a row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series (below 3) and of the continued fraction (from 3 on) of the error function.
TERMS = 80


def erfc(z: Column) -> Column:
    """The complementary error function of z >= 0, to twelve digits and more."""
    state = F.struct(z.alias("term"), z.alias("sum"))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * 2 * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), state, add, lambda a: a["sum"])
    fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), z, lambda a, k: z + k / 2.0 / a)
    return F.when(z < 3, 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * series).otherwise(F.exp(-z * z) / math.sqrt(math.pi) / fraction)


def chi_square_p(x: Column) -> Column:
    """P that a chi-square with one degree of freedom is above x."""
    return erfc(F.sqrt(x / 2))


def binomial_tail(n: Column, k: Column) -> Column:
    """P of at most k heads in n fair tosses. One pass for the binomial coefficient's logarithm, one down the ratios of its neighbours: linear in k."""
    n, k = n.cast("double"), k.cast("int")
    log_top = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, j: s + F.when(j > 0, F.log((n - k + j) / j)).otherwise(0.0)) - n * math.log(2)
    state = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("s"))

    def down(a: Column, j: Column) -> Column:
        r = a["r"] * (k - j + 1) / (n - k + j)
        return F.struct(r.alias("r"), (a["s"] + r).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.exp(log_top + F.log(F.aggregate(steps, state, down, lambda a: a["s"])))
