"""Column expressions for statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Terms of the error function's series; enough for |x| up to 6, beyond which it is 1 to the last digit.
TERMS = 120


def erf(x: Column) -> Column:
    """2/sqrt(pi) * exp(-x^2) * sum of 2^k x^(2k+1) / (2k+1)!!, all of one sign."""
    a = F.abs(x)
    start = F.struct(a.alias("term"), a.alias("sum"))
    step = lambda acc, k: F.struct((acc["term"] * 2 * a * a / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * 2 * a * a / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["sum"])
    return F.signum(x) * F.when(a > 6, F.lit(1.0)).otherwise(F.lit(2 / math.sqrt(math.pi)) * F.exp(-a * a) * series)


def two_proportion_p(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Two-sided p of the pooled z-test; 1 where a group is empty or the variance 0."""
    p = F.try_divide((x1 + x2).cast("double"), n1 + n2)
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    z = F.try_divide(F.abs(x1.cast("double") / F.greatest(n1, F.lit(1)) - x2.cast("double") / F.greatest(n2, F.lit(1))), se)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - erf(z / math.sqrt(2)))), F.lit(1.0))


def odds_ratio(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """With half a case added to each cell."""
    return ((x1 + 0.5) / (n1 - x1 + 0.5)) / ((x2 + 0.5) / (n2 - x2 + 0.5))


def percent(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the columns of a table of one row, as scalar subqueries; nulls where it has none."""
    return rows.withColumns({c: totals.select(c).scalar() for c in totals.columns})
