"""Exact tests that Spark SQL has no function for, as Arrow-batched UDFs, and closed forms as columns."""

from __future__ import annotations

import math
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def kendall_s(series: Column) -> Column:
    """Mann-Kendall's S: rising pairs less falling ones."""
    later = lambda x, i: F.aggregate(F.slice(series, i + 2, F.size(series)), F.lit(0), lambda acc, y: acc + F.signum((y - x).cast("double")).cast("int"))
    return F.aggregate(F.transform(series, later), F.lit(0), lambda acc, v: acc + v)


def _orders_of_five() -> dict[int, float]:
    """100 * (sum of squared numbers of equal values) + |S| -> the share of all orders of five values with at least this |S|.

    The sum of squares tells the seven ways in which five values can be alike.
    """
    out = {}
    for sizes in ((1, 1, 1, 1, 1), (2, 1, 1, 1), (2, 2, 1), (3, 1, 1), (3, 2), (4, 1), (5,)):
        values = [v for v, size in enumerate(sizes) for _ in range(size)]
        reached = [abs(sum((q > p) - (q < p) for p, q in combinations(order, 2))) for order in permutations(values)]
        for s in range(11):
            out[100 * sum(n * n for n in sizes) + s] = sum(r >= s for r in reached) / len(reached)
    return out


def mann_kendall(series: Column) -> Column:
    """struct(tau, p_value, direction) of an array of numbers: the exact p for five values, that of the tie-corrected normal for others; (0, 1, stable) below four.

    All of it is column expressions.
    """
    n = F.size(series).cast("double")
    exact = F.create_map(*[F.lit(x) for pair in _orders_of_five().items() for x in pair])
    alike = F.transform(series, lambda x: F.size(F.filter(series, lambda y: y == x)))  # how many values are equal to each
    squares = F.aggregate(alike, F.lit(0), lambda a, c: a + c)
    ties = F.aggregate(alike, F.lit(0.0), lambda a, c: a + (c - 1) * (2 * c + 5))
    s = kendall_s(series)
    variance = (n * (n - 1) * (2 * n + 5) - ties) / 18
    z = F.when((n != 5) & (variance > 0), F.greatest(F.abs(s) - 1, F.lit(0)) / F.sqrt(variance))
    p = F.when(n == 5, F.try_element_at(exact, squares * 100 + F.abs(s))).when(variance <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_tail(z)))
    direction = F.when(s > 0, "increasing").when(s < 0, "decreasing").otherwise("stable")
    none = F.struct(F.lit(0.0).alias("tau"), F.lit(1.0).alias("p_value"), F.lit("stable").alias("direction"))
    found = F.struct((s / (n * (n - 1) / 2)).alias("tau"), p.alias("p_value"), direction.alias("direction"))
    unknown = F.struct(F.lit(None).cast("double").alias("tau"), F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("string").alias("direction"))
    return F.when(series.isNull(), unknown).when(n < 4, none).otherwise(found)


@F.pandas_udf(StructType([StructField("tau", DoubleType()), StructField("p_value", DoubleType()), StructField("direction", StringType())]))
def _mann_kendall(series: pd.Series) -> pd.DataFrame:
    """mann_kendall for use in SQL texts."""
    exact = _orders_of_five()

    def one(x) -> tuple:
        if x is None:
            return None, None, None
        x = np.asarray(x, dtype=float)
        n = len(x)
        if n < 4:
            return 0.0, 1.0, "stable"
        s = int(np.triu(np.sign(x[None, :] - x[:, None]), 1).sum())
        alike = (x[None, :] == x[:, None]).sum(axis=1)
        variance = (n * (n - 1) * (2 * n + 5) - ((alike - 1) * (2 * alike + 5)).sum()) / 18
        p = exact[100 * int(alike.sum()) + abs(s)] if n == 5 else 1.0 if variance <= 0 else min(1.0, math.erfc(max(abs(s) - 1, 0) / math.sqrt(2 * variance)))
        return s / (n * (n - 1) / 2), p, "increasing" if s > 0 else "decreasing" if s < 0 else "stable"

    return pd.DataFrame([one(x) for x in series], columns=["tau", "p_value", "direction"])


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_of(n11: int, n12: int, n21: int, n22: int) -> float:
    """Two-sided Fisher test of a 2x2 table: the share of all tables with these margins that are no likelier; 1 for an empty margin.

    Likelihoods are built from the ratios of neighbouring tables, over 40 standard deviations around the
    mode; those beyond are below any double.
    """
    row, column, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    if 0 in (row, column, n - row, n - column):
        return 1.0
    mode = (row + 1) * (column + 1) // (n + 2)
    reach = 20 + int(40 * math.sqrt(row / n * column / n * (n - row) * (n - column) / max(n - 1, 1)))
    first, last = max(0, row + column - n, mode - reach), min(row, column, mode + reach)
    if not first <= n11 <= last:
        return 0.0
    k = np.arange(first, last, dtype=np.float64)
    ratios = np.log((column - k) * (row - k)) - np.log((k + 1) * (n - row - column + k + 1))
    likely = np.concatenate(([0.0], np.cumsum(ratios)))
    weights = np.exp(likely - likely.max())
    return float(min(1.0, weights[likely <= likely[n11 - first] + 1e-8].sum() / weights.sum()))


@F.pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_of(*map(int, t)) for t in zip(a, b, c, d)])


def fisher(n11: Column, n12: Column, n21: Column, n22: Column) -> Column:
    return _fisher(n11, n12, n21, n22)


def binomial_tail_of(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    return min(1.0, math.fsum(math.exp(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))) if 0 < p < 1 else float(p >= 1 and k <= n)


@F.pandas_udf(DoubleType())
def _binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail_of(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)])


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    return _binomial_tail(k, n, p)


@F.pandas_udf(DoubleType())
def _mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, 2 * math.fsum(math.exp(_log_choose(int(x + y), i) - (x + y) * math.log(2)) for i in range(int(min(x, y)) + 1))) if x + y else 1.0 for x, y in zip(b, c)])


def mcnemar(b: Column, c: Column) -> Column:
    """Exact McNemar test on the two discordant counts."""
    return _mcnemar(b, c)


def normal_tail(z: Column) -> Column:
    """The normal distribution's tail beyond z >= 0: up to 3 by its series, further out by its continued fraction, which keep twelve digits and more."""
    density = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))
    start = F.struct(z.cast("double").alias("term"), z.cast("double").alias("sum"))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    inner = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda a: a["sum"])
    fraction = F.aggregate(F.sequence(F.lit(150), F.lit(1), F.lit(-1)), z.cast("double"), lambda a, k: z + k / a)
    return F.when(z < 3, inner).otherwise(density / fraction)


def normal_cdf(z: Column) -> Column:
    return F.when(z < 0, normal_tail(-z)).otherwise(1 - normal_tail(z))


@F.pandas_udf(DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    """normal_cdf for use in SQL texts."""
    return z.map(lambda v: math.erfc(-v / math.sqrt(2)) / 2, na_action="ignore")
