"""Evaluation of raters against a gold sample: confusion, metrics, agreement, bootstrap, equivalence.

Undefined metrics are null, never NaN, so that they survive sums and comparisons.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("mcc", "f1", "precision", "recall", "accuracy", "balanced_accuracy", "npv", "kappa")


def counts(truth: Column, judged: Column) -> list[Column]:
    """tp, fp, fn, tn and n over rows where both labels (1 or 0) are there."""
    t, j = truth == 1, judged == 1
    both = truth.isNotNull() & judged.isNotNull()
    return [F.count_if(both & t & j).alias("tp"), F.count_if(both & ~t & j).alias("fp"), F.count_if(both & t & ~j).alias("fn"), F.count_if(both & ~t & ~j).alias("tn"), F.count_if(both).alias("n")]


def metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics of a 2x2 confusion; null where the denominator is empty."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    over = lambda a, b: F.try_divide(a, b)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    agree = over(tp + tn, n)
    chance = over((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return {
        "mcc": over(tp * tn - fp * fn, root), "f1": over(2 * tp, 2 * tp + fp + fn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "accuracy": agree,
        "balanced_accuracy": (over(tp, tp + fn) + over(tn, tn + fp)) / 2, "npv": over(tn, tn + fn), "kappa": over(agree - chance, 1 - chance),
    }


def with_metrics(confusions: DataFrame, digits: int = 9, names: tuple[str, ...] = METRICS) -> DataFrame:
    """Adds metrics to rows with tp, fp, fn, tn."""
    found = metrics(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return confusions.withColumns({k: F.round(found[k], digits) for k in names})


def binary(label: Column) -> Column:
    """1 for accept, 0 for reject, null for others."""
    return F.when(label == "accept", 1).when(label == "reject", 0)


def confusion_by_scope(gold: DataFrame, scope: str, rows: str, columns: str, row_values: list[str], column_values: list[str]) -> DataFrame:
    """Counts of (scope, row label, column label) and over all scopes ('combined'), with zeros for what doesn't occur."""
    spark = gold.sparkSession
    kept = gold.filter(F.col(columns).isNotNull())
    seen = kept.groupingSets([[F.col(scope), F.col(rows), F.col(columns)], [F.col(rows), F.col(columns)]], F.col(scope), F.col(rows), F.col(columns)).agg(F.count("*").alias("n"), F.grouping(scope).alias("g"))
    seen = seen.select(F.when(F.col("g") == 1, "combined").otherwise(F.col(scope)).alias("scope"), F.col(rows).alias("row"), F.col(columns).alias("column"), "n")
    scopes = gold.select(F.col(scope).alias("scope")).distinct().union(spark.createDataFrame([("combined",)], "scope string"))
    grid = scopes.withColumn("row", F.explode(F.array(*map(F.lit, row_values)))).withColumn("column", F.explode(F.array(*map(F.lit, column_values))))
    return grid.join(seen, ["scope", "row", "column"], "left").select("scope", "row", "column", F.coalesce("n", F.lit(0)).alias("n"))


def by_scope(gold: DataFrame, scope: str, truth: Column, judged: Column) -> DataFrame:
    """Confusions of each scope and of all ('combined')."""
    labelled = gold.select(F.col(scope).alias("scope"), truth.alias("t"), judged.alias("j"))
    each = labelled.groupBy("scope").agg(*counts(F.col("t"), F.col("j")))
    return each.union(labelled.agg(*counts(F.col("t"), F.col("j"))).select(F.lit("combined").alias("scope"), "tp", "fp", "fn", "tn", "n"))


def by_dimension(gold: DataFrame, key: str, truth: Column, judged: Column, least: int | None = None) -> DataFrame:
    """Metrics by a dimension; keys with fewer than `least` rows share one row, _other_."""
    labelled = gold.select(F.col(key).alias("key"), truth.alias("t"), judged.alias("j")).filter("t IS NOT NULL AND j IS NOT NULL")
    cells = labelled.groupBy("key").agg(*counts(F.col("t"), F.col("j")), F.sum("t").alias("accepts"))
    if least:
        cells = cells.withColumn("key", F.when(F.col("n") < least, F.lit(f"_other_(N<{least})")).otherwise(F.col("key")))
        cells = cells.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "n", "accepts")])
    return with_metrics(cells.withColumn("accept_rate", F.round(F.try_divide(F.col("accepts").cast("double"), F.col("n")), 9)).drop("accepts"))


def alpha(pairs: DataFrame, keys: list[str], one: str, other: str, values: list[str], ordinal: bool = False) -> DataFrame:
    """(keys..., n, alpha): Krippendorff's alpha of two raters over rows where both labels are among values (in order, if ordinal).

    From the coincidence table: disagreement seen over disagreement expected from the margins. Null for fewer than two rows,
    and where only one label occurs.
    """
    place = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
    rows = pairs.select(*keys, place[F.col(one)].alias("a"), place[F.col(other)].alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    k = len(values)
    margin = [(F.count_if(F.col("a") == i) + F.count_if(F.col("b") == i)).cast("double").alias(f"n{i}") for i in range(k)]
    seen = [F.count_if((F.least("a", "b") == i) & (F.greatest("a", "b") == j)).cast("double").alias(f"o{i}_{j}") for i in range(k) for j in range(i + 1, k)]
    table = rows.groupBy(*keys).agg(F.count("*").alias("n"), *margin, *seen)

    def delta(i: int, j: int) -> Column:
        if not ordinal:
            return F.lit(1.0)
        between = sum((F.col(f"n{m}") for m in range(i, j + 1)), F.lit(0.0)) - (F.col(f"n{i}") + F.col(f"n{j}")) / 2
        return between * between

    total = 2.0 * F.col("n")
    observed = sum((F.col(f"o{i}_{j}") * delta(i, j) for i in range(k) for j in range(i + 1, k)), F.lit(0.0))
    expected = sum((F.col(f"n{i}") * F.col(f"n{j}") * delta(i, j) for i in range(k) for j in range(i + 1, k)), F.lit(0.0))
    # each differing row is two coincidences, each pair of margins is counted once: (N - 1) * observed / expected
    return table.select(*keys, "n", F.round(F.when(F.col("n") >= 2, 1 - F.try_divide((total - 1) * observed, expected)), 9).alias("alpha"))


def sensitivity(gold: DataFrame, scope: str, truth: Column, judged: Column) -> DataFrame:
    """Confusions when missing labels are left out (complete), all right (best) or all wrong (worst), by scope and of all ('combined'), in one pass."""
    parts = {"complete": judged, "best": F.coalesce(judged, truth), "worst": F.coalesce(judged, 1 - truth)}
    cases = F.inline(F.array(*[F.struct(F.lit(name).alias("scenario"), j.alias("j")) for name, j in parts.items()]))
    labelled = gold.select(F.col(scope).alias("scope"), truth.alias("t"), judged.alias("judged"), cases)
    sets = [[F.col("scenario"), F.col("scope")], [F.col("scenario")]]
    cells = labelled.groupingSets(sets, "scenario", "scope").agg(*counts(F.col("t"), F.col("j")), F.grouping("scope").alias("g"))
    return with_metrics(cells.select(F.when(F.col("g") == 1, "combined").otherwise(F.col("scope")).alias("scope"), "tp", "fp", "fn", "tn", "n", "scenario"))


def error_correction(gold: DataFrame, code: str, first: Column, second: Column, truth: Column) -> DataFrame:
    """By error code and over all (_total): rows, the first rater's wrong accepts and rejects, and how many the second puts right or repeats."""
    rows = gold.select(F.col(code).alias("code"), first.alias("f"), second.alias("s"), truth.alias("t")).filter("code IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL AND f IS NOT NULL")
    wrong = F.col("f") != F.col("t")
    sums = [F.count("*").alias("n"), F.count_if((F.col("f") == 1) & (F.col("t") == 0)).alias("v1_fp"), F.count_if((F.col("f") == 0) & (F.col("t") == 1)).alias("v1_fn"), F.count_if(wrong & (F.col("s") == F.col("t"))).alias("corrected"), F.count_if(wrong & (F.col("s") != F.col("t"))).alias("repeated")]
    rolled = rows.rollup("code").agg(*sums, F.grouping("code").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "_total").otherwise(F.col("code")).alias("error_code"), "n", "v1_fp", "v1_fn", "corrected", "repeated", F.round(F.try_divide(F.col("corrected").cast("double"), F.col("corrected") + F.col("repeated")), 9).alias("correction_rate"))


def bootstrap(gold: DataFrame, scope: str, truth: Column, judged: Column, iterations: int = 1000, seed: int = 42, metric: str = "f1", method: str = "bca") -> DataFrame:
    """(scope, n, point, ci_low, ci_high): interval of a metric.

    Methods: bca (levels kept within .001 and .999, null for fewer than 10 replicates), clipped (the share
    below the point kept within 1e-9 of 0 and 1, levels as they come, null for n under 5 or fewer than 50
    replicates), percentile (order statistics).

    A metric depends on four counts only, so a replicate is a multinomial draw over four cells: each is
    drawn from the cell probabilities of a scope, never from its rows. The jackknife is closed form too.
    """
    import pandas as pd

    cells = by_scope(gold, scope, truth, judged)
    point = with_metrics(cells, names=(metric,)).select("scope", "n", F.col(metric).alias("point"), "tp", "fp", "fn", "tn")

    def value(t):
        tp, fp, fn, tn = (float(v) for v in t)
        over = lambda a, b: a / b if b else math.nan
        n = tp + fp + fn + tn
        chance = over((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
        return {
            "mcc": over(tp * tn - fp * fn, math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "f1": over(2 * tp, 2 * tp + fp + fn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn),
            "accuracy": over(tp + tn, n), "balanced_accuracy": (over(tp, tp + fn) + over(tn, tn + fp)) / 2, "npv": over(tn, tn + fn), "kappa": over(over(tp + tn, n) - chance, 1 - chance),
        }[metric]

    def run(batches):
        import numpy as np
        import xxhash

        normal = NormalDist()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                table = np.array([r.tp, r.fp, r.fn, r.tn], dtype=float)
                n, low, high = int(table.sum()), None, None
                if n:
                    draw = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}:{r.scope}")).multinomial(n, table / n, size=iterations)
                    reps = np.array([v for v in map(value, draw) if not math.isnan(v)])
                    here = value(table)
                    enough = n >= 5 and len(reps) >= 50 if method == "clipped" else len(reps) >= 10
                    if enough and method == "percentile":
                        ordered = np.sort(reps)
                        low, high = (float(ordered[min(len(ordered) - 1, int(q * len(ordered)))]) for q in (0.025, 0.975))
                    elif enough and not math.isnan(here):
                        share = (reps < here).mean()
                        share = min(max(share, 1e-9), 1 - 1e-9) if method == "clipped" else share
                        z0 = normal.inv_cdf(share) if 0 < share < 1 else 0.0
                        left = [(table[k], value(table - np.eye(4)[k])) for k in range(4) if table[k]]
                        left = [(w, v) for w, v in left if not math.isnan(v)]
                        mean = sum(w * v for w, v in left) / max(sum(w for w, _ in left), 1)
                        cube, square = sum(w * (mean - v) ** 3 for w, v in left), sum(w * (mean - v) ** 2 for w, v in left)
                        a = cube / (6 * square**1.5) if square else 0.0
                        ends = [normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
                        ends = ends if method == "clipped" else [min(max(e, 0.001), 0.999) for e in ends]
                        low, high = (float(v) for v in np.quantile(reps, ends))
                out.append((r.scope, r.n, r.point, low, high))
            yield pd.DataFrame(out, columns=["scope", "n", "point", "ci_low", "ci_high"])

    return point.mapInPandas(run, "scope string, n long, point double, ci_low double, ci_high double")


def post_stratified(points: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of points (scope, point) with weights (scope, n): one row."""
    return points.join(weights.select("scope", F.col("n").alias("w")), "scope").agg(F.try_divide(F.sum(F.col("point") * F.col("w")), F.sum("w")).alias("point"))


def tost(one_accepts: Column, one_n: Column, other_accepts: Column, other_n: Column, delta: float = 0.05) -> dict[str, Column]:
    """Two one-sided z tests that two shares differ by less than delta (unpooled), without the normal distribution's tail."""
    p, q = one_accepts / one_n, other_accepts / other_n
    error = F.sqrt(p * (1 - p) / one_n + q * (1 - q) / other_n)
    return {"p_one": p, "p_other": q, "difference": p - q, "standard_error": error, "z_low": F.try_divide(p - q + delta, error), "z_high": F.try_divide(p - q - delta, error)}


def least_delta(difference: Column, error: Column, level: float = 0.05) -> Column:
    """The smallest margin at which equivalence would be shown."""
    return F.abs(difference) + error * NormalDist().inv_cdf(1 - level)


def shares(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by keys and their per cent of all."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
