"""The library's functions under names in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarrylane.functions import stats
from quarrylane.operators import screen

_FORMULAS = {
    "hamming64": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    "f1_of": ("tp BIGINT, fp BIGINT, fn BIGINT", "DOUBLE", "try_divide(2.0D * tp, 2 * tp + fp + fn)"),
    "precision_of": ("tp BIGINT, fp BIGINT", "DOUBLE", "try_divide(CAST(tp AS DOUBLE), tp + fp)"),
    "recall_of": ("tp BIGINT, fn BIGINT", "DOUBLE", "try_divide(CAST(tp AS DOUBLE), tp + fn)"),
    "mcc_of": ("tp BIGINT, fp BIGINT, fn BIGINT, tn BIGINT", "DOUBLE", "try_divide(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn, sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)))"),
    "parent_item": ("item STRING", "STRING", "substring_index(item, '.', 1)"),
    "canonical_url": ("url STRING", "STRING", "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers formulas as SQL functions, which Catalyst inlines, and tests as Arrow UDFs; returns their names."""
    for name, (parameters, kind, body) in _FORMULAS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    udfs = {"simhash64": screen._simhash, "mann_kendall": stats._mann_kendall, "fisher_exact": stats._fisher, "binomial_tail": stats._binomial_tail, "mcnemar_exact": stats._mcnemar, "normal_cdf": stats._normal_cdf}
    for name, f in udfs.items():
        spark.udf.register(name, f)
    return [*_FORMULAS, *udfs]
