"""Joins, windows, allocation and sampling that the analyses are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order, which should be total."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def latest_per_key(rows: DataFrame, key: str, by: str) -> DataFrame:
    """One whole row for each key, with the largest `by`; of equal ones that with the largest hash of all columns, so that reruns agree."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(whole, F.struct(F.col(by), F.xxhash64(*rows.columns))).alias("r")).select("r.*")


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """existing plus those rows of new whose key it doesn't have, one for each key."""
    return existing.unionByName(best_per_key(new.join(existing.select(*key), key, "left_anti"), key, *order))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """existing with rows replaced by those of new with the same key."""
    return existing.join(new.select(*key), key, "left_anti").unionByName(best_per_key(new, key, *order))


def cascade_delete(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """children without those of the parents given."""
    return children.join(parents.select(key), key, "left_anti")


def with_fallback(rows: DataFrame, lookup: DataFrame, item: Column, parent: Column, name: str = "name") -> DataFrame:
    """Adds a name from lookup (id, name): the item's, else its parent's, else the item itself. The lookup is one row for each id."""
    one = lookup.select(F.col("id").alias("__i"), F.col(name).alias("__n"))
    two = lookup.select(F.col("id").alias("__p"), F.col(name).alias("__m"))
    joined = rows.withColumns({"__item": item, "__parent": parent}).join(one, F.col("__item") == F.col("__i"), "left").join(two, F.col("__parent") == F.col("__p"), "left")
    return joined.withColumn(name, F.coalesce("__n", "__m", "__item")).drop("__item", "__parent", "__i", "__n", "__p", "__m")


def allocate(pools: DataFrame, total: int, key: str, n: str = "n") -> DataFrame:
    """Adds `take`: total dealt over pools in proportion, half-even rounding, largest pools first, capped by pool and by what is left.

    Pools are groups that have been counted, such as sources and labels; one task puts them in order.
    """
    order = Window.orderBy(F.desc(n), key)
    want = F.least(F.bround(F.lit(float(total)) * F.col(n) / F.sum(n).over(Window.partitionBy())).cast("long"), F.col(n))
    before = F.coalesce(F.sum("__want").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pools.withColumn("__want", want).withColumn("take", F.greatest(F.lit(0), F.least(F.col("__want"), F.lit(total) - before))).drop("__want")


def sample(rows: DataFrame, key: str, n: int, seed: int = 43) -> DataFrame:
    """n rows drawn by a hash of key and seed: the same on every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def page(rows: DataFrame, number: int, size: int, *order: Column, least: int = 5, most: int = 50) -> DataFrame:
    """A page of rows in a total order; the size is kept between least and most."""
    size = min(max(size, least), most)
    return rows.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)
