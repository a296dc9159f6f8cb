"""Lag of a corpus behind the releases of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalogue_index(entries: DataFrame) -> DataFrame:
    """entries (item, version int, released string, name, created, revoked) -> one row for each item.

    The first release, the first in which it isn't revoked, and the latest name and state.
    """
    first, live, last = F.struct("version", "released"), F.when(~F.col("revoked"), F.struct("version", "released")), F.col("version")
    found = entries.groupBy("item").agg(F.min(first).alias("f"), F.min(live).alias("l"), F.max_by(F.struct("name", "created", "revoked"), last).alias("m"))
    return found.select("item", F.col("f.version").alias("first_version"), F.col("f.released").alias("first_released"), F.col("l.version").alias("live_version"), F.col("l.released").alias("live_released"), "m.name", "m.created", "m.revoked")


def first_seen(rows: DataFrame, item: str = "item", published: str = "published", document: str = "document_id", source: str = "source") -> DataFrame:
    """First date and where, lower median date, count, documents and sources of each item; rows without a date are left out."""
    dated = rows.filter(F.col(published).isNotNull() & (F.col(published) != ""))
    first = F.min(F.struct(F.col(published).alias("p"), F.col(document).alias("d"), F.col(source).alias("s"))).alias("f")
    found = dated.groupBy(F.col(item).alias("item")).agg(first, lower_median(published).alias("median_seen"), F.count("*").alias("n"), F.countDistinct(document).alias("documents"), F.countDistinct(source).alias("sources"))
    return found.select("item", F.col("f.p").alias("first_seen"), F.col("f.d").alias("first_document"), F.col("f.s").alias("first_source"), "median_seen", "n", "documents", "sources")


def lower_median(column: str) -> Column:
    """The date at place (n - 1) // 2 in order; the whole list is sorted only in numbers of days."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY datediff(CAST({column} AS DATE), DATE '1970-01-01'))").cast("int")).cast("string")


def lags(seen: DataFrame, index: DataFrame, start: str) -> DataFrame:
    """Days from release to sighting: {first, median} x {first release, live release (else first), created}; null where a date is missing."""
    joined = seen.join(index, "item", "left")
    live = F.coalesce("live_released", "first_released")
    days = lambda a, b: F.datediff(F.try_to_date(a), F.try_to_date(b))
    made = {}
    for name, of in (("first", F.col("first_seen")), ("median", F.col("median_seen"))):
        for base, at in (("release", F.col("first_released")), ("live", live), ("created", F.col("created"))):
            made[f"lag_{name}_{base}"] = days(of, at)
    return joined.withColumns(made).withColumn("is_post_start", F.col("first_released") > start)


def lag_summary(rows: DataFrame, lag: str) -> DataFrame:
    """n, min, p10, p50, p90 (the value at place int(p * n)), max and positives of a lag."""
    values = F.array_sort(F.collect_list(lag))  # a row for each item of a catalogue
    at = lambda p: F.get("v", F.least(F.size("v") - 1, F.floor(F.lit(p) * F.size("v")).cast("int")))
    return rows.filter(F.col(lag).isNotNull()).agg(values.alias("v"), F.count_if(F.col(lag) > 0).alias("positive")).select(F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).alias("min"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.get("v", F.size("v") - 1).alias("max"), "positive")


def histogram(rows: DataFrame, value: str, low: int, width: int, bins: int) -> DataFrame:
    """(bin, low, n) for every bin, values outside left out."""
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    of = F.floor((F.col(value) - low) / width).cast("int").alias("bin")
    n = rows.filter((F.col(value) >= low) & (F.col(value) < low + bins * width)).groupBy(of).agg(F.count("*").alias("n"))
    return grid.join(n, "bin", "left").select("bin", (F.col("bin") * width + low).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))
