"""Trends over time: volumes, shares, emergence, source-normalised growth, entropy, monotone trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions.stats import kendall_s

__all__ = ["contribution", "copresence", "dense_series", "emergence", "kendall_s", "normalised_emergence", "quarter_of", "share_by_year", "source_entropy", "top_by_group", "trend_category", "volume_by_quarter", "volume_by_year", "year_over_year"]


def year_over_year(counts: DataFrame, period: str = "year", n: str = "n") -> DataFrame:
    """Adds the change against the previous period, absolute and in per cent; null for the first."""
    before = F.lag(n).over(Window.orderBy(period))
    return counts.withColumns({"yoy_delta": F.col(n) - before, "yoy_pct": F.round(100.0 * F.try_divide(F.col(n) - before, before), 6)})


def volume_by_year(rows: DataFrame, year: str = "year", excluded: Column | None = None) -> DataFrame:
    kept = rows if excluded is None else rows.filter(~excluded)
    return year_over_year(kept.groupBy(F.col(year).alias("year")).agg(F.count("*").alias("n")))


def quarter_of(published: Column) -> Column:
    """Quarter of an ISO date string; the first for strings without a month."""
    month = F.when(F.length(published) >= 7, F.substring(published, 6, 2).try_cast("int"))
    return F.concat(F.lit("Q"), (F.floor((F.coalesce(month, F.lit(1)) - 1) / 3) + 1).cast("string"))


def volume_by_quarter(rows: DataFrame, published: str = "published") -> DataFrame:
    quartered = rows.select(F.substring(published, 1, 4).alias("year"), quarter_of(F.col(published)).alias("q"))
    return quartered.groupBy("year").pivot("q", ["Q1", "Q2", "Q3", "Q4"]).count().na.fill(0)


def share_by_year(rows: DataFrame, category: str, values: Sequence[str], year: str = "year") -> DataFrame:
    """Counts of each category value by year, and their total."""
    counts = rows.groupBy(F.col(year).alias("year")).agg(F.count("*").alias("total"), *[F.count_if(F.col(category) == v).alias(v.lower()) for v in values])
    return counts


def top_by_group(rows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k most frequent items of each group; ties to the smaller item."""
    counts = rows.groupBy(group, item).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item)))
    return ranked.filter(F.col("rank") <= k)


def emergence(rows: DataFrame, item: str, early: Column, late: Column, year: str = "year", least: int = 5, up: float = 1.5, down: float = 0.5, floor: int = 5, new_from: int | None = None) -> DataFrame:
    """Counts of an early and a late period by item, their ratio (null where nothing is early) and a label.

    emerging: ratio of at least `up` (or nothing early) and `floor` late; declining: ratio of at most `down` and `floor` early.
    Items with fewer than `least` rows in both periods are left out.
    """
    counts = rows.groupBy(F.col(item).alias("item")).agg(F.count_if(early).alias("early"), F.count_if(late).alias("late"), F.min(year).alias("first_year"))
    counts = counts.filter(F.col("early") + F.col("late") >= least).withColumn("total", F.col("early") + F.col("late"))
    growth = F.try_divide(F.col("late").cast("double"), F.col("early"))
    rising = (F.coalesce(growth, F.lit(float("inf"))) >= up) & (F.col("late") >= floor)
    falling = (growth <= down) & (F.col("early") >= floor)
    labelled = counts.withColumns({"growth": F.round(growth, 6), "trend": F.when(rising, "emerging").when(falling, "declining").otherwise("steady")})
    return labelled if new_from is None else labelled.withColumn("is_new", F.col("first_year") >= new_from)


def contribution(rows: DataFrame, source: str, years: Sequence[int], year: str = "year") -> DataFrame:
    """Rows of each source by year, and their total."""
    return rows.groupBy(source).agg(*[F.count_if(F.col(year) == y).alias(f"y{y}") for y in years], F.count("*").alias("total"))


def copresence(rows: DataFrame, document: str, year: str, one: Column, other: Column) -> DataFrame:
    """Per year: documents, those with one kind, with the other, with both, and the share of both."""
    per_document = rows.groupBy(document, year).agg(F.max(one.cast("int")).alias("a"), F.max(other.cast("int")).alias("b"))
    years = per_document.groupBy(year).agg(F.count("*").alias("docs"), F.sum("a").alias("has_one"), F.sum("b").alias("has_other"), F.sum(F.col("a") * F.col("b")).alias("has_both"))
    return years.withColumn("rate", F.round(F.try_divide(F.col("has_both").cast("double"), F.col("docs")), 6))


def normalised_emergence(rows: DataFrame, documents: DataFrame, item: str, source: str, early: Column, late: Column, year: str = "year", floor: float = 0.05, tiny: float = 0.001, up: float = 1.5, down: float = 0.5, least: float = 0.1) -> DataFrame:
    """Emergence with each count divided by the source's documents of that year, so that a growing source is no trend."""
    per = rows.groupBy(F.col(item).alias("item"), F.col(source).alias("s"), F.col(year).alias("y")).agg(F.count("*").alias("c"))
    base = documents.groupBy(F.col(source).alias("s"), F.col(year).alias("y")).agg(F.count("*").alias("n"))
    rate = per.join(base, ["s", "y"]).withColumn("r", F.col("c").cast("double") / F.col("n")).withColumnRenamed("y", year)
    sums = rate.groupBy("item").agg(F.coalesce(F.sum(F.when(early, F.col("r"))), F.lit(0.0)).alias("early"), F.coalesce(F.sum(F.when(late, F.col("r"))), F.lit(0.0)).alias("late"))
    sums = sums.filter(F.col("early") + F.col("late") >= floor)
    growth = F.when(F.col("early") > tiny, F.col("late") / F.col("early"))
    rising = (F.coalesce(growth, F.lit(float("inf"))) >= up) & (F.col("late") >= least)
    falling = (growth <= down) & (F.col("early") >= least)
    return sums.select("item", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"), F.round(growth, 6).alias("growth"), F.when(rising, "emerging").when(falling, "declining").otherwise("steady").alias("trend"))


def source_entropy(rows: DataFrame, year: str, source: str) -> DataFrame:
    """Shannon entropy of sources by year, in bits and as a share of the most that all sources allow; the three largest sources."""
    counts = rows.groupBy(year, source).agg(F.count("*").alias("n"))
    total = Window.partitionBy(year)
    p = F.col("n") / F.sum("n").over(total)
    shares = counts.withColumn("p", p)
    sources = counts.agg(F.countDistinct(source).alias("k"))
    by_year = shares.groupBy(year).agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(source).alias("s")))).alias("all"))
    joined = by_year.join(F.broadcast(sources))  # one row
    top = F.array_join(F.transform(F.slice("all", 1, 3), lambda x: x["s"]), ", ")
    return joined.select(year, F.round("h", 6).alias("entropy_bits"), F.round(F.when(F.col("k") > 1, F.col("h") / F.log2("k")), 6).alias("entropy_normalized"), top.alias("top3_sources"))


def dense_series(rows: DataFrame, item: str, year: str, years: Sequence[int]) -> DataFrame:
    """(item, series): counts for each of the years in order, zero where there is none."""
    counts = [F.count_if(F.col(year) == y) for y in years]
    return rows.groupBy(F.col(item).alias("item")).agg(F.array(*counts).alias("series"))


def trend_category(total: Column, mean: Column, direction: Column, significant: Column) -> Column:
    """High, Medium or Infrequent by mean, crossed with a significant direction."""
    level = F.when(mean >= 10, "High").when(mean >= 3, "Medium").otherwise("Infrequent")
    up, down = significant & (direction == "increasing"), significant & (direction == "decreasing")
    return F.when(up & (level == "Infrequent"), "EMERGING").when(up, "RISING").when(down, "OBSOLESCENT").when(level == "High", "CORE").otherwise("STABLE")
