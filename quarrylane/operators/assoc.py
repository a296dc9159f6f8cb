"""Association rules over item sets of documents, and the weighted graph that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import stats
from quarrylane.scratch import materialize


def transactions(rows: DataFrame, document: str = "document_id", item: str = "item") -> DataFrame:
    """(document, items): the distinct items of each document, sorted."""
    return rows.groupBy(F.col(document).alias("document")).agg(F.array_sort(F.collect_set(item)).alias("items"))


def item_details(rows: DataFrame, document: str = "document_id", order: str = "idx", item: str = "item", category: str = "category") -> DataFrame:
    """(item, category, n): category as first seen in (document, order), ties to the smaller category; documents that have the item."""
    first = F.min(F.struct(F.col(document).alias("d"), F.col(order).alias("o"), F.col(category).alias("c")))
    return rows.groupBy(F.col(item).alias("item")).agg(first.alias("f"), F.countDistinct(document).alias("n")).select("item", F.col("f.c").alias("category"), "n")


def pairs(baskets: DataFrame) -> DataFrame:
    """(a, b, both): how many baskets (document, items) hold both items, a < b.

    Pairs are formed within a row and counted with partial sums, so that a very common pair is a few rows
    in a shuffle; a basket of k items makes k * (k - 1) / 2 pairs.
    """
    with_later = F.flatten(F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return baskets.select(F.explode(with_later).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("both"))


def pair_table(baskets: DataFrame) -> DataFrame:
    """(a, b, count_both, count_a, count_b, n_documents, jaccard, support) for all pairs that occur."""
    single = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    total = baskets.agg(F.count("*").alias("n_documents"))
    joined = pairs(baskets).join(single.select(F.col("item").alias("a"), F.col("n").alias("count_a")), "a").join(single.select(F.col("item").alias("b"), F.col("n").alias("count_b")), "b")
    joined = joined.join(F.broadcast(total))  # one row
    union = F.col("count_a") + F.col("count_b") - F.col("both")
    return joined.select("a", "b", F.col("both").alias("count_both"), "count_a", "count_b", "n_documents", (F.col("both") / union).alias("jaccard"), (F.col("both") / F.col("n_documents")).alias("support"))


def benjamini_hochberg(rows: DataFrame, p: str, tie: str | list[str], alpha: float = 0.05, out: str = "bh_significant") -> DataFrame:
    """Adds whether a row's p is rejected by the step-up rule over all rows; `tie` orders equal p. Rows without p take no part and aren't rejected.

    Rows are dealt out by ranges of p, and a row's rank is its place in its range plus the sizes of the ranges
    before, so no task sees all of them. The largest rank that passes is one number.
    """
    ties = [tie] if isinstance(tie, str) else tie
    order = [F.col(f"row.{c}") for c in (p, *ties)]
    nested = rows.select(F.struct(*rows.columns).alias("row"))
    ranges = materialize(nested.repartitionByRange(F.col(f"row.{p}").asc_nulls_last(), *order[1:]).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranges.filter(F.col(f"row.{p}").isNotNull()).groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("part").orderBy(order[0].asc_nulls_last(), *order[1:]))
    ranked = ranges.withColumn("place", place).join(F.broadcast(starts.select("part", "start")), "part", "left").withColumn("rank", F.col("place") + F.col("start"))
    m = sizes.agg(F.sum("n")).first()[0] or 0
    cut = ranked.agg(F.max(F.when(F.col(f"row.{p}") <= alpha * F.col("rank") / F.lit(m), F.col("rank")))).first()[0]
    rejected = F.coalesce(F.col(f"row.{p}").isNotNull() & (F.col("rank") <= F.lit(cut or 0)), F.lit(False))
    return ranked.select(*[F.col(f"row.{c}").alias(c) for c in rows.columns if c != out], rejected.alias(out))


def rules(table: DataFrame, support: float = 0.01, confidence: float = 0.40, lift: float = 1.2) -> DataFrame:
    """Rules in both directions from a pair_table that reach support, confidence and exceed lift, with Fisher's p and its BH decision."""
    one = table.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "count_both", F.col("count_a").alias("count_ant"), F.col("count_b").alias("count_con"), "n_documents", "jaccard", "support")
    two = table.select(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), "count_both", F.col("count_b").alias("count_ant"), F.col("count_a").alias("count_con"), "n_documents", "jaccard", "support")
    both = one.union(two).withColumn("confidence", F.col("count_both") / F.col("count_ant")).withColumn("lift", F.col("confidence") / (F.col("count_con") / F.col("n_documents")))
    kept = both.filter((F.col("support") >= support) & (F.col("confidence") >= confidence) & (F.col("lift") > lift))
    n11, n12, n21 = F.col("count_both"), F.col("count_ant") - F.col("count_both"), F.col("count_con") - F.col("count_both")
    tested = kept.withColumn("fisher_p", stats.fisher(n11, n12, n21, F.col("n_documents") - n11 - n12 - n21))
    return benjamini_hochberg(tested, "fisher_p", ["antecedent", "consequent"])


def direction(rank_from: Column, rank_to: Column) -> Column:
    """forward, backward, same or unknown, by the order of two categories."""
    return F.when(rank_from.isNull() | rank_to.isNull(), "unknown").when(rank_from < rank_to, "forward").when(rank_from > rank_to, "backward").otherwise("same")


def graph(table: DataFrame, jaccard: float = 0.02, count: int = 2, excised: str | None = None) -> DataFrame:
    """(src, dst, weight) both ways for pairs of at least this Jaccard index and count, without one excised node."""
    kept = table.filter((F.col("jaccard") >= jaccard) & (F.col("count_both") >= count))
    if excised is not None:
        kept = kept.filter((F.col("a") != excised) & (F.col("b") != excised))
    return kept.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("jaccard").alias("weight")).union(kept.select("b", "a", "jaccard"))


def by_category_pair(found: DataFrame, details: DataFrame, pairs_kept: int = 20, per_pair: int = 5) -> DataFrame:
    """The per_pair most confident rules of each of the pairs_kept category pairs with most rules."""
    of = details.select("item", "category")
    named = found.join(of.select(F.col("item").alias("antecedent"), F.col("category").alias("category_from")), "antecedent").join(of.select(F.col("item").alias("consequent"), F.col("category").alias("category_to")), "consequent")
    sizes = named.groupBy("category_from", "category_to").agg(F.count("*").alias("rules")).orderBy(F.desc("rules"), "category_from", "category_to").limit(pairs_kept)
    place = F.row_number().over(Window.partitionBy("category_from", "category_to").orderBy(F.desc("confidence"), F.desc("lift"), "antecedent", "consequent"))
    return named.join(F.broadcast(sizes), ["category_from", "category_to"]).withColumn("place", place).filter(F.col("place") <= per_pair)
