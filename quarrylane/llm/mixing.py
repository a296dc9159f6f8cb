"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words. A document's expected copies are
its source's target over its source's size; the documents of a source are laid
along a line, each as long as its expected copies, and with one offset for the
source a document is emitted once for each integer boundary that its piece
crosses. The line is ordered by size class, then by a digest, so that neighbours
are of like size and the words taken stay close to the target.

The position on the line is a distributed rank: counts of cells
(source, size class, two hex digits of a digest) are summed up along the source,
and only rows of one cell are sorted together. A hot source is so dealt over
256 cells for each size class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import carried, materialize, words

#: Sources whose targets one task finds, at most.
MOST_IN_ORDER = 100_000


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def _weights(weights: Sequence[int], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))


def _targets_in_order(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """The level found in the order of cap / weight, by windows over all sources, in one task."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "rank")
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = sizes.select("source", "source_size").withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", _weights(weights, F.col("rank"))).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("all", F.lit(float(share)) * F.sum("source_size").over(everything))
    ranked = ranked.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def _targets_in_rounds(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """The same level by rounds of two sums each: a round caps the sources that the last level would fill, until none is new.

    The rank of a source in code point order is its place in its range of names plus the sizes of the ranges before.
    """
    ranges = materialize(sizes.select("source", "source_size").repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "source-ranges")
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("start"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = ranges.withColumn("place", place).join(F.broadcast(starts), "part")
    weighed = materialize(ranked.select("source", "source_size", _weights(weights, F.col("place") + F.col("start")).alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")), "weighed-sources")
    goal = share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = -1.0, -1
    while True:
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        n, caps, rest = weighed.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, (goal - (caps or 0.0)) / rest
    target = F.col("cap") if not rest else F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: (source, source_size), a row for each source -> the same with target.

    The weights repeat over the sources in code point order, null last. Targets share `share` times
    all words by weight; one that would pass `most` times its source's size stops there, and what is
    left is dealt again by weight. That fixed point is min(cap, level * weight) for one level. Up to
    MOST_IN_ORDER sources, which are counted, it is found in one task; more (such as domains) take rounds
    of distributed sums, with the same targets but for rounding.
    """
    few = sizes.limit(MOST_IN_ORDER + 1).count() <= MOST_IN_ORDER
    return (_targets_in_order if few else _targets_in_rounds)(sizes, weights, share, most)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", prefix: str = "mix_") -> DataFrame:
    """Adds size, source_size, target and copies (each under `prefix`) to every row of docs (doc_id, text, source, ...).

    Nulls: a null text has size 0, a null source is a source of its own, a row without doc_id is placed
    by a digest of its text. Ties and repeated rows: every row is a document; rows alike in source, size and
    doc_id (without one: in text) are interchangeable. Sources without words get target 0 and no copies. An
    empty table gives an empty one. Other columns are carried along, whatever their names; those named like
    an added one are replaced.
    """
    added = [prefix + c for c in ("size", "source_size", "target", "copies")]
    own = [c for c in docs.columns if c not in added]
    away, column, back = carried(own)
    counted = docs.select(*away, F.size(words(F.col("text"))).cast("long").alias("size"))
    bits = F.length(F.bin("size"))
    class_ = bits * 32 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 5, F.lit(0))).cast("int")
    digest = F.md5(F.coalesce(column["doc_id"].cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(column["text"], F.lit(""))))))
    sized = counted.select(*column.values(), "size", _source_key(column["source"]).alias("key"), class_.alias("class"), digest.alias("digest"), F.substring(digest, 1, 2).alias("bin"))

    cells = materialize(sized.groupBy("key", "class", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "cells")
    along = Window.partitionBy("key").orderBy("class", "bin")  # a source has some 300,000 cells at most, however many its rows
    placed_cells = cells.withColumn("start", F.sum("n").over(along) - F.col("n"))
    sizes = cells.groupBy("key").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("key") != "0", F.expr("substring(key, 2)")))
    goal = targets(sizes.select("source", "source_size"), weights, share, most).select(_source_key(F.col("source")).alias("key"), "source_size", "target")
    goals = placed_cells.join(goal, "key").select("key", "class", "bin", "start", "source_size", "target")

    placed = sized.join(goals, ["key", "class", "bin"])
    in_cell = Window.partitionBy("key", "class", "bin").orderBy(F.col("size"), F.col("digest"), column["doc_id"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    placed = placed.withColumns({"place": F.row_number().over(in_cell) + F.col("start"), "rate": rate, "offset": offset})
    copies = F.floor(F.col("place") * F.col("rate") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("rate") + F.col("offset"))
    made = dict(zip(added, (F.col("size"), F.col("source_size"), F.col("target"), copies.cast("long"))))
    return placed.select(*back, *[c.alias(name) for name, c in made.items()])


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is copied, with the columns of docs."""
    column = options.get("prefix", "mix_") + "copies"
    return mix(docs, **options).withColumn(column, F.explode(F.array_repeat(F.lit(1), F.col(column).cast("int")))).select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: size, source_size, target and words taken of every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


OP7_SQL = r"""
WITH s AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT *, length(bin(size)) AS bits, md5(coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))) AS digest, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k FROM s),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bits * 32 + (size >> greatest(bits - 5, 0)), substr(digest, 1, 2), size, digest, doc_id) AS place FROM t),
g AS (SELECT k, sum(size)::BIGINT AS source_size FROM t GROUP BY k),
r AS (SELECT *, row_number() OVER (ORDER BY (k = '0'), k) AS rnk FROM g),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((rnk - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
f AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
v AS (SELECT (SELECT lvl FROM f WHERE lvl <= ratio ORDER BY ratio, rnk LIMIT 1) AS level),
goal AS (SELECT k, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM f, v),
m AS (SELECT doc_id, size, source_size, target, place, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate, ('0x' || substr(md5('mix:' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM placed JOIN goal USING (k))
SELECT doc_id, size, source_size, target, ((floor(place * rate + u) - floor((place - 1) * rate + u)) * size)::BIGINT AS taken FROM m
"""
