"""Column expressions and small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.scratch import materialize, shared_dir

__all__ = ["LOWER", "SPACES", "MOST_BROADCAST", "UPPER", "bounded_sample", "broadcast_if_small", "carried", "crc_mod", "let", "materialize", "shared_dir", "table", "words"]

#: The six characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes in memory of a side that may be broadcast, at most; measured before, and larger sides are joined by a shuffle.
MOST_BROADCAST = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: Column, most: int | None = None) -> DataFrame:
    """A materialized DataFrame, marked for broadcast if its rows have been measured to be small."""
    most = MOST_BROADCAST if most is None else most
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= most else df


def carried(names: list[str]) -> tuple[list[Column], dict[str, Column], list[Column]]:
    """(columns under numbers, by name, back under their names): a caller's columns under names that none of an operator's own can clash with.

    They stay columns of their own, so that those nobody asks for are still left out of scans and shuffles.
    """
    own = [f"column {k}" for k in range(len(names))]
    away = [F.col(f"`{c}`").alias(k) for c, k in zip(names, own)]
    return away, {c: F.col(f"`{k}`") for c, k in zip(names, own)}, [F.col(f"`{k}`").alias(c) for c, k in zip(names, own)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order, array<string>; null counts as empty."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often `use` names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo `modulus`; a null key gives null."""
    return F.crc32(key.cast("string")) % modulus


def bounded_sample(docs: DataFrame, labels: DataFrame, rows: int, rank: Column) -> DataFrame:
    """(doc_id, <label>, text), at most `rows` rows: the documents of the labels (doc_id, <label>) with the smallest `rank`, written to the shared folder.

    A doc_id counts once, with its smallest label and its text of the smallest hash, so that repeated rows
    of either table can't pass the bound. Null doc_ids and labels take no part.
    """
    label = next(c for c in labels.columns if c != "doc_id")
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    chosen = one.withColumn("rank", rank).orderBy("rank", "doc_id").limit(rows).drop("rank")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `rows` rows
    return materialize(texts.groupBy("doc_id", label).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "sample")
