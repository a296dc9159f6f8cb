"""Screening of texts by patterns, vocabulary, length and similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType

from quarrylane.functions import text as T

# Patterns of indicators (vulnerability ids, hashes, IPv4 addresses, defanged addresses), in the order in which hits are listed.
INDICATORS = (
    r"(?i)CVE-\d{4}-\d{4,}",
    r"\b[0-9a-fA-F]{32}\b|\b[0-9a-fA-F]{40}\b|\b[0-9a-fA-F]{64}\b",
    r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    r"(?i)hxxps?://|\[\.\](?:com|net|org|io|gov|edu|co|uk|ru|cn|de)\b|(?:com|net|org|io|gov)\[at\]|\[dot\](?:com|net|org|io|gov)",
)


def indicator_hits(x: Column) -> Column:
    """Distinct hits, by pattern and then by place."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in INDICATORS]))


def has_indicator(x: Column) -> Column:
    hit = x.rlike(INDICATORS[0])
    for p in INDICATORS[1:]:
        hit = hit | x.rlike(p)
    return hit


def term_hits(x: Column, terms: list[str]) -> Column:
    """Terms of a short list that are substrings of the text in lower case, in the order of the list, each once."""
    return T.let(F.lower(x), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in dict.fromkeys(terms)])))


def vocabulary_hits(x: Column, terms: list[str], tools: list[str]) -> Column:
    """Hits of the vocabulary, then those of the tools that aren't among them."""
    return F.array_union(term_hits(x, terms), term_hits(x, tools))


def first_term(x: Column, terms: list[str], aliases: dict[str, str] | None = None) -> Column:
    """The first term in list order that the text contains, by its alias if it has one, without spaces."""
    low = F.lower(x)
    case = None
    for t in terms:
        named = F.lit((aliases or {}).get(t, t).replace(" ", ""))
        case = F.when(F.contains(low, F.lit(t)), named) if case is None else case.when(F.contains(low, F.lit(t)), named)
    return case


def gate_one(docs: DataFrame, terms: list[str], tools: list[str], least_words: int = 200, least_terms: int = 2, column: str = "text") -> DataFrame:
    """Adds n_words, rules (those that fire) and reason: short, no_heuristic or level1_ok."""
    x = F.coalesce(F.col(column), F.lit(""))
    rules = F.array_compact(F.array(F.when(has_indicator(x), "indicator"), F.when(F.size(term_hits(x, terms)) >= least_terms, "vocabulary"), F.when(F.size(term_hits(x, tools)) > 0, "tool")))
    gated = docs.withColumns({"n_words": T.word_count(x), "rules": rules})
    return gated.withColumn("reason", F.when(F.col("n_words") < least_words, "short").when(F.size("rules") == 0, "no_heuristic").otherwise("level1_ok"))


def gate_two(passed: DataFrame, similarity: DataFrame, key: str, floor: float = 0.55) -> DataFrame:
    """Joins the best similarity of each key (clamped to 0..1); those below the floor become low_similarity, others passed."""
    best = similarity.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("similarity"))).alias("similarity"))
    joined = passed.join(best, key, "left")
    reason = F.when(F.col("reason") != "level1_ok", F.col("reason")).when(F.coalesce("similarity", F.lit(0.0)) >= floor, "passed").otherwise("low_similarity")
    return joined.withColumn("reason", reason)


def gate_stats(gated: DataFrame) -> DataFrame:
    """Totals by reason and the share that passes, three digits."""
    reasons = ("short", "no_heuristic", "low_similarity", "passed")
    sums = gated.agg(F.count("*").alias("total"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons])
    return sums.withColumn("pass_rate", F.round(F.try_divide(F.col("passed").cast("double"), F.col("total")), 3))


def bins(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n) for half-open bins between edges, zero where there is none."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    case = F.lit(None).cast("int")
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        case = F.when((F.col(value) >= a) & (F.col(value) < b), k).otherwise(case)
    n = rows.groupBy(case.alias("bin")).agg(F.count("*").alias("n"))
    return grid.join(n, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


#: Trigrams whose bits a worker remembers, at most; then it starts afresh.
MOST_TRIGRAMS = 300_000


class _Bits:
    """The low 64 bits of the MD5 of each trigram met, as rows of zeros and ones."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.rows = np.zeros((1024, 64), dtype=np.uint8)

    def of(self, grams: list[str]) -> np.ndarray:
        if len(self.places) > MOST_TRIGRAMS:
            self.__init__()
        places = self.places
        new = [g for g in dict.fromkeys(grams) if g not in places]
        if new:
            n = len(places)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            low = np.frombuffer(b"".join([hashlib.md5(g.encode()).digest()[8:] for g in new]), dtype=np.uint8).reshape(-1, 8)
            self.rows[n : n + len(new)] = np.unpackbits(low, axis=1)
            places.update(zip(new, range(n, n + len(new))))
        return self.rows[np.fromiter(map(places.__getitem__, grams), dtype=np.int64, count=len(grams))]


def fingerprint(x: str | None, prefix: int = 2000, bits: _Bits | None = None) -> int:
    """64-bit SimHash over character trigrams with repeats: bits vote over the low 64 bits of each trigram's MD5."""
    t = " ".join((x or "")[:prefix].lower().split())
    grams = [t] if len(t) < 3 else [t[i : i + 3] for i in range(len(t) - 2)]
    votes = (bits or _Bits()).of(grams).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(grams)).view(">i8")[0])


@F.pandas_udf(LongType())
def _simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    bits = _Bits()
    for x in batches:
        yield pd.Series([fingerprint(t, bits=bits) for t in x], dtype="int64")


def simhash64(x: Column) -> Column:
    """SimHash of the first 2000 characters, lower case, white space collapsed, as a signed long.

    An Arrow UDF that hashes each trigram once a task: a fold over trigrams in column expressions took eight
    times as long as one that hashes all.
    """
    return _simhash(x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Fingerprints of a band that meet in one tile, about.
MOST_IN_TILE = 4096


def near_pairs(prints: DataFrame, key: str, fp: str = "fp", bits: int = 3, bands: int = 6, most_in_tile: int = MOST_IN_TILE) -> DataFrame:
    """(a, b, distance): pairs of keys, a < b, whose fingerprints differ in at most `bits` bits.

    Of `bands` bands of bits, bands - bits at least are equal: fingerprints are joined on every choice of so
    many bands (with 6 bands and 3 bits twenty keys of 32 bits), and distances verified, so no pair is lost.
    More bands make more and longer keys. Bands that one fingerprint has go no further; a crowded one is dealt
    as tiles, in one of which any two of its fingerprints meet. Equal fingerprints should be collapsed before,
    as they pair with one another.
    """
    edges = [64 * k // bands for k in range(bands + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(bands), bands - bits)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        keys.append(F.xxhash64(F.lit(n), F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    banded = prints.select(F.col(key).alias("id"), F.col(fp).alias("f"), F.explode(F.array(*keys)).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / most_in_tile).cast("int").alias("parts"))
    dealt = banded.join(shared, "band").withColumn("part", F.pmod(F.xxhash64("f", "id"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("part")) | (F.col("parts") == 1))
    tiles = F.transform(others, lambda p: F.struct(F.least(p, F.col("part")).alias("low"), F.greatest(p, F.col("part")).alias("high")))
    tiled = dealt.select("id", "f", "band", F.explode(tiles).alias("tile"))
    one, two = (tiled.select(F.col("id").alias(n), F.col("f").alias(f"f{n}"), "band", "tile") for n in ("a", "b"))
    pairs = one.join(two, ["band", "tile"]).filter("a < b").withColumn("distance", hamming(F.col("fa"), F.col("fb"))).filter(F.col("distance") <= bits)
    return pairs.select("a", "b", "distance").distinct()


#: Rows, and links, that one task settles at the end, at most.
MOST_AT_ONCE = 200_000


def ingest_status(rows: DataFrame, pairs: DataFrame, most_at_once: int = MOST_AT_ONCE) -> DataFrame:
    """(id, status) of rows (id, url, fp) read in the order of id: inserted, dup_sim (near an inserted earlier row) or else dup_url (an inserted earlier row has its url).

    Ids are distinct. pairs (a, b): fingerprints that are near each other, either way round; equal ones always
    are. Rows that aren't inserted make no later one a duplicate. A null url is no duplicate.

    A row is inserted if it is the first undecided one both of its url and of the fingerprints near its own;
    then all others of these are decided. Groups are reduced to their first row before they meet, so large
    ones cost no pairs. Rounds go on until all is decided; once the undecided rows and links have been counted
    to be few, one task reads them in order.
    """
    from quarrylane.scratch import materialize

    docs = materialize(rows.select("id", F.coalesce(F.concat(F.lit("="), F.col("url").cast("string")), F.concat(F.lit("-"), F.col("id").cast("string"))).alias("url"), "fp"), "ingest")
    own = docs.select(F.col("fp").alias("x"), F.col("fp").alias("y")).distinct()
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a")).union(own).distinct()
    links = materialize(both, "ingest-links")
    open_, inserted = docs, None
    while True:
        left = open_.limit(most_at_once + 1).count()
        if not left:
            break
        asked = open_.select(F.col("fp").alias("x")).distinct()
        near = links.join(asked, "x", "left_semi").join(asked.withColumnRenamed("x", "y"), "y", "left_semi")
        if left <= most_at_once and near.limit(most_at_once + 1).count() <= most_at_once:
            new = _first_in_order(open_, near)
            inserted = new if inserted is None else inserted.union(new)
            break
        reach = near.join(open_.groupBy(F.col("fp").alias("y")).agg(F.min("id").alias("m")), "y").groupBy(F.col("x").alias("fp")).agg(F.min("m").alias("first_near"))
        of_url = open_.groupBy("url").agg(F.min("id").alias("first_of_url"))
        first = open_.join(reach, "fp").join(of_url, "url").filter((F.col("id") == F.col("first_near")) & (F.col("id") == F.col("first_of_url")))
        new = materialize(first.select("id", "url", "fp"), "inserted")
        inserted = new if inserted is None else inserted.union(new)
        blocked = links.join(new.select(F.col("fp").alias("y")), "y", "left_semi").select(F.col("x").alias("fp")).distinct()
        open_ = materialize(open_.join(blocked, "fp", "left_anti").join(new.select("url"), "url", "left_anti"), "undecided")
    if inserted is None:
        return docs.select("id", F.lit("inserted").alias("status"))
    inserted = materialize(inserted.select("id", "url", "fp"), "all-inserted")
    near_first = links.join(inserted.groupBy(F.col("fp").alias("y")).agg(F.min("id").alias("m")), "y").groupBy(F.col("x").alias("fp")).agg(F.min("m").alias("first_near"))
    marked = docs.join(inserted.select("id", F.lit(True).alias("is_in")), "id", "left").join(near_first, "fp", "left")
    return marked.select("id", F.when(F.col("is_in"), "inserted").when(F.col("first_near") < F.col("id"), "dup_sim").otherwise("dup_url").alias("status"))


def _first_in_order(open_: DataFrame, near: DataFrame) -> DataFrame:
    """What of few rows is inserted, read in one task."""
    schema = open_.select("id", "url", "fp").schema
    table = near.groupBy(F.col("x").alias("fp")).agg(F.collect_list(F.col("y")).alias("near"))
    joined = open_.join(table, "fp", "left").select("id", "url", "fp", "near").coalesce(1)

    def run(batches):
        read = sorted((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)))), key=lambda r: r[0])
        urls, prints, kept = set(), set(), []
        for i, url, fp, close in read:
            if url not in urls and prints.isdisjoint(close or ()):
                urls.add(url)
                prints.add(fp)
                kept.append((i, url, fp))
        yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in kept], f.type) for n, f in enumerate(to_arrow_schema(schema))], names=schema.names)

    return joined.mapInArrow(run, schema)


def keep_first(prints: DataFrame, pairs: DataFrame, key: str, most_at_once: int = MOST_AT_ONCE) -> DataFrame:
    """Keys that a pass in key order keeps: those with no kept earlier neighbour by pairs (a, b). It ends when every key is decided."""
    rows = prints.select(F.col(key).alias("id"), F.lit(None).cast("string").alias("url"), F.col(key).alias("fp"))
    return ingest_status(rows, pairs.select("a", "b"), most_at_once).filter("status = 'inserted'").select(F.col("id").alias(key))


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", column: str = "embedding", blocks: int = 256) -> DataFrame:
    """(query, vector, similarity, rank): exact cosine top k of a stated, small query set against all vectors, ties to smaller ids.

    Queries are broadcast only if their components have been counted to be few (32 MB); else vectors are dealt
    into blocks by a hash, and each query goes to every block. Norms are computed once for each vector.
    """
    few = (queries.agg(F.sum(F.size(column))).first()[0] or 0) * 8 <= 32 << 20
    parts = 1 if few else blocks
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(F.col(column), F.col(column)))
    q = queries.select(F.col(query_id).alias("q"), F.col(column).alias("qv"), norm.alias("qn"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"))
    v = vectors.select(F.col(vector_id).alias("v"), F.col(column).alias("vv"), norm.alias("vn"), F.pmod(F.xxhash64(vector_id), F.lit(parts)).cast("int").alias("block"))
    pairs = v.join(F.broadcast(q) if few else q, "block").filter(F.size("qv") == F.size("vv"))
    scored = pairs.withColumn("similarity", F.try_divide(dot(F.col("qv"), F.col("vv")), F.col("qn") * F.col("vn")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("similarity", 9)), "v"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("v").alias(vector_id), "similarity", "rank")


def merge_candidates(forced: DataFrame, found: DataFrame, key: str, most: int = 50) -> DataFrame:
    """Candidates (key, item, similarity): forced ones at 1.0 with their parents, then the best of the found, `most` in all found ones."""
    items = forced.select(key, "item")
    parents = items.select(key, T.parent_of(F.col("item")).alias("item"))
    first = items.union(parents).distinct().select(key, "item", F.lit(1.0).alias("similarity"), F.lit(0).alias("tier"))
    best = found.groupBy(key, "item").agg(F.round(F.max("similarity"), 3).alias("similarity"))
    rest = best.join(first.select(key, "item"), [key, "item"], "left_anti").withColumn("tier", F.lit(1))
    place = F.row_number().over(Window.partitionBy(key, "tier").orderBy(F.desc("similarity"), "item"))
    return first.unionByName(rest).withColumn("place", place).filter((F.col("tier") == 0) | (F.col("place") <= most)).select(key, "item", "similarity", "tier", "place")
