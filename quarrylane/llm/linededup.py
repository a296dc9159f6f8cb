"""Line dedup over a corpus by a deletion-neighbourhood join.

A line stands for the sequence of its words. Two lines are the same if they are
equal or, from MIN_WORDS words up, one edit apart: one word put in, left out or
replaced. (Shorter lines must be equal: one word more or less is another line.)
Of such lines the earliest (by doc_id, then position) stays.

1. Lines are reduced to digests; equal ones collapse to their earliest place,
   with partial minima, so a line that a third of all documents has is one row.
2. Lines one edit apart share a prefix or a suffix of half their words. Lines
   whose half-line keys are nobody else's have no partner and go no further.
3. The others emit their deletion neighbourhood: themselves, and each variant
   with one word left out, as hashed keys. A variant's hash is the exclusive or
   of position-dependent word hashes, from running totals, so that a line's
   neighbourhood takes time in proportion to its words.
4. Equal variants are joined, each line with the earliest of its group only,
   never a group with itself: lines that agree on a variant and on the place
   left out differ in one word at most, and a line that equals another's
   variant lacks one word.
5. The joined pairs are verified word by word; a later line with a verified
   earlier partner goes.

A partner counts even if it goes itself, so the result doesn't depend on the
order of decisions. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import broadcast_if_small, let, materialize, table

#: Lines of fewer words are compared for equality only; an edit bound of one word would join most of them.
MIN_WORDS = 5
_LAST = 9223372036854775807


def _lines(text: Column) -> Column:
    """The lines of a text in order, each as its words joined by single spaces; most texts have nothing to replace."""
    odd = F.lit(False)
    for x in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(text, F.lit(x))
    spaced = F.when(odd, F.regexp_replace(text, "[\\x20\\x09\\x0B-\\x0D]+", " ")).otherwise(text)
    return F.transform(F.split(spaced, "\n"), lambda line: F.trim(line))


def _word_count(line: Column) -> Column:
    """Words of a line as _lines gives it."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


#: Columns of a line's half-line keys; unused ones are null.
_KEYS = ("k0", "k1", "k2", "k3")


def _with_halves(lines: DataFrame, min_words: int) -> DataFrame:
    """Adds _KEYS to lines (t, ...): keys one of which two lines one edit apart, or equal, share.

    For two such lines of m and m or m + 1 words, either the first or the last m // 2 words agree. A line
    of n words can be the shorter or the longer one, so both m = n and m = n - 1 count. Lengths are taken
    from a coarse scale (1, 2, 3, 4, 6, 8, 12, ...), so that most lines have two keys, not four.
    """
    half = lambda m: F.floor(m / 2).cast("int")

    def scale(h: Column) -> Column:
        power = F.call_function("shiftleft", F.lit(1), F.length(F.bin(h)) - 1)
        return F.when(h < 2, h).when(h * 2 >= power * 3, (power * 3 / 2).cast("int")).otherwise(power).cast("int")

    def keys(k: str) -> tuple[Column, Column]:
        first = lambda n: F.call_function("substring_index", "t", F.lit(" "), n)
        return F.xxhash64(F.lit("first"), k, first(F.col(k))), F.xxhash64(F.lit("last"), k, first(-F.col(k)))

    n, compared = F.col("n"), F.col("n") >= min_words
    scaled = lines.withColumn("n", _word_count(F.col("t"))).withColumns({"a": scale(half(n)), "b": scale(half(n - 1))})
    made = [F.when(compared, k) for k in keys("a")] + [F.when(compared & (F.col("a") != F.col("b")), k) for k in keys("b")]
    return scaled.withColumns(dict(zip(_KEYS, made))).drop("n", "a", "b")


def _document() -> Column:
    """What tells a document: its id, null as the largest long, and a hash of its text."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("h"))


def first_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(x, y, at struct<d, pos>, _KEYS): the earliest place of each distinct line that has a word, told by 128 bits of hashes, and its half-line keys.

    Lines of fewer than min_words words have no keys.
    """
    split = docs.filter("text IS NOT NULL").select(_document().alias("d"), _lines(F.col("text")).alias("lines"))  # first, so that texts aren't carried along with each line
    each = split.select("d", F.posexplode("lines").alias("pos", "t")).filter("t <> ''")
    known = _with_halves(each, min_words).select(F.struct("d", "pos").alias("at"), F.xxhash64("t").alias("x"), F.xxhash64(F.lit("line"), "t").alias("y"), *_KEYS)
    return known.groupBy("x", "y").agg(F.min("at").alias("at"), *[F.min(k).alias(k) for k in _KEYS])


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """lines (d, pos, w) -> (v, m, gone, at): hash and word count of the line itself (gone null) and of it without word gone."""
    hashed = lines.select("d", "pos", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"))
    each = hashed.select("d", "pos", "n", F.posexplode("hashes").alias("i", "h"))
    along = Window.partitionBy("d", "pos").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("d", "pos")
    here, left = F.xxhash64("h", "i"), F.xxhash64("h", F.col("i") - 1)  # as the word counts where it is, and one place to the left
    run = each.repartition("d", "pos").select("d", "pos", "n", "i", here.alias("here"), left.alias("left")).select(
        F.struct("d", "pos").alias("at"), "n", "i", "here", F.bit_xor("here").over(along).alias("here_to"), F.bit_xor("left").over(along).alias("left_to"), F.bit_xor("here").over(whole).alias("here_all"), F.bit_xor("left").over(whole).alias("left_all")
    )
    without = F.col("here_to").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("left_to")).bitwiseXOR(F.col("left_all"))
    itself = F.struct(F.col("here_all").alias("v"), F.col("n").alias("m"), F.lit(None).cast("int").alias("gone"))
    variant = F.struct(without.alias("v"), (F.col("n") - 1).alias("m"), F.col("i").alias("gone"))
    return run.select("at", F.inline(F.when(F.col("i") == 0, F.array(itself, variant)).otherwise(F.array(variant))))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two different word arrays are one insertion, omission or replacement apart."""
    common = lambda x, y, n: F.coalesce(F.array_position(F.transform(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(x, i) != F.get(y, i))), True).cast("int") - 1, F.lit(0))
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n, m = F.size(short), F.size(long)
    rest = lambda p: F.when(n == m, F.slice(short, p + 2, m) == F.slice(long, p + 2, m)).otherwise(F.slice(short, p + 1, m) == F.slice(long, p + 2, m))
    return (m - n <= 1) & let(common(short, long, n), rest)


def later_lines(docs: DataFrame, places: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(at): earliest places of distinct lines that have an earlier line one edit apart, among docs (doc_id, text) with their first_places."""
    keys = places.select(F.xxhash64("x", "y").alias("id"), "at", F.explode(F.array_compact(F.array(*_KEYS))).alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("key")
    found = materialize(keys.select("at", "key").join(shared, "key", "left_semi").select("at.d", "at.pos").distinct(), "found")
    positions = materialize(found.groupBy("d").agg(F.collect_set("pos").alias("positions")), "documents-of-found")
    here = broadcast_if_small(positions, 48 + 4 * F.size("positions"))
    source = docs.select(_document().alias("d"), "text").join(here, "d")
    chosen = let(_lines(F.col("text")), lambda lines: F.transform("positions", lambda p: F.struct(p.alias("pos"), F.get(lines, p).alias("line"))))
    picked = source.select("d", F.inline(chosen)).filter(_word_count(F.col("line")) >= min_words).select("d", "pos", F.split("line", " ").alias("w"))
    lines = materialize(picked.dropDuplicates(["d", "pos"]), "lines")

    every = materialize(_neighbourhood(lines), "neighbourhood")
    several = broadcast_if_small(materialize(every.groupBy("v", "m").agg(F.count("*").alias("k")).filter("k > 1").select("v", "m"), "variants"), F.lit(32))
    near = materialize(every.join(several, ["v", "m"]), "near")
    variants = near.filter("gone IS NOT NULL")
    same_place = variants.groupBy("v", "m", "gone").agg(F.min("at").alias("first"))
    replaced = variants.join(same_place, ["v", "m", "gone"]).filter("first < at").select("at", "first")
    whole = F.min(F.when(F.col("gone").isNull(), F.col("at"))).alias("itself")
    variant = F.min(F.when(F.col("gone").isNotNull(), F.col("at"))).alias("variant")
    inserted = near.groupBy("v", "m").agg(whole, variant).filter("itself IS NOT NULL AND variant IS NOT NULL")
    lacks_word = inserted.filter("variant < itself").select(F.col("itself").alias("at"), F.col("variant").alias("first"))
    has_word = variants.join(inserted.select("v", "m", "itself"), ["v", "m"]).filter("itself < at").select("at", F.col("itself").alias("first"))
    pairs = replaced.union(lacks_word).union(has_word).distinct()
    text = lines.select(F.struct("d", "pos").alias("at"), "w")
    verified = pairs.join(text, "at").join(text.select(F.col("at").alias("first"), F.col("w").alias("first_w")), "first").filter(_one_edit(F.col("w"), F.col("first_w")))
    return materialize(verified.select("at").distinct(), "later-lines")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) without later lines; adds n_lines and n_removed (long).

    A line goes if an equal line stands earlier, or one that is one word edit apart and both have min_words
    words or more. Lines without words stay. A document all of whose lines go keeps its row with an
    empty text. A null text stays null, with no lines. Rows alike in doc_id and text count as one document
    and are treated alike; rows of one doc_id with different texts are documents of their own, in the
    order of a hash of the text. Null doc_ids come last. Other columns stay, whatever their names; those
    named like an added one are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    thin = docs.select("doc_id", "text")
    places = materialize(first_places(thin, min_words), "places")
    kept = places.select("at").join(later_lines(thin, places, min_words), "at", "left_anti").select("at.d", "at.pos").groupBy("d").agg(F.collect_set("pos").alias("kept"))
    # a row for each document, which are many and alike: its part of a partition is small beside the texts, which so needn't be sorted
    joined = docs.select(F.struct(*own).alias("row"), _document().alias("d")).join(kept.hint("shuffle_hash"), "d", "left")

    def rebuilt(lines: Column) -> Column:
        of_words = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike("[^\\x20\\x09-\\x0D]"), F.lit(-1)).otherwise(i)), lambda i: i >= 0)  # places without words
        stay = F.array_sort(F.concat(of_words, F.coalesce("kept", F.array().cast("array<int>"))))
        return let(stay, lambda s: F.struct(F.array_join(F.transform(s, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(s)).cast("long").alias("gone")))

    done = joined.select("row", F.when(F.col("row.text").isNotNull(), let(F.split("row.text", "\n"), rebuilt)).alias("new"))
    columns = [(F.col("new.text") if c == "text" else F.col("row")[c]).alias(c) for c in own]
    return done.select(*columns, F.coalesce("new.n", F.lit(0).cast("long")).alias("n_lines"), F.coalesce("new.gone", F.lit(0).cast("long")).alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later lines; see dedup for nulls, ties and repeated rows."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
o AS (SELECT *, CASE WHEN len(ws) > 0 THEN row_number() OVER (PARTITION BY ws ORDER BY doc_id, pos) END AS nth FROM w),
d AS (SELECT doc_id, pos, ws, row_number() OVER (ORDER BY doc_id, pos) AS ord FROM o WHERE nth = 1 AND len(ws) >= 5),
k AS (SELECT ord, ws, len(ws) AS m, unnest([(len(ws), 0, list_aggregate(ws[1 : len(ws) // 2], 'string_agg', ' ')), (len(ws), 1, list_aggregate(ws[len(ws) - len(ws) // 2 + 1 :], 'string_agg', ' ')),
  (len(ws) - 1, 0, list_aggregate(ws[1 : (len(ws) - 1) // 2], 'string_agg', ' ')), (len(ws) - 1, 1, list_aggregate(ws[len(ws) - (len(ws) - 1) // 2 + 1 :], 'string_agg', ' '))]) AS key FROM d),
p AS (SELECT DISTINCT b.ord, a.ws AS aw, b.ws AS bw FROM k a JOIN k b ON a.key = b.key AND a.ord < b.ord AND abs(a.m - b.m) <= 1),
s AS (SELECT ord, CASE WHEN len(aw) <= len(bw) THEN aw ELSE bw END AS x, CASE WHEN len(aw) <= len(bw) THEN bw ELSE aw END AS y FROM p),
f AS (SELECT ord, x, y, coalesce(list_position(list_transform(range(1, len(x) + 1), lambda i: x[i] <> y[i]), true), len(x) + 1) AS q FROM s),
gone AS (SELECT DISTINCT ord FROM f WHERE CASE WHEN len(x) = len(y) THEN x[q + 1 :] = y[q + 1 :] ELSE x[q :] = y[q + 1 :] END),
dead AS (SELECT doc_id, pos FROM d JOIN gone USING (ord)),
kept AS (SELECT o.doc_id, string_agg(o.line, chr(10) ORDER BY o.pos) AS text, count(*) AS n FROM o LEFT JOIN dead ON o.doc_id = dead.doc_id AND o.pos = dead.pos WHERE o.nth IS NULL OR (o.nth = 1 AND dead.pos IS NULL) GROUP BY o.doc_id)
SELECT t.doc_id, CASE WHEN t.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(len(string_split(t.text, chr(10))), 0)::BIGINT AS n_lines, (coalesce(len(string_split(t.text, chr(10))), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed
FROM documents t LEFT JOIN kept USING (doc_id)
"""
