"""SimHash near-dedup with pivot distance tables.

Fingerprints are compared once for each distinct value. For every distinct
fingerprint a table holds its Hamming distances to many reference fingerprints
(pivots), computed once; two fingerprints within k bits differ by at most k in
each coordinate, so pairs with a larger difference in any coordinate are
discarded, and survivors are verified bit by bit. Pairs with a larger difference
in the first coordinate aren't formed at all: a bucket is read in its order.

A pivot table alone would have to meet every pair. Pairs are therefore only
formed within buckets: of B bands of bits, two fingerprints within k bits agree
on B - k at least, so each is put under every choice of B - k bands. That loses
no link. A bucket of more than MOST_IN_BUCKET fingerprints is dealt as tiles, in
which any two of its fingerprints meet, over many tasks. What leaves a task is a
spanning forest of its links, never its pairs.

A few bits reach copies that are nearly exact only: at Jaccard similarity 0.8
fingerprints differ in 10 of 64 bits on average, and no choice of bands of 64 bits
has that radius at a bearable number of keys. `similar` goes the same way with a
wider SimHash, whose first word is the fingerprint: texts that agree on one of
its bands meet in a bucket, pairs too far apart in the pivot distance table go,
the bits verify the others, and the shared shingles of what is left are counted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .text import broadcast_if_small, materialize, table

MOST_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
PIVOTS = 24
MOST_IN_BUCKET = 8192
#: Shingles hashed, and pairs looked at, at once.
BLOCK = 1 << 16

# similar(): a bit differs with probability 0.16 at similarity 0.8, 0.19 for texts of five shingles.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: (texts at most, bits of a band, bands): the bands fill whole words, and a pair of similarity 0.8 shares one with a probability over 0.9996, 0.996 for texts of five shingles.
BANDS = ((1 << 24, 12, 64), (1 << 27, 14, 96), (1 << 63, 16, 144))
SIMILAR_PIVOTS = 8
#: Bits of the fingerprint beyond which candidates are discarded; similarity 0.8 has 9.7 on average, with a deviation of 2.9.
CANDIDATE_BITS = 24
#: The same over as many words as verify; similarity 0.8 has 41 bits at most on average, with a deviation of 5.9.
VERIFY_WORDS, VERIFY_BITS = 4, 72
#: Shingles in a tile of a group; components of candidates up to that are dealt as tiles of a 64th, larger ones by their buckets.
MOST_IN_TILE = 1 << 21
TILES_OF_COMPONENT = 64


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], dtype=np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half the hashes of its shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(shingle_words, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row of docs (doc_id long, text); null and wordless texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = []
            for at in range(0, batch.num_rows, 256):
                fps += [fingerprint(t) for t in batch.column(1).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def bucket_keys(fp: Column, bits: int = MOST_BITS, bands: int = 6) -> Column:
    """array<long>: for each choice of bands - bits bands, its number and the bits there, hashed to a long."""
    edges = [64 * k // bands for k in range(bands + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(bands), bands - bits)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (node, smallest node of its component here), for nodes that aren't it."""
    nodes, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ab[: len(a)], ab[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def pivot_columns(fp: Column, n: int = PIVOTS) -> list[Column]:
    """The pivot distance table's columns p0, p1, ... of a fingerprint: eight distances each, a byte for a distance."""
    reference = [int(r) - (1 << 64) if r >> 63 else int(r) for r in map(int, pivots(n))]
    distance = lambda r, k: F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("long"), 8 * k)
    packed = [[distance(r, k) for k, r in enumerate(reference[at : at + 8])] for at in range(0, n, 8)]
    return [sum(row[1:], row[0]).alias(f"p{at}") for at, row in enumerate(packed)]


def _linked(fp: np.ndarray, coordinates: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs i, j those within `bits`: discarded by pivot coordinates first, then verified."""
    for k in range(1, coordinates.shape[1]):  # the first one has told already which pairs to form
        near = np.abs(coordinates[i, k] - coordinates[j, k]) <= bits
        i, j = i[near], j[near]
        if not len(i):
            return i, j
    near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
    return i[near], j[near]


def _within(key: np.ndarray, fp: np.ndarray, coordinates: np.ndarray, bits: int):
    """Links among rows with equal keys, given sorted by key and first coordinate; forests of about BLOCK pairs each."""
    if not len(key):
        return
    starts = np.concatenate(([True], key[1:] != key[:-1]))
    along = (np.cumsum(starts) << 8) + coordinates[:, 0]
    partners = np.searchsorted(along, along + bits, "right") - np.arange(len(key)) - 1  # rows further down in the same bucket, and near in the first coordinate
    done = np.cumsum(partners)
    at = 0
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + 16 * BLOCK, "right")))
        n = partners[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        i, j = _linked(fp, coordinates, i, j, bits)
        if len(i):
            yield _forest(fp[i].view(np.int64), fp[j].view(np.int64))
        at = stop


def links(fps: DataFrame, bits: int = MOST_BITS, bands: int | None = None, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (fp long) within `bits` of each other.

    bands: more of them make buckets smaller and keys more; by default 6 (15 keys of 21 bits) up to
    2^24 fingerprints, 7 (35 of 27) up to 2^30, else 8 (70 of 32). The links connect the same whatever it is.
    """
    if bands is None:
        n = fps.count()
        bands = bits + (2 if n <= 1 << 24 else 3 if n <= 1 << 30 else 4)
    distances = pivot_columns(F.col("fp"))
    names = [f"p{k}" for k in range(len(distances))]
    pivot_table = materialize(fps.select("fp", *distances), "pivot-table")
    keyed = pivot_table.select("fp", *names, F.explode(bucket_keys(F.col("fp"), bits, bands)).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / most_in_bucket).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keyed.join(crowded, "key").withColumn("parts", parts).withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("own")) | (F.col("parts") == 1))
    tile = F.explode(F.transform(others, lambda p: F.xxhash64("key", F.least(p, F.col("own")), F.greatest(p, F.col("own")))))
    tiled = dealt.select("fp", tile.alias("key"), *names)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            """Links of all buckets that are complete."""
            nonlocal held
            if not held:
                return
            rows = pa.Table.from_batches(held)
            key, fp = rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            cut = len(key) if last else int(np.searchsorted(key, key[-1], "left"))
            coordinates = np.ascontiguousarray(np.stack([rows[n].to_numpy()[:cut] for n in names], axis=1)).view(np.int8)
            held = [] if last else rows.slice(cut).combine_chunks().to_batches()
            for a, b in _within(key[:cut], fp[:cut], coordinates, bits):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * BLOCK:
                yield from flush(False)
        yield from flush(True)

    first = F.col("p0").bitwiseAND(F.lit(255))
    return tiled.repartition("key").sortWithinPartitions("key", first).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id whose fingerprint can be reached by links of at most `bits`
    differing bits, the document's own included. Null and wordless texts have fingerprint 0 and link
    like any other. Repeated rows stay repeated. A null doc_id never names a component; a component of
    such rows only has a null id. An empty table gives an empty one. Only doc_id and text are read.
    """
    fps = materialize(with_fingerprint(docs), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = materialize(components(links(distinct.select("fp"), bits)), "components")
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, shingle_words: int = SIMILAR_WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; a text of fewer words is one shingle, and one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x, SEED) for x in words], dtype=np.uint64)
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _wide(h: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of distinct shingle hashes in that many words; the first is of the hashes themselves, the others of the hashes mixed anew."""
    times = (np.arange(words, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(h), 255):  # so many are counted in bytes
        x = h[at : at + 255, None] * times
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x[:, 0] = h[at : at + 255]
        bits = np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8")


def _band_keys(words: Column, bits: int, bands: int) -> Column:
    """array<long>: for each band its number and its bits."""
    keys = []
    for band in range(bands):
        at, off = divmod(band * bits, 64)
        value = F.shiftrightunsigned(words[at], off)
        if off + bits > 64:
            value = value.bitwiseOR(F.shiftleft(words[at + 1], 64 - off))
        keys.append(value.bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(band << bits))
    return F.array(*keys)


def _candidates(words: np.ndarray, coordinates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a bucket, given by first coordinate, that neither the pivots nor the bits tell to be far apart."""
    found_i, found_j = [], []
    first, ones = words[:, 0], np.uint64(0x0101010101010101)
    step = max(1, BLOCK // len(words))
    for at in range(0, len(words), step):
        stop = min(at + step, len(words))
        to = int(np.searchsorted(coordinates[:, 0], int(coordinates[stop - 1, 0]) + CANDIDATE_BITS, "right"))
        near = (np.abs(coordinates[at:stop, None] - coordinates[None, at:to]) <= CANDIDATE_BITS).view(np.uint64)[..., 0] == ones
        near &= np.bitwise_count(first[at:stop, None] ^ first[None, at:to]) <= CANDIDATE_BITS
        i, j = np.nonzero(near)
        i, j = i[i < j] + at, j[i < j] + at
        verified = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= VERIFY_BITS
        found_i.append(i[verified])
        found_j.append(j[verified])
    return np.concatenate(found_i), np.concatenate(found_j)


def _near_groups(pivot_table: DataFrame, bits: int, bands: int, most_in_bucket: int) -> DataFrame:
    """(key, root, node): of each bucket of pivot_table (node, words, p0) the groups that candidate pairs connect, each under one of its nodes."""
    verifying = [f"w{k}" for k in range(VERIFY_WORDS)]
    of_words = [F.col("words")[k].alias(w) for k, w in enumerate(verifying)]
    key = F.explode(_band_keys(F.col("words"), bits, bands)).alias("key")
    crowded = materialize(pivot_table.select(key).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most_in_bucket), "crowded")
    keyed = pivot_table.select(key, "node", *of_words, "p0")
    if not crowded.isEmpty():
        parts = F.ceil(F.col("n") / most_in_bucket).cast("int")
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        dealt = keyed.join(broadcast_if_small(crowded, F.lit(16)), "key", "left").withColumn("parts", parts).withColumn("own", own)
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own"))
        tiles = F.transform(others, lambda p: F.xxhash64("key", F.least(p, F.col("own")), F.greatest(p, F.col("own"))))
        keyed = dealt.select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(tiles)).alias("key"), "node", *verifying, "p0")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            """Groups of all buckets that are complete."""
            nonlocal held
            if not held:
                return
            rows = pa.Table.from_batches(held)
            key, node = rows["key"].to_numpy(), rows["node"].to_numpy()
            cut = len(key) if last else int(np.searchsorted(key, key[-1], "left"))
            held = [] if last else rows.slice(cut).combine_chunks().to_batches()
            words = np.stack([rows[w].to_numpy()[:cut] for w in verifying], axis=1).view(np.uint64)
            coordinates = np.ascontiguousarray(rows["p0"].to_numpy()[:cut]).view(np.int8).reshape(-1, 8)
            edges = np.concatenate((np.flatnonzero(np.concatenate(([True], key[1:cut] != key[: cut - 1]))), [cut])) if cut else np.zeros(1, dtype=np.int64)
            a, b = [], []
            for at, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if stop - at > 1:
                    i, j = _candidates(words[at:stop], coordinates[at:stop])
                    if len(i):
                        a.append(i + at)
                        b.append(j + at)
            if a:
                row, root = _forest(np.concatenate(a), np.concatenate(b))
                roots = np.unique(root)
                row, root = np.concatenate((row, roots)), np.concatenate((root, roots))
                yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(node[root]), pa.array(node[row])], names=["key", "root", "node"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from flush(False)
        yield from flush(True)

    first = F.col("p0").bitwiseAND(F.lit(255))
    return keyed.repartition("key").sortWithinPartitions("key", first).mapInArrow(run, "key long, root long, node long")


def _similar_within(nodes: np.ndarray, words: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all rows of a tile whose sets have this Jaccard similarity; pairs far apart in bits and pairs connected already aren't looked at."""
    sizes = np.array([len(s) for s in sets])
    root = np.arange(len(nodes))
    a, b = [], []
    for i in range(1, len(nodes)):
        small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        apart = np.bitwise_count(words[:i] ^ words[i]).sum(axis=1, dtype=np.int64)
        open_ = np.flatnonzero((nodes[:i] != nodes[i]) & (small >= similarity * large) & (apart <= VERIFY_BITS))
        while len(open_):
            j = open_[0]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (sizes[i] + sizes[j] - both):
                a.append(nodes[i])
                b.append(nodes[j])
                root[root == root[j]] = root[i]
            open_ = open_[1:][root[open_[1:]] != root[i]]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def similar(docs: DataFrame, shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, most_in_bucket: int = MOST_IN_BUCKET, most_in_tile: int = MOST_IN_TILE) -> DataFrame:
    """(h, component), one row for each distinct text of docs (text): h is xxhash64 of the text, null as ''.

    Texts have one component if they are reached by links between texts whose sets of shingles have at
    least this Jaccard similarity (bands and bits are set for 0.8 or more); texts of equal shingle sets
    have it, wordless ones too. Links are found with the probability of a shared band of the wide SimHash
    (see BANDS), counted exactly, and never wrong.
    """
    n_texts = docs.count()
    bits, bands = next((bits, bands) for most, bits, bands in BANDS if n_texts <= most)
    n_words = bits * bands // 64
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    as_long = lambda values: pa.array(np.array(values, dtype=np.uint64).view(np.int64))
    each = lambda column: (t for at in range(0, len(column), 256) for t in column.slice(at, 256).to_pylist())

    def sketch(batches):
        for batch in batches:
            nodes, sizes, words = [], [], []
            for t in each(batch.column(1)):
                s = shingles(t, shingle_words)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                words.append(_wide(s, n_words))
            ends = np.arange(len(words) + 1, dtype=np.int32) * n_words
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), as_long(np.concatenate(words) if words else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_long(nodes), pa.array(sizes, pa.int64()), lists], names=["h", "node", "n", "words"])

    prints = materialize(texts.mapInArrow(sketch, "h long, node long, n long, words array<long>"), "sketches")
    distinct = prints.filter("n > 0").groupBy("node").agg(F.min(F.struct("h", "n", "words")).alias("p")).select("node", "p.*")
    pivot_table = materialize(distinct.select("*", *pivot_columns(F.col("words")[0], SIMILAR_PIVOTS)), "pivot-table")
    near = materialize(_near_groups(pivot_table, bits, bands, most_in_bucket), "near")

    # A component of candidates has its sets once, or once a tile; a large one has them in each of its buckets, so that not all of it meets all of it.
    candidates = materialize(components(near.select(F.col("node").alias("a"), F.col("root").alias("b"))), "candidates")
    sized = candidates.join(pivot_table.select("node", "h", "n", F.slice("words", 1, VERIFY_WORDS).alias("words")), "node")
    totals = sized.groupBy("component").agg(F.sum("n").alias("whole"))
    large = F.col("whole") > most_in_tile
    joined = sized.join(totals, "component")
    by_group = joined.filter(large).join(near, "node").withColumn("key", F.xxhash64("key", "root"))
    columns = ["key", "node", "h", "n", "words", F.when(large, most_in_tile).otherwise(F.ceil(F.lit(most_in_tile) / TILES_OF_COMPONENT)).cast("long").alias("most")]
    keyed = materialize(joined.filter(~large).withColumn("key", F.col("component")).select(columns).union(by_group.select(columns)), "groups")
    members = [F.count("*").alias("k"), F.sum("n").alias("total"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("most").alias("most")]
    buckets = keyed.groupBy("key").agg(*members).filter("k > 1")
    once = materialize(buckets.groupBy("k", "total", "low", "high", "x", "most").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("total") / F.col("most")).cast("int").alias("parts")), "buckets")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = keyed.join(once, "key").withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("own")) | (F.col("parts") == 1))
    tile = F.explode(F.transform(others, lambda p: F.xxhash64("key", F.least(p, F.col("own")), F.greatest(p, F.col("own")))))
    tiled = materialize(dealt.select("node", "h", "words", tile.alias("key")), "tiles")

    def spell(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, shingle_words).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["h", "shingles"])

    chosen = texts.join(tiled.select("h").distinct(), "h", "left_semi")
    sets = materialize(chosen.mapInArrow(spell, "h long, shingles binary").dropDuplicates(["h"]), "shingles")

    def run(batches):
        held_key, nodes, words, held = None, [], [], []

        def links_of():
            a, b = _similar_within(np.array(nodes, dtype=np.int64), np.array(words, dtype=np.int64).view(np.uint64), held, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for key, node, w, s in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "words", "shingles"))):
                if key != held_key:
                    if len(held) > 1:
                        yield links_of()
                    held_key, nodes, words, held = key, [], [], []
                nodes.append(node)
                words.append(w)
                held.append(np.frombuffer(s, dtype=np.uint64))
        if len(held) > 1:
            yield links_of()

    linked = tiled.join(sets, "h").select("key", "node", "words", "shingles").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    found = materialize(components(linked), "components")
    named = prints.select("h", "node").distinct().join(found, "node", "left")
    return named.select("h", F.coalesce("component", "node").alias("component"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document as hex, and the smallest doc_id that links reach; see near_duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
