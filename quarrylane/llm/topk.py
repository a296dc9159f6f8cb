"""Exact top-k search by aggregation of sorted lists without random access.

Vectors are dealt into blocks, and a block is written once, with a list for each
dimension of its vectors sorted by their components. A query reads a list from
the end that suits its sign, so contributions come largest first. Lists are read
to equal depths; each vector then has a lower bound (what was seen, and the
list's least contribution where nothing was) and an upper one (with the
contribution last read there). Reading stops when no vector outside a few
candidates can still reach the k-th lower bound; the candidates' final scores are
then resolved. Each block gives its best results of a query; the best k of all
blocks are the answer. Blocks that one task reads one after another hand on the
k-th score found, which lets reading stop sooner.

Queries come in blocks too, a stated set against all rows, and every block of
vectors meets every block of queries in one task, so neither side is ever
broadcast or held whole. Bounds of a block of queries are matrix products of the
query components with the part of the lists that was read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import materialize, table

#: Vectors, and queries, that meet in one task.
VECTOR_BLOCK = 16384
QUERY_BLOCK = 4096
#: Vectors that share sorted lists, and queries whose bounds are computed together.
LISTED = 4096
ASKED = 512
#: Shares of the lists after which bounds are looked at, without and with a score to beat from lists read before.
CHECKS, CHECKS_TO_BEAT = (0.75, 0.875, 1.0), (0.4, 0.55, 0.75, 1.0)
#: Whole numbers below this are exact in doubles; blocks that may pass it are computed with Python's integers.
EXACT = 2.0**53
_LONG = 2**63 - 1


def _floor(x: Column) -> Column:
    """Whole doubles; those of 2^52 and more are whole already."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as whole doubles; null for vectors that are null or hold components that are null or, scaled, not finite."""
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    whole = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(scaled, _floor))


_PACKED = "a int, b int, d int, asks boolean, part int, kind string, ids binary, unnamed binary, vectors binary, lists binary"


def _packed(block: str, d: int, at: int, part: int, ids: np.ndarray, unnamed: np.ndarray, v: np.ndarray, lists: np.ndarray | None) -> dict:
    """A block's part as one row; components in the smallest type that holds them."""
    most = np.abs(v).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    other = "b" if block == "a" else "a"
    return {block: at, other: None, "d": d, "asks": lists is None, "part": part, "kind": kind, "ids": ids.astype("<i8").tobytes(), "unnamed": unnamed.astype(bool).tobytes(), "vectors": v.astype(kind).tobytes(), "lists": b"" if lists is None else lists.tobytes()}


def _matrix(rows: pa.Table, d: int) -> np.ndarray:
    return rows["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(rows.num_rows, d)


def _table(rows: list[dict]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = [f.split()[0] for f in _PACKED.split(", ")]
    return pa.table([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)


def _pack_vectors(listed: int):
    def run(rows: pa.Table) -> pa.Table:
        d, at = rows["d"][0].as_py(), rows["a"][0].as_py()
        v, unnamed = _matrix(rows, d), rows["id"].is_null().to_numpy()
        ids = rows["id"].fill_null(0).to_numpy()
        out = []
        for part, k in enumerate(range(0, len(v), listed)):
            here = v[k : k + listed]
            rising = np.argsort(here, axis=0, kind="stable").astype(np.uint32)  # of each dimension; read from its end, it falls
            out.append(_packed("a", d, at, part, ids[k : k + listed], unnamed[k : k + listed], here, rising))
        return _table(out)

    return run


def _pack_queries(rows: pa.Table) -> pa.Table:
    d = rows["d"][0].as_py()
    return _table([_packed("b", d, rows["b"][0].as_py(), 0, rows["id"].to_numpy(), np.zeros(rows.num_rows, bool), _matrix(rows, d), None)])


class Block:
    """Vectors (n, d) with a sorted list for each dimension and direction; rising[r, j] is the vector with the r-th smallest component j."""

    def __init__(self, vectors: np.ndarray, rising: np.ndarray, ids: np.ndarray, unnamed: np.ndarray):
        self.vectors, self.rising, self.ids, self.unnamed = vectors, rising, ids, unnamed
        self.place = np.empty(rising.shape, dtype=np.int32)
        np.put_along_axis(self.place, rising.astype(np.int64), np.arange(len(vectors), dtype=np.int32)[:, None], 0)

    def _at(self, rank: int) -> np.ndarray:
        """Components in place `rank` of the rising lists."""
        return np.take_along_axis(self.vectors, self.rising[rank][None, :].astype(np.int64), 0)[0]

    def candidates(self, queries: np.ndarray, need: int, beat: list) -> list[np.ndarray]:
        """For each query the vectors of which its `need` best, as far as they reach `beat`, are a part: lists are read until no other can be."""
        n = len(self.vectors)
        exact = np.float64 if np.abs(queries).max(axis=0, initial=0) @ np.abs(self.vectors).max(axis=0, initial=0) < EXACT else object
        whole = (lambda x: x) if exact is np.float64 else np.vectorize(int, otypes=[object])
        v, q = (whole(x) if x.size else x.astype(exact) for x in (self.vectors, queries))
        up, down = np.maximum(q, 0), np.minimum(q, 0)  # read falling, and rising, lists
        times = lambda a, b: a @ b.T.astype(exact)
        from_end = n - 1 - self.place
        seen = np.zeros((len(q), n), dtype=exact)  # contributions read so far
        found: list = [None] * len(q)
        open_, depth = np.arange(len(q)), 0
        to_beat = [b is not None for b in beat]
        for share in CHECKS_TO_BEAT if all(to_beat) else CHECKS:
            stop = min(n, max(need, int(n * share), depth + 1))
            here = lambda x: v * ((x >= depth) & (x < stop))  # noqa: B023, E731
            seen[open_] += times(up[open_], here(from_end)) + times(down[open_], here(self.place))
            depth = stop
            if depth >= n:
                break
            top, bottom = from_end >= depth, self.place >= depth  # not read yet
            frontier = whole(self._at(n - depth)), whole(self._at(depth - 1))
            least = whole(self._at(0)), whole(self._at(n - 1))
            bound = lambda ends: times(up[open_] * ends[0], top) + times(down[open_] * ends[1], bottom)  # noqa: B023, E731
            high = seen[open_] + bound(frontier)
            if all(to_beat):
                reach = np.array([beat[i] for i in open_], dtype=exact)
            else:
                reach = np.partition(seen[open_] + bound(least), n - need, axis=1)[:, n - need]
            able = high >= reach[:, None]
            few = able.sum(axis=1) <= max(8 * need, n // 16)
            for row in np.flatnonzero(few):
                found[open_[row]] = np.flatnonzero(able[row])
            open_ = open_[~few]
            if not len(open_):
                return found
        for i in open_:
            reach = np.partition(seen[i], n - need)[n - need]
            found[i] = np.flatnonzero(seen[i] >= (reach if beat[i] is None else max(reach, beat[i])))
        return found

    def search(self, queries: np.ndarray, need: int, before: list[list[tuple]]) -> list[list[tuple]]:
        """The `need` best (score, unnamed, id, whether the vector is the query) of this block and of those before, for each query."""
        beat = [b[need - 1][0] if len(b) >= need else None for b in before]
        out = []
        for q, at, old in zip(queries, self.candidates(queries, min(len(self.vectors), need), beat), before):
            chosen = self.vectors[at]
            if np.abs(chosen).max(axis=0, initial=0) @ np.abs(q) < EXACT:
                scores = chosen @ q
                at = at[np.lexsort((self.ids[at], self.unnamed[at], -scores))[:need]] if len(at) > need else at
                scores = [int(s) for s in self.vectors[at] @ q]
            else:
                scores = [sum(int(x) * int(y) for x, y in zip(c, q)) for c in chosen]
            same = (self.vectors[at] == q).all(axis=1)
            new = [(s, bool(u), int(i), bool(e)) for s, u, i, e in zip(scores, self.unnamed[at], self.ids[at], same)]
            out.append(sorted(old + new, key=lambda x: (-x[0], x[1], x[2]))[:need])
        return out


def _beyond(score: int) -> tuple[int, str]:
    """What orders a score that no long holds: its sign times its digits' number, and its digits (of a negative one, what they lack to nines); (0, '') for others."""
    if abs(score) <= _LONG:
        return 0, ""
    digits = str(abs(score))
    return (len(digits), digits) if score > 0 else (-len(digits), "".join(str(9 - int(c)) for c in digits))


def _meet(need: int):
    def run(rows: pa.Table) -> pa.Table:
        d, out = rows["d"][0].as_py(), []
        read = lambda r: np.frombuffer(r["vectors"], r["kind"]).astype(np.float64).reshape(len(r["ids"]) // 8, d)
        packed = sorted(rows.select(["asks", "part", "kind", "ids", "unnamed", "vectors", "lists"]).to_pylist(), key=lambda r: r["part"])
        blocks = [r for r in packed if not r["asks"]]
        for asked in (r for r in packed if r["asks"]):
            queries, numbers = read(asked), np.frombuffer(asked["ids"], "<i8")
            best: list[list[tuple]] = [[] for _ in numbers]
            for r in blocks:
                v = read(r)
                block = Block(v, np.frombuffer(r["lists"], np.uint32).reshape(v.shape), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["unnamed"], bool))
                for k in range(0, len(queries), ASKED):
                    best[k : k + ASKED] = block.search(queries[k : k + ASKED], need, best[k : k + ASKED])
            out += [(int(i), None if u else x, max(min(s, _LONG), -_LONG), *_beyond(s), e) for i, found in zip(numbers, best) for s, u, x, e in found]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
        return pa.table([pa.array([o[n] for o in out], k) for n, k in enumerate(kinds)], names=["q", "vec_id", "score", "beyond", "digits", "same"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest inner product for each query, exactly.

    vectors, queries: (vec_id long, v array of whole numbers, of any type that doubles hold); every row of
    queries should be a row of vectors, and every other row is a candidate. Rows with the same vec_id are rows
    of their own, each with its results; a row that stands twice finds its other self. Ties go to the smaller
    vec_id, null last; fewer than k candidates give fewer ranks; an empty side gives an empty result. Vectors
    of other lengths than the query's never meet it. Null vectors take no part. Scores are computed
    and ranked exactly; one that no long holds is given as the nearest long.
    """
    plain = lambda df: df.filter(F.col("v").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.transform(F.col("v").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    rows, asking = plain(vectors), plain(queries)
    # of equal vectors, the k smallest ids and the query's own can matter
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last()))
    kept = materialize(rows.withColumn("n", nth).filter(F.col("n") <= k + 1).select("id", "v", F.size("v").alias("d")), "vectors")
    asked = materialize(asking.select("v").distinct().select(F.monotonically_increasing_id().alias("id"), "v", F.size("v").alias("d")), "queries")
    blocks = lambda df, size: max(1, -(-df.count() // size))
    m, q = blocks(kept, vector_block), blocks(asked, query_block)
    block_of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    lists = materialize(kept.select("id", "v", "d", block_of("v", m).alias("a")).groupBy("a", "d").applyInArrow(_pack_vectors(LISTED), _PACKED), "lists")
    packed = materialize(asked.select("id", "v", "d", block_of("id", q).alias("b")).groupBy("b", "d").applyInArrow(_pack_queries, _PACKED), "asked")
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    rest = ["d", "asks", "part", "kind", "ids", "unnamed", "vectors", "lists"]
    pairs = lists.select("a", every("b", q), *rest).unionByName(packed.select(every("a", m), "b", *rest))
    found = pairs.groupBy("a", "b", "d").applyInArrow(_meet(k + 1), "q long, vec_id long, score long, beyond int, digits string, same boolean")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("beyond"), F.desc("digits"), F.desc("score"), F.col("vec_id").asc_nulls_last()))
    ranked = found.withColumn("n", place).filter(F.col("n") <= k + 1)
    best = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "same"))).alias("best"))  # k + 1 at most
    answered = asking.join(asked.select(F.col("id").alias("q"), "v"), "v").join(best, "q").select(F.col("id").alias("query_id"), "best")
    own = F.coalesce(F.get(F.filter("best", lambda x: x["same"] & x["vec_id"].eqNullSafe(F.col("query_id"))), F.lit(0))["n"], F.lit(k + 1))
    others = F.slice(F.filter("best", lambda x: x["n"] != own), F.lit(1), F.lit(k))
    return answered.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def prepared(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id long, v array<double>) of embeddings (vec_id, embedding): every row whose vector can take part, quantized."""
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("v")).filter("v IS NOT NULL")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every row for each row whose vec_id is divisible by 50; see top_k for ties, repeated ids and large scores."""
    vectors = materialize(prepared(table(spark, sf_dir, "embeddings")), "prepared")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP1_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.n <> e.n AND len(q.v) = len(e.v)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
