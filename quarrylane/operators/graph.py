"""Centrality on weighted graphs (src, dst, weight), each undirected edge given both ways."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.scratch import materialize

#: Edges that betweenness may send to every task; larger graphs are refused, as each source needs all edges.
MOST_EDGES = 2_000_000


def weighted_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, most_rounds: int = 100, tolerance: float = 1e-6, cut_every: int = 5) -> DataFrame:
    """(node, rank): weighted PageRank from even ranks; stops when ranks change by less than tolerance in sum, and fails if they still do after most_rounds.

    Mass of nodes without outgoing weight isn't dealt out. A round is one join and one sum; every few
    rounds the ranks are written to the shared folder.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    moves = materialize(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")), "moves")
    nodes = materialize(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, most_rounds + 1):
        gained = ranks.join(moves, ranks["node"] == moves["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("g"))
        new = ranks.join(gained, "node", "left").select("node", F.col("rank").alias("before"), (F.lit((1 - damping) / n) + damping * F.coalesce("g", F.lit(0.0))).alias("rank"))
        if k % cut_every and k < most_rounds:
            ranks = new.select("node", "rank")
            continue
        new = materialize(new, "ranks")
        ranks = new.select("node", "rank")
        if new.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < tolerance:
            return ranks
    raise RuntimeError(f"PageRank still changes after {most_rounds} rounds")


def betweenness(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, betweenness): shortest unweighted paths through a node, both directions counted, over (n - 1) * (n - 2).

    Sources are dealt over tasks, which all hold the adjacency; the edges are counted first, and a graph
    of more than MOST_EDGES is refused rather than broadcast.
    """
    spark = edges.sparkSession
    rows = edges.select("src", "dst").distinct().limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"betweenness takes graphs of up to {MOST_EDGES} edges")
    near: dict[str, list[str]] = defaultdict(list)
    for a, b in sorted(tuple(r) for r in rows):
        near[a].append(b)
        near[b]  # a node even if nothing leaves it
    shared = spark.sparkContext.broadcast(dict(near))
    n = len(near)
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches):
        adjacent = shared.value
        sums: dict[str, float] = defaultdict(float)
        for batch in batches:
            for source in batch["node"]:
                order, paths, distance, before = [], defaultdict(float, {source: 1.0}), {source: 0}, defaultdict(list)
                queue = deque([source])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in adjacent[v]:
                        if w not in distance:
                            distance[w] = distance[v] + 1
                            queue.append(w)
                        if distance[w] == distance[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                depends: dict[str, float] = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        depends[v] += paths[v] / paths[w] * (1 + depends[w])
                    if w != source:
                        sums[w] += depends[w]
        if sums:
            yield pd.DataFrame({"node": list(sums), "b": list(sums.values())})

    nodes = spark.createDataFrame([(v,) for v in sorted(near)], f"node {kind}").repartition(parts or spark.sparkContext.defaultParallelism, "node")
    sums = nodes.mapInPandas(run, f"node {kind}, b double").groupBy("node").agg(F.sum("b").alias("b"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def centrality(items: DataFrame, edges: DataFrame, prefix: str = "full") -> DataFrame:
    """items (item, ...) with degree, PageRank and betweenness; zero for items outside the graph."""
    found = weighted_degree(edges).join(pagerank(edges), "node").join(betweenness(edges), "node")
    joined = items.join(found.withColumnRenamed("node", "item"), "item", "left")
    return joined.select(*items.columns, *[F.coalesce(c, F.lit(0.0)).alias(f"{prefix}_{c}" if c != "rank" else f"{prefix}_pagerank") for c in ("degree", "rank", "betweenness")])
