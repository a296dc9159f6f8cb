"""Association rules and graph queries: the items are part names, so that pairs are many and rules few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.operators import assoc, graph

from .fixtures import ANNOTATIONS, ctes, view
from .registry import query

_N = ctes(n=ANNOTATIONS).rstrip()
_BASKETS = _N + ", t AS (SELECT DISTINCT document_id, category || '/' || item AS item FROM n), c AS (SELECT item, count(*) AS k FROM t GROUP BY item), z AS (SELECT count(DISTINCT document_id) AS z FROM t)"
_PAIRS = _BASKETS + ", p AS (SELECT x.item AS a, y.item AS b, count(*) AS k FROM t x JOIN t y ON x.document_id = y.document_id AND x.item < y.item GROUP BY 1, 2), pt AS (SELECT p.a, p.b, p.k AS count_both, ca.k AS count_a, cb.k AS count_b, z.z AS n_documents, p.k::DOUBLE / (ca.k + cb.k - p.k) AS jaccard, p.k::DOUBLE / z.z AS support FROM p JOIN c ca ON p.a = ca.item JOIN c cb ON p.b = cb.item, z)"
#: Lower than the defaults, as brands are drawn independently here.
_FLOORS = {"support": 0.00015, "confidence": 0.015, "lift": 1.2}


def _rows(spark, d) -> DataFrame:
    return view(spark, d, ANNOTATIONS).withColumn("item", F.concat_ws("/", "category", "item"))


@query("g01_transactions", _BASKETS + " SELECT document_id AS document, string_agg(item, ',' ORDER BY item) AS items FROM t GROUP BY document_id")
def transactions(spark, d) -> DataFrame:
    return assoc.transactions(_rows(spark, d)).withColumn("items", F.array_join("items", ","))


@query("g01_item_details", _N + " SELECT item, arg_min(category, (document_id, idx)) AS category, count(DISTINCT document_id) AS n FROM n GROUP BY item")
def item_details(spark, d) -> DataFrame:
    return assoc.item_details(view(spark, d, ANNOTATIONS))


@query("g02_j14_pairs", _PAIRS + " SELECT a, b, count_both, count_a, count_b, n_documents, round(jaccard, 9) AS jaccard, round(support, 9) AS support FROM pt")
def pair_table(spark, d) -> DataFrame:
    return assoc.pair_table(assoc.transactions(_rows(spark, d))).withColumns({"jaccard": F.round("jaccard", 9), "support": F.round("support", 9)})


_RULES = _PAIRS + """, dirs AS (SELECT a AS ant, b AS con, count_both AS k, count_a AS ka, count_b AS kc, n_documents AS n, support FROM pt UNION ALL SELECT b, a, count_both, count_b, count_a, n_documents, support FROM pt),
q AS (SELECT *, k::DOUBLE / ka AS confidence, (k::DOUBLE / ka) / (kc::DOUBLE / n) AS lift FROM dirs),
kept AS (SELECT * FROM q WHERE support >= 0.00015 AND confidence >= 0.015 AND lift > 1.2),
lp AS (SELECT ant, con, i, lgamma(kc + 1) - lgamma(i + 1) - lgamma(kc - i + 1) + lgamma(n - kc + 1) - lgamma(ka - i + 1) - lgamma(n - kc - ka + i + 1) - lgamma(n + 1) + lgamma(ka + 1) + lgamma(n - ka + 1) AS l, i = k AS seen
  FROM (SELECT *, unnest(range(greatest(0, ka + kc - n), least(ka, kc) + 1)) AS i FROM kept)),
f AS (SELECT ant, con, least(1.0, sum(exp(l)) FILTER (WHERE l <= o + 1e-10)) AS p FROM (SELECT *, max(CASE WHEN seen THEN l END) OVER (PARTITION BY ant, con) AS o FROM lp) GROUP BY ant, con),
rr AS (SELECT kept.*, f.p, row_number() OVER (ORDER BY f.p, kept.ant, kept.con) AS r, count(*) OVER () AS m FROM kept JOIN f USING (ant, con))
"""


@query("g03_e11_rules", _RULES + "SELECT ant AS antecedent, con AS consequent, k AS count_both, round(confidence, 9) AS confidence, round(lift, 9) AS lift, round(p, 4) AS fisher_p FROM rr")
def rules(spark, d) -> DataFrame:
    found = assoc.rules(assoc.pair_table(assoc.transactions(_rows(spark, d))), **_FLOORS)
    return found.select("antecedent", "consequent", "count_both", F.round("confidence", 9).alias("confidence"), F.round("lift", 9).alias("lift"), F.round("fisher_p", 4).alias("fisher_p"))


@query("e12_w05_benjamini_hochberg", ctes(n=ANNOTATIONS) + ", p AS (SELECT DISTINCT document_id, ((document_id * 37) % 1009 + 1)::DOUBLE / 10000 AS p FROM n), r AS (SELECT *, row_number() OVER (ORDER BY p, document_id) AS r, count(*) OVER () AS m FROM p), c AS (SELECT max(r) AS c FROM r WHERE p <= 0.05 * r / m) SELECT document_id, p, coalesce(r <= c, false) AS bh_significant FROM r, c")
def benjamini_hochberg(spark, d) -> DataFrame:
    p = view(spark, d, ANNOTATIONS).select("document_id").distinct().withColumn("p", ((F.col("document_id") * 37) % 1009 + 1).cast("double") / 10000)
    return assoc.benjamini_hochberg(p, "p", "document_id")


_RANKS = {"ECONOMY": 1, "SMALL": 2, "MEDIUM": 3, "LARGE": 4, "STANDARD": 5}
_CASE = "CASE {0} WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LARGE' THEN 4 WHEN 'STANDARD' THEN 5 END"


def _rank(c):
    return F.create_map(*[F.lit(x) for kv in _RANKS.items() for x in kv])[c]


@query("g04_direction", _RULES + ", w AS (SELECT ant, con, " + _CASE.format("split_part(ant, '/', 1)") + " AS x, " + _CASE.format("split_part(con, '/', 1)") + " AS y FROM rr) SELECT CASE WHEN x IS NULL OR y IS NULL THEN 'unknown' WHEN x < y THEN 'forward' WHEN x > y THEN 'backward' ELSE 'same' END AS temporal_direction, count(*) AS rules FROM w GROUP BY 1")
def directions(spark, d) -> DataFrame:
    found = assoc.rules(assoc.pair_table(assoc.transactions(_rows(spark, d))), **_FLOORS)
    named = found.withColumn("temporal_direction", assoc.direction(_rank(F.split_part("antecedent", F.lit("/"), F.lit(1))), _rank(F.split_part("consequent", F.lit("/"), F.lit(1)))))
    return named.groupBy("temporal_direction").agg(F.count("*").alias("rules"))


@query("g05_l06_rules_by_category_pair", _RULES + """, w AS (SELECT *, split_part(ant, '/', 1) AS f, split_part(con, '/', 1) AS t FROM rr), s AS (SELECT f, t, count(*) AS rules FROM w GROUP BY f, t ORDER BY rules DESC, f, t LIMIT 20)
SELECT f AS category_from, t AS category_to, rules, place, ant AS antecedent, con AS consequent, round(confidence, 9) AS confidence FROM (SELECT w.*, s.rules, row_number() OVER (PARTITION BY f, t ORDER BY confidence DESC, lift DESC, ant, con) AS place FROM w JOIN s USING (f, t)) WHERE place <= 5""")
def rules_by_category_pair(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    found = assoc.rules(assoc.pair_table(assoc.transactions(rows)), **_FLOORS)
    best = assoc.by_category_pair(found, assoc.item_details(rows))
    return best.select("category_from", "category_to", "rules", "place", "antecedent", "consequent", F.round("confidence", 9).alias("confidence"))


def _edges(spark, d, excised=None) -> DataFrame:
    return assoc.graph(assoc.pair_table(assoc.transactions(view(spark, d, ANNOTATIONS))), jaccard=0.0815, excised=excised)


_GRAPH = _PAIRS.replace("category || '/' || item AS item", "item") + ", e AS (SELECT a AS src, b AS dst, jaccard AS weight FROM pt WHERE jaccard >= 0.0815 AND count_both >= 2 UNION ALL SELECT b, a, jaccard FROM pt WHERE jaccard >= 0.0815 AND count_both >= 2)"


@query("g06_g07_degree", _GRAPH + " SELECT src AS node, round(sum(weight), 9) AS degree FROM e GROUP BY src")
def degree(spark, d) -> DataFrame:
    return graph.weighted_degree(_edges(spark, d)).withColumn("degree", F.round("degree", 9))


@query("g08_pagerank", _GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + ", mv AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e), sz AS MATERIALIZED (SELECT count(DISTINCT src) AS n FROM e), pr(k, node, rank) AS (SELECT DISTINCT 0, src, 1.0::DOUBLE / n FROM e, sz UNION ALL SELECT any_value(k) + 1, dst, any_value(0.15::DOUBLE / n) + 0.85 * sum(rank * p) FROM pr JOIN mv ON node = src, sz WHERE k < 120 GROUP BY dst) SELECT node, round(rank, 8) AS rank FROM pr WHERE k = 120")
def pagerank(spark, d) -> DataFrame:
    return graph.pagerank(_edges(spark, d), most_rounds=200, tolerance=1e-11).withColumn("rank", F.round("rank", 8))


_PATHS = """, ed AS MATERIALIZED (SELECT DISTINCT src, dst FROM e), nodes AS MATERIALIZED (SELECT DISTINCT src AS v FROM ed), reach(s, v, d) AS (SELECT v, v, 0 FROM nodes UNION SELECT s, dst, d + 1 FROM reach JOIN ed ON v = src WHERE d < (SELECT count(*) FROM nodes)),
far AS MATERIALIZED (SELECT s, v, min(d) AS d FROM reach GROUP BY s, v), paths(s, v, d, c) AS (SELECT v, v, 0, 1.0::DOUBLE FROM nodes UNION ALL SELECT paths.s, ed.dst, paths.d + 1, sum(c) FROM paths JOIN ed ON paths.v = ed.src JOIN far ON far.s = paths.s AND far.v = ed.dst AND far.d = paths.d + 1 GROUP BY paths.s, ed.dst, paths.d),
through AS (SELECT x.v, sum(x.c * y.c / z.c) AS b FROM paths x JOIN paths y ON x.v = y.s JOIN paths z ON z.s = x.s AND z.v = y.v WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v AND x.d + y.d = z.d GROUP BY x.v)"""


@query("g09_betweenness", _GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + _PATHS + " SELECT nodes.v AS node, round(coalesce(b, 0.0) / (SELECT CASE WHEN count(*) > 2 THEN (count(*) - 1) * (count(*) - 2) ELSE 1 END FROM nodes), 9) AS betweenness FROM nodes LEFT JOIN through ON nodes.v = through.v")
def betweenness(spark, d) -> DataFrame:
    return graph.betweenness(_edges(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query("g10_centrality")
def centrality(spark, d) -> DataFrame:
    items = assoc.item_details(view(spark, d, ANNOTATIONS))
    return graph.centrality(graph.centrality(items, _edges(spark, d)), _edges(spark, d, "Brand#7"), "excised")


@query("g11_graph_view", _GRAPH + " SELECT src, dst, weight AS jaccard FROM (SELECT src, dst, round(weight, 9) AS weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e WHERE src <> 'Brand#7' AND dst <> 'Brand#7') WHERE r <= 8")
def graph_view(spark, d) -> DataFrame:
    near = _edges(spark, d, "Brand#7").withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")))
    return near.filter("r <= 8").select("src", "dst", F.round("weight", 9).alias("jaccard"))
