"""Trend queries over the annotated orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import stats
from quarrylane.operators import trends

from .fixtures import ACCEPTED, DOCUMENTS, ctes, view
from .registry import query

_YEARS = list(range(1995, 2002))
_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_A, _AD = ctes(a=ACCEPTED), ctes(a=ACCEPTED, d=DOCUMENTS)


def _periods():
    """Early and late years."""
    return F.col("year") <= 1997, F.col("year") >= 1998


@query("a01_volume_by_year", _A + "SELECT year, count(*) AS n, count(*) - lag(count(*)) OVER (ORDER BY year) AS yoy_delta, round(100.0 * (count(*) - lag(count(*)) OVER (ORDER BY year)) / lag(count(*)) OVER (ORDER BY year)::DOUBLE, 6) AS yoy_pct FROM a WHERE source <> 'NATION_3' GROUP BY year")
def volume_by_year(spark, d) -> DataFrame:
    return trends.volume_by_year(view(spark, d, ACCEPTED), excluded=F.col("source") == "NATION_3")


@query("a02_volume_by_quarter", _A + "SELECT substr(published, 1, 4) AS year, " + ", ".join(f"count(*) FILTER (WHERE quarter(published::DATE) = {q}) AS Q{q}" for q in (1, 2, 3, 4)) + " FROM a GROUP BY 1")
def volume_by_quarter(spark, d) -> DataFrame:
    return trends.volume_by_quarter(view(spark, d, ACCEPTED))


@query("a03_category_by_year", _A + "SELECT year, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE category = '{t}') AS {t.lower()}" for t in _TYPES) + " FROM a WHERE published <= '2001' GROUP BY year")
def category_by_year(spark, d) -> DataFrame:
    return trends.share_by_year(view(spark, d, ACCEPTED).filter("published <= '2001'"), "category", _TYPES)


@query("a04_top_items_by_year", _A + "SELECT year, item, n, rank FROM (SELECT year, item, count(*) AS n, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, item) AS rank FROM a GROUP BY year, item) WHERE rank <= 10")
def top_items_by_year(spark, d) -> DataFrame:
    return trends.top_by_group(view(spark, d, ACCEPTED), "year", "item", 10)


_EMERGENCE = """
SELECT item, early, late, first_year, early + late AS total, round(late::DOUBLE / nullif(early, 0), 6) AS growth,
  CASE WHEN (early = 0 OR late::DOUBLE / early >= 1.5) AND late >= 5 THEN 'emerging' WHEN early > 0 AND late::DOUBLE / early <= 0.5 AND early >= 5 THEN 'declining' ELSE 'steady' END AS trend, first_year >= 2000 AS is_new
FROM (SELECT item, count(*) FILTER (WHERE year <= 1997) AS early, count(*) FILTER (WHERE year >= 1998) AS late, min(year) AS first_year FROM a GROUP BY item) WHERE early + late >= 5
"""


@query("a05_emergence", _A + _EMERGENCE)
def emergence(spark, d) -> DataFrame:
    return trends.emergence(view(spark, d, ACCEPTED), "item", *_periods(), new_from=2000)


@query("a05_first_appearances", _A + "SELECT first_year, count(*) AS items FROM (SELECT item, source, min(year) AS first_year FROM a GROUP BY item, source) GROUP BY first_year")
def first_appearances(spark, d) -> DataFrame:
    return view(spark, d, ACCEPTED).groupBy("item", "source").agg(F.min("year").alias("first_year")).groupBy("first_year").agg(F.count("*").alias("items"))


@query("a06_source_contribution", _A + "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE year = {y}) AS y{y}" for y in _YEARS) + ", count(*) AS total FROM a GROUP BY source")
def source_contribution(spark, d) -> DataFrame:
    return trends.contribution(view(spark, d, ACCEPTED), "source", _YEARS)


@query("a07_copresence_by_year", _A + "SELECT year, count(*) AS docs, sum(x)::BIGINT AS has_one, sum(y)::BIGINT AS has_other, sum(x * y)::BIGINT AS has_both, round(sum(x * y)::DOUBLE / count(*), 6) AS rate FROM (SELECT document_id, year, max((item = 'Brand#7')::INT) AS x, max((item IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4'))::INT) AS y FROM a GROUP BY document_id, year) GROUP BY year")
def copresence(spark, d) -> DataFrame:
    return trends.copresence(view(spark, d, ACCEPTED), "document_id", "year", F.col("item") == "Brand#7", F.col("item").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4"))


_NORMALISED = """, r AS (SELECT item, c.year, c.c::DOUBLE / n.n AS r FROM (SELECT item, source_group AS s, year, count(*) AS c FROM a GROUP BY 1, 2, 3) c JOIN (SELECT source_group AS s, year, count(*) AS n FROM d GROUP BY 1, 2) n ON c.s = n.s AND c.year = n.year),
e AS (SELECT item, coalesce(sum(r) FILTER (WHERE year <= 1997), 0) AS early, coalesce(sum(r) FILTER (WHERE year >= 1998), 0) AS late FROM r GROUP BY item)
SELECT item, round(early, 6) AS early, round(late, 6) AS late, round(CASE WHEN early > 0.001 THEN late / early END, 6) AS growth,
  CASE WHEN (early <= 0.001 OR late / early >= 1.5) AND late >= 0.1 THEN 'emerging' WHEN early > 0.001 AND late / early <= 0.5 AND early >= 0.1 THEN 'declining' ELSE 'steady' END AS trend
FROM e WHERE early + late >= 0.05
"""


@query("a08_normalised_emergence", _AD.rstrip() + _NORMALISED)
def normalised_emergence(spark, d) -> DataFrame:
    return trends.normalised_emergence(view(spark, d, ACCEPTED), view(spark, d, DOCUMENTS), "item", "source_group", *_periods())


@query("a09_source_entropy", _A.rstrip() + """, c AS (SELECT year, source, count(*) AS n FROM a GROUP BY year, source), p AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS p, row_number() OVER (PARTITION BY year ORDER BY n DESC, source) AS r FROM c)
SELECT year, round(sum(-p * log2(p)), 6) AS entropy_bits, round(sum(-p * log2(p)) / log2((SELECT count(DISTINCT source) FROM c)), 6) AS entropy_normalized, string_agg(source, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS top3_sources FROM p GROUP BY year""")
def source_entropy(spark, d) -> DataFrame:
    return trends.source_entropy(view(spark, d, ACCEPTED), "year", "source")


@query("a10_documents_by_source_year", ctes(d=DOCUMENTS) + "SELECT source, year, count(*) AS n FROM d WHERE state IN ('completed', 'filtered') AND published <> '' AND source NOT IN ('NATION_3') GROUP BY source, year")
def documents_by_source_year(spark, d) -> DataFrame:
    kept = view(spark, d, DOCUMENTS).filter(F.col("state").isin("completed", "filtered") & (F.col("published") != "") & ~F.col("source").isin("NATION_3"))
    return kept.groupBy("source", "year").agg(F.count("*").alias("n"))


_SERIES = ", ".join(f"count(*) FILTER (WHERE year = {y})" for y in _YEARS)


@query("w06_dense_series", _A + f"SELECT item, [{_SERIES}] AS series FROM a GROUP BY item")
def dense_series(spark, d) -> DataFrame:
    return trends.dense_series(view(spark, d, ACCEPTED), "item", "year", _YEARS)


@query("e13_kendall_s", _A.rstrip() + f", s AS (SELECT item, [{_SERIES}] AS x FROM a GROUP BY item) SELECT item, s, round(s / 21.0, 6) AS tau FROM (SELECT item, (SELECT sum(sign(x[j] - x[i])) FROM range(1, 8) t(i), range(1, 8) u(j) WHERE i < j)::INT AS s FROM s)")
def kendall_s(spark, d) -> DataFrame:
    series = trends.dense_series(view(spark, d, ACCEPTED), "item", "year", _YEARS)
    return series.select("item", trends.kendall_s(F.col("series")).alias("s")).withColumn("tau", F.round(F.col("s") / F.lit(21.0), 6))


@query("e13_mann_kendall")
def mann_kendall(spark, d) -> DataFrame:
    series = trends.dense_series(view(spark, d, ACCEPTED), "item", "year", _YEARS)
    return series.withColumn("mk", stats.mann_kendall(F.col("series"))).select("item", "series", "mk.tau", "mk.p_value", "mk.direction")


_SERIES5 = ", ".join(f"count(*) FILTER (WHERE year = {y})" for y in _YEARS[:5])
# Of the 120 orders of five different values, how many have at least this |S|.
_AT_LEAST = "CASE abs(s) WHEN 0 THEN 120 WHEN 2 THEN 98 WHEN 4 THEN 58 WHEN 6 THEN 28 WHEN 8 THEN 10 WHEN 10 THEN 2 END"


@query("e13_exact_p_of_five", _A.rstrip() + f", s AS (SELECT item, [{_SERIES5}] AS x FROM a GROUP BY item HAVING len(list_distinct([{_SERIES5}])) = 5), k AS (SELECT item, (SELECT sum(sign(x[j] - x[i])) FROM range(1, 6) t(i), range(1, 6) u(j) WHERE i < j)::INT AS s FROM s) SELECT item, round(s / 10.0, 6) AS tau, round({_AT_LEAST} / 120.0, 6) AS p_value, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM k")
def exact_p_of_five(spark, d) -> DataFrame:
    series = trends.dense_series(view(spark, d, ACCEPTED), "item", "year", _YEARS[:5]).filter(F.size(F.array_distinct("series")) == 5)
    return series.withColumn("mk", stats.mann_kendall(F.col("series"))).select("item", F.round("mk.tau", 6).alias("tau"), F.round("mk.p_value", 6).alias("p_value"), "mk.direction")


_ORDERS = "orders AS MATERIALIZED (SELECT [a, b, c, d, e] AS o FROM range(1, 6) t(a), range(1, 6) u(b), range(1, 6) v(c), range(1, 6) w(d), range(1, 6) x(e) WHERE len(list_distinct([a, b, c, d, e])) = 5)"
_S_OF = "list_sum(list_transform(range(1, 5), lambda i: list_sum(list_transform(range(i + 1, 6), lambda j: sign({x}[j] - {x}[i])))))"


@query("e14_trend_matrix", _A.rstrip() + f", {_ORDERS}, s AS MATERIALIZED (SELECT item, [{_SERIES5}] AS x FROM a GROUP BY item), k AS (SELECT item, x, list_sum(x) AS total, {_S_OF.format(x='x')} AS s FROM s WHERE list_sum(x) >= 4), y AS (SELECT k.item, list_transform(o, lambda i: x[i]) AS y FROM k, orders), p AS (SELECT k.item, avg((abs({_S_OF.format(x='y')}) >= abs(k.s))::INT) AS p FROM y JOIN k USING (item) GROUP BY k.item), m AS (SELECT *, total / 5.0 AS mean, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM k JOIN p USING (item)) SELECT item, total::BIGINT AS total, mean AS mean_per_year, round(s / 10.0, 9) AS tau, round(p, 9) AS p_value, direction, p < 0.10 AS significant, CASE WHEN p < 0.10 AND direction = 'increasing' AND mean < 3 THEN 'EMERGING' WHEN p < 0.10 AND direction = 'increasing' THEN 'RISING' WHEN p < 0.10 AND direction = 'decreasing' THEN 'OBSOLESCENT' WHEN mean >= 10 THEN 'CORE' ELSE 'STABLE' END AS category, x AS series FROM m")
def trend_matrix(spark, d) -> DataFrame:
    series = trends.dense_series(view(spark, d, ACCEPTED), "item", "year", _YEARS[:5])
    total = F.aggregate("series", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = series.withColumns({"total": total, "mk": stats.mann_kendall(F.col("series"))}).filter("total >= 4").withColumn("mean_per_year", F.col("total") / F.size("series"))
    significant = F.col("mk.p_value") < 0.10
    return rows.select("item", "total", "mean_per_year", F.round("mk.tau", 9).alias("tau"), F.round("mk.p_value", 9).alias("p_value"), "mk.direction", significant.alias("significant"), trends.trend_category(F.col("total"), F.col("mean_per_year"), F.col("mk.direction"), significant).alias("category"), "series")


@query("u03_u04_robust_items", _AD.rstrip() + _NORMALISED.replace("SELECT item, round(early", ", norm AS (SELECT item, round(early", 1).replace("FROM e WHERE", "FROM e WHERE", 1).rstrip() + f"), raw AS ({_EMERGENCE}) SELECT coalesce(r.item, n.item) AS item, CASE WHEN r.item IS NOT NULL AND n.item IS NOT NULL THEN 'both' WHEN n.item IS NULL THEN 'raw only' ELSE 'normalised only' END AS found FROM (SELECT item FROM raw WHERE trend <> 'steady') r FULL JOIN (SELECT item FROM norm WHERE trend <> 'steady') n ON r.item = n.item")
def robust_items(spark, d) -> DataFrame:
    rows, docs = view(spark, d, ACCEPTED), view(spark, d, DOCUMENTS)
    raw = trends.emergence(rows, "item", *_periods()).filter("trend <> 'steady'").select("item")
    norm = trends.normalised_emergence(rows, docs, "item", "source_group", *_periods()).filter("trend <> 'steady'").select("item")
    parts = (raw.intersect(norm), "both"), (raw.exceptAll(norm), "raw only"), (norm.exceptAll(raw), "normalised only")
    one, two, three = (df.withColumn("found", F.lit(name)) for df, name in parts)
    return one.unionByName(two).unionByName(three)


@query("a35_column_shares", _A + "SELECT year, category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS pct FROM a GROUP BY year, category")
def column_shares(spark, d) -> DataFrame:
    counts = view(spark, d, ACCEPTED).groupBy("year", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))
