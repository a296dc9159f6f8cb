"""The library's data model laid over the star schema: annotated documents, raters, a catalogue, jobs.

An order is a document, its line items are annotations on it, the brand is the
annotated item, the part type an ordered category, the customer's nation the
source. Each view is one SQL text that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = """
SELECT o_orderkey AS document_id, n_name AS source, r_name AS source_group, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published, year(o_orderdate) AS year,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'filtered' END AS state,
  o_orderpriority AS priority, o_totalprice AS size
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

ANNOTATIONS = """
SELECT l_orderkey AS document_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS idx,
  p_brand AS item, p_type AS category, p_name AS label_text, CAST(CAST(l_shipdate AS DATE) AS STRING) AS judged,
  CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'reject' ELSE 'uncertain' END AS v1,
  CASE WHEN l_linestatus = 'F' THEN 'accept' ELSE 'reject' END AS v2,
  CASE WHEN l_tax < 0.03 THEN 1.0E0 WHEN l_tax < 0.06 THEN 0.75E0 ELSE 0.5E0 END AS confidence, l_quantity AS quantity
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

#: Annotations that the first rater accepts, with their document's date and source.
ACCEPTED = f"""
SELECT a.document_id, a.idx, a.item, a.category, d.source, d.source_group, d.published, d.year
FROM ({ANNOTATIONS}) a JOIN ({DOCUMENTS}) d ON a.document_id = d.document_id WHERE a.v1 = 'accept'
"""

#: Labels of a human rater and of two others; the second's are missing for some.
GOLD = f"""
SELECT a.document_id, a.idx, a.item, a.category, d.source, d.source_group, CASE WHEN d.priority IN ('1-URGENT', '2-HIGH') THEN 'control' ELSE 'stratified' END AS stratum,
  a.v1, CASE WHEN a.quantity % 5 = 0 THEN NULL ELSE a.v2 END AS v2,
  CASE WHEN a.quantity % 7 = 0 THEN 'uncertain' WHEN (a.v2 = 'accept') = (a.quantity % 3 > 0) THEN 'accept' ELSE 'reject' END AS human,
  CASE WHEN a.v1 = 'accept' AND a.quantity % 3 = 0 THEN 'E1' WHEN a.v1 = 'reject' AND a.quantity % 4 = 0 THEN 'E2' WHEN a.quantity % 11 = 0 THEN 'E4' END AS error_code
FROM ({ANNOTATIONS}) a JOIN ({DOCUMENTS}) d ON a.document_id = d.document_id
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view's DataFrame; the text names tables in braces."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text})


def duck(text: str) -> str:
    """A view's text for DuckDB."""
    for t in _TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def ctes(**views: str) -> str:
    """WITH clause that names views."""
    return "WITH " + ", ".join(f"{name} AS ({duck(text)})" for name, text in views.items()) + "\n"
