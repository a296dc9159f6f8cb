"""Sources and sinks, on files that the queries write to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.functions import text as T
from quarrylane.scratch import materialize, shared_dir
from quarrylane.sources import files

from .fixtures import table
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_s02_s03_csv_scan", "SELECT CASE WHEN doc_id % 2 = 0 AND source = 'src3' THEN 'third' ELSE source END AS source, lang || doc_id AS url, doc_id::VARCHAR AS title, md5(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS digest FROM documents")
def csv_scan(spark, d) -> DataFrame:
    """Whole documents written as CSV files of two layouts, and one of a third that is skipped, into one folder; each file is read by its own header."""
    docs = table(spark, d, "documents").withColumn("url", F.concat("lang", F.col("doc_id").cast("string")))
    path = _folder(spark, "layouts")
    even = docs.filter("doc_id % 2 = 0").select("source", F.lit("2024-01-01").alias("published_utc"), F.col("doc_id").cast("string").alias("headline"), "url", F.col("text").alias("body"))
    odd = docs.filter("doc_id % 2 = 1").select("source", "url", F.col("doc_id").cast("string").alias("Title"), F.lit("2024-01-01").alias("DATE"), F.col("text").alias("body"))
    for rows in (even, odd, docs.select("doc_id")):
        rows.write.mode("append").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    found = files.read_articles(spark, [path])
    renamed = F.when((F.col("source") == "src3") & (F.col("title").cast("long") % 2 == 0), "third").otherwise(F.col("source"))
    return found.select(renamed.alias("source"), "url", "title", F.md5("body").alias("digest"))


@query("s04_table_scan", "SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 1000")
def table_scan(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("n_chars > 1000").select("doc_id", "source", "n_chars")


@query("s05_json_lines", "SELECT event_id, user_id FROM events WHERE event_id % 10 NOT IN (3, 4)")
def json_lines(spark, d) -> DataFrame:
    """Lines of which some are broken and some lack a key."""
    path = _folder(spark, "lines")
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit('{"event_id": '), e)).when(F.col("event_id") % 10 == 4, F.concat(F.lit('{"event_id": '), e, F.lit("}"))).otherwise(F.concat(F.lit('{"event_id": '), e, F.lit(', "user_id": '), u, F.lit("}")))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return files.read_json_lines(spark, path, "event_id long, user_id long", ["event_id", "user_id"])


@query("s06_bundle_scan", "SELECT 1 AS version, 'T' || (1000 + p_partkey) AS item, p_name AS name, '2020-01-0' || (1 + p_partkey % 9) AS created, p_size % 7 = 0 AS revoked FROM part WHERE p_partkey % 3 > 0")
def bundle_scan(spark, d) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "tool").otherwise("attack-pattern")
    item = F.concat(F.lit("T"), (1000 + F.col("p_partkey")).cast("string"))
    refs = F.array(F.struct(F.lit("other").alias("source_name"), F.lit("X1").alias("external_id")), F.struct(F.lit("catalogue").alias("source_name"), item.alias("external_id")))
    o = F.struct(kind.alias("type"), F.col("p_name").alias("name"), F.concat(F.lit("2020-01-0"), (1 + F.col("p_partkey") % 9).cast("string"), F.lit("T00:00:00Z")).alias("created"), F.when(F.col("p_size") % 7 == 0, True).alias("revoked"), refs.alias("external_references"))
    bundle = table(spark, d, "part").groupBy((F.col("p_partkey") % 5).alias("b")).agg(F.to_json(F.struct(F.collect_list(o).alias("objects"))).alias("bundle"))
    return files.bundle_items(bundle.select(F.lit(1).alias("version"), "bundle"), "catalogue")


@query("s08_typed_records", "SELECT doc_id, try_cast(CASE WHEN doc_id % 4 = 0 THEN 'n/a' ELSE n_chars::VARCHAR END AS BIGINT) AS n FROM documents")
def typed_records(spark, d) -> DataFrame:
    raw = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("n"))
    return files.typed(raw, {"n": "long"})


@query("s09_csv_round_trip", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def csv_round_trip(spark, d) -> DataFrame:
    path = _folder(spark, "nation")
    files.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), path, one_file=True)
    return spark.read.option("header", True).csv(path)


@query("s10_resumed_sink", "SELECT event_id, event_type FROM events")
def resumed_sink(spark, d) -> DataFrame:
    """Two overlapping appends leave every row once."""
    path = _folder(spark, "sink")
    events = table(spark, d, "events").select("event_id", "event_type")
    files.append_json_lines(events.filter("event_type <> 'error'"), path, "event_id")
    files.append_json_lines(events, path, "event_id")
    return spark.read.schema(events.schema).json(path)


@query("s15_vector_table", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings")
def vector_table(spark, d) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(squares), 5).alias("norm"))


@query("s16_listing", "SELECT lang, count(*) AS rows, true AS sized FROM documents GROUP BY lang")
def listing(spark, d) -> DataFrame:
    """Files written by language, listed with their sizes and counted."""
    path = _folder(spark, "listed")
    table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").json(path)
    found = files.listing(spark, path).withColumn("size", T.human_size(F.col("bytes")))
    rows = spark.read.json(path).groupBy("lang", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("n")).agg(F.count("*").alias("rows"))
    listed = rows.join(found, (rows["file"] == found["file"]) & (rows["n"] == found["bytes"]))
    return listed.groupBy("lang").agg(F.sum("rows").alias("rows"), F.bool_and(F.col("size").rlike("^[0-9.]+ [KM]?B$")).alias("sized"))


@query("s17_repaired_history", "SELECT source AS spider, sum(CASE WHEN source < 'src2' THEN 7 ELSE n END)::BIGINT AS total, count(*) AS runs FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def repaired_history(spark, d) -> DataFrame:
    counts = materialize(table(spark, d, "documents").groupBy(F.concat_ws("_", "source", "lang").alias("file"), "source").agg(F.count("*").alias("n")), "counts")
    runs = counts.select("file", F.col("source").alias("spider"), F.when(F.col("source") < "src2", 7).otherwise(0).cast("long").alias("articles"))
    return files.repair_counts(runs, counts.select("file", "n"))


@query("t26_declared_names", "SELECT 'f' || p_partkey || '.py' AS file, 'spider_' || p_partkey AS name FROM part WHERE p_partkey % 4 = 0")
def declared_names(spark, d) -> DataFrame:
    kind, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    name = F.concat(F.when(kind == 1, F.lit("_f")).otherwise(F.lit("f")), key, F.when(kind == 2, F.lit(".txt")).otherwise(F.lit(".py")))
    content = F.when(kind == 3, F.lit("class A:\n    title = 'x'\n")).otherwise(F.concat(F.lit("class A:\n    name = \"spider_"), key, F.lit("\"\n    name = 'later'\n")))
    return files.declared_names(table(spark, d, "part").select(name.alias("file"), content.alias("content")))
