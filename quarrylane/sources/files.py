"""Files in and out: CSV layouts told by their header, tolerant JSON lines, release bundles, listings, sinks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarrylane.scratch import materialize

#: Names of the columns of each known layout, all lower case; a header that has the marking columns is of that layout.
LAYOUTS: dict[str, tuple[set[str], dict[str, str]]] = {
    "a": ({"published_utc", "headline"}, {"source": "source", "url": "url", "title": "headline", "published": "published_utc", "body": "body"}),
    "b": ({"date", "title"}, {"source": "source", "url": "url", "title": "title", "published": "date", "body": "body"}),
}
_OUT = ("source", "url", "title", "published", "body")


def layout_of(header: list[str]) -> str | None:
    """The layout of a header, by lower-case names; None if it is unknown."""
    names = {h.strip().lower() for h in header}
    return next((k for k, (marks, _) in LAYOUTS.items() if marks <= names), None)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The header of each file of some files, folders or globs, by its path; empty files have none. One job; a row for each file reaches the driver."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("line")).collect()
    return {r["path"]: next(csv.reader([r["line"].rstrip("\r")]), []) for r in first}


def read_articles(spark: SparkSession, paths: list[str], aliases: dict[str, str] | None = None, ignored: tuple[str, ...] = (), marker: str = "_ransomware") -> DataFrame:
    """(source, url, title, published, body, file) of CSV files of either layout, given as files, folders or globs.

    Each file is read by its own header, whatever the order and case of its columns; files of unknown
    layouts, empty files and those with an ignored name are skipped, repeated header rows dropped. Values
    are stripped, missing ones ''. A source may have an alias; an empty one is the file's stem up to the
    marker. Bad UTF-8 is replaced. Files with the same header are one scan.
    """
    by_header: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for path, header in sorted(headers(spark, paths).items()):
        names = tuple(h.strip().lower() for h in header)
        if (kind := layout_of(header)) is not None and path.rsplit("/", 1)[-1] not in ignored:
            by_header.setdefault((kind, names), []).append(path)
    out = spark.createDataFrame([], StructType([StructField(c, StringType()) for c in (*_OUT, "file")]))
    for (kind, header), found in by_header.items():
        # a column that stands twice counts where it stands last
        unique = [f"{h}_{n}" if h in header[n + 1 :] else h for n, h in enumerate(header)]
        schema = StructType([StructField(h, StringType()) for h in unique])
        rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(found)
        names = LAYOUTS[kind][1]
        pick = [_stripped(F.col(f"`{names[c]}`")).alias(c) if names[c] in unique else F.lit("").alias(c) for c in _OUT]
        out = out.unionByName(rows.select(*pick, F.col("_metadata.file_name").alias("file")).filter(F.lower("source") != "source"))
    stem = F.substring_index(F.regexp_replace(F.url_decode("file"), "\\.[^.]*$", ""), marker, 1)
    given = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[F.col("source")], F.col("source")) if aliases else F.col("source")
    return out.withColumn("source", F.when(F.col("source") == "", stem).otherwise(given))


def read_bundles(spark: SparkSession, releases: dict[str, str], missing: str = "skip") -> DataFrame:
    """(version, bundle) of release files by version. Releases that aren't there are skipped, or an error if missing is 'raise'; what was read is kept in the shared folder."""
    frames = []
    for version, path in releases.items():
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            frames.append(spark.read.text(path, wholetext=True).select(F.lit(version).alias("version"), F.col("value").alias("bundle")))
        elif missing == "raise":
            raise FileNotFoundError(path)
    if not frames:
        return spark.createDataFrame([], "version string, bundle string")
    found = frames[0]
    for f in frames[1:]:
        found = found.union(f)
    return materialize(found, "bundles")


def read_json_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """JSON lines with bad lines, and lines that lack a required key, left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for r in required:
        rows = rows.filter(F.col(r).isNotNull())
    return rows


def append_json_lines(new: DataFrame, path: str, key: str) -> DataFrame:
    """Appends those rows whose key the sink doesn't have yet; returns what was appended."""
    spark = new.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    todo = new.join(spark.read.schema(new.schema).json(path).select(key), key, "left_anti") if there else new
    todo = materialize(todo, "to-append")  # decided before the sink changes
    todo.write.mode("append").json(path)
    return todo


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; one file only where a result is known to be small."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def bundle_items(bundles: DataFrame, catalogue: str) -> DataFrame:
    """(version, item, name, created, revoked) of release bundles (version, bundle JSON): objects of type attack-pattern by their id in the catalogue."""
    schema = "array<struct<type: string, name: string, created: string, revoked: boolean, external_references: array<struct<source_name: string, external_id: string>>>>"
    objects = bundles.select("version", F.explode(F.from_json(F.get_json_object("bundle", "$.objects"), schema)).alias("o")).filter("o.type = 'attack-pattern'")
    ref = F.get(F.filter("o.external_references", lambda r: r["source_name"] == catalogue), F.lit(0))["external_id"]
    return objects.select("version", ref.alias("item"), "o.name", F.substring("o.created", 1, 10).alias("created"), F.coalesce("o.revoked", F.lit(False)).alias("revoked")).filter("item IS NOT NULL")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def repair_counts(runs: DataFrame, counts: DataFrame, key: str = "file") -> DataFrame:
    """runs (key, spider, articles) with zero counts replaced by real ones (key, n), and each spider's total."""
    fixed = runs.join(counts, key, "left").withColumn("articles", F.coalesce(F.nullif("articles", F.lit(0)), "n", F.lit(0)))
    return fixed.groupBy("spider").agg(F.sum("articles").alias("total"), F.count("*").alias("runs"))


def declared_names(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, name): the first `name = "..."` line of each file that has one; private and other files are left out."""
    name = F.regexp_extract(content, "(?m)^\\s+name\\s*=\\s*[\"']([a-z][a-z0-9_]+)", 1)
    return files.filter(F.col("file").endswith(".py") & ~F.col("file").startswith("_")).select("file", name.alias("name")).filter("name <> ''")


def typed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns cast where they can be, null where not."""
    return rows.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def valid_enum(column: Column, values: list[str]) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))
