"""Joins, windows, top-k, sampling, sets and catalogue lag on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.operators import relational, releases

from .fixtures import ACCEPTED, ANNOTATIONS, DOCUMENTS, GOLD, ctes, duck, table, view
from .registry import query

_N, _D, _ND, _A = (ctes(**v).rstrip() for v in ({"n": ANNOTATIONS}, {"d": DOCUMENTS}, {"n": ANNOTATIONS, "d": DOCUMENTS}, {"a": ACCEPTED}))


@query("j01_accepted_with_document", _A + " SELECT document_id, idx, item, source, published FROM a")
def accepted(spark, d) -> DataFrame:
    found, docs = view(spark, d, ANNOTATIONS).filter("v1 = 'accept'"), view(spark, d, DOCUMENTS)
    return found.join(docs, "document_id").select("document_id", "idx", "item", "source", "published")


@query("j01_array_lookup", _N + " SELECT v.document_id, v.idx, e.item FROM (SELECT document_id, idx + (document_id % 3)::INT AS idx FROM n WHERE v1 = 'accept') v JOIN n e ON v.document_id = e.document_id AND v.idx = e.idx")
def array_lookup(spark, d) -> DataFrame:
    """Verdicts look an element of the document's array up by place; places outside are left out."""
    rows = view(spark, d, ANNOTATIONS)
    arrays = rows.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda x: x["item"]).alias("items"))
    verdicts = rows.filter("v1 = 'accept'").select("document_id", (F.col("idx") + (F.col("document_id") % 3).cast("int")).alias("idx"))
    return verdicts.join(arrays, "document_id").select("document_id", "idx", F.get("items", F.col("idx")).alias("item")).filter("item IS NOT NULL")


@query("j02_items_of_accepted", _N + " SELECT item, count(*) AS n, count(DISTINCT document_id) AS documents FROM n WHERE v1 = 'accept' GROUP BY item")
def items_of_accepted(spark, d) -> DataFrame:
    return view(spark, d, ANNOTATIONS).filter("v1 = 'accept'").groupBy("item").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


@query("j03_verdicts_by_state", _ND + " SELECT d.state, n.v1, count(*) AS n FROM n JOIN d ON n.document_id = d.document_id GROUP BY 1, 2")
def verdicts_by_state(spark, d) -> DataFrame:
    return view(spark, d, ANNOTATIONS).join(view(spark, d, DOCUMENTS), "document_id").groupBy("state", "v1").agg(F.count("*").alias("n"))


@query("j04_gold_left_joins", ctes(g=GOLD).rstrip() + " , l AS (SELECT * FROM labels) SELECT g.stratum, count(*) AS n, count(l.quality) AS labelled, sum(l.toxic)::BIGINT AS toxic FROM g LEFT JOIN l ON g.document_id = l.doc_id LEFT JOIN documents x ON g.document_id = x.doc_id AND g.idx = 0 GROUP BY g.stratum")
def gold_left_joins(spark, d) -> DataFrame:
    gold, labels = view(spark, d, GOLD), table(spark, d, "labels").withColumnRenamed("doc_id", "document_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("idx"), "lang")
    return gold.join(labels, "document_id", "left").join(docs, ["document_id", "idx"], "left").groupBy("stratum").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum("toxic").alias("toxic"))


@query("j05_left_chain", _ND + " SELECT d.document_id, d.source, count(n.item) AS annotations, count(*) FILTER (WHERE n.v2 = 'accept') AS accepted FROM d LEFT JOIN n ON d.document_id = n.document_id GROUP BY 1, 2")
def left_chain(spark, d) -> DataFrame:
    return view(spark, d, DOCUMENTS).join(view(spark, d, ANNOTATIONS), "document_id", "left").groupBy("document_id", "source").agg(F.count("item").alias("annotations"), F.count_if(F.col("v2") == "accept").alias("accepted"))


@query("j06_documents_with_accept", _ND + " SELECT d.source, count(DISTINCT d.document_id) AS documents FROM d JOIN n ON d.document_id = n.document_id WHERE n.v2 = 'accept' GROUP BY 1")
def documents_with_accept(spark, d) -> DataFrame:
    hits = view(spark, d, ANNOTATIONS).filter("v2 = 'accept'").select("document_id")
    return view(spark, d, DOCUMENTS).join(hits, "document_id", "left_semi").groupBy("source").agg(F.count("*").alias("documents"))


@query("j07_migration_matrix", _N + " SELECT v1, v2, count(*) AS n FROM n WHERE confidence >= 0.75 GROUP BY v1, v2")
def migration_matrix(spark, d) -> DataFrame:
    return view(spark, d, ANNOTATIONS).filter("confidence >= 0.75").groupBy("v1", "v2").agg(F.count("*").alias("n"))


@query("j08_anti_unlabelled", "SELECT doc_id, source FROM documents x WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id)")
def anti_unlabelled(spark, d) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("j09_semi_labelled", "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id AND l.quality = 1) THEN 'good' ELSE 'open' END AS mode FROM documents x")
def semi_labelled(spark, d) -> DataFrame:
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("__g", F.lit(True))
    return table(spark, d, "documents").join(good, "doc_id", "left").select("doc_id", F.when(F.col("__g"), "good").otherwise("open").alias("mode"))


@query("j10_unjudged_elements", _N + ", j AS (SELECT document_id, idx FROM n WHERE quantity % 2 = 0) SELECT n.document_id, n.idx, n.item FROM n LEFT JOIN j ON n.document_id = j.document_id AND n.idx = j.idx WHERE j.idx IS NULL AND n.confidence = 0.75")
def unjudged_elements(spark, d) -> DataFrame:
    """Elements of each document's array that no rater has seen."""
    rows = view(spark, d, ANNOTATIONS)
    arrays = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("idx", "item", "confidence"))).alias("elements"))
    elements = arrays.select("document_id", F.posexplode("elements").alias("at", "e")).select("document_id", F.col("at").alias("idx"), "e.item", "e.confidence")
    judged = rows.filter("quantity % 2 = 0").select("document_id", "idx")
    return elements.filter("confidence = 0.75").join(judged, ["document_id", "idx"], "left_anti").select("document_id", "idx", "item")


@query("j11_scalar_subquery", _ND + " SELECT d.document_id, (SELECT n.item FROM n WHERE n.document_id = d.document_id ORDER BY n.idx DESC LIMIT 1) AS last_item FROM d WHERE d.state = 'completed'")
def scalar_subquery(spark, d) -> DataFrame:
    last = view(spark, d, ANNOTATIONS).groupBy("document_id").agg(F.max_by("item", "idx").alias("last_item"))
    return view(spark, d, DOCUMENTS).filter("state = 'completed'").select("document_id").join(last, "document_id", "left")


@query("j12_lookup_with_parent", "WITH p AS (SELECT p_partkey::VARCHAR || '.' || p_size::VARCHAR AS item FROM part), l AS (SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier UNION ALL SELECT p_partkey::VARCHAR || '.' || p_size::VARCHAR, p_name FROM part WHERE p_partkey % 7 = 0) SELECT item, coalesce(a.name, b.name, item) AS name FROM p LEFT JOIN l a ON a.id = item LEFT JOIN l b ON b.id = split_part(item, '.', 1)")
def lookup_with_parent(spark, d) -> DataFrame:
    part = table(spark, d, "part").withColumn("item", F.concat_ws(".", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")))
    lookup = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")).union(part.filter("p_partkey % 7 = 0").select("item", "p_name"))
    return relational.with_fallback(part.select("item"), lookup, F.col("item"), F.substring_index("item", ".", 1)).select("item", "name")


@query("j17_tool_matches", "SELECT doc_id, tool FROM documents, (VALUES ('idiot'), ('clown'), ('license'), ('thor')) t(tool) WHERE regexp_matches(text, '(?i)\\b' || tool || '\\b')")
def tool_matches(spark, d) -> DataFrame:
    """Words of a short list found in texts at word boundaries; the list is part of the plan."""
    tools = ["idiot", "clown", "license", "thor"]
    hit = F.array_compact(F.array(*[F.when(F.col("text").rlike(rf"(?i)\b{t}\b"), F.lit(t)) for t in tools]))
    return table(spark, d, "documents").select("doc_id", F.explode(hit).alias("tool"))


@query("j18_j19_distinct_gold_documents", ctes(g=GOLD).rstrip() + " SELECT DISTINCT g.document_id, x.source FROM g JOIN documents x ON g.document_id = x.doc_id WHERE g.human <> 'uncertain'")
def gold_documents(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("s"))
    return view(spark, d, GOLD).filter("human <> 'uncertain'").join(docs, "document_id").select("document_id", F.col("s").alias("source")).distinct()


@query("j20_latest_with_raters", _N + ", b AS (SELECT document_id, max(idx) AS idx FROM n GROUP BY document_id) SELECT n.document_id, n.idx, n.item, n.v1, CASE WHEN n.quantity % 5 > 0 THEN n.v2 END AS v2 FROM n JOIN b ON n.document_id = b.document_id AND n.idx = b.idx")
def latest_with_raters(spark, d) -> DataFrame:
    rows = view(spark, d, ANNOTATIONS)
    last = relational.latest_per_key(rows.select("document_id", "idx", "item", "v1"), "document_id", "idx")
    second = rows.filter("quantity % 5 > 0").select("document_id", "idx", "v2")
    return last.join(second, ["document_id", "idx"], "left").select("document_id", "idx", "item", "v1", "v2")


@query("j21_late_body", "SELECT l.doc_id, coalesce(nullif(CASE WHEN l.doc_id % 2 = 0 THEN '' ELSE 'own' END, ''), x.source, '-') AS body FROM labels l LEFT JOIN documents x ON x.doc_id = l.doc_id AND x.lang = 'en'")
def late_body(spark, d) -> DataFrame:
    own = F.when(F.col("doc_id") % 2 == 0, "").otherwise("own")
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "source")
    return table(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", F.coalesce(F.nullif(own, F.lit("")), "source", F.lit("-")).alias("body"))


_KEEP = ", k AS (SELECT *, row_number() OVER (PARTITION BY item, document_id % 50 ORDER BY quantity DESC NULLS LAST, document_id, idx) AS r, row_number() OVER (PARTITION BY item, document_id % 50 ORDER BY (v2 = 'accept')::INT DESC, quantity DESC, document_id DESC, idx DESC) AS s FROM n)"


@query("w01_keep_best", _N + _KEEP + " SELECT item, document_id, idx, quantity FROM k WHERE r = 1")
def keep_best(spark, d) -> DataFrame:
    rows = view(spark, d, ANNOTATIONS).withColumn("bucket", F.col("document_id") % 50)
    return relational.best_per_key(rows, ["item", "bucket"], F.col("quantity").desc_nulls_last(), F.col("document_id"), F.col("idx")).select("item", "document_id", "idx", "quantity")


@query("w02_keep_best_accepted", _N + _KEEP + " SELECT item, document_id, idx, quantity FROM k WHERE s = 1")
def keep_best_accepted(spark, d) -> DataFrame:
    rank = F.struct((F.col("v2") == "accept").cast("int").alias("a"), "quantity", "document_id", "idx")
    rows = view(spark, d, ANNOTATIONS).groupBy("item", (F.col("document_id") % 50).alias("b")).agg(F.max(rank).alias("m"))
    return rows.select("item", "m.document_id", "m.idx", "m.quantity")


@query("w07_allocation", "WITH p AS (SELECT source, count(*) AS n FROM documents GROUP BY source), w AS (SELECT *, least(round_even(384.0::DOUBLE * n / sum(n) OVER (), 0)::BIGINT, n) AS want FROM p) SELECT source, n, greatest(0, least(want, 384 - coalesce(sum(want) OVER (ORDER BY n DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS take FROM w")
def allocation(spark, d) -> DataFrame:
    return relational.allocate(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), 384, "source")


@query("l01_f12_page", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source ILIKE '%SRC1%' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 20")
def listing_page(spark, d) -> DataFrame:
    hits = table(spark, d, "documents").filter((F.col("lang") == "en") & F.col("source").ilike("%SRC1%"))
    return relational.page(hits, 2, 20, F.col("n_chars").desc_nulls_last(), F.col("doc_id")).select("doc_id", "source", "n_chars")


@query("l02_k06_poll", "SELECT event_id, event_type FROM events WHERE event_id > 9000 ORDER BY event_id LIMIT 200")
def poll(spark, d) -> DataFrame:
    return table(spark, d, "events").filter("event_id > 9000").orderBy("event_id").limit(200).select("event_id", "event_type")


@query("l04_next_open", "SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def next_open(spark, d) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").agg(F.min("doc_id").alias("doc_id"))


@query("l05_latest_event", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event(spark, d) -> DataFrame:
    return relational.latest_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("l07_l08_sample", "SELECT doc_id FROM documents ORDER BY md5('43:' || doc_id::VARCHAR), doc_id LIMIT 100")
def seeded_sample(spark, d) -> DataFrame:
    return relational.sample(table(spark, d, "documents"), "doc_id", 100).select("doc_id")


@query("u01_u02_sets", _N + ", one AS (SELECT DISTINCT document_id, item FROM n WHERE v1 = 'accept'), two AS (SELECT DISTINCT document_id, item FROM n WHERE v2 = 'accept') SELECT kind, count(*) AS n FROM (SELECT 'missed' AS kind FROM (SELECT * FROM one EXCEPT SELECT * FROM two) UNION ALL SELECT 'either' FROM (SELECT * FROM one UNION SELECT * FROM two) UNION ALL SELECT 'shared' FROM (SELECT * FROM one INTERSECT SELECT * FROM two)) GROUP BY kind")
def sets(spark, d) -> DataFrame:
    rows = view(spark, d, ANNOTATIONS)
    one, two = (rows.filter(f"{v} = 'accept'").select("document_id", "item").distinct() for v in ("v1", "v2"))
    parts = {"missed": one.subtract(two), "either": one.union(two).distinct(), "shared": one.intersect(two)}
    first, *rest = [df.select(F.lit(k).alias("kind")) for k, df in parts.items()]
    return first.union(rest[0]).union(rest[1]).groupBy("kind").agg(F.count("*").alias("n"))


@query("u05_common_items", _N + " SELECT document_id, array_to_string(list_sort(list_distinct(list_filter(list(item), lambda x: x IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#23', 'Brand#5')))), ',') AS items FROM n GROUP BY document_id")
def common_items(spark, d) -> DataFrame:
    """The items of each document that a list has too."""
    wanted = F.array(*map(F.lit, ("Brand#1", "Brand#11", "Brand#12", "Brand#23", "Brand#5")))
    items = view(spark, d, ANNOTATIONS).groupBy("document_id").agg(F.collect_set("item").alias("items"))
    return items.select("document_id", F.array_join(F.array_sort(F.array_intersect("items", wanted)), ",").alias("items"))


@query("u07_joint_vocabulary", "SELECT term FROM (SELECT lower(p_brand) AS term FROM part UNION SELECT lower(p_type) FROM part UNION SELECT lower(n_name) FROM nation)")
def joint_vocabulary(spark, d) -> DataFrame:
    """Terms of three vocabularies, each once."""
    parts, nations = table(spark, d, "part"), table(spark, d, "nation")
    terms = parts.select(F.lower("p_brand").alias("term")).union(parts.select(F.lower("p_type"))).union(nations.select(F.lower("n_name")))
    return terms.distinct()


@query("u08_distinct_values", "WITH d AS (" + duck(DOCUMENTS) + ") SELECT DISTINCT year, source FROM d")
def distinct_values(spark, d) -> DataFrame:
    """The years and sources that occur together."""
    return view(spark, d, DOCUMENTS).select("year", "source").distinct()


@query("s11_insert_ignore", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def insert_ignore(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id")
    first = relational.best_per_key(docs.filter("source < 'src5'"), "source", F.col("doc_id"))
    return relational.insert_ignore(first, docs, ["source"], F.col("doc_id"))


@query("s12_upsert", "SELECT source, CASE WHEN source >= 'src3' THEN max(doc_id) ELSE min(doc_id) END AS doc_id FROM documents GROUP BY source")
def upsert(spark, d) -> DataFrame:
    """Old rows of some sources, new ones of others; some sources have both."""
    docs = table(spark, d, "documents").select("source", "doc_id")
    old = relational.best_per_key(docs.filter("source < 'src6'"), "source", F.col("doc_id"))
    return relational.upsert(old, docs.filter("source >= 'src3'"), ["source"], F.col("doc_id").desc())


@query("s13_cascade_delete", "SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 4)")
def cascade_delete(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return relational.cascade_delete(turns, turns.filter("turn >= 4").select("conv_id").distinct(), "conv_id")


@query("a26_corpus_statistics", _ND + " SELECT d.source, d.state, d.year, count(*) AS documents, max(d.published) AS last_published, sum((EXISTS (SELECT 1 FROM n WHERE n.document_id = d.document_id AND n.v2 = 'accept'))::INT)::BIGINT AS with_accept FROM d GROUP BY 1, 2, 3")
def corpus_statistics(spark, d) -> DataFrame:
    hits = view(spark, d, ANNOTATIONS).groupBy("document_id").agg(F.max((F.col("v2") == "accept").cast("int")).alias("hit"))
    return view(spark, d, DOCUMENTS).join(hits, "document_id", "left").groupBy("source", "state", "year").agg(F.count("*").alias("documents"), F.max("published").alias("last_published"), F.sum(F.coalesce("hit", F.lit(0))).alias("with_accept"))


# A literal table of releases stands for the catalogue's; an item enters at a release that its name gives.
_RELEASES = [(k, f"{1994 + k}-0{1 + k % 9}-15") for k in range(1, 8)]
_ENTRIES = ctes(n=ANNOTATIONS).rstrip() + ", rel(version, released) AS (VALUES " + ", ".join(str(r) for r in _RELEASES) + "), it AS (SELECT DISTINCT item, split_part(item, '#', 2)::INT AS k FROM n), en AS (SELECT item, version, released, item || ' v' || version AS name, (1994 + k % 7)::VARCHAR || '-03-01' AS created, (k % 5 = 0 AND version < 4) AS revoked FROM it, rel WHERE version > k % 6)"
_INDEX = ", ix AS (SELECT item, min(version) AS first_version, min(released) AS first_released, min(version) FILTER (WHERE NOT revoked) AS live_version, min(released) FILTER (WHERE NOT revoked) AS live_released, arg_max(name, version) AS name, arg_max(created, version) AS created, arg_max(revoked, version) AS revoked FROM en GROUP BY item)"
_SEEN = ", a AS (" + ACCEPTED.replace("{", "").replace("}", "") + "), sn AS (SELECT item, min(published) AS first_seen, arg_min(document_id, (published, document_id, source)) AS first_document, arg_min(source, (published, document_id, source)) AS first_source, quantile_disc(published::DATE, 0.5)::VARCHAR AS median_seen, count(*) AS n, count(DISTINCT document_id) AS documents, count(DISTINCT source) AS sources FROM a GROUP BY item)"
_LAGS = ", lg AS (SELECT *, " + ", ".join(f"date_diff('day', {b}::DATE, {s}_seen::DATE) AS lag_{s}_{n}" for s in ("first", "median") for n, b in (("release", "first_released"), ("live", "coalesce(live_released, first_released)"), ("created", "created"))) + ", first_released > '1997-01-01' AS is_post_start FROM sn LEFT JOIN ix USING (item))"


def _entries(spark, d) -> DataFrame:
    released = spark.createDataFrame(_RELEASES, "version int, released string")
    items = view(spark, d, ANNOTATIONS).select("item").distinct().withColumn("k", F.split_part("item", F.lit("#"), F.lit(2)).cast("int"))
    joined = items.join(F.broadcast(released), F.col("version") > F.col("k") % 6)  # a literal table of a few releases
    return joined.select("item", "version", "released", F.concat("item", F.lit(" v"), F.col("version").cast("string")).alias("name"), F.concat((1994 + F.col("k") % 7).cast("string"), F.lit("-03-01")).alias("created"), ((F.col("k") % 5 == 0) & (F.col("version") < 4)).alias("revoked"))


@query("a18_s07_catalogue_index", _ENTRIES + _INDEX + " SELECT * FROM ix")
def catalogue_index(spark, d) -> DataFrame:
    return releases.catalogue_index(_entries(spark, d))


@query("a19_a20_first_seen", _ENTRIES + _SEEN + " SELECT * FROM sn")
def first_seen(spark, d) -> DataFrame:
    return releases.first_seen(view(spark, d, ACCEPTED))


def _lags(spark, d) -> DataFrame:
    return releases.lags(releases.first_seen(view(spark, d, ACCEPTED)), releases.catalogue_index(_entries(spark, d)), "1997-01-01")


_LAG_COLUMNS = [f"lag_{s}_{n}" for s in ("first", "median") for n in ("release", "live", "created")]


@query("a21_j13_lags", _ENTRIES + _INDEX + _SEEN + _LAGS + f" SELECT item, {', '.join(_LAG_COLUMNS)}, is_post_start, revoked FROM lg")
def lags(spark, d) -> DataFrame:
    return _lags(spark, d).select("item", *_LAG_COLUMNS, "is_post_start", "revoked")


@query("a22_a25_lag_subsets", _ENTRIES + _INDEX + _SEEN + _LAGS + " SELECT item, (lag_first_live > 0) AS positive, (lag_first_live > 0 AND n >= 3) AS robust, (lag_first_live > 0 AND sources >= 2) AS multi_source, (lag_first_live > 0 AND lag_median_live > 0 AND n >= 3 AND sources >= 2) AS strict, first_version IS NULL AS not_catalogued, (lag_first_live > 0 AND lag_median_live < 0) AS outlier FROM lg")
def lag_subsets(spark, d) -> DataFrame:
    first, median = F.col("lag_first_live"), F.col("lag_median_live")
    return _lags(spark, d).select(
        "item", (first > 0).alias("positive"), ((first > 0) & (F.col("n") >= 3)).alias("robust"), ((first > 0) & (F.col("sources") >= 2)).alias("multi_source"),
        ((first > 0) & (median > 0) & (F.col("n") >= 3) & (F.col("sources") >= 2)).alias("strict"), F.col("first_version").isNull().alias("not_catalogued"), ((first > 0) & (median < 0)).alias("outlier"),
    )


@query("a23_lag_summary", _ENTRIES + _INDEX + _SEEN + _LAGS + ", v AS (SELECT list_sort(list(lag_first_live)) AS v, count(*) FILTER (WHERE lag_first_live > 0) AS positive FROM lg WHERE lag_first_live IS NOT NULL) SELECT len(v)::BIGINT AS n, v[1] AS min, v[least(len(v), floor(0.1 * len(v)) + 1)::INT] AS p10, v[least(len(v), floor(0.5 * len(v)) + 1)::INT] AS p50, v[least(len(v), floor(0.9 * len(v)) + 1)::INT] AS p90, v[len(v)] AS max, positive FROM v")
def lag_summary(spark, d) -> DataFrame:
    return releases.lag_summary(_lags(spark, d), "lag_first_live")


@query("a24_lag_histogram", _ENTRIES + _INDEX + _SEEN + _LAGS + " SELECT b.bin::INT AS bin, (b.bin * 200 - 2000)::INT AS low, count(lg.item) AS n FROM range(20) b(bin) LEFT JOIN lg ON lag_median_release >= -2000 AND lag_median_release < 2000 AND floor((lag_median_release + 2000) / 200.0) = b.bin GROUP BY b.bin")
def lag_histogram(spark, d) -> DataFrame:
    return releases.histogram(_lags(spark, d), "lag_median_release", -2000, 200, 20)
