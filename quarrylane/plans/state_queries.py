"""JSON annotations, work queue, event log and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.operators import annotations, state
from quarrylane.streaming import rollups

from .fixtures import ANNOTATIONS, GOLD, ctes, table, view
from .registry import query

_N, _G = ctes(n=ANNOTATIONS).rstrip(), ctes(g=GOLD).rstrip()


def _json_rows(spark, d) -> DataFrame:
    """A JSON array for each document: keys missing, null, or elements that are no objects, and some texts broken."""
    rows = view(spark, d, ANNOTATIONS)
    q = F.col("quantity").cast("int")
    parts = [F.concat(F.lit('"item":"'), "item", F.lit('"')), F.concat(F.lit('"category":'), F.when(q % 11 == 0, "null").otherwise(F.concat(F.lit('"'), "category", F.lit('"')))), F.when(q % 7 != 0, F.lit('"quote":"x"')), F.when(q % 5 != 0, F.concat(F.lit('"name":"'), "label_text", F.lit('"'))), F.when(q % 13 != 0, F.lit('"confidence":1.0'))]
    element = F.when(q == 3, F.lit("17")).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    arrays = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("idx", element.alias("e")))).alias("a"))
    text = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["e"]), ","), F.lit("]"))
    kind = F.col("document_id") % 40
    broken = F.when(kind == 0, F.lit("[{")).when(kind == 1, F.lit("null")).when(kind == 2, F.lit('{"item": 1}')).when(kind == 3, F.lit("")).when(kind == 4, F.lit(None).cast("string")).otherwise(text)
    return arrays.select("document_id", F.concat(F.lit("m"), (F.col("document_id") % 3).cast("string")).alias("model"), broken.alias("annotations"))


_JSON = _N + """, e AS (SELECT document_id, quantity::INT AS q, quantity::INT = 3 AS odd FROM n), k AS (SELECT document_id, 'm' || (document_id % 3) AS model, (document_id % 40)::INT AS kind,
 count(*) FILTER (WHERE NOT odd) AS objects, count(*) AS everything, count(*) FILTER (WHERE NOT odd AND q % 7 <> 0) AS core, count(*) FILTER (WHERE NOT odd AND q % 7 <> 0 AND q % 5 <> 0 AND q % 13 <> 0) AS strict FROM e GROUP BY document_id),
r AS (SELECT document_id, model, kind > 2 AS parseable, (CASE WHEN kind > 4 THEN objects ELSE 0 END)::INT AS n_elements, (CASE WHEN kind > 4 THEN core ELSE 0 END)::INT AS core_ok, (CASE WHEN kind > 4 THEN strict ELSE 0 END)::INT AS strict_ok,
 kind > 2 AND (kind < 5 OR (objects = everything AND core = objects)) AS row_core_ok, kind > 2 AND (kind < 5 OR (objects = everything AND strict = objects)) AS row_strict_ok FROM k)"""


@query("a17_adherence_rows", _JSON + " SELECT * FROM r")
def adherence_rows(spark, d) -> DataFrame:
    return annotations.adherence_rows(_json_rows(spark, d), "document_id", "annotations").drop("annotations", "__keys")


@query("a17_adherence_summary", _JSON + ", s AS (SELECT unnest([('parseable', count(*) FILTER (WHERE parseable), count(*)), ('rows_core', count(*) FILTER (WHERE row_core_ok), count(*)), ('rows_strict', count(*) FILTER (WHERE row_strict_ok), count(*)), ('elements_core', sum(core_ok)::BIGINT, sum(n_elements)::BIGINT), ('elements_strict', sum(strict_ok)::BIGINT, sum(n_elements)::BIGINT)]) AS x FROM r) SELECT x[1] AS metric, x[2] AS numerator, x[3] AS denominator, round(100.0 * x[2]::DOUBLE / x[3], 2) AS percent FROM s")
def adherence_summary(spark, d) -> DataFrame:
    return annotations.adherence_summary(annotations.adherence_rows(_json_rows(spark, d), "document_id", "annotations"))


@query("a17_adherence_by_model", _JSON + " SELECT model, count(*) AS n, count(*) FILTER (WHERE parseable) AS parseable, count(*) FILTER (WHERE row_core_ok) AS row_core, count(*) FILTER (WHERE row_strict_ok) AS row_strict, sum(n_elements)::BIGINT AS elements FROM r GROUP BY model")
def adherence_by_model(spark, d) -> DataFrame:
    found = annotations.adherence_rows(_json_rows(spark, d), "document_id", "annotations")
    return found.groupBy("model").agg(F.count("*").alias("n"), F.count_if("parseable").alias("parseable"), F.count_if("row_core_ok").alias("row_core"), F.count_if("row_strict_ok").alias("row_strict"), F.sum("n_elements").alias("elements"))


@query("a17_u06_missing_keys", _N + ", e AS (SELECT quantity::INT AS q FROM n WHERE document_id % 40 > 4 AND quantity <> 3) SELECT unnest(['item', 'category', 'quote', 'name', 'confidence']) AS field, unnest([0, 0, count(*) FILTER (WHERE q % 7 = 0), count(*) FILTER (WHERE q % 5 = 0), count(*) FILTER (WHERE q % 13 = 0)]) AS n FROM e")
def missing_keys(spark, d) -> DataFrame:
    return annotations.missing_keys(annotations.adherence_rows(_json_rows(spark, d), "document_id", "annotations"))


@query("a30_exploration", _N + ", k AS (SELECT document_id, count(*) AS n FROM n GROUP BY document_id) SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 6 THEN '4-6' WHEN n <= 10 THEN '7-10' WHEN n <= 15 THEN '11-15' ELSE '16+' END AS bucket, count(*) AS documents, sum(n)::BIGINT AS annotations, round(avg(n), 9) AS mean FROM k GROUP BY 1")
def exploration(spark, d) -> DataFrame:
    n = F.col("n")
    bucket = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 6, "4-6").when(n <= 10, "7-10").when(n <= 15, "11-15").otherwise("16+")
    return view(spark, d, ANNOTATIONS).groupBy("document_id").agg(F.count("*").alias("n")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("documents"), F.sum("n").alias("annotations"), F.round(F.avg("n"), 9).alias("mean"))


_MADE = _G + ", m AS (SELECT DISTINCT 'm' || (idx % 2) AS model, document_id, item FROM g WHERE v1 <> 'reject'), a AS (SELECT DISTINCT document_id, item FROM g WHERE human = 'accept'), r AS (SELECT DISTINCT document_id, item FROM g WHERE human = 'reject'), h AS (SELECT m.model, count(*) FILTER (WHERE a.item IS NOT NULL) AS tp, count(*) FILTER (WHERE a.item IS NULL AND r.item IS NOT NULL) AS fp, count(*) FILTER (WHERE a.item IS NULL AND r.item IS NULL) AS unknown FROM m LEFT JOIN a USING (document_id, item) LEFT JOIN r USING (document_id, item) GROUP BY 1), f AS (SELECT d.model, count(*) AS fn FROM (SELECT DISTINCT model, document_id FROM m) d JOIN a USING (document_id) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.model = d.model AND m.document_id = a.document_id AND m.item = a.item) GROUP BY 1)"


@query("a31_a32_set_scores", _MADE + " SELECT model, tp, fp, coalesce(fn, 0) AS fn, unknown, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + coalesce(fn, 0), 0), 9) AS recall, round(2.0 * tp::DOUBLE / nullif(2 * tp + fp + coalesce(fn, 0), 0), 9) AS f1 FROM h LEFT JOIN f USING (model)")
def set_scores(spark, d) -> DataFrame:
    gold = view(spark, d, GOLD)
    made = gold.filter("v1 <> 'reject'").select(F.concat(F.lit("m"), (F.col("idx") % 2).cast("string")).alias("model"), "document_id", "item")
    return annotations.set_scores(made, gold.filter("human = 'accept'"), gold.filter("human = 'reject'"))


@query("a33_response_checks", "SELECT event_id, event_id % 4 <> 3 AS parses, event_id % 4 IN (0, 1) AS item_ok, event_id % 4 = 0 AS category_ok FROM events")
def response_checks(spark, d) -> DataFrame:
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.lit('```json\n{"item": "T1059.001", "category": "TA0002"}\n```')).when(kind == 1, F.lit('{"item": "T1059", "category": "execution"}')).when(kind == 2, F.lit('{"item": 7}')).otherwise(F.lit("```{item}```"))
    return table(spark, d, "events").select("event_id", annotations.response_checks(raw).alias("c")).select("event_id", "c.*")


@query("v04_validation", _N + ", c AS (SELECT p_brand AS id, list_sort(list(DISTINCT p_type)) AS cats FROM part WHERE p_brand <> 'Brand#3' AND p_type <> 'PROMO' GROUP BY p_brand), x AS (SELECT n.*, c.cats, CASE WHEN idx % 4 = 0 THEN item || '.001' WHEN idx % 4 = 1 THEN 'Other.002' END AS sub FROM n LEFT JOIN c ON n.item = c.id), y AS (SELECT *, row_number() OVER (PARTITION BY document_id, item, sub ORDER BY idx) AS r FROM x) SELECT document_id, idx, (cats IS NULL)::INT + (cats IS NOT NULL AND NOT list_contains(cats, category))::INT + (quantity % 6 = 0)::INT + (idx % 4 = 1)::INT + (r > 1)::INT AS n_issues, CASE WHEN cats IS NOT NULL AND NOT list_contains(cats, category) THEN cats[1] ELSE category END AS category FROM y")
def validation(spark, d) -> DataFrame:
    rows = view(spark, d, ANNOTATIONS)
    catalogue = table(spark, d, "part").filter("p_brand <> 'Brand#3' AND p_type <> 'PROMO'").groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_set("p_type")).alias("categories"), F.min("p_name").alias("name"))
    sub = F.when(F.col("idx") % 4 == 0, F.concat("item", F.lit(".001"))).when(F.col("idx") % 4 == 1, F.lit("Other.002"))
    quote = F.when(F.col("quantity") % 6 == 0, "entirely missing words").when(F.col("quantity") % 6 == 1, "About LABELS, quite broadly").otherwise(F.upper("label_text"))
    elements = rows.withColumns({"sub": sub, "quote": quote, "body": F.concat(F.lit("quite broadly about labels: "), "label_text")})
    return annotations.validate(elements, catalogue).select("document_id", "idx", F.size("issues").alias("n_issues"), "category")


@query("v05_verdict_parsing", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'accept' ELSE 'uncertain' END AS verdict, event_id % 5 > 2 AS parse_failure FROM events")
def verdict_parsing(spark, d) -> DataFrame:
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, F.lit('{"verdict": "ACCEPT"}')).when(kind == 1, F.lit('I think {"verdict": "reject", "why": "x"} fits')).when(kind == 2, F.lit('{"verdict":"accept","reasoning":"{}"}')).when(kind == 3, F.lit('{"verdict": "maybe"}')).otherwise(F.lit(""))
    return table(spark, d, "events").select("event_id", annotations.parse_verdict(raw).alias("v")).select("event_id", "v.*")


@query("v06_outcomes", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'failed' WHEN event_id % 6 = 1 THEN 'filtered' WHEN event_id % 6 = 2 THEN 'failed' WHEN event_id % 6 = 3 THEN 'retry' ELSE 'completed' END AS outcome FROM events")
def outcomes(spark, d) -> DataFrame:
    kind = F.col("event_id") % 6
    made = annotations.outcome(F.when(kind != 0, F.lit("text")), F.when(kind == 1, F.lit("short")), F.when(kind == 2, 3).otherwise(1), F.when(kind.isin(2, 3), F.lit("timeout")))
    return table(spark, d, "events").select("event_id", made.alias("outcome"))


_NOW = "2024-01-20 00:00:00"
_QUEUE = "WITH q AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state, CASE WHEN event_type = 'click' THEN ts + INTERVAL 10 DAY END AS locked_at FROM events), f AS (SELECT id, CASE WHEN state = 'processing' AND locked_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 HOUR THEN 'pending' ELSE state END AS state FROM q), t AS (SELECT id FROM f WHERE state = 'pending' ORDER BY id LIMIT 150)"


def _queue(spark, d) -> DataFrame:
    kind = F.col("event_type")
    states = F.when(kind == "click", "processing").when(kind == "view", "completed").when(kind == "error", "failed").otherwise("pending")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), states.alias("state"), F.when(kind == "click", F.col("ts") + F.expr("INTERVAL 10 DAY")).alias("locked_at"))


@query("k01_acquire", _QUEUE + " SELECT f.id, CASE WHEN t.id IS NOT NULL THEN 'processing' ELSE state END AS state FROM f LEFT JOIN t USING (id)")
def acquire(spark, d) -> DataFrame:
    return state.acquire(_queue(spark, d), F.lit(_NOW).cast("timestamp_ntz"), 150).select("id", "state")


@query("k02_commit", _QUEUE + ", r AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' WHEN id % 3 = 1 THEN 'completed' ELSE 'filtered' END AS outcome FROM q WHERE id % 2 = 0) SELECT q.id, CASE WHEN q.state = 'processing' AND r.outcome IS NOT NULL THEN r.outcome ELSE q.state END AS state, coalesce(q.state = 'processing' AND r.outcome IN ('failed', 'completed'), false) AS inserted FROM q LEFT JOIN r USING (id)")
def commit(spark, d) -> DataFrame:
    queue = _queue(spark, d)
    of = lambda k: F.when(k % 3 == 0, "failed").when(k % 3 == 1, "completed").otherwise("filtered")
    results = queue.filter("id % 2 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).withColumn("outcome", F.when(F.col("seq") == 1, of(F.col("id"))).otherwise("late"))
    updated, inserted = state.commit(queue, results)
    return updated.join(inserted.select("id", F.lit(True).alias("i")), "id", "left").select("id", "state", F.coalesce("i", F.lit(False)).alias("inserted"))


@query("k03_open_for_rater", _N + " SELECT document_id, idx FROM n WHERE confidence = 0.75 AND NOT (quantity % 2 = 0) ORDER BY document_id, idx LIMIT 100")
def open_for_rater(spark, d) -> DataFrame:
    rows = view(spark, d, ANNOTATIONS)
    judged = rows.filter("quantity % 2 = 0").select("document_id", "idx")
    return rows.filter("confidence = 0.75").join(judged, ["document_id", "idx"], "left_anti").orderBy("document_id", "idx").limit(100).select("document_id", "idx")


_LOG = "WITH l AS (SELECT event_id, user_id * 40 + event_id % 40 AS job, CASE event_type WHEN 'purchase' THEN 'end' WHEN 'signup' THEN 'start' ELSE 'step' END AS kind, CASE WHEN value < 10 THEN 'completed' WHEN value < 20 THEN 'failed' ELSE 'strange' END AS s FROM events)"


def _log(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "signup", "start").otherwise("step")
    s = F.when(F.col("value") < 10, "completed").when(F.col("value") < 20, "failed").otherwise("strange")
    return table(spark, d, "events").select("event_id", (F.col("user_id") * 40 + F.col("event_id") % 40).alias("job_id"), kind.alias("event_type"), s.alias("state"))


@query("k04_k09_job_status", _LOG + ", e AS (SELECT job, min(event_id) FILTER (WHERE kind = 'end') AS o, arg_min(s, event_id) FILTER (WHERE kind = 'end') AS s, count(*) AS events, count(*) FILTER (WHERE kind = 'start') AS starts FROM l GROUP BY job) SELECT e.job, CASE WHEN o IS NOT NULL THEN CASE WHEN e.s = 'strange' THEN 'completed' ELSE e.s END WHEN starts > 0 THEN 'running' ELSE 'queued' END AS status, events, (SELECT count(*) FROM l WHERE l.job = e.job AND l.event_id > e.o) AS late FROM e")
def job_status(spark, d) -> DataFrame:
    return state.job_status(_log(spark, d))


@query("k05_liveness", "SELECT user_id AS host, max(ts) AS last_seen, max(ts) >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 15 MINUTE AS online FROM events GROUP BY user_id")
def liveness(spark, d) -> DataFrame:
    return state.liveness(table(spark, d, "events"), "user_id", "ts", F.lit("2024-01-30 23:00:00").cast("timestamp_ntz"), "15 minutes")


@query("k07_job_detail", _LOG + " SELECT job, string_agg(kind, '>' ORDER BY event_id) AS events FROM l GROUP BY job")
def job_detail(spark, d) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return _log(spark, d).groupBy(F.col("job_id").alias("job")).agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ">").alias("events"))


@query("k08_write_once_labels", "SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events WHERE event_type <> 'error' GROUP BY user_id")
def write_once_labels(spark, d) -> DataFrame:
    return state.first_labels(table(spark, d, "events").withColumn("event_type", F.nullif("event_type", F.lit("error"))), "user_id", "event_type", "event_id")


@query("k09_stream_deduplicated", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_deduplicated(spark, d) -> DataFrame:
    """Events read as a stream twice over; repeats within the watermark are dropped."""
    return rollups.run_once(rollups.deduplicated(rollups.events_stream(spark, d, twice=True)).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("k10_stream_hourly", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)")
def stream_hourly(spark, d) -> DataFrame:
    """A tumbling rollup over the event stream, beyond the batch views: windows that the watermark, an hour behind the last event, has passed."""
    return rollups.run_once(rollups.hourly(rollups.events_stream(spark, d)), "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("k04_stream_job_status", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' WHEN bool_or(event_type = 'signup') THEN 'running' ELSE 'queued' END AS status, count(*) AS events FROM events GROUP BY user_id")
def stream_job_status(spark, d) -> DataFrame:
    """Job states kept by a stateful operator, the last of each user; an end event is final."""
    states = rollups.run_once(rollups.job_states(rollups.events_stream(spark, d)), "update")
    return states.groupBy("user_id").agg(F.max(F.struct("events", "status")).alias("last")).select("user_id", "last.status", "last.events")


@query("k10_stream_sessions", "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 90 MINUTE <= (SELECT max(ts) FROM events)")
def stream_sessions(spark, d) -> DataFrame:
    """Runs of a user's events, beyond the batch views: those that the watermark has passed."""
    return rollups.run_once(rollups.sessions(rollups.events_stream(spark, d)), "append").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
