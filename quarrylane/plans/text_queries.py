"""Text, screening, near-duplicate and similarity queries on documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import text as T
from quarrylane.operators import screen

from .fixtures import table
from .registry import query

_TERMS = ["idiot", "clown", "scum", "license", "thor", "reserved", "nation"]
_TOOLS = ["apache", "moron", "trash"]


@query("t01_clean_text", "SELECT page_id, length(c) AS n, md5(c) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s{3,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS c FROM pages)")
def clean_text(spark, d) -> DataFrame:
    cleaned = table(spark, d, "pages").select("page_id", T.clean_text(F.col("html")).alias("c"))
    return cleaned.select("page_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


@query("t03_body_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def body_digest(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


_DAY = "strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')"
_TEN = "strftime(o_orderdate, '%Y-%m-%dT10:05:00Z')"


@query("t02_normalise_date", f"SELECT o_orderkey, {_DAY} AS one, {_DAY} AS two, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS three, {_DAY} AS four, NULL::VARCHAR AS five, {_DAY} AS six, {_DAY} AS seven, {_DAY} AS eight, {_TEN} AS nine, {_TEN} AS ten FROM orders")
def normalise_date(spark, d) -> DataFrame:
    day = F.to_date("o_orderdate")
    forms = {"one": F.date_format(day, "yyyy-MM-dd"), "two": F.date_format(day, "MMMM d, yyyy"), "three": F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00+02:00")), "four": F.date_format(day, "EEE, d MMM yyyy 00:00:00 +0000"), "five": F.lit("no date")}
    forms |= {"six": F.date_format(day, "MM/dd/yyyy"), "seven": F.date_format(day, "d MMM yyyy"), "eight": F.date_format(day, "yyyy/MM/dd"), "nine": F.date_format(day, "yyyy-MM-dd 10:05"), "ten": F.date_format(day, "MMM d yyyy '10:05AM'")}
    return table(spark, d, "orders").select("o_orderkey", *[T.normalise_date(v).alias(k) for k, v in forms.items()])


@query("t06_canonical_url", "SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS url FROM pages")
def canonical_url(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("t07_url_predicates", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) LIKE '/en/%' AS english, len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')) AS segments FROM pages")
def url_predicates(spark, d) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", T.url_host(url).alias("host"), T.url_path(url).startswith("/en/").alias("english"), T.path_segments(url).alias("segments"))


_JOINED = "CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || h ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END"


@query("t08_links", "WITH h AS (SELECT page_id, url, list_transform(regexp_extract_all(html || '<a class=x href=''/one/two''>t</a><A HREF=three.html>t</A><a href=\"\">t</a>', '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1), lambda h: trim(regexp_replace(h, '^[\"'']|[\"'']$', '', 'g'))) AS h FROM pages) SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(h, lambda h: h <> ''), lambda h: " + _JOINED + "))), ' ') AS links FROM h")
def links(spark, d) -> DataFrame:
    """Links of pages that also get a relative, an unquoted and an empty one."""
    html = F.concat("html", F.lit("<a class=x href='/one/two'>t</a><A HREF=three.html>t</A><a href=\"\">t</a>"))
    return table(spark, d, "pages").select("page_id", F.array_join(T.links(html, F.col("url")), " ").alias("links"))


@query("t10_headline", "SELECT page_id, coalesce(" + ", ".join(f"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '{p}', 1), '<[^>]+>', ' ', 'g'), '\\s{{3,}}', ' ', 'g')), '')" for p in ("(?s)<h1[^>]*>(.*?)</h1>", '<meta property="og:title" content="([^"]*)"', "(?s)<title>(.*?)</title>")) + ") AS headline FROM pages")
def headline(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.headline(F.col("html")).alias("headline"))


@query("t09_published_date", "SELECT page_id, make_date((2000 + page_id % 20)::BIGINT, 3, (1 + page_id % 28)::BIGINT)::VARCHAR AS published FROM pages")
def published_date(spark, d) -> DataFrame:
    """Pages have no dates; each third gets one in a tag, in its url, or in its text."""
    day = F.make_date((2000 + F.col("page_id") % 20).cast("int"), F.lit(3), (1 + F.col("page_id") % 28).cast("int"))
    kind = F.col("page_id") % 3
    html = F.when(kind == 0, F.concat(F.lit('<time class="x" datetime="'), day.cast("string"), F.lit('T10:00:00Z">'), "html")).when(kind == 1, F.concat("html", F.lit(" March "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"))).otherwise(F.col("html"))
    url = F.when(kind == 2, F.concat(F.lit("https://x.example.org/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/a"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.published_date(html, url).alias("published"))


def _sql_text(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def _sql_page(x: str) -> str:
    for t in ("script", "style", "nav", "header", "footer", "aside"):
        x = f"regexp_replace({x}, '(?is)<{t}\\b[^>]*>.*?</{t}>', ' ', 'g')"
    return _sql_text(x)


_PARTS = ", ".join(_sql_page(f"regexp_extract(html, '(?is)<{t}\\b[^>]*>(.*)</{t}>', 1)") + f" AS {t}_part" for t in ("article", "main"))
_AFTER = _sql_text("array_to_string(regexp_extract_all(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*)$', 1), '(?is)<p\\b[^>]*>(.*?)</p>', 1), ' ')")


@query("t11_main_text", f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, CASE WHEN length(article_part) > 200 THEN article_part WHEN length(main_part) > 200 THEN main_part WHEN after <> '' THEN after ELSE whole END AS t FROM (SELECT page_id, {_PARTS}, {_AFTER} AS after, {_sql_page('html')} AS whole FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN regexp_replace(html, '</?(article|main)\\b[^>]*>', '', 'g') ELSE regexp_replace(html, '</?(article|main|h1)\\b[^>]*>', '', 'g') END AS html FROM pages)))")
def main_text(spark, d) -> DataFrame:
    """Pages of which a third lacks its article part, and a third its headline too."""
    bare = lambda tags: F.regexp_replace("html", f"</?({tags})\\b[^>]*>", "")
    kind = F.col("page_id") % 3
    html = F.when(kind == 0, F.col("html")).when(kind == 1, bare("article|main")).otherwise(bare("article|main|h1"))
    return table(spark, d, "pages").select("page_id", T.main_text(html).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("t12_keyword_and_cutoff", "SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderdate >= TIMESTAMP '1999-01-29'")
def keyword_and_cutoff(spark, d) -> DataFrame:
    return table(spark, d, "orders").filter(F.contains(F.lower("o_orderpriority"), F.lit("high")) & (F.col("o_orderdate") >= F.lit("1999-01-29").cast("timestamp_ntz"))).select("o_orderkey")


@query("t13_early_stop", "SELECT user_id, page FROM (SELECT user_id, event_id // 500 AS page, min(ts) AS oldest FROM events GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, event_id // 500 AS page, min(ts) AS oldest FROM events GROUP BY 1, 2) y WHERE y.user_id = x.user_id AND y.page > x.page AND y.oldest < TIMESTAMP '2024-01-10')")
def early_stop(spark, d) -> DataFrame:
    """Pages of each feed, newest first, up to the first whose oldest entry is before the cutoff."""
    pages = table(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 500).alias("page")).agg(F.min("ts").alias("oldest"))
    newer = Window.partitionBy("user_id").orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("stopped", F.max((F.col("oldest") < F.lit("2024-01-10").cast("timestamp_ntz")).cast("int")).over(newer)).filter("coalesce(stopped, 0) = 0").select("user_id", "page")


@query("t14_word_count", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n FROM documents")
def word_count(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n"))


@query("t15_chunks", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(1, ceil(len(w) / 187.0)::INT))) AS k FROM w) SELECT doc_id, k::INT AS chunk, md5(array_to_string(w[k * 187 + 1 : (k + 1) * 187], ' ')) AS digest FROM c")
def chunks(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "c")).select("doc_id", "chunk", F.md5("c").alias("digest"))


_SENTENCES = "list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 30 AND NOT starts_with(s, 'Title:'))"
_BULLETS = "list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: starts_with(l, '- ') AND length(l) > 20), lambda b: substr(b, 3))"


@query("t16_behaviour_queries", f"WITH q AS (SELECT conv_id, turn, {_SENTENCES} || {_BULLETS} AS q FROM conversations), k AS (SELECT conv_id, turn, list_filter(q, lambda x, i: list_position(list_transform(q, lambda y: lower(left(y, 60))), lower(left(x, 60))) = i) AS q FROM q) SELECT conv_id, turn, (generate_subscripts(q, 1) - 1)::INT AS place, unnest(q) AS query FROM k")
def behaviour_queries(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.queries_of(F.col("text"))).alias("place", "query"))


@query("t17_year_quarter", "SELECT o_orderkey, substr(o_orderdate::VARCHAR, 1, 4) || '-Q' || quarter(o_orderdate) AS bucket FROM orders")
def year_quarter(spark, d) -> DataFrame:
    from quarrylane.operators.trends import quarter_of

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.substring(day, 1, 4), F.lit("-"), quarter_of(day)).alias("bucket"))


@query("t18_t23_item_links", "SELECT p_partkey, split_part(p_size::VARCHAR || '.' || p_partkey, '.', 1) AS parent, 'https://items.example/' || p_size || '/' || p_partkey || '/' AS link FROM part")
def item_links(spark, d) -> DataFrame:
    item = F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.parent_of(item).alias("parent"), T.item_link(item, "https://items.example/").alias("link"))


@query("t19_t22_truncation", "SELECT doc_id, left(text, 120) AS head, CASE WHEN length(text) > 600 THEN regexp_replace(left(text, 600), ' [^ ]*$', '') || '...' ELSE text END AS short FROM documents")
def truncation(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(120)).alias("head"), T.truncate_at_word(F.col("text")).alias("short"))


@query("t20_formats", "SELECT c_custkey, printf('%.1f%%', round(c_acctbal::DECIMAL(18, 4), 1)::DOUBLE) AS pct, printf('%+.1f%%', round(c_acctbal::DECIMAL(18, 4), 1)::DOUBLE) AS signed FROM customer")
def formats(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.percent(F.col("c_acctbal")).alias("pct"), T.percent(F.col("c_acctbal"), True).alias("signed"))


@query("t21_description", "SELECT doc_id, array_to_string(string_split(regexp_replace(regexp_replace('[' || lang || '](http://x) ' || text, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\n+', ' ', 'g'), '. ')[1:3], '. ') AS summary FROM documents")
def description(spark, d) -> DataFrame:
    marked = F.concat(F.lit("["), "lang", F.lit("](http://x) "), "text")
    return table(spark, d, "documents").select("doc_id", T.first_sentences(T.strip_markdown_links(marked)).alias("summary"))


@query("t24_redact", "SELECT page_id, regexp_replace(url || '?token=t&key=a1-b_2%&apikey=z&x=' || page_id, 'key=[\\w-]+', 'key=***', 'g') AS line FROM pages")
def redact(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.redact(F.concat("url", F.lit("?token=t&key=a1-b_2%&apikey=z&x="), F.col("page_id").cast("string"))).alias("line"))


_LINES = ["x ERROR WARNING", "Scraped from ERROR", "items scraped", "WARNING: slow", "Crawled (200) <GET x>", "at 3 pages/min", "9 items/min", "idle"]


@query("t25_log_kinds", "SELECT event_id, (['error', 'item', 'item', 'warning', 'rate', 'rate', 'rate', 'other'])[event_id % 8 + 1] AS kind FROM events")
def log_kinds(spark, d) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, _LINES)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.log_kind(line).alias("kind"))


@query("t27_grouped_text", "WITH t AS (SELECT DISTINCT p_type, p_brand, left(p_name, 120) AS p_name FROM part) SELECT p_type, string_agg(p_brand || ': ' || p_name, '; ' ORDER BY p_brand, p_name) AS listing FROM t GROUP BY p_type")
def grouped_text(spark, d) -> DataFrame:
    lines = table(spark, d, "part").select("p_type", "p_brand", F.left("p_name", F.lit(120)).alias("p_name")).distinct()
    sorted_lines = F.array_sort(F.collect_list(F.struct("p_brand", "p_name")))
    return lines.groupBy("p_type").agg(F.array_join(F.transform(sorted_lines, lambda x: F.concat_ws(": ", x["p_brand"], x["p_name"])), "; ").alias("listing"))


def _any_indicator(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in screen.INDICATORS) + ")"


_ALL_INDICATORS = " || ".join(f"regexp_extract_all(text, '{p}')" for p in screen.INDICATORS)


@query("f01_f02_indicators", f"SELECT doc_id, {_any_indicator('text')} AS hit, array_to_string(list_filter({_ALL_INDICATORS}, lambda x, i: list_position({_ALL_INDICATORS}, x) = i), ' ') AS hits FROM (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' CVE-2021-12345678 xcve-2021-4444' WHEN 1 THEN ' evil [.]com com[at]x' WHEN 2 THEN ' 010.020.030.040 [dot]com' WHEN 3 THEN ' hxxp:// 10.0.0' ELSE '' END AS text FROM documents)")
def indicators(spark, d) -> DataFrame:
    """Documents of which some get indicators, and what is nearly one, at their end."""
    kind = F.col("doc_id") % 6
    end = F.when(kind == 0, " CVE-2021-12345678 xcve-2021-4444").when(kind == 1, " evil [.]com com[at]x").when(kind == 2, " 010.020.030.040 [dot]com").when(kind == 3, " hxxp:// 10.0.0").otherwise("")
    text = F.concat("text", end)
    return table(spark, d, "documents").select("doc_id", screen.has_indicator(text).alias("hit"), F.array_join(screen.indicator_hits(text), " ").alias("hits"))


def _hits(terms: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in terms) + "], lambda x: x IS NOT NULL)"


@query("f03_f05_vocabulary", f"SELECT doc_id, array_to_string({_hits(_TERMS)}, ',') AS terms, len({_hits(_TERMS)}) >= 2 AS enough, array_to_string({_hits(_TOOLS)}, ',') AS tools, array_to_string({_hits(_TERMS)} || {_hits([t for t in _TOOLS if t not in _TERMS])}, ',') AS hits FROM documents")
def vocabulary(spark, d) -> DataFrame:
    x = F.col("text")
    terms, tools = screen.term_hits(x, _TERMS), screen.term_hits(x, _TOOLS)
    return table(spark, d, "documents").select("doc_id", F.array_join(terms, ",").alias("terms"), (F.size(terms) >= 2).alias("enough"), F.array_join(tools, ",").alias("tools"), F.array_join(screen.vocabulary_hits(x, _TERMS, _TOOLS), ",").alias("hits"))


_GATE = f"SELECT doc_id, CASE WHEN n < 200 THEN 'short' WHEN NOT (i OR v OR t) THEN 'no_heuristic' ELSE 'level1_ok' END AS reason FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, len({_hits(_TERMS)}) >= 2 AS v, len({_hits(_TOOLS)}) > 0 AS t, {_any_indicator('text')} AS i FROM documents)"


@query("f06_gate_one", _GATE)
def gate_one(spark, d) -> DataFrame:
    return screen.gate_one(table(spark, d, "documents"), _TERMS, _TOOLS).select("doc_id", "reason")


def _gated(spark, d) -> DataFrame:
    passed = screen.gate_one(table(spark, d, "documents"), _TERMS, _TOOLS)
    vectors = table(spark, d, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    similarity = screen.cosine_top_k(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), queries.withColumnRenamed("query_id", "vec_id"), 1).select(F.col("query_id").alias("doc_id"), "similarity")
    return screen.gate_two(passed, similarity, "doc_id")


_GATE_TWO = f"WITH g AS ({_GATE}), s AS (SELECT x.vec_id AS doc_id, max(list_cosine_similarity(x.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS s FROM embeddings x JOIN embeddings q ON q.vec_id % 50 = 0 GROUP BY 1), r AS (SELECT g.doc_id, CASE WHEN s IS NOT NULL THEN greatest(0.0, least(1.0, s)) END AS similarity, CASE WHEN reason <> 'level1_ok' THEN reason WHEN s >= 0.55 THEN 'passed' ELSE 'low_similarity' END AS reason FROM g LEFT JOIN s USING (doc_id))"


@query("f07_f08_two_level_gate", _GATE_TWO + " SELECT doc_id, reason, round(similarity, 6) AS similarity FROM r")
def two_level_gate(spark, d) -> DataFrame:
    return _gated(spark, d).select("doc_id", "reason", F.round("similarity", 6).alias("similarity"))


@query("f09_gate_statistics", _GATE_TWO + " SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in ("short", "no_heuristic", "low_similarity", "passed")) + ", round(count(*) FILTER (WHERE reason = 'passed')::DOUBLE / count(*), 3) AS pass_rate FROM r")
def gate_statistics(spark, d) -> DataFrame:
    return screen.gate_stats(_gated(spark, d))


@query("f10_histogram", "WITH e(bin, low, high) AS (VALUES (0, 0.0, 0.2), (1, 0.2, 0.3), (2, 0.3, 0.4), (3, 0.4, 0.5), (4, 0.5, 0.7), (5, 0.7, 1.01)) SELECT bin, low::DOUBLE AS low, high::DOUBLE AS high, (SELECT count(*) FROM lineitem WHERE l_discount * 9 >= low::DOUBLE AND l_discount * 9 < high::DOUBLE) AS n FROM e")
def histogram(spark, d) -> DataFrame:
    return screen.bins(table(spark, d, "lineitem").withColumn("x", F.col("l_discount") * 9), "x", [0, 0.2, 0.3, 0.4, 0.5, 0.7, 1.01])


@query("f11_reason_codes", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'too_short' WHEN 'O' THEN 'off_topic' END AS code FROM orders")
def reason_codes(spark, d) -> DataFrame:
    codes = F.create_map(F.lit("F"), F.lit("too_short"), F.lit("O"), F.lit("off_topic"))
    return table(spark, d, "orders").select("o_orderkey", codes[F.col("o_orderstatus")].alias("code"))


@query("f13_having", "SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0")
def having(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done")).filter("done > 0")


@query("f14_f15_filtered_page", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'error') AND contains(props, '7') AND value > 10 ORDER BY value DESC, event_id LIMIT 10 OFFSET 10")
def filtered_page(spark, d) -> DataFrame:
    from quarrylane.operators.relational import page

    hits = table(spark, d, "events").filter(F.col("event_type").isin("click", "error") & F.contains("props", F.lit("7")) & (F.col("value") > 10))
    return page(hits, 2, 10, F.desc("value"), F.col("event_id")).select("event_id", "event_type", "value")


@query("f16_first_family", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'crimson' WHEN contains(lower(p_name), 'ring') THEN 'ring' WHEN contains(lower(p_name), 'blue') THEN 'deepblue' END AS family FROM part")
def first_family(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", screen.first_term(F.col("p_name"), ["red", "ring", "blue"], {"red": "crimson", "blue": "deep blue"}).alias("family"))


def _prints(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", screen.simhash64(F.col("text")).alias("fp"))


_PRINTS = "WITH t AS (SELECT doc_id, trim(regexp_replace(lower(left(text, 2000)), '\\s+', ' ', 'g')) AS t FROM documents), g AS (SELECT doc_id, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END) AS g FROM t), h AS (SELECT doc_id, ('0x' || substr(md5(g), 17, 16))::UBIGINT AS h FROM g), v AS (SELECT doc_id, " + ", ".join(f"2 * sum((h >> {b}) & 1) > count(*) AS b{b}" for b in range(64)) + " FROM h GROUP BY doc_id), p AS (SELECT doc_id, " + " || ".join(f"(b{b}::INT)::VARCHAR" for b in range(63, -1, -1)) + " AS bits FROM v)"


@query("t04_simhash", _PRINTS + " SELECT doc_id, bits FROM p")
def simhash(spark, d) -> DataFrame:
    return _prints(spark, d).select("doc_id", F.lpad(F.bin("fp"), 64, "0").alias("bits"))


@query("t05_j15_near_pairs", _PRINTS + ", f AS (SELECT min(doc_id) AS doc_id, bits FROM p GROUP BY bits), n AS (SELECT doc_id, ('0b' || bits)::UBIGINT AS x FROM f) SELECT i.doc_id AS a, j.doc_id AS b, bit_count(xor(i.x, j.x)) AS distance FROM n i JOIN n j ON i.doc_id < j.doc_id WHERE bit_count(xor(i.x, j.x)) <= 3")
def near_pairs(spark, d) -> DataFrame:
    firsts = _prints(spark, d).groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    return screen.near_pairs(firsts, "doc_id")


_DOCS_IN_ORDER = _PRINTS + ", n AS MATERIALIZED (SELECT p.doc_id, ('0b' || bits)::UBIGINT AS fp, source || '/' || (p.doc_id % 200) AS url FROM p JOIN documents d ON d.doc_id = p.doc_id), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM n)"


@query("v03_keep_first", _DOCS_IN_ORDER.replace("WITH ", "WITH RECURSIVE ", 1) + ", read(r, kept) AS (SELECT 0::BIGINT, []::STRUCT(doc_id BIGINT, fp UBIGINT)[] UNION ALL SELECT o.r, CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k.fp, o.fp)) <= 3)) = 0 THEN list_append(kept, {'doc_id': o.doc_id, 'fp': o.fp}) ELSE kept END FROM read JOIN o ON o.r = read.r + 1) SELECT unnest(kept).doc_id AS doc_id FROM read WHERE r = (SELECT max(r) FROM read)")
def keep_first(spark, d) -> DataFrame:
    from quarrylane.scratch import materialize

    prints = materialize(_prints(spark, d), "prints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "firsts")
    return screen.keep_first(firsts, screen.near_pairs(firsts, "doc_id"), "doc_id")


@query("v01_j16_cosine_top_k", "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 7")
def cosine_top_k(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return screen.cosine_top_k(queries, vectors, 7).withColumn("similarity", F.round("similarity", 6))


@query("v02_merged_candidates", "WITH s AS (SELECT q.vec_id AS query_id, 'T' || e.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0), f AS (SELECT DISTINCT vec_id AS query_id, unnest(['T' || vec_id || '.001', 'T' || vec_id]) AS item FROM embeddings WHERE vec_id % 50 = 0 AND vec_id % 3 = 0), k AS (SELECT query_id, item, 1.0::DOUBLE AS similarity, 0 AS tier FROM f UNION ALL SELECT s.query_id, s.item, round(s.s, 3), 1 FROM s WHERE r <= 7 AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = s.query_id AND f.item = s.item)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY similarity DESC, item) AS place FROM k) SELECT query_id, item, similarity, tier, place FROM o WHERE tier = 0 OR place <= 5")
def merged_candidates(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = screen.cosine_top_k(queries, vectors, 7).select("query_id", F.concat(F.lit("T"), F.col("vec_id").cast("string")).alias("item"), "similarity")
    forced = queries.filter("query_id % 3 = 0").select("query_id", F.concat(F.lit("T"), F.col("query_id").cast("string"), F.lit(".001")).alias("item"))
    return screen.merge_candidates(forced, found, "query_id", 5)


@query("v03_ingest_counters", _DOCS_IN_ORDER.replace("WITH ", "WITH RECURSIVE ", 1) + ", read(r, kept, status) AS (SELECT 0::BIGINT, []::STRUCT(url VARCHAR, fp UBIGINT)[], NULL::VARCHAR UNION ALL SELECT r, CASE WHEN status = 'inserted' THEN list_append(kept, {'url': url, 'fp': fp}) ELSE kept END, status FROM (SELECT o.*, kept, CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k.fp, o.fp)) <= 3)) > 0 THEN 'dup_sim' WHEN len(list_filter(kept, lambda k: k.url = o.url)) > 0 THEN 'dup_url' ELSE 'inserted' END AS status FROM read JOIN o ON o.r = read.r + 1)) SELECT status, count(*) AS n FROM read WHERE r > 0 GROUP BY status")
def ingest_counters(spark, d) -> DataFrame:
    """Documents in order: near an inserted one (dup_sim), else of a url already inserted (dup_url), else inserted; the check for nearness comes first."""
    from quarrylane.scratch import materialize

    docs = materialize(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), (F.col("doc_id") % 200).cast("string")).alias("url"), screen.simhash64(F.col("text")).alias("fp")), "prints")
    pairs = screen.near_pairs(docs.select("fp").distinct(), "fp")
    return screen.ingest_status(docs, pairs).groupBy("status").agg(F.count("*").alias("n"))
