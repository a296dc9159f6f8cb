"""Operators on hand-made rows with the edge cases of FIXTURES.md."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from quarrylane.functions import stats
from quarrylane.functions import text as T
from quarrylane.operators import annotations, assoc, evaluate, graph, relational, releases, screen, state, trends
from quarrylane.sources import files


def values(spark, column, texts, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_clean_text(spark):
    got = values(spark, T.clean_text, [None, "", "<p>a</p><b>b</b>", "a  b", "a   b", " \t\n a  \n\t b \n"])
    assert got == ["", "", "a  b", "a  b", "a b", "a b"]


def test_normalise_date(spark):
    got = values(spark, T.normalise_date, [None, "", "  ", "2026-02-23", "2026-02-23T10:00:00Z", "2026-02-23T10:00:00+00:00", "2026-02-23T10:00:00+02:00", "Mon, 23 Feb 2026 10:00:00 +0100", "February 3, 2026", "Feb 3, 2026", "2026-13-40", "nonsense"])
    assert got == [None, None, None, "2026-02-23T00:00:00Z", "2026-02-23T10:00:00Z", "2026-02-23T10:00:00Z", "2026-02-23T08:00:00Z", "2026-02-23T09:00:00Z", "2026-02-03T00:00:00Z", "2026-02-03T00:00:00Z", None, None]


def test_normalise_date_in_other_forms(spark):
    got = values(spark, T.normalise_date, ["03/05/2024", "5 Mar 2024", "2024/03/05", "2024-03-05 10:00", "March 5th, 2024 3pm", "20240305", "2024-03-05T10:00:00.5-05:00", "25/12/2024", "xyzzy not a date", "99999999999999", "2026-02-23T10:00:00+0200"])
    day = "2024-03-05T"
    assert got == [day + "00:00:00Z"] * 3 + [day + "10:00:00Z", day + "15:00:00Z", day + "00:00:00Z", day + "15:00:00Z", "2024-12-25T00:00:00Z", None, None, "2026-02-23T08:00:00Z"]


def test_links_and_main_text(spark):
    html = "<A class=x HREF='b.html'>x</A><a href=/c?d=1>y</a><a href=\"https://o.org/z\">z</a><a href=''>n</a><a name=q>n</a><abbr href='no'>"
    rows = spark.createDataFrame([(html, "https://e.com/a/p.html"), ("none", None)], "h string, u string")
    got = [r[0] for r in rows.select(T.links(F.col("h"), F.col("u"))).collect()]
    assert got == [["https://e.com/a/b.html", "https://e.com/c?d=1", "https://o.org/z"], []]
    long = "word " * 60
    pages = [f"<nav>n</nav><article><h1>t</h1><p>{long}</p><aside>a</aside></article><p>after</p>", "<article>short</article><h1>t</h1><div><p>one <b>two</b></p></div><p>three</p>", "<nav>n</nav><div>all  of it</div>", None]
    assert values(spark, T.main_text, pages) == ["t " + long.strip(), "one two three", "all of it", None]


def test_chunks(spark):
    assert values(spark, lambda x: T.chunks(x, 2), ["a b c d", "a b c", "", None]) == [["a b", "c d"], ["a b", "c"], [""], [""]]


def test_behaviour_queries(spark):
    x = "Title: this one is a heading and left out. The sentence is long enough to stay in here. Short.\n- a bullet that is long enough\n- short\nThe sentence is long enough to stay in here."
    got = values(spark, T.queries_of, [x])[0]
    assert "The sentence is long enough to stay in here." in got and "a bullet that is long enough" in got and len([q for q in got if q.startswith("The sentence")]) == 1


def test_indicators(spark):
    texts = ["CVE-2024-1234 and cve-2024-1234", "version 10.2.3", "at 192.168.0.1 and 192.168.0.1", "a" * 32 + " " + "b" * 40, "a" * 33, "hxxp://bad[.]site", None]
    texts += ["CVE-2021-12345678", "xCVE-2021-4444", "evil [.]com", "com[at]x", "[dot]com", "010.020.030.040", "see hxxp:// there", "8.8.8.8 ... CVE-2024-1234 8.8.8.8", "clean text"]
    hits = values(spark, screen.indicator_hits, texts)
    assert hits[:5] == [["CVE-2024-1234", "cve-2024-1234"], [], ["192.168.0.1"], ["a" * 32, "b" * 40], []]
    assert hits[5] == ["hxxp://"]
    assert hits[7:] == [["CVE-2021-12345678"], ["CVE-2021-4444"], ["[.]com"], ["com[at]"], ["[dot]com"], ["010.020.030.040"], ["hxxp://"], ["CVE-2024-1234", "8.8.8.8"], []]
    assert values(spark, screen.has_indicator, texts) == [None if h is None else bool(h) for h in hits]


def test_vocabulary_hits_keep_the_order_of_the_lists(spark):
    assert values(spark, lambda x: screen.vocabulary_hits(x, ["play", "apache", "bee"], ["zed", "apache", "ant"]), ["display of ANTS, apache, zed"]) == [["play", "apache", "zed", "ant"]]


def test_gate(spark):
    docs = spark.createDataFrame([(1, "w " * 199), (2, "w " * 200), (3, "w " * 200 + "play display apache 10.0.0.1"), (4, None)], "doc_id int, text string")
    got = {r["doc_id"]: (r["reason"], r["rules"]) for r in screen.gate_one(docs, ["play", "display"], ["apache"]).collect()}
    assert got == {1: ("short", []), 2: ("no_heuristic", []), 3: ("level1_ok", ["indicator", "vocabulary", "tool"]), 4: ("short", [])}


def test_hamming(spark):
    low = -(2**63)
    pairs = [(0, 0, 0), (10, 1, 3), (255, 255, 0), (-1, 0, 64), (low, 0, 1), (1, -1, 63)]
    rows = spark.createDataFrame(pairs, "a long, b long, want int").select("want", screen.hamming(F.col("a"), F.col("b")).alias("got"))
    assert all(r["want"] == r["got"] for r in rows.collect())


def test_simhash(spark):
    got = values(spark, screen.simhash64, ["The  cat sat", "the cat\nsat", "", "ab", None, "x" * 2000 + "y" * 500, "x" * 2000])
    assert got[0] == got[1] and got[2] == got[4] and got[5] == got[6] and got[0] != got[3]


def test_near_pairs_and_keep_first(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(5):
            prints.append(v)
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame(list(enumerate(signed)), "k int, fp long")
    pairs = screen.near_pairs(rows, "k")
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    kept: list[int] = []
    for i in range(len(prints)):
        if not any((prints[i] ^ prints[j]).bit_count() <= 3 for j in kept):
            kept.append(i)
    assert sorted(r["k"] for r in screen.keep_first(rows, pairs, "k").collect()) == kept


def test_lookup_with_parent(spark):
    rows = spark.createDataFrame([("T1",), ("T1.001",), ("T2.001",), ("T9",)], "item string")
    lookup = spark.createDataFrame([("T1", "one"), ("T2.001", "sub")], "id string, name string")
    got = {r["item"]: r["name"] for r in relational.with_fallback(rows, lookup, F.col("item"), T.parent_of(F.col("item"))).collect()}
    assert got == {"T1": "one", "T1.001": "one", "T2.001": "sub", "T9": "T9"}


def test_mann_kendall(spark):
    x = [[0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [1, 1, 1, 1, 1], [1, 2, 3], [1, 2, 3, 4, 5, 6], None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x array<long>").select("i", stats.mann_kendall(F.col("x")).alias("m")).orderBy("i").collect()
    got = [r["m"] for r in rows]
    assert got[0]["direction"] == "increasing" and math.isclose(got[0]["p_value"], 2 / 120) and got[1]["tau"] == -1
    assert got[2]["p_value"] == 1 and got[3]["direction"] == "stable" and got[4]["p_value"] < 0.05 and got[5]["tau"] is None


def test_mann_kendall_by_all_orders(spark):
    from itertools import permutations

    of = lambda x: sum((b > a) - (b < a) for i, a in enumerate(x) for b in x[i + 1 :])
    rng = random.Random(7)
    x = [[rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(5)] for _ in range(60)] + [[rng.randrange(4) for _ in range(9)] for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(x)), "i int, x array<long>").select("i", stats.mann_kendall(F.col("x")).alias("m")).collect()
    for r in rows:
        v, s = x[r["i"]], of(x[r["i"]])
        n = len(v)
        if n == 5:
            p = sum(abs(of(o)) >= abs(s) for o in permutations(v)) / 120
        else:
            variance = (n * (n - 1) * (2 * n + 5) - sum(c * (c - 1) * (2 * c + 5) for c in (v.count(k) for k in {*v}))) / 18
            p = min(1.0, math.erfc(max(abs(s) - 1, 0) / math.sqrt(variance) / math.sqrt(2)))
        assert math.isclose(r["m"]["p_value"], p, rel_tol=1e-9) and math.isclose(r["m"]["tau"], s / (n * (n - 1) / 2))


def test_normal_cdf(spark):
    z = [0.0, 0.3, -0.3, 1.96, -2.9999, 3.0, 5.5, -8.0, -20.0, 40.0, None]
    for x, got in zip(z, values(spark, stats.normal_cdf, z, "double")):
        assert got is None if x is None else math.isclose(got, math.erfc(-x / math.sqrt(2)) / 2, rel_tol=1e-10)


def test_fisher_of_large_tables():
    assert stats.fisher_of(10**6, 10**6, 10**6, 10**6) == 1.0 and stats.fisher_of(10**6, 0, 0, 10**6) == 0.0
    assert 0 < stats.fisher_of(501_500, 498_500, 498_500, 501_500) < 1e-3 < stats.fisher_of(500_100, 499_900, 499_900, 500_100)


def test_fisher_against_enumeration():
    def exact(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        p = lambda k: math.comb(col, k) * math.comb(n - col, row - k) / math.comb(n, row)
        return sum(p(k) for k in range(max(0, row + col - n), min(row, col) + 1) if p(k) <= p(a) * (1 + 1e-9))

    rng = random.Random(1)
    for _ in range(300):
        t = [rng.randrange(30) for _ in range(4)]
        row, col, n = t[0] + t[1], t[0] + t[2], sum(t)
        want = 1.0 if not (row and col and n - row and n - col) else exact(*t)
        assert math.isclose(stats.fisher_of(*t), want, rel_tol=1e-6)


def test_benjamini_hochberg(spark):
    rng = random.Random(2)
    for m in (1, 2, 17, 40):
        p = [round(rng.random() ** 3, 4) for _ in range(m)]
        rows = spark.createDataFrame(list(enumerate(p)), "i int, p double")
        got = {r["i"]: r["bh_significant"] for r in assoc.benjamini_hochberg(rows, "p", "i").collect()}
        order = sorted(range(m), key=lambda i: (p[i], i))
        cut = max((r for r, i in enumerate(order, 1) if p[i] <= 0.05 * r / m), default=0)
        assert got == {i: r <= cut for r, i in enumerate(order, 1)}


def test_metrics_degenerate(spark):
    rows = spark.createDataFrame([("one", 0, 0, 0, 5), ("two", 0, 0, 5, 0), ("none", 0, 0, 0, 0)], "scope string, tp long, fp long, fn long, tn long")
    got = {r["scope"]: r for r in evaluate.with_metrics(rows).collect()}
    assert got["one"]["f1"] is None and got["one"]["accuracy"] == 1 and got["one"]["kappa"] is None
    assert got["two"]["f1"] == 0 and got["two"]["precision"] is None and got["none"]["accuracy"] is None


def test_alpha(spark):
    rng = random.Random(4)
    values_ = ["reject", "uncertain", "accept"]
    pairs = [(rng.choice(values_), rng.choice(values_ + [None])) for _ in range(80)]
    rows = spark.createDataFrame(pairs, "a string, b string")

    def by_definition(ordinal):
        kept = [(values_.index(a), values_.index(b)) for a, b in pairs if b]
        n = [sum((a == k) + (b == k) for a, b in kept) for k in range(3)]
        total = sum(n)
        delta = lambda i, j: (sum(n[min(i, j) : max(i, j) + 1]) - (n[i] + n[j]) / 2) ** 2 if ordinal else float(i != j)
        seen = sum(2 * delta(a, b) for a, b in kept if a != b) / total
        expected = sum(n[i] * n[j] * delta(i, j) for i in range(3) for j in range(3) if i != j) / (total * (total - 1))
        return 1 - seen / expected

    for ordinal in (False, True):
        got = evaluate.alpha(rows, [], "a", "b", values_, ordinal).first()["alpha"]
        assert math.isclose(got, by_definition(ordinal), abs_tol=1e-8)


def test_bootstrap_covers_the_point(spark):
    rows = spark.createDataFrame([("s", i % 3 > 0, i % 4 > 0) for i in range(200)], "stratum string, t boolean, j boolean")
    got = evaluate.bootstrap(rows, "stratum", F.col("t").cast("int"), F.col("j").cast("int")).collect()
    assert {r["scope"] for r in got} == {"s", "combined"} and all(r["ci_low"] < r["point"] < r["ci_high"] for r in got)


def test_graph(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("x", "y", 1.0)]
    both = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src string, dst string, weight double")
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(both).collect()}
    assert between == {"a": 0, "b": 4 / 20, "c": 4 / 20, "d": 0, "x": 0, "y": 0}
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(both).collect()}
    near = {n: {b: w for a, b, w in edges + [(b, a, w) for a, b, w in edges] if a == n} for n in "abcdxy"}
    want = {n: 1 / 6 for n in near}
    for _ in range(200):
        want = {n: 0.15 / 6 + 0.85 * sum(want[m] * near[m][n] / sum(near[m].values()) for m in near if n in near[m]) for n in near}
    assert all(abs(ranks[n] - want[n]) < 1e-5 for n in near)


def test_pagerank_says_when_it_does_not_settle(spark):
    both = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    with pytest.raises(RuntimeError):
        graph.pagerank(both, most_rounds=2, tolerance=1e-12)


def test_ties_are_settled(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, None)]
    frame = spark.createDataFrame(rows, "k string, o int, v string")
    assert len({tuple(map(tuple, sorted(relational.latest_per_key(f, "k", "o").collect()))) for f in (frame, frame.orderBy(F.desc("v")), frame.repartition(3))}) == 1
    assert [tuple(r) for r in state.first_labels(frame.withColumn("o", F.lit(1)), "k", "v", "o").collect()] == [("a", "x")]


def test_bh_over_many_ranges(spark):
    rng = random.Random(9)
    p = [round(rng.random() ** 4, 3) for _ in range(500)] + [None, None]
    rows = spark.createDataFrame([(i, v, "mine") for i, v in enumerate(p)], "i int, p double, part string").repartition(7)
    got = {r["i"]: r["bh_significant"] for r in assoc.benjamini_hochberg(rows, "p", "i").collect()}
    order = sorted((i for i in range(500)), key=lambda i: (p[i], i))
    cut = max((r for r, i in enumerate(order, 1) if p[i] <= 0.05 * r / 500), default=0)
    assert got == {**{i: r <= cut for r, i in enumerate(order, 1)}, 500: False, 501: False}


def test_late_events_are_dropped_and_state_is_freed(spark, tmp_path):
    from quarrylane.streaming import rollups

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    batches = [[(1, "2024-01-01 00:10:00"), (2, "2024-01-01 05:00:00")], [(4, "2024-01-01 09:00:00")], [(3, "2024-01-01 00:20:00"), (5, "2024-01-01 12:00:00")]]
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame([(i, t, 1, "view", 1.0) for i, t in batch], "event_id long, t string, user_id long, event_type string, value double")
        rows.select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / f"in/b{n}"))
    for n in range(3):
        for f in (tmp_path / f"in/b{n}").glob("*.parquet"):
            os.utime(f, (1000 + n, 1000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = rollups.hourly(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {str(r["start"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 05:00:00": 1, "2024-01-01 09:00:00": 1}  # event 3 came late; the last window is open
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_no_folder_on_a_cluster(spark):
    from quarrylane import scratch

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string, weight double")
    assert graph.pagerank(none).count() == 0 and graph.betweenness(none).count() == 0


def test_allocation(spark):
    pools = spark.createDataFrame([("a", 50), ("b", 50), ("c", 1)], "source string, n long")
    got = {r["source"]: r["take"] for r in relational.allocate(pools, 10, "source").collect()}
    assert got == {"a": 5, "b": 5, "c": 0}


def test_verdicts(spark):
    got = values(spark, annotations.parse_verdict, ['{"verdict":"accept"}', 'so {"verdict": "Reject"} it is', '{"verdict": "perhaps"}', "", None, '{"a": {"verdict": "accept"}'])
    assert [(g["verdict"], g["parse_failure"]) for g in got] == [("accept", False), ("reject", False), ("uncertain", True), ("uncertain", True), ("uncertain", True), ("accept", False)]


def test_adherence(spark):
    texts = ["[]", None, "", "[{", "null", '{"item": 1}', '[{"item": 1, "category": null, "quote": 2}]', '[{"item": 1}, 5]', '[{"item":1,"category":2,"quote":3,"name":4,"confidence":5,"extra":6}]']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [tuple(r[c] for c in ("parseable", "n_elements", "core_ok", "strict_ok", "row_core_ok", "row_strict_ok")) for r in annotations.adherence_rows(rows, "id", "t").orderBy("id").collect()]
    empty, broken = (True, 0, 0, 0, True, True), (False, 0, 0, 0, False, False)
    assert got == [empty, empty, empty, broken, broken, broken, (True, 1, 1, 0, True, False), (True, 1, 0, 0, False, False), (True, 1, 1, 1, True, True)]


def test_lease_queue(spark):
    rows = [(1, "processing", "2024-01-01 00:00:00"), (2, "processing", "2024-01-01 09:00:00"), (3, "pending", None), (4, "completed", None), (5, "pending", None)]
    queue = spark.createDataFrame(rows, "id int, state string, t string").select("id", "state", F.col("t").cast("timestamp").alias("locked_at"))
    got = {r["id"]: r["state"] for r in state.acquire(queue, F.lit("2024-01-01 10:00:00").cast("timestamp"), 2).collect()}
    assert got == {1: "processing", 2: "processing", 3: "processing", 4: "completed", 5: "pending"}


def test_job_status_keeps_the_first_end(spark):
    rows = [(1, "j", "start", None), (2, "j", "end", "failed"), (3, "j", "end", "completed"), (4, "k", "start", None), (5, "l", "end", "odd"), (6, "m", "step", None)]
    events = spark.createDataFrame(rows, "event_id int, job_id string, event_type string, state string")
    got = {r["job"]: (r["status"], r["late"]) for r in state.job_status(events).collect()}
    assert got == {"j": ("failed", 1), "k": ("running", 0), "l": ("completed", 0), "m": ("queued", 0)}


def test_lower_median(spark):
    rows = spark.createDataFrame([("a", f"2024-01-0{d}", d, "s") for d in (1, 2, 3, 4)] + [("a", None, 9, "s"), ("a", "", 9, "s")], "item string, published string, document_id int, source string")
    got = releases.first_seen(rows).first()
    assert (got["first_seen"], got["median_seen"], got["n"]) == ("2024-01-01", "2024-01-02", 4)


def test_layouts(spark, tmp_path):
    (tmp_path / "bc_site_ransomware_20260223.csv").write_bytes(b"source,published_utc,headline,url,body\n,2024,h,u,\"two\nlines\"\nsource,published_utc,headline,url,body\nx,2024,\xff,u2,b\nmap,2024, h ,u4\n")
    (tmp_path / "beta.csv").write_text("Title,DATE,url,body,source\nt,2024,u3,b,s\n")
    (tmp_path / "gamma.csv").write_text("date,other\n1,2\n")
    (tmp_path / "left_out.csv").write_text("Title,DATE,url,body,source\nt,2024,u5,b,s\n")
    (tmp_path / "empty.csv").write_text("")
    want = {"u": ("bc_site", "h", "two\nlines"), "u2": ("x", "\ufffd", "b"), "u3": ("s", "t", "b"), "u4": ("alias", "h", "")}
    for paths in ([str(tmp_path)], [f"{tmp_path}/*.csv"], sorted(map(str, tmp_path.glob("*.csv")))):  # a folder of mixed layouts too
        got = files.read_articles(spark, paths, {"map": "alias"}, ignored=("left_out.csv",)).collect()
        assert {r["url"]: (r["source"], r["title"], r["body"]) for r in got} == want and len(got) == 4


def test_missing_releases(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"objects": []}')
    releases = {"1": str(tmp_path / "one.json"), "2": str(tmp_path / "two.json")}
    assert [r["version"] for r in files.read_bundles(spark, releases).collect()] == ["1"]
    assert files.read_bundles(spark, {"2": releases["2"]}).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_bundles(spark, releases, missing="raise")


def test_series_s(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(5) for _ in range(rng.randrange(1, 8))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "i int, x array<long>").select("i", trends.kendall_s(F.col("x")).alias("s"))
    want = {i: sum((b > a) - (b < a) for k, a in enumerate(x) for b in x[k + 1 :]) for i, x in rows}
    assert {r["i"]: r["s"] for r in frame.collect()} == want


@pytest.mark.parametrize("direction", ["increasing", "decreasing"])
def test_trend_category(spark, direction):
    row = spark.range(1).select(trends.trend_category(F.lit(50), F.lit(2.0), F.lit(direction), F.lit(True)).alias("c")).first()
    assert row["c"] == ("EMERGING" if direction == "increasing" else "OBSOLESCENT")


@pytest.mark.parametrize("most", [3, 200_000])
def test_keep_first_decides_long_chains(spark, most):
    n = 300 if most > 3 else 16
    prints = spark.createDataFrame([(i,) for i in range(n)], "id long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    assert {r["id"] for r in screen.keep_first(prints, chain, "id", most).collect()} == {*range(0, n, 2)}


@pytest.mark.parametrize("most", [0, 200_000])
def test_ingest_in_order(spark, most):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, *"abcdefgh"]), rng.randrange(30)) for i in range(120)]
    pairs = {(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.03}
    near, inserted, want = {(a, b) for p in pairs for a, b in (p, p[::-1])}, [], {}
    for i, url, fp in rows:
        if any(fp == g or (fp, g) in near for _, g in inserted):
            want[i] = "dup_sim"
        elif url is not None and any(url == u for u, _ in inserted):
            want[i] = "dup_url"
        else:
            want[i] = "inserted"
            inserted.append((url, fp))
    got = screen.ingest_status(spark.createDataFrame(rows, "id long, url string, fp long"), spark.createDataFrame(sorted(pairs), "a long, b long"), most)
    assert {r["id"]: r["status"] for r in got.collect()} == want
    empty = screen.ingest_status(spark.createDataFrame([], "id long, url string, fp long"), spark.createDataFrame([], "a long, b long"))
    assert empty.count() == 0


def test_near_pairs_by_tiles(spark):
    rng = random.Random(8)
    prints = sorted({rng.getrandbits(64) & 0xFF for _ in range(150)})
    rows = spark.createDataFrame(list(enumerate(prints)), "k int, fp long")
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in screen.near_pairs(rows, "k", most_in_tile=10).collect()} == want
