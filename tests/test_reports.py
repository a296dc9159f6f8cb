"""Report bundles, SQL functions and the page source."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrylane import reports
from quarrylane.functions import sql
from quarrylane.plans import fixtures, relational_queries, state_queries
from quarrylane.sources.pages import read_pages


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return {n: fixtures.view(spark, sf_dir, t).cache() for n, t in (("documents", fixtures.DOCUMENTS), ("annotations", fixtures.ANNOTATIONS), ("gold", fixtures.GOLD))}


def test_reports(spark, sf_dir, model, tmp_path):
    d, a, g = model["documents"], model["annotations"], model["gold"]
    ranks = F.create_map(F.lit("ECONOMY"), F.lit(1), F.lit("SMALL"), F.lit(2))
    bundles = {
        "longitudinal": reports.longitudinal(d, a, range(1995, 2002), 1998, ["ECONOMY", "PROMO"], ["NATION_3"]),
        "cooccurrence": reports.cooccurrence(a, ranks, "Brand#7", support=0.001, confidence=0.01, lift=1.0, with_graph=False),
        "evaluation": reports.evaluation(g),
        "agreement": reports.agreement(g),
        "adherence": reports.adherence(state_queries._json_rows(spark, sf_dir)),
        "lag": reports.catalogue_lag(d, a, relational_queries._entries(spark, sf_dir), "1997-01-01"),
    }
    for name, bundle in bundles.items():
        for table, rows in bundle.items():
            assert len(rows.columns) and rows.count() >= 0, (name, table)
    assert bundles["evaluation"]["metrics"].count() == 3 and bundles["agreement"]["headline"].count() == 12
    reports.save({"lag": bundles["lag"]["summary"]}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "lag")).count() == 1


def test_sql_functions(spark):
    names = sql.register(spark)
    row = spark.sql("SELECT hamming64(10, 1) AS h, f1_of(2, 1, 1) AS f, mcc_of(0, 0, 0, 5) AS m, parent_item('T1.2') AS p, canonical_url('http://a/b/?x#y') AS u, fisher_exact(3, 1, 1, 3) AS e, mann_kendall(array(1, 2, 3, 4, 5)).direction AS k, simhash64('abc') = simhash64('ABC') AS s").first()
    assert (row["h"], row["m"], row["p"], row["u"], row["k"], row["s"]) == (3, None, "T1", "http://a/b", "increasing", True)
    assert abs(row["f"] - 2 / 3) < 1e-12 and abs(row["e"] - 34 / 70) < 1e-9 and "mcnemar_exact" in names


def test_page_source(spark):
    pages = read_pages(spark, [f"http://x/{i}" for i in range(20)], lambda urls: ((u, f"<h1>{u}</h1>") for u in urls), parts=3)
    assert sorted(r["html"] for r in pages.collect()) == sorted(f"<h1>http://x/{i}</h1>" for i in range(20))
