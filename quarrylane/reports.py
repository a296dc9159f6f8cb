"""The analyses as bundles of tables, over frames of the library's data model.

documents: document_id, source, published (ISO date string), year, state
annotations: document_id, idx, item, category, v1, v2 (accept, reject, uncertain), confidence
gold: document_id, idx, item, category, source, stratum, v1, v2, human, error_code
entries: item, version, released, name, created, revoked (a catalogue's releases)
extractions: document_id, model, annotations (JSON text)

Each function returns name -> DataFrame, lazily; save() writes a bundle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.functions import stats
from quarrylane.operators import annotations as schema
from quarrylane.operators import assoc, evaluate, graph, releases, trends
from quarrylane.sources import files

Report = dict[str, DataFrame]


def longitudinal(documents: DataFrame, annotations: DataFrame, years: Sequence[int], split: int, categories: Sequence[str], excluded_sources: Sequence[str] = ()) -> Report:
    """Trends of accepted annotations; years before `split` are early, it and later ones late."""
    accepted = annotations.filter("v1 = 'accept'").join(documents, "document_id")
    reliable = accepted if not excluded_sources else accepted.filter(~F.col("source").isin(*excluded_sources))
    early, late = F.col("year") < split, F.col("year") >= split
    series = trends.dense_series(reliable, "item", "year", list(years))
    total = F.aggregate("series", F.lit(0).cast("long"), lambda a, x: a + x)
    matrix = series.withColumns({"total": total, "mk": stats.mann_kendall(F.col("series"))}).filter("total >= 4").withColumn("mean_per_year", F.col("total") / F.size("series"))
    significant = F.col("mk.p_value") < 0.10
    return {
        "volume_by_year": trends.volume_by_year(reliable),
        "volume_by_quarter": trends.volume_by_quarter(accepted),
        "category_distribution_by_year": trends.share_by_year(reliable, "category", list(categories)),
        "top_items_by_year": trends.top_by_group(reliable, "year", "item", 10),
        "emergence": trends.emergence(reliable, "item", early, late),
        "source_contribution_by_year": trends.contribution(reliable, "source", list(years)),
        "normalised_emergence": trends.normalised_emergence(reliable, documents, "item", "source", early, late),
        "source_entropy": trends.source_entropy(reliable, "year", "source"),
        "trend_matrix": matrix.select("item", "total", "mean_per_year", "mk.tau", "mk.p_value", "mk.direction", significant.alias("significant"), trends.trend_category(F.col("total"), F.col("mean_per_year"), F.col("mk.direction"), significant).alias("category"), F.array_join("series", " ").alias("series")),
    }


def cooccurrence(annotations: DataFrame, ranks: Column | None = None, excised: str | None = None, support: float = 0.01, confidence: float = 0.40, lift: float = 1.2, jaccard: float = 0.02, with_graph: bool = True) -> Report:
    """Pairs, rules and centrality of items accepted together; ranks: a map column from category to its order."""
    accepted = annotations.filter("v1 = 'accept'")
    details, pairs = assoc.item_details(accepted), assoc.pair_table(assoc.transactions(accepted))
    found = assoc.rules(pairs, support, confidence, lift)
    of = details.select("item", "category")
    named = found.join(of.select(F.col("item").alias("antecedent"), F.col("category").alias("category_from")), "antecedent").join(of.select(F.col("item").alias("consequent"), F.col("category").alias("category_to")), "consequent")
    if ranks is not None:
        named = named.withColumn("direction", assoc.direction(ranks[F.col("category_from")], ranks[F.col("category_to")]))
    report = {"pairwise": pairs, "rules": named, "rules_significant": named.filter("bh_significant"), "rules_by_category_pair": assoc.by_category_pair(found, details)}
    if with_graph:
        report["centrality"] = graph.centrality(graph.centrality(details, assoc.graph(pairs, jaccard)), assoc.graph(pairs, jaccard, excised=excised), "excised")
    return report


def evaluation(gold: DataFrame, least_source: int = 10, least_item: int = 5) -> Report:
    """Quality of the second rater against the human label."""
    human, first, second = (evaluate.binary(F.col(c)) for c in ("human", "v1", "v2"))
    report = {
        "confusion_3x2": evaluate.confusion_by_scope(gold, "stratum", "human", "v2", ["accept", "reject", "uncertain"], ["accept", "reject"]),
        "metrics": evaluate.with_metrics(evaluate.by_scope(gold, "stratum", human, second)),
        "sensitivity": evaluate.sensitivity(gold, "stratum", human, second),
        "extractor_only": evaluate.with_metrics(evaluate.by_scope(gold, "stratum", human, F.lit(1))),
        "by_source": evaluate.by_dimension(gold, "source", human, second, least_source),
        "by_item": evaluate.by_dimension(gold, "item", human, second, least_item),
        "by_category": evaluate.by_dimension(gold, "category", human, second),
        "error_correction": evaluate.error_correction(gold, "error_code", first, second, human),
    }
    return report | {f"interval_{m}": evaluate.bootstrap(gold, "stratum", human, second, metric=m) for m in ("f1", "mcc", "precision", "recall")}


def agreement(gold: DataFrame, least: int = 10) -> Report:
    """Krippendorff's alpha of human and raters by cut, rater and level, and by source."""
    binary, ordinal = ["reject", "accept"], ["reject", "uncertain", "accept"]
    head = None
    for cut, rows in (("full", gold), ("stratified", gold.filter("stratum = 'stratified'")), ("control", gold.filter("stratum = 'control'"))):
        for rater in ("v1", "v2"):
            for level, values in (("binary", binary), ("ordinal", ordinal)):
                one = evaluate.alpha(rows, [], "human", rater, values, level == "ordinal").select(F.lit(cut).alias("cut"), F.lit(rater).alias("rater"), F.lit(level).alias("level"), "n", "alpha")
                head = one if head is None else head.unionByName(one)
    return {"headline": head, "by_source": evaluate.alpha(gold, ["source"], "human", "v2", binary).filter(F.col("n") >= least)}


def adherence(extractions: DataFrame) -> Report:
    """How far JSON annotations keep to the schema."""
    rows = schema.adherence_rows(extractions, "document_id", "annotations")
    by_model = rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if("parseable").alias("parseable"), F.count_if("row_core_ok").alias("row_core"), F.count_if("row_strict_ok").alias("row_strict"), F.sum("n_elements").alias("elements"))
    return {"summary": schema.adherence_summary(rows), "by_model": by_model, "missing_fields": schema.missing_keys(rows), "per_extraction": rows.drop("annotations", "__keys")}


def catalogue_lag(documents: DataFrame, annotations: DataFrame, entries: DataFrame, start: str) -> Report:
    """Lag of accepted items behind their release, and the subsets that are looked at."""
    accepted = annotations.filter("v1 = 'accept'").join(documents, "document_id")
    lags = releases.lags(releases.first_seen(accepted), releases.catalogue_index(entries), start)
    first, median, often, spread = F.col("lag_first_live") > 0, F.col("lag_median_live") > 0, F.col("n") >= 3, F.col("sources") >= 2
    return {
        "all_items": lags, "positive": lags.filter(first), "robust": lags.filter(first & often), "multi_source": lags.filter(first & spread), "strict": lags.filter(first & median & often & spread),
        "not_catalogued": lags.filter("first_version IS NULL"), "revoked": lags.filter("revoked"), "post_start": lags.filter("is_post_start"), "summary": releases.lag_summary(lags, "lag_first_live"),
    }


def save(report: Report, folder: str, one_file: bool = True) -> None:
    """Writes each table of a report as CSV below a folder; reports are aggregates, so one file each by default."""
    for name, rows in report.items():
        files.write_csv(rows, f"{folder}/{name}", one_file)
