"""Evaluation queries: two raters and a human label on a stratified sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.functions import stats
from quarrylane.operators import evaluate

from .fixtures import ANNOTATIONS, GOLD, ctes, table, view
from .registry import query

_G = ctes(g=GOLD).rstrip()
_B = ", b AS (SELECT *, CASE human WHEN 'accept' THEN 1 WHEN 'reject' THEN 0 END AS t, CASE v2 WHEN 'accept' THEN 1 WHEN 'reject' THEN 0 END AS j, CASE v1 WHEN 'accept' THEN 1 WHEN 'reject' THEN 0 END AS f FROM g)"
_CELLS = "count(*) FILTER (WHERE t = 1 AND j = 1) AS tp, count(*) FILTER (WHERE t = 0 AND j = 1) AS fp, count(*) FILTER (WHERE t = 1 AND j = 0) AS fn, count(*) FILTER (WHERE t = 0 AND j = 0) AS tn, count(*) FILTER (WHERE t IS NOT NULL AND j IS NOT NULL) AS n"
_MCC = "round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 9) AS mcc"
_METRICS = _MCC + ", round(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 9) AS f1, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall, round((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 9) AS accuracy, round((tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy, round(tn::DOUBLE / nullif(tn + fn, 0), 9) AS npv, round(((tp + tn)::DOUBLE / (tp + fp + fn + tn) - ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / ((tp + fp + fn + tn)::DOUBLE ^ 2)) / nullif(1 - ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / ((tp + fp + fn + tn)::DOUBLE ^ 2), 0), 9) AS kappa"


def _truth():
    return evaluate.binary(F.col("human"))


def _judged():
    return evaluate.binary(F.col("v2"))


def _first():
    return evaluate.binary(F.col("v1"))


@query("a11_coverage", _G + " SELECT stratum, count(*) AS n_total, count(v2) AS n_with_v2, count(*) FILTER (WHERE human = 'uncertain' OR v2 IS NULL) AS n_excluded, count(*) FILTER (WHERE human = 'accept') AS h_accept, count(*) FILTER (WHERE human = 'reject') AS h_reject, count(*) FILTER (WHERE human = 'uncertain') AS h_uncertain, count(*) FILTER (WHERE v2 = 'accept') AS v2_accept, count(*) FILTER (WHERE v2 = 'reject') AS v2_reject FROM g GROUP BY stratum")
def coverage(spark, d) -> DataFrame:
    of = lambda c, v: F.count_if(F.col(c) == v)
    return view(spark, d, GOLD).groupBy("stratum").agg(
        F.count("*").alias("n_total"), F.count("v2").alias("n_with_v2"), F.count_if((F.col("human") == "uncertain") | F.col("v2").isNull()).alias("n_excluded"),
        *[of("human", v).alias(f"h_{v}") for v in ("accept", "reject", "uncertain")], *[of("v2", v).alias(f"v2_{v}") for v in ("accept", "reject")],
    )


@query("a12_confusion_3x2", _G + ", s AS (SELECT unnest(['stratified', 'control', 'combined']) AS scope), h AS (SELECT unnest(['accept', 'reject', 'uncertain']) AS r), v AS (SELECT unnest(['accept', 'reject']) AS c) SELECT scope, r AS \"row\", c AS \"column\", (SELECT count(*) FROM g WHERE human = r AND v2 = c AND (scope = 'combined' OR stratum = scope)) AS n FROM s, h, v")
def confusion(spark, d) -> DataFrame:
    return evaluate.confusion_by_scope(view(spark, d, GOLD), "stratum", "human", "v2", ["accept", "reject", "uncertain"], ["accept", "reject"])


@query("e01_metrics_by_scope", _G + _B + f", c AS (SELECT stratum AS scope, {_CELLS} FROM b GROUP BY stratum UNION ALL SELECT 'combined', {_CELLS} FROM b) SELECT scope, tp, fp, fn, tn, n, {_METRICS} FROM c")
def metrics_by_scope(spark, d) -> DataFrame:
    return evaluate.with_metrics(evaluate.by_scope(view(spark, d, GOLD), "stratum", _truth(), _judged()))


@query("e02_metrics_zero", _G + _B + f", c AS (SELECT source AS scope, {_CELLS} FROM b WHERE t = 1 GROUP BY source) SELECT scope, coalesce(round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 9), 0) AS mcc, coalesce(round(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 9), 0) AS f1 FROM c")
def metrics_zero(spark, d) -> DataFrame:
    cells = view(spark, d, GOLD).filter(_truth() == 1).groupBy(F.col("source").alias("scope")).agg(*evaluate.counts(_truth(), _judged()))
    return evaluate.with_metrics(cells, names=("mcc", "f1")).select("scope", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mcc", "f1")])


def _dimension(key: str, least: int | None) -> str:
    k = f"CASE WHEN n < {least} THEN '_other_(N<{least})' ELSE key END" if least else "key"
    return _G + _B + f", x AS (SELECT {key} AS key, {_CELLS}, sum(t) AS a FROM b WHERE t IS NOT NULL AND j IS NOT NULL GROUP BY 1), c AS (SELECT {k} AS key, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, sum(n)::BIGINT AS n, sum(a) AS a FROM x GROUP BY 1) SELECT key, tp, fp, fn, tn, n, round(a::DOUBLE / n, 9) AS accept_rate, {_METRICS} FROM c"


@query("a13_metrics_by_source", _dimension("source", 1560))
def metrics_by_source(spark, d) -> DataFrame:
    return evaluate.by_dimension(view(spark, d, GOLD), "source", _truth(), _judged(), 1560)


@query("a13_metrics_by_item", _dimension("item", 5))
def metrics_by_item(spark, d) -> DataFrame:
    return evaluate.by_dimension(view(spark, d, GOLD), "item", _truth(), _judged(), 5)


@query("a13_metrics_by_category", _dimension("category", None))
def metrics_by_category(spark, d) -> DataFrame:
    return evaluate.by_dimension(view(spark, d, GOLD), "category", _truth(), _judged())


_ERR = "count(*) AS n, count(*) FILTER (WHERE f = 1 AND t = 0) AS v1_fp, count(*) FILTER (WHERE f = 0 AND t = 1) AS v1_fn, count(*) FILTER (WHERE f <> t AND j = t) AS corrected, count(*) FILTER (WHERE f <> t AND j <> t) AS repeated, round(count(*) FILTER (WHERE f <> t AND j = t)::DOUBLE / nullif(count(*) FILTER (WHERE f <> t), 0), 9) AS correction_rate FROM b WHERE error_code IS NOT NULL AND f IS NOT NULL AND t IS NOT NULL AND j IS NOT NULL"


@query("a14_error_correction", _G + _B + f" SELECT error_code, {_ERR} GROUP BY error_code UNION ALL SELECT '_total', {_ERR}")
def error_correction(spark, d) -> DataFrame:
    return evaluate.error_correction(view(spark, d, GOLD), "error_code", _first(), _judged(), _truth())


@query("a15_audit", _G + " SELECT document_id, idx, item, stratum, human, v2, CASE WHEN human = 'accept' THEN 1 WHEN human = 'reject' THEN 0 END AS extractor_correct, CASE WHEN human = 'uncertain' OR v2 IS NULL THEN NULL ELSE (human = v2)::INT END AS pipeline_correct, (human = 'uncertain' OR v2 IS NULL)::INT AS excluded FROM g")
def audit(spark, d) -> DataFrame:
    out = (F.col("human") == "uncertain") | F.col("v2").isNull()
    return view(spark, d, GOLD).select("document_id", "idx", "item", "stratum", "human", "v2", _truth().alias("extractor_correct"), F.when(~out, (F.col("human") == F.col("v2")).cast("int")).alias("pipeline_correct"), out.cast("int").alias("excluded"))


@query("a16_by_label", _G + " SELECT human, v1, count(*) AS n, count(v2) AS n_with_v2, count(*) FILTER (WHERE v2 = 'accept') AS v2_accept, count(*) FILTER (WHERE v2 = 'reject') AS v2_reject, round(100.0 * count(*) FILTER (WHERE v2 = human)::DOUBLE / nullif(count(v2), 0), 6) AS agree_pct FROM g GROUP BY human, v1")
def by_label(spark, d) -> DataFrame:
    counts = view(spark, d, GOLD).groupBy("human", "v1").agg(F.count("*").alias("n"), F.count("v2").alias("n_with_v2"), F.count_if(F.col("v2") == "accept").alias("v2_accept"), F.count_if(F.col("v2") == "reject").alias("v2_reject"), F.count_if(F.col("v2") == F.col("human")).alias("agree"))
    return counts.withColumn("agree_pct", F.round(100.0 * F.try_divide(F.col("agree").cast("double"), F.col("n_with_v2")), 6)).drop("agree")


_ALPHA = ", p AS (SELECT {k} AS key, unnest([(human, v), (v, human)]) AS u FROM (SELECT *, {v} AS v FROM g) WHERE human IN ({w}) AND v IN ({w})), o AS (SELECT key, u[1] AS c, u[2] AS k, count(*)::DOUBLE AS o FROM p GROUP BY 1, 2, 3), m AS (SELECT key, c, sum(o) AS n FROM o GROUP BY 1, 2), z AS (SELECT key, sum(n) AS z FROM m GROUP BY 1)"
_NOMINAL = _ALPHA.format(k="source_group", v="v2", w="'accept', 'reject'") + " SELECT key AS source_group, (z / 2)::BIGINT AS n, round(1 - (z - 1) * (SELECT sum(o) FROM o WHERE o.key = z.key AND c <> k) / (SELECT sum(x.n * y.n) FROM m x, m y WHERE x.key = z.key AND y.key = z.key AND x.c <> y.c), 9) AS alpha FROM z"


@query("e03_alpha_nominal", _G + _NOMINAL)
def alpha_nominal(spark, d) -> DataFrame:
    return evaluate.alpha(view(spark, d, GOLD), ["source_group"], "human", "v2", ["reject", "accept"])


_ORD = "CASE {0} WHEN 'reject' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END"
_ORDINAL = _ALPHA.format(k="stratum", v="v1", w="'accept', 'reject', 'uncertain'") + f", r AS (SELECT key, n, {_ORD.format('c')} AS c FROM m), q AS (SELECT key, {_ORD.format('c')} AS c, {_ORD.format('k')} AS k, o FROM o), d AS (SELECT x.key, x.c, y.c AS k, x.n * y.n AS e, ((SELECT sum(n) FROM r WHERE r.key = x.key AND r.c BETWEEN least(x.c, y.c) AND greatest(x.c, y.c)) - (x.n + y.n) / 2) ^ 2 AS d2 FROM r x JOIN r y ON x.key = y.key AND x.c <> y.c) SELECT z.key AS stratum, (z / 2)::BIGINT AS n, round(1 - (z - 1) * (SELECT sum(o * d2) FROM q JOIN d USING (key, c, k) WHERE q.key = z.key) / (SELECT sum(e * d2) FROM d WHERE d.key = z.key), 9) AS alpha FROM z"


@query("e03_alpha_ordinal", _G + _ORDINAL)
def alpha_ordinal(spark, d) -> DataFrame:
    return evaluate.alpha(view(spark, d, GOLD), ["stratum"], "human", "v1", ["reject", "uncertain", "accept"], ordinal=True)


@query("e18_raw_agreement", _G + " SELECT stratum, count(*) AS n, round(count(*) FILTER (WHERE human = v2)::DOUBLE / count(*), 9) AS raw_agreement FROM g WHERE v2 IS NOT NULL GROUP BY stratum")
def raw_agreement(spark, d) -> DataFrame:
    rows = view(spark, d, GOLD).filter("v2 IS NOT NULL").groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("human") == F.col("v2")).alias("k"))
    return rows.select("stratum", "n", F.round(F.col("k").cast("double") / F.col("n"), 9).alias("raw_agreement"))


_CUTS = ", cuts AS (SELECT unnest(['full', 'stratified', 'control']) AS cut), lv AS (SELECT unnest(['binary', 'ordinal']) AS level), jd AS (SELECT unnest(['v1', 'v2']) AS judge), pr AS (SELECT cut, level, judge, " + _ORD.format("human") + " AS a, " + _ORD.format("CASE judge WHEN 'v1' THEN v1 ELSE v2 END") + " AS b FROM g, cuts, lv, jd WHERE (cut = 'full' OR stratum = cut) AND (judge = 'v1' OR v2 IS NOT NULL) AND (level = 'ordinal' OR (human <> 'uncertain' AND CASE judge WHEN 'v1' THEN v1 ELSE v2 END <> 'uncertain'))), un AS (SELECT cut, level, judge, unnest([a, b]) AS c FROM pr), mg AS (SELECT cut, level, judge, c, count(*)::DOUBLE AS n FROM un GROUP BY 1, 2, 3, 4), dl AS (SELECT x.cut, x.level, x.judge, x.c, y.c AS k, x.n * y.n AS e, CASE WHEN x.level = 'binary' THEN 1.0 ELSE ((SELECT sum(n) FROM mg WHERE mg.cut = x.cut AND mg.level = x.level AND mg.judge = x.judge AND mg.c BETWEEN least(x.c, y.c) AND greatest(x.c, y.c)) - (x.n + y.n) / 2) ^ 2 END AS d2 FROM mg x JOIN mg y ON x.cut = y.cut AND x.level = y.level AND x.judge = y.judge AND x.c <> y.c), ob AS (SELECT pr.cut, pr.level, pr.judge, count(*) AS n, sum(coalesce(d2, 0)) * 2 AS o FROM pr LEFT JOIN dl ON pr.cut = dl.cut AND pr.level = dl.level AND pr.judge = dl.judge AND pr.a = dl.c AND pr.b = dl.k GROUP BY 1, 2, 3)"


@query("e19_alpha_headline", _G + _CUTS + " SELECT cut, judge, level, n, round(1 - (2 * n - 1) * o / (SELECT sum(e * d2) FROM dl WHERE dl.cut = ob.cut AND dl.level = ob.level AND dl.judge = ob.judge), 9) AS alpha FROM ob")
def alpha_headline(spark, d) -> DataFrame:
    """All cuts and judges of a level in one pass."""
    cuts, judges = F.explode(F.array(F.lit("full"), "stratum")).alias("cut"), F.inline(F.array(*[F.struct(F.lit(j).alias("judge"), F.col(j).alias("judged")) for j in ("v1", "v2")]))
    rows = view(spark, d, GOLD).select("human", "stratum", "v1", "v2", cuts).select("human", "cut", judges)
    levels = {"binary": ["reject", "accept"], "ordinal": ["reject", "uncertain", "accept"]}
    one, two = (evaluate.alpha(rows, ["cut", "judge"], "human", "judged", values, level == "ordinal").select("cut", "judge", F.lit(level).alias("level"), "n", "alpha") for level, values in levels.items())
    return one.unionByName(two)


_SENS = " UNION ALL ".join(f"SELECT '{name}' AS scenario, stratum, t, {j} AS j FROM b" for name, j in (("complete", "j"), ("best", "coalesce(j, t)"), ("worst", "coalesce(j, 1 - t)")))


@query("e08_sensitivity", _G + _B + f", x AS ({_SENS}), c AS (SELECT scenario, stratum AS scope, {_CELLS} FROM x GROUP BY 1, 2 UNION ALL SELECT scenario, 'combined', {_CELLS} FROM x GROUP BY 1) SELECT scope, scenario, tp, fp, fn, tn, n, {_METRICS} FROM c")
def sensitivity(spark, d) -> DataFrame:
    return evaluate.sensitivity(view(spark, d, GOLD), "stratum", _truth(), _judged())


@query("e09_extractor_only", _G + _B + f", x AS (SELECT * REPLACE (1 AS j) FROM b), c AS (SELECT stratum AS scope, {_CELLS} FROM x GROUP BY stratum UNION ALL SELECT 'combined', {_CELLS} FROM x) SELECT scope, tp, fp, fn, tn, n, {_METRICS} FROM c")
def extractor_only(spark, d) -> DataFrame:
    return evaluate.with_metrics(evaluate.by_scope(view(spark, d, GOLD), "stratum", _truth(), F.lit(1)))


@query("e04_bootstrap_bca")
def bootstrap(spark, d) -> DataFrame:
    return evaluate.bootstrap(view(spark, d, GOLD), "stratum", _truth(), _judged())


@query("e05_bootstrap_clipped")
def bootstrap_clipped(spark, d) -> DataFrame:
    return evaluate.bootstrap(view(spark, d, GOLD), "stratum", _truth(), _judged(), metric="kappa", method="clipped")


@query("e06_bootstrap_percentile")
def bootstrap_percentile(spark, d) -> DataFrame:
    return evaluate.bootstrap(view(spark, d, GOLD), "stratum", _truth(), _judged(), metric="kappa", method="percentile")


@query("e07_post_stratified", _G + _B + f", c AS (SELECT stratum AS scope, {_CELLS} FROM b GROUP BY stratum), w AS (SELECT stratum AS scope, count(*) AS w FROM g GROUP BY stratum) SELECT round(sum(2.0 * tp::DOUBLE / (2 * tp + fp + fn) * w) / sum(w), 8) AS point FROM c JOIN w USING (scope)")
def post_stratified(spark, d) -> DataFrame:
    gold = view(spark, d, GOLD)
    points = evaluate.with_metrics(gold.groupBy(F.col("stratum").alias("scope")).agg(*evaluate.counts(_truth(), _judged())), names=("f1",)).select("scope", F.col("f1").alias("point"))
    return evaluate.post_stratified(points, gold.groupBy(F.col("stratum").alias("scope")).agg(F.count("*").alias("n"))).select(F.round("point", 8).alias("point"))


_TOST = "SELECT a / n AS p_one, b / m AS p_other, n, m FROM (SELECT count(*) FILTER (WHERE human = 'accept')::DOUBLE AS a, count(*)::DOUBLE AS n, count(*) FILTER (WHERE v2 = 'accept')::DOUBLE AS b, count(v2)::DOUBLE AS m FROM g)"


@query("e10_tost", _G + f", x AS ({_TOST}), e AS (SELECT p_one, p_other, p_one - p_other AS difference, sqrt(p_one * (1 - p_one) / n + p_other * (1 - p_other) / m) AS se FROM x) SELECT round(p_one, 9) AS p_one, round(p_other, 9) AS p_other, round(difference, 9) AS difference, round(se, 9) AS standard_error, round((difference + 0.05) / se, 6) AS z_low, round((difference - 0.05) / se, 6) AS z_high, round(abs(difference) + se * 1.6448536269514715, 6) AS delta_min FROM e")
def tost(spark, d) -> DataFrame:
    sums = view(spark, d, GOLD).agg(F.count_if(F.col("human") == "accept").cast("double").alias("a"), F.count("*").cast("double").alias("n"), F.count_if(F.col("v2") == "accept").cast("double").alias("b"), F.count("v2").cast("double").alias("m"))
    found = evaluate.tost(*(F.col(c) for c in ("a", "n", "b", "m")))
    return sums.select(*[F.round(v, 6 if k[0] == "z" else 9).alias(k) for k, v in found.items()], F.round(evaluate.least_delta(found["difference"], found["standard_error"]), 6).alias("delta_min"))


# the normal distribution by its series 1/2 + density(z) * sum of z^(2k+1) / (1 * 3 * ... * (2k+1)); beyond 8 it is 0 or 1 to nine digits
_PHI = "CASE WHEN {z} > 8 THEN 1.0::DOUBLE WHEN {z} < -8 THEN 0.0::DOUBLE ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: CASE WHEN {z} = 0 THEN 0.0 ELSE exp((2 * k + 1) * ln(abs({z})) + 0.5 * ln(pi()) - (k + 1) * ln(2.0::DOUBLE) - lgamma(k + 1.5)) END)) END"
_P = {"p_low": f"1 - {_PHI.format(z='z_low')}", "p_high": _PHI.format(z="z_high")}


@query("e10_tost_p_values", _G + f", x AS ({_TOST}), e AS (SELECT p_one, p_other, p_one - p_other AS difference, sqrt(p_one * (1 - p_one) / n + p_other * (1 - p_other) / m) AS se FROM x), t AS (SELECT round(p_one, 9) AS p_one, round(p_other, 9) AS p_other, round(difference, 9) AS difference, round(se, 9) AS standard_error, round((difference + 0.05) / se, 6) AS z_low, round((difference - 0.05) / se, 6) AS z_high, round(abs(difference) + se * 1.6448536269514715, 6) AS delta_min FROM e) SELECT *, round({_P['p_low']}, 7) AS p_low, round({_P['p_high']}, 7) AS p_high, greatest({_P['p_low']}, {_P['p_high']}) < 0.05 AS equivalence_proven FROM t")
def tost_p_values(spark, d) -> DataFrame:
    return tost(spark, d).withColumns({"p_low": F.round(stats.normal_cdf(-F.col("z_low")), 7), "p_high": F.round(stats.normal_cdf(F.col("z_high")), 7)}).withColumn("equivalence_proven", F.greatest("p_low", "p_high") < 0.05)


_LAB = "WITH x AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) + 40 AS c FROM labels), y AS (SELECT b, c, unnest(range(0, least(b, c) + 1)) AS i FROM x) "


@query("e15_mcnemar", _LAB + "SELECT b, c, round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE)))), 9) AS p_value FROM y GROUP BY b, c")
def mcnemar(spark, d) -> DataFrame:
    one, two = (F.col("quality") == 1) & (F.col("toxic") == 0), (F.col("quality") == 0) & (F.col("toxic") == 1)
    found = table(spark, d, "labels").agg(F.count_if(one).alias("b"), (F.count_if(two) + 40).alias("c"))
    return found.withColumn("p_value", F.round(stats.mcnemar(F.col("b"), F.col("c")), 9))


@query("e16_binomial_tail", "WITH x AS (SELECT label, count(*) FILTER (WHERE vec_id % 2 = 0) AS k, count(*) AS n FROM embeddings GROUP BY label), y AS (SELECT label, k, n, unnest(range(k, n + 1)) AS i FROM x) SELECT label, k, n, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5::DOUBLE)))), 9) AS p_value FROM y GROUP BY label, k, n")
def binomial_tail(spark, d) -> DataFrame:
    found = table(spark, d, "embeddings").groupBy("label").agg(F.count_if(F.col("vec_id") % 2 == 0).alias("k"), F.count("*").alias("n"))
    return found.withColumn("p_value", F.round(stats.binomial_tail(F.col("k"), F.col("n"), F.lit(0.5)), 9))


@query("e17_binomial_larger_tail", "WITH x AS (SELECT label, count(*) FILTER (WHERE vec_id % 2 = 0) AS k, count(*) AS n FROM embeddings GROUP BY label), y AS (SELECT label, k, n, unnest(range(0, n + 1)) AS i FROM x), z AS (SELECT label, k, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5::DOUBLE))) FILTER (WHERE i >= k) AS hi, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5::DOUBLE))) FILTER (WHERE i <= k) AS lo FROM y GROUP BY 1, 2, 3) SELECT label, k, n, round(least(1.0, greatest(hi, lo)), 9) AS p_value FROM z")
def binomial_larger_tail(spark, d) -> DataFrame:
    found = table(spark, d, "embeddings").groupBy("label").agg(F.count_if(F.col("vec_id") % 2 == 0).alias("k"), F.count("*").alias("n"))
    upper = stats.binomial_tail(F.col("k"), F.col("n"), F.lit(0.5))
    lower = stats.binomial_tail(F.col("n") - F.col("k"), F.col("n"), F.lit(0.5))
    return found.withColumn("p_value", F.round(F.greatest(upper, lower), 9))


@query("a34_rater_agreement", _G + " SELECT stratum, count(*) AS n, round(avg((v1 = v2)::INT::DOUBLE), 9) AS accuracy, count(*) FILTER (WHERE v1 = 'accept' AND v2 = 'reject') AS removed FROM g WHERE v2 IS NOT NULL GROUP BY stratum")
def rater_agreement(spark, d) -> DataFrame:
    return view(spark, d, GOLD).filter("v2 IS NOT NULL").groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg((F.col("v1") == F.col("v2")).cast("double")), 9).alias("accuracy"), F.count_if((F.col("v1") == "accept") & (F.col("v2") == "reject")).alias("removed"))


@query("a27_progress", _G + " SELECT count(*) AS total, count(v2) AS done, round(100.0 * count(v2)::DOUBLE / count(*), 1) AS pct, count(*) FILTER (WHERE stratum = 'control') AS control, round(100.0 * count(*) FILTER (WHERE human = v2)::DOUBLE / count(v2), 1) AS agreement_pct FROM g")
def progress(spark, d) -> DataFrame:
    sums = view(spark, d, GOLD).agg(F.count("*").alias("total"), F.count("v2").alias("done"), F.count_if(F.col("stratum") == "control").alias("control"), F.count_if(F.col("human") == F.col("v2")).alias("agree"))
    pct = lambda a, b: F.round(100.0 * F.col(a).cast("double") / F.col(b), 1)
    return sums.select("total", "done", pct("done", "total").alias("pct"), "control", pct("agree", "done").alias("agreement_pct"))


@query("a28_a29_distributions", ctes(n=ANNOTATIONS) + "SELECT v1, v2, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM n GROUP BY v1, v2")
def distributions(spark, d) -> DataFrame:
    return evaluate.shares(view(spark, d, ANNOTATIONS), "v1", "v2")
