"""Machine-made JSON annotations: parsing, adherence to a schema, validation, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORE = ("item", "category", "quote")
STRICT = (*CORE, "name", "confidence")


def adherence_rows(rows: DataFrame, key: str, text: str, core: tuple[str, ...] = CORE, strict: tuple[str, ...] = STRICT) -> DataFrame:
    """Per row: parseable, elements, elements with all core and all strict keys, and whether all of a row's elements have.

    Presence of a key counts, its value may be null. Null and empty texts count as an empty array; a JSON
    null or object isn't parseable; elements that are no objects fail their row but aren't counted.
    """
    x = F.coalesce(F.nullif(F.trim(F.col(text)), F.lit("")), F.lit("[]"))
    parsed = F.try_parse_json(x)
    elements = F.when(F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False)), F.from_json(x, "array<string>"))
    keys = F.transform(elements, lambda e: F.json_object_keys(e))
    objects = F.filter(keys, lambda k: k.isNotNull())
    has = lambda names: F.size(F.filter(objects, lambda k: F.size(F.array_except(F.array(*map(F.lit, names)), k)) == 0))
    found = rows.withColumn("__e", elements).select(
        *rows.columns, F.col("__e").isNotNull().alias("parseable"), F.coalesce(F.size(objects), F.lit(0)).alias("n_elements"), F.coalesce(F.size("__e"), F.lit(0)).alias("__all"), F.coalesce(has(core), F.lit(0)).alias("core_ok"), F.coalesce(has(strict), F.lit(0)).alias("strict_ok"), F.coalesce(objects, F.array().cast("array<array<string>>")).alias("__keys")
    )
    whole = lambda n: F.col("parseable") & (F.col("n_elements") == F.col("__all")) & (F.col(n) == F.col("n_elements"))
    return found.withColumns({"row_core_ok": whole("core_ok"), "row_strict_ok": whole("strict_ok")}).drop("__all")


def adherence_summary(found: DataFrame) -> DataFrame:
    """(metric, numerator, denominator, percent): parseable, core and strict rows, core and strict elements."""
    sums = found.agg(F.count("*").alias("rows"), F.count_if("parseable").alias("parseable"), F.count_if("row_core_ok").alias("rows_core"), F.count_if("row_strict_ok").alias("rows_strict"), F.sum("n_elements").alias("elements"), F.sum("core_ok").alias("elements_core"), F.sum("strict_ok").alias("elements_strict"))
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("numerator"), F.col("elements" if m.startswith("elements") else "rows").cast("long").alias("denominator")) for m in ("parseable", "rows_core", "rows_strict", "elements_core", "elements_strict")])
    return sums.select(F.inline(metrics)).withColumn("percent", F.round(100.0 * F.try_divide(F.col("numerator").cast("double"), F.col("denominator")), 2))


def missing_keys(found: DataFrame, strict: tuple[str, ...] = STRICT) -> DataFrame:
    """(field, n): elements without a key, for every key of the strict set."""
    each = found.select(F.explode("__keys").alias("k"))
    sums = each.agg(*[F.count_if(~F.array_contains("k", f)).alias(f) for f in strict])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in strict])))


def validate(elements: DataFrame, catalogue: DataFrame, body: str = "body", key: str = "document_id") -> DataFrame:
    """elements (key, idx, item, sub, category, quote, body) checked against catalogue (id, name, categories array).

    Issues: unknown item, a category that the item doesn't have (replaced by its first), a quote that is
    not in the body (whole, ignoring case; else its first four words of more than three letters, all), a
    sub-item that isn't one of the item's, a repeated (item, sub) of a document. Valid: no issue.
    """
    known = catalogue.select(F.col("id").alias("__id"), F.col("name").alias("__name"), F.col("categories").alias("__categories"))
    joined = elements.join(known, F.col("item") == F.col("__id"), "left")
    low, quote = F.lower(body), F.lower(F.trim("quote"))
    first_words = F.slice(F.filter(F.split(quote, "\\W+"), lambda w: F.length(w) > 3), 1, 4)
    grounded = F.contains(low, quote) | ((F.size(first_words) > 0) & F.forall(first_words, lambda w: F.contains(low, w)))
    place = F.row_number().over(Window.partitionBy(key, "item", "sub").orderBy("idx"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("__id").isNull(), "unknown_item"), F.when(F.col("__id").isNotNull() & ~F.array_contains("__categories", F.col("category")), "category_corrected"), F.when(~F.coalesce(grounded, F.lit(False)), "quote_not_found"),
            F.when(F.col("sub").isNotNull() & ~F.startswith("sub", F.concat("item", F.lit("."))), "sub_item_mismatch"), F.when(F.col("__place") > 1, "duplicate"),
        )
    )
    checked = joined.withColumn("__place", place).withColumn("issues", issues)
    fixed = F.when(F.array_contains("issues", "category_corrected"), F.get("__categories", F.lit(0))).otherwise(F.col("category"))
    return checked.select(key, "idx", "item", "sub", F.coalesce("__name", "item").alias("name"), fixed.alias("category"), "issues", (F.size("issues") == 0).alias("valid"))


def parse_verdict(raw: Column, labels: tuple[str, ...] = ("accept", "reject", "uncertain")) -> Column:
    """struct<verdict, parse_failure>: strict JSON, else the first {...} that holds a verdict, else uncertain and a failure."""
    of = lambda text: F.lower(F.get_json_object(text, "$.verdict"))
    inner = F.regexp_extract(raw, '\\{[^{}]*"verdict"[^{}]*\\}', 0)
    strict = F.when(F.try_parse_json(raw).isNotNull(), of(raw))
    found = F.coalesce(strict, F.when(inner != "", of(inner)))
    known = found.isin(*labels)
    return F.struct(F.when(F.coalesce(known, F.lit(False)), found).otherwise("uncertain").alias("verdict"), (~F.coalesce(known, F.lit(False))).alias("parse_failure"))


def response_checks(raw: Column) -> Column:
    """struct<parses, item_ok, category_ok>: a response, in a fence or not, as JSON with well-formed ids."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), "^```[a-z]*\\s*", ""), "\\s*```$", "")
    parses = F.try_parse_json(bare).isNotNull()
    item, category = F.get_json_object(bare, "$.item"), F.get_json_object(bare, "$.category")
    return F.struct(parses.alias("parses"), F.coalesce(parses & item.rlike("^T\\d{4}(\\.\\d{3})?$"), F.lit(False)).alias("item_ok"), F.coalesce(parses & category.rlike("^TA\\d{4}$"), F.lit(False)).alias("category_ok"))


def outcome(body: Column, reason: Column, tries: Column, error: Column, dry: bool = False, most_tries: int = 3) -> Column:
    """What becomes of a document: failed without a body, filtered by a reason, dry-run, failed after the last try, retry, completed."""
    return (
        F.when(F.coalesce(F.trim(body), F.lit("")) == "", "failed").when(reason.isNotNull(), "filtered").when(F.lit(dry), "dry_run").when(error.isNotNull() & (tries >= most_tries), "failed").when(error.isNotNull(), "retry").otherwise("completed")
    )


def set_scores(made: DataFrame, accepted: DataFrame, rejected: DataFrame, by: str = "model", document: str = "document_id", item: str = "item") -> DataFrame:
    """tp, fp, fn, unknown, precision, recall, f1 by model over (document, item) sets; an item both accepted and rejected counts as accepted.

    made: (by, document, item); false negatives are accepted items of documents that the model has processed.
    """
    key = [document, item]
    m = made.select(by, *key).distinct()
    a, r = accepted.select(*key).distinct().withColumn("__a", F.lit(1)), rejected.select(*key).distinct().withColumn("__r", F.lit(1))
    hits = m.join(a, key, "left").join(r, key, "left").groupBy(by).agg(F.count("__a").alias("tp"), F.count_if(F.col("__a").isNull() & F.col("__r").isNotNull()).alias("fp"), F.count_if(F.col("__a").isNull() & F.col("__r").isNull()).alias("unknown"))
    missed = m.select(by, document).distinct().join(a.drop("__a"), document).join(m, [by, *key], "left_anti").groupBy(by).agg(F.count("*").alias("fn"))
    joined = hits.join(missed, by, "left").withColumn("fn", F.coalesce("fn", F.lit(0)))
    p, q = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return joined.select(by, "tp", "fp", "fn", "unknown", F.round(p, 9).alias("precision"), F.round(q, 9).alias("recall"), F.round(F.try_divide(2 * p * q, p + q), 9).alias("f1"))
