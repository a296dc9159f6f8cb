"""Quality rules: a decision list learned by sequential covering, run as ordered Spark conditions.

Statistics of a text are plain DataFrame expressions. A bounded sample of
labelled documents is brought to the driver as numbers only; there rules are
grown condition by condition for information gain on two thirds of it, pruned
on the other third, and kept while they are precise. The list becomes one
CASE expression, so judging the corpus needs no Python and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bounded_sample, let, table, words

#: Numbers per text that conditions may test.
FEATURES = ("mean_word_chars", "symbols_per_word", "bangs_per_word", "upper_share", "dup_line_share", "repeat_word_share")
#: Labelled rows that the list is learned from, at most.
SAMPLE_ROWS = 6000


def _repeated(w: Column) -> Column:
    """Words of w, an array, that lie in a window of three words which w has twice or more."""
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def positions(s: Column) -> Column:
        alike = lambda x, other: F.coalesce(F.get(s, other)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, j: alike(x, j - 1) | alike(x, j + 1)), lambda x: x["i"])

    def covered(h: Column) -> Column:
        in_order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        every = lambda at: F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))))
        return let(in_order, lambda s: let(positions(s), every))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def with_stats(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and FEATURES (double) to docs (text, ...).

    Null and empty texts have zero everywhere. Windows of three words are compared by a 64-bit hash.
    Other columns stay; those named like an added one are replaced. Work is n log n in a text's words,
    and only texts that repeat a window sort anything.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]
    own = [c for c in docs.columns if c not in added]
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    counted = docs.select(
        F.struct(*own).alias("row"), let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("repeated"))).alias("words"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated"))).alias("lines"),
        F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("chars"), count("[#*$%&|<>]").alias("symbols"), count("!").alias("bangs"), count("[A-Z]").alias("upper"),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.select(
        *[F.col("row")[c].alias(c) for c in own], F.col("words.n").alias("n_words"), F.col("chars").alias("word_chars"), F.col("symbols").alias("n_symbols"), F.col("lines.repeated").alias("n_dup_lines"), F.col("words.repeated").alias("n_repeat_words"),
        per("chars", "words.n").alias("mean_word_chars"), per("symbols", "words.n").alias("symbols_per_word"), per("bangs", "words.n").alias("bangs_per_word"),
        per("upper", "chars").alias("upper_share"), per("lines.repeated", "lines.n").alias("dup_line_share"), per("words.repeated", "words.n").alias("repeat_word_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def fits(self, row) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold

    def column(self) -> Column:
        c, t = F.col(FEATURES[self.feature]), F.lit(self.threshold)
        return c >= t if self.above else c < t

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _fits(rule: Rule, row) -> bool:
    return all(c.fits(row) for c in rule)


def _best_condition(bad: list, good: list) -> tuple[float, Condition | None]:
    """The threshold condition with the highest information gain for the bad rows among those given."""
    p0, n0 = len(bad), len(good)
    start = math.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (1e-9, None)
    for f in range(len(FEATURES)):
        both = sorted([(r[f], 1) for r in bad] + [(r[f], 0) for r in good])
        p = n = 0
        for i, (v, is_bad) in enumerate(both):
            if i and v > both[i - 1][0]:
                cut = (v + both[i - 1][0]) / 2
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a and (gain := a * (math.log2(a / (a + b)) - start)) > best[0]:
                        best = gain, Condition(f, above, cut)
            p, n = p + is_bad, n + 1 - is_bad
    return best


def learn(rows: list[tuple], bad: list[bool], most_rules: int = 16, most_conditions: int = 4, precision: float = 0.9) -> list[Rule]:
    """Sequential covering: rules that reject, in order. rows: FEATURES of each; bad: whether it is to be rejected.

    Every third row is kept for pruning. A rule ends the list if it is right on less than `precision` of
    the pruning rows that it covers; without bad rows, or without good ones, the list is empty.
    """
    order = sorted(range(len(rows)), key=lambda i: (rows[i], bad[i]))  # so that the order of the input does not matter
    sets = {(held, b): [rows[i] for k, i in enumerate(order) if (k % 3 == 2) is held and bad[i] is b] for held in (False, True) for b in (False, True)}
    found: list[Rule] = []
    if not all(sets.values()):
        return found
    while len(found) < most_rules and sets[False, True]:
        p, n, rule = sets[False, True], sets[False, False], ()
        while n and len(rule) < most_conditions:
            _, c = _best_condition(p, n)
            if c is None:
                break
            rule, p, n = (*rule, c), [r for r in p if c.fits(r)], [r for r in n if c.fits(r)]
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            a, b = (sum(_fits(r, x) for x in sets[True, kind]) for kind in (True, False))
            return ((a - b) / (a + b) if a + b else -1.0, a)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        a, b = (sum(_fits(rule, x) for x in sets[True, kind]) for kind in (True, False))
        if not a or a < precision * (a + b):
            break
        found.append(rule)
        for key in sets:
            sets[key] = [x for x in sets[key] if not _fits(rule, x)]
    return found


def verdict(rules: list[Rule]) -> Column:
    """True to keep: the first rule that fits rejects, the default keeps."""
    conditions = [reduce(lambda a, b: a & b, (c.column() for c in rule)) for rule in rules]
    if not conditions:
        return F.lit(True)
    case = F.when(conditions[0], F.lit(False))
    for c in conditions[1:]:
        case = case.when(c, F.lit(False))
    return case.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from at most sample_rows labelled documents, those with the smallest hashes of their doc_id; nulls take no part.

    A doc_id counts once: with its smaller label, if it has several, and with the text of the smallest hash.
    Documents that fail the base conditions are none of the learned list's business and left out.
    The sample is written first, so that statistics are computed for its texts only.
    """
    sample = bounded_sample(docs, labels.filter("quality IN (0, 1)").select("doc_id", "quality"), sample_rows, F.xxhash64("doc_id"))
    rows = with_stats(sample).filter(~base_failed()).select("quality", *FEATURES).collect()  # numbers of sample_rows documents at most
    return learn([tuple(r)[1:] for r in rows], [r["quality"] == 0 for r in rows])


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the statistics, base_failed and kept. Nulls and empty texts fail the base conditions."""
    own = [c for c in docs.columns if c not in ("base_failed", "kept")]
    judged = with_stats(docs.select(*own)).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The statistics and verdict of every document, by the list learned from the labelled sample; null and empty texts fail the base conditions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
