"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A bounded sample of labelled texts is used. A lexicon of word beginnings is
learned by their odds in toxic texts; the features that the trees and the
calibration are learned from come from a lexicon of the other half of the
sample, and the calibration from texts that the trees haven't seen, so that
each sees the others' output as it is on new texts. Counting the lexicon and computing
features are Spark jobs; numbers only reach the driver. The model is a few
thousand numbers, and scoring is one pass over the corpus without a shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .pieces import Bounded
from .text import bounded_sample, crc_mod, materialize, table

#: Labelled rows that everything is learned from, at most: two thirds for the trees, the rest for calibration, all for the lexicon.
SAMPLE_ROWS = 12_000
#: Entries of the lexicon, at most.
LEXICON_ENTRIES = 2_000
THRESHOLD = 0.3
# Second-person words of the four languages, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself youre u ya du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
FEATURES = ("entries", "entry_weight", "top_weight", "hit_rate", "strong_rate", "second_person_rate", "second_person_near", "capital_share", "capital_word_share", "bang_rate", "punctuation_rate", "obfuscated_hit_rate", "obfuscated_rate", "log_words")

_INNER = re.compile(r"[^\W\d_][\d@$!€*._\-]+[^\W\d_]")
_LETTERS = re.compile(r"[\W\d_]+")
_NEAR = 12


def plain(word: str) -> str:
    """Letters of a word in lower case."""
    return _LETTERS.sub("", word.lower())


def unmasked(word: str) -> str:
    """A word with what stands for letters inside it put back."""
    core = word.lower().strip(".,;:!?\"'()[]{}")
    return _LETTERS.sub("", core.translate(STANDS_FOR))


def beginnings(word: str) -> list[str]:
    """What the lexicon may know of a word: its beginnings of 4 to 6 letters, and itself (marked by a dot)."""
    return [word[:n] for n in (4, 5, 6) if len(word) >= n] + ([word + "."] if len(word) > 1 else [])


def terms(text: str | None) -> set[str]:
    words = {*(text or "").split()}
    return {t for w in words for v in {plain(w), unmasked(w)} for t in beginnings(v)}


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    base: float
    rate: float
    trees: tuple  # each (features, thresholds, values), complete trees by level
    steps: tuple[tuple[float, ...], tuple[float, ...]]  # calibration: raw scores, probabilities


class Features:
    """Features of texts by a lexicon; words are remembered in a bounded table."""

    def __init__(self, lexicon: dict[str, float]):
        self.weights = [0.0, *lexicon.values()]
        self.number = {t: k for k, t in enumerate(lexicon, 1)}
        self.memo = Bounded(self._code, 300_000)

    def _best(self, word: str) -> int:
        return max((k for t in beginnings(word) if (k := self.number.get(t))), key=self.weights.__getitem__, default=0)

    def _code(self, word: str) -> int:
        """Entry number * 8, + 1 if only unmasking finds it, + 2 for second person, + 4 for a masked word."""
        p = plain(word)
        masked = bool(_INNER.search(word))
        k = self._best(p)
        hidden = self._best(unmasked(word)) if masked and not k else 0
        return (k or hidden) * 8 + (1 if hidden else 0) + (2 if p in SECOND_PERSON else 0) + (4 if masked else 0)

    def of(self, text: str | None) -> list[float]:
        """FEATURES of a text; all zero for null, empty and blank ones."""
        words = (text or "").split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        codes = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=n)
        odd = np.flatnonzero(codes)
        found = codes[odd] >> 3
        at, found = odd[found > 0], found[found > 0]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        spelled = self._spelled(words, lengths)
        weights = np.array(self.weights)
        own = np.unique(np.concatenate([found, np.array(spelled, dtype=np.int64)]))
        second = odd[(codes[odd] & 2) > 0]
        near = 0.0
        if len(at) and len(second):
            k = np.searchsorted(second, at)
            distance = np.minimum(np.abs(second[np.minimum(k, len(second) - 1)] - at), np.abs(second[np.maximum(k - 1, 0)] - at))
            near = float(np.maximum(0, 1 - distance / _NEAR).max())
        b = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
        upper, lower = int(b[65:91].sum()), int(b[97:123].sum())
        punctuation = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
        hidden = int(((codes[odd] & 1) > 0).sum()) + len(spelled)
        return [
            float(len(own)), float(weights[own].sum()), float(weights[own].max()) if len(own) else 0.0, (len(at) + len(spelled)) / n, float((weights[found] >= 3).sum()) / n,
            len(second) / n, near, upper / max(upper + lower, 1), sum(map(str.isupper, words)) / n, (int(b[33]) + int(b[63])) / n, punctuation / n, hidden / n, int(((codes[odd] & 4) > 0).sum()) / n, math.log1p(n),
        ]

    def _spelled(self, words: list[str], lengths: np.ndarray) -> list[int]:
        """Entries that runs of four or more single letters spell."""
        single = np.concatenate(([False], lengths == 1, [False]))
        edges = np.flatnonzero(single[1:] != single[:-1])
        runs = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= 4]
        return [k for a, b in runs if (k := self._best(unmasked("".join(words[a:b]))))]


def _grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, edges: list[np.ndarray], depth: int, least: int) -> tuple:
    """One complete regression tree on binned features, by level; (features, thresholds, leaf values)."""
    node = np.zeros(len(bins), dtype=np.int64)
    feature, threshold = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
    for level in range(depth):
        below = np.zeros_like(node)
        for k in range(2**level):
            rows = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf)
            g, h = gradient[rows].sum(), hessian[rows].sum()
            if len(rows) >= 2 * least:
                for f, cuts in enumerate(edges):
                    if not len(cuts):
                        continue
                    b, size = bins[rows, f], len(cuts) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (gradient[rows], hessian[rows], None))
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    c = int(gain.argmax())
                    if gain[c] > best[0]:
                        best = (float(gain[c]), f, float(cuts[c]))
            at = 2**level - 1 + k
            feature[at], threshold[at] = best[1], best[2]
            below[rows] = 2 * k + (bins[rows, best[1]] > np.searchsorted(edges[best[1]], best[2]) if np.isfinite(best[2]) else 0)
        node = below
    value = np.array([-gradient[node == k].sum() / (hessian[node == k].sum() + 1) for k in range(2**depth)])
    return feature, threshold, value


def _leaves(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, threshold, value = tree
    node = np.zeros(len(x), dtype=np.int64)
    depth = len(value).bit_length() - 1
    for level in range(depth):
        at = 2**level - 1 + node
        node = 2 * node + (x[np.arange(len(x)), feature[at]] > threshold[at])
    return value[node]


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, rate: float = 0.15, depth: int = 3, least: int = 8, bins: int = 48) -> tuple[float, float, tuple]:
    """Logistic gradient boosting; deterministic."""
    p = min(max(float(y.mean()), 1e-4), 1 - 1e-4) if len(y) else 0.1
    base = math.log(p / (1 - p))
    if len(y) < 2 * least or y.min() == y.max():
        return base, rate, ()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    raw, grown = np.full(len(y), base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        tree = _grow(binned, q - y, q * (1 - q), edges, depth, least)
        raw += rate * _leaves(tree, x)
        grown.append(tree)
    return base, rate, tuple(grown)


def raw_scores(model: Model, x: np.ndarray) -> np.ndarray:
    return model.base + sum((model.rate * _leaves(t, x) for t in model.trees), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Pool adjacent violators: raw scores and the probabilities there, not falling. Without both labels: none."""
    if not len(y) or y.min() == y.max():
        return (), ()
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of raw scores
    values, starts = np.unique(raw[order], return_index=True)
    for v, a, b in zip(values, starts, [*starts[1:], len(raw)]):
        blocks.append([float(y[order][a:b].sum()), float(b - a), float(v * (b - a))])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return tuple(s / n for _, n, s in blocks), tuple(t / n for t, n, _ in blocks)


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    raw = raw_scores(model, x)
    smooth = 1 / (1 + np.exp(-raw))
    return 0.999 * np.interp(raw, *model.steps) + 0.001 * smooth if model.steps[0] else smooth  # a little of the raw score keeps the order within a step


def lexicons(texts: DataFrame, entries: int = LEXICON_ENTRIES, least: int = 3, share: float = 0.004, weight: float = 1.5) -> list[dict[str, float]]:
    """Of texts (text, toxic, half): the lexicon of all, of half 0 and of half 1.

    A term's weight is its log odds in toxic against other texts, less half their standard error. It
    counts if `least` toxic texts and a `share` of them have it; the `entries` with the highest weights stay.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                columns = (c.to_pylist() for c in batch.slice(at, 64).columns)
                found = [(t, y, h) for text, y, h in zip(*columns) for t in terms(text)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["term", "toxic", "half"])

    whether = {"all": F.lit(1), "0": 1 - F.col("half"), "1": F.col("half")}
    sums = [x for k, of in whether.items() for x in (F.sum(F.col("toxic") * of).alias(f"t{k}"), F.sum((1 - F.col("toxic")) * of).alias(f"n{k}"))]
    numbers = texts.select("text", F.col("toxic").cast("long"), F.col("half").cast("long"))
    size = numbers.agg(*sums).first()
    counted = materialize(numbers.mapInArrow(run, "term string, toxic long, half long").groupBy("term").agg(*sums).filter(F.col("tall") >= least), "terms")
    found = []
    for k in whether:
        t, n, all_t, all_n = F.col(f"t{k}") + 0.5, F.col(f"n{k}") + 0.5, (size[f"t{k}"] or 0) + 1.0, (size[f"n{k}"] or 0) + 1.0
        w = F.round(F.log(t / all_t) - F.log(n / all_n) - 0.5 * F.sqrt(1 / t + 1 / n), 9)
        best = counted.filter(F.col(f"t{k}") >= max(least, share * all_t)).select("term", w.alias("w")).filter(F.col("w") >= weight).orderBy(F.desc("w"), "term").limit(entries)
        found.append({r["term"]: r["w"] for r in best.collect()})
    return found


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most sample_rows labelled documents, those with the smallest hashes of their doc_id; nulls take no part.

    A doc_id counts once: with its smaller label, if it has several, and with the text of the smallest hash.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    part = F.pmod(key, F.lit(6)).cast("int")
    found = bounded_sample(docs, labels.filter("toxic IN (0, 1)").select("doc_id", "toxic"), sample_rows, key)
    sample = found.select("text", "toxic", part.alias("part"), (part % 2).alias("half"))
    whole, *halves = lexicons(sample)
    rows = [r for k in (0, 1) for r in with_features(sample.filter(F.col("half") == k), halves[1 - k], ["part", "toxic"]).collect()]  # numbers of sample_rows rows at most
    data = np.array(sorted((float(r["part"]), float(r["toxic"]), *r["features"]) for r in rows)).reshape(-1, 2 + len(FEATURES))
    learn, hold = data[data[:, 0] < 4], data[data[:, 0] >= 4]
    base, rate, trees = boost(learn[:, 2:], learn[:, 1])
    model = Model(whole, base, rate, trees, ((), ()))
    return Model(whole, base, rate, trees, isotonic(raw_scores(model, hold[:, 2:]), hold[:, 1]))


def with_features(texts: DataFrame, lexicon: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys..., features array<double>) for texts (text, keys...)."""
    schema = texts.select(*keys).schema.add("features", ArrayType(DoubleType()))

    def run(batches):
        features = Features(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [features.of(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(made, pa.list_(pa.float64()))], names=schema.names)

    return texts.select("text", *keys).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double) for every row of docs (doc_id, text): 0 to 1, higher for toxic texts. Null and empty texts have a score too."""
    schema = docs.select("doc_id").schema.add("score", "double")

    def run(batches):
        features = Features(model.lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.array([features.of(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(probabilities(model, x))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: it isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
