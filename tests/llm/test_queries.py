"""The registered queries on small tables of their own, against definitions written here."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quarrylane.llm import entry, pieces, quality, toxicity

from .test_llm import DOCS, ODD_TEXTS, brute_fingerprint, brute_lm, brute_stats


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, documents, labels): odd and ordinary texts, near copies, good and bad, toxic and plain ones."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD_TEXTS)
    for n in range(240):
        w = [rng.choice(words) for _ in range(rng.choice([20, 60, 90]))]
        if n % 4 == 0:
            w = [x + "#$%" if k % 2 else x for k, x in enumerate(w)]
        if n % 5 == 0:
            w[3:6] = ["you", "dumbhead", "SHUT!!"]
        texts.append(" ".join(w))
        if n % 10 == 0:
            texts.append(" ".join(w[:-1] + ["other"]))
    docs = [(i if i != 3 else None, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]
    labels = [(i, int("#$%" not in (t or "")), int("dumbhead" in (t or ""))) for i, t, *_ in docs if i is not None and i >= 9]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([*labels, labels[0], (None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), docs, labels


def answer(spark, tables, name):
    got = entry.queries()[name](spark, tables[0]).collect()
    assert len(got) == len(tables[1])
    return {r["doc_id"]: r for r in got}


def remainder(i, modulus):
    return None if i is None else zlib.crc32(str(i).encode()) % modulus


def test_op2(spark, tables):
    got = answer(spark, tables, "op2_simhash")
    prints = {i: brute_fingerprint(t) for i, t, *_ in tables[1]}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = list(prints)
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i))
                root[y] = x
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in ids}


def test_op4(spark, tables):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = answer(spark, tables, "op4_sentencepiece")
    for i, t, *_ in tables[1]:
        ids = sp.encode(t or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_long_parts_are_not_remembered():
    codec = pieces.Codec(pieces.model_bytes())
    codec.encode("x" * 5000 + " y")
    assert max(map(len, codec.memo)) <= pieces.LONGEST_PART and len(codec.memo) == 1


def test_op5(spark, tables):
    got = answer(spark, tables, "op5_quality_rules")
    good = {i: y for i, y, _ in tables[2]}
    for i, t, *_ in tables[1]:
        n, *rest = brute_stats(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n) and not (r["base_failed"] and r["kept"])
        if not r["base_failed"] and i in good:
            assert r["kept"] == bool(good[i])


def test_quality_list_on_documents_held_out(spark, tables):
    folder, docs, labels = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    learn = spark.createDataFrame([(i, y) for i, y, _ in labels if i % 3], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(frame, quality.fit(frame, learn)).collect()}
    held = [(got[i]["kept"], bool(y)) for i, y, _ in labels if i % 3 == 0 and not got[i]["base_failed"]]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op9(spark, tables):
    got = answer(spark, tables, "op9_toxicity")
    toxic = {i: y for i, _, y in tables[2]}
    for i, r in got.items():
        assert r["held_out"] == (remainder(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[i]["predicted"], y) for i, y in toxic.items() if got[i]["held_out"]]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op9_learns_from_no_held_out_label(spark, tables, tmp_path):
    folder, docs, labels = tables
    turned = [(i, y, 1 - t if remainder(i, 4) == 2 else t) for i, y, t in labels]
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*turned, (None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    one, other = ({r["doc_id"]: r["score"] for r in entry.queries()["op9_toxicity"](spark, d).collect()} for d in (folder, str(tmp_path)))
    assert one == other


def test_op10(spark, tables):
    got = answer(spark, tables, "op10_lm_scoring")
    train = [t for i, t, *_ in tables[1] if remainder(i, 7) != 2]
    count, p = brute_lm(train)
    n = sum(count.values())
    from quarrylane.llm.ngrams import tokens

    for i, t, *_ in tables[1]:
        w, r = tokens(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(i, 7) == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + len(count) + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(*x)) for x in zip([b" s", b" s", *w], [b" s", *w], w)), rel_tol=1e-6)


# boosting and features of op9 by definition


def plain_tree_score(tree, row):
    feature, threshold, value = tree
    at = 0
    for _ in range(len(value).bit_length() - 1):
        at = 2 * at + 1 + (row[feature[at]] > threshold[at])
    return value[at - len(feature)]


def test_boosting_by_definition():
    """The first tree's root is the best of all cuts, leaves are Newton steps, and raw scores are sums of leaves."""
    rng = np.random.default_rng(5)
    x = rng.random((300, 4))
    y = ((x[:, 1] > 0.6) ^ (rng.random(300) < 0.1)).astype(float)
    base, rate, trees = toxicity.boost(x, y, trees=5)
    p = y.mean()
    assert math.isclose(base, math.log(p / (1 - p)))
    gradient, hessian = np.full(300, p) - y, np.full(300, p * (1 - p))

    def gain(f, cut):
        left = x[:, f] <= cut
        if left.sum() < 8 or (~left).sum() < 8:
            return 0.0
        part = lambda rows: gradient[rows].sum() ** 2 / (hessian[rows].sum() + 1)
        return part(left) + part(~left) - part(np.ones(300, bool))

    cuts = [(f, c) for f in range(4) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 49)[1:-1], method="lower"))]
    feature, threshold, value = trees[0]
    assert math.isclose(gain(feature[0], threshold[0]), max(gain(*c) for c in cuts), rel_tol=1e-9)
    leaf = [tuple(np.flatnonzero(value == plain_tree_score(trees[0], row)).tolist()) for row in x]
    for k in {*leaf}:
        rows = np.array([other == k for other in leaf])
        assert math.isclose(value[k[0]], -gradient[rows].sum() / (hessian[rows].sum() + 1), abs_tol=1e-12)
    model = toxicity.Model({}, base, rate, trees, ((), ()))
    want = [base + sum(rate * plain_tree_score(t, row) for t in trees) for row in x]
    assert np.allclose(toxicity.raw_scores(model, x), want)
    q = 1 / (1 + np.exp(-toxicity.raw_scores(toxicity.Model({}, base, rate, trees[:1], ((), ())), x)))
    residual = [abs(q - y).mean(), abs(1 / (1 + np.exp(-np.array(want))) - y).mean()]
    assert residual[1] < residual[0] < abs(p - y).mean()


def test_features_by_definition():
    lexicon = {"idio": 4.0, "scum.": 2.0, "moron": 3.5}
    f = toxicity.Features(lexicon)
    text = "You are an IDIOT, and she saw scum! id1ot m o r o n fine WORDS"
    words = text.split()
    got = dict(zip(toxicity.FEATURES, f.of(text)))
    n = len(words)
    assert got["entries"] == 3 and got["entry_weight"] == 9.5 and got["top_weight"] == 4.0
    assert math.isclose(got["hit_rate"], 4 / n) and math.isclose(got["strong_rate"], 2 / n)  # three words, and one spelled out
    assert math.isclose(got["second_person_rate"], 1 / n) and math.isclose(got["second_person_near"], 1 - 3 / 12)
    letters = [c for c in text if c.isascii() and c.isalpha()]
    assert math.isclose(got["capital_share"], sum(c.isupper() for c in letters) / len(letters))
    assert math.isclose(got["capital_word_share"], 2 / n) and math.isclose(got["bang_rate"], 1 / n) and math.isclose(got["punctuation_rate"], 2 / n)
    assert math.isclose(got["obfuscated_hit_rate"], 2 / n) and math.isclose(got["obfuscated_rate"], 1 / n) and math.isclose(got["log_words"], math.log1p(n))


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(3)
    raw, y = rng.random(60).round(1), (rng.random(60) < 0.5).astype(float)
    x, p = (np.array(v) for v in toxicity.isotonic(raw, y))
    assert (np.diff(p) > 0).all() and (np.diff(x) > 0).all()
    # by the min-max formula
    values = np.unique(raw)
    total, size = np.array([y[raw == v].sum() for v in values]), np.array([(raw == v).sum() for v in values])
    mean = lambda a, b: total[a : b + 1].sum() / size[a : b + 1].sum()
    fit = [max(min(mean(a, b) for b in range(k, len(values))) for a in range(k + 1)) for k in range(len(values))]
    assert Counter(np.round(p, 9)) == Counter(np.round(np.unique(np.round(fit, 9)), 9))
