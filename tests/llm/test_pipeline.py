"""The pipeline's stages on hand-made tables and on the driver's smallest, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from quarrylane.llm import pieces, quality, simhash

from .test_llm import DOCS, ODD_TEXTS, brute_dedup, brute_fingerprint, brute_stats, documents


def write_labels(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0), (5, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_odd_rows(spark, tmp_path):
    where = write_labels(spark, tmp_path)
    long = " ".join(f"w{i}" for i in range(80))
    for texts in ([*ODD_TEXTS, long, long], []):
        docs = documents(spark, texts) if texts else spark.createDataFrame([], DOCS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, where)
            assert out.columns == docs.columns
            out.collect()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, where)
        assert last.count() == docs.count()


def test_pipeline_step_by_step(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    rules = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def kept(text):
        n, chars, symbols, dup, repeat = brute_stats(text)
        if n < 50 or 100 * repeat > 50 * n:
            return False
        lines = [x for x in text.split("\n") if x.split()]
        upper = sum("A" <= c <= "Z" for c in text)
        row = (chars / n, symbols / n, text.count("!") / n, upper / chars, dup / len(lines), repeat / n)
        return not any(all(c.fits(row) for c in rule) for rule in rules)

    one = [(i, t, s) for i, t, s in docs if kept(t)]
    new = brute_dedup([(i, t) for i, t, _ in one])
    two = [(i, new[i], s) for i, _, s in one]
    prints = {i: brute_fingerprint(t) for i, t, _ in two}
    ids = sorted(prints)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    three = {i: (t, s) for i, t, s in two if root[i] == i}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    copies = Counter(r["doc_id"] for r in got)
    assert {*copies} <= {*three} and max(copies.values()) <= 2
    codec = pieces.Codec(pieces.model_bytes())
    for r in got:
        assert r["ids"] == codec.encode(three[r["doc_id"]][0]) and r["n_tokens"] == len(r["ids"])
    for s in {s for _, s in three.values()}:
        size = sum(len(t.split()) for t, x in three.values() if x == s)
        taken = sum(copies[i] * len(t.split()) for i, (t, x) in three.items() if x == s)
        assert taken <= 2 * size
    total = sum(len(t.split()) for t, _ in three.values())
    assert 1.3 * total < sum(copies[i] * len(t.split()) for i, (t, _) in three.items()) < 1.7 * total
    assert simhash.MOST_BITS == 4


def test_near_dedup_at_similarity(spark, tmp_path):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    texts, pairs = [], []
    for n in range(120):
        base = [rng.choice(words) for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(5, 195), rng.randint(1, 6)):
            other[at] = "new"
        x, y = shingles(" ".join(base)), shingles(" ".join(other))
        texts += [" ".join(base), " ".join(other)]
        pairs.append(len(x & y) / len(x | y))
    assert sum(0.8 <= p < 0.95 for p in pairs) > 40 and sum(p < 0.8 for p in pairs) > 20
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()}
    assert got == {i for i in range(240) if i % 2 == 0 or pairs[i // 2] < 0.8}
    found = simhash.similar(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(found) == 240 and len({r["component"] for r in found}) == len(got)


def test_near_dedup_of_null_and_repeated_ids(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, c + " more"), (7, c), (7, d), (8, d + " more"), (7, d), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert Counter(got) == Counter([(None, a), (None, b), (7, c), (7, d), (None, "")])


def test_similar_takes_its_candidates_from_fingerprints_and_pivots():
    rng = np.random.default_rng(3)
    base = simhash.shingles(" ".join(f"b{i}" for i in range(300)))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) < keep], rng.integers(1 << 63, size=20, dtype=np.uint64)))) for keep in rng.uniform(0.2, 1, 120)]
    words = np.stack([simhash._wide(s, 12) for s in sets])
    for s, w in zip(sets, words[:, 0].tolist()):
        assert w == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in s.tolist()) > len(s))
    pivots = simhash.pivots(simhash.SIMILAR_PIVOTS).tolist()
    table = np.array([[(w ^ p).bit_count() for p in pivots] for w in words[:, 0].tolist()], dtype=np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    words, table = words[order, : simhash.VERIFY_WORDS], table[order]
    bits = lambda x, y: sum((a ^ b).bit_count() for a, b in zip(x, y))
    rows = words.tolist()
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if (rows[i][0] ^ rows[j][0]).bit_count() <= simhash.CANDIDATE_BITS and bits(rows[i], rows[j]) <= simhash.VERIFY_BITS}
    assert 500 < len(want) < 6000
    assert {*zip(*(x.tolist() for x in simhash._candidates(words, table)))} == want
    far = np.zeros_like(table)
    far[60:, 5] = simhash.CANDIDATE_BITS + 1  # a table by which the halves are far apart
    assert {*zip(*(x.tolist() for x in simhash._candidates(words, far)))} == {(i, j) for i, j in want if (i < 60) == (j < 60)}


def test_similar_in_crowded_buckets_and_small_tiles(spark):
    rng = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rng.choice((12, 40, 150)))]
        for _ in range(15):
            text = list(base)
            for at in rng.sample(range(len(text)), rng.randint(0, max(1, len(text) // 40))):
                text[at] = rng.choice("xyz")
            texts.append(" ".join(text))
    texts = sorted({*texts})
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = [*range(len(texts))]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    named = spark.createDataFrame([(t, r) for t, r in zip(texts, root)], "text string, root int").selectExpr("xxhash64(text) h", "root").collect()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for most_in_bucket, most_in_tile in ((simhash.MOST_IN_BUCKET, simhash.MOST_IN_TILE), (3, 400), (simhash.MOST_IN_BUCKET, 64 * 200)):
        got = {r["h"]: r["component"] for r in simhash.similar(docs, most_in_bucket=most_in_bucket, most_in_tile=most_in_tile).collect()}
        assert len({(got[r["h"]], r["root"]) for r in named}) == len({*got.values()}) == len({*root})
