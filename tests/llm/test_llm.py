"""The ten operators and the pipeline on small hand-made tables, against brute force.

Covered for each: nulls in any column, empty and long texts, ties and repeated rows, empty tables, and
extra columns whose names clash with added ones.
"""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylane.llm import components, entry, licenses, linededup, mixing, ngrams, pieces, quality, simhash, text, topk, toxicity, urlfilter

from ..conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", " \n\t ", "one", "Two words\x0b", "a b c d e f\n\na b c d e f", "é ñ 日本 🙂 \x00 x", "word " * 30000, "x" * 50000]


def documents(spark, texts, extra=""):
    rows = [(i if i != 3 else None, t, None if i % 5 == 4 else "en", None if i % 4 == 3 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:], DOCS)  # one row twice


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD_TEXTS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, sf_dir, duck, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)


# 1 exact top-k search


@pytest.mark.parametrize("listed", [10, 4096])
def test_top_k(spark, monkeypatch, listed):
    monkeypatch.setattr(topk, "LISTED", listed)
    rng = np.random.default_rng(1)
    v = rng.integers(-20, 20, (300, 12))
    v[50:90] = v[50]  # many copies
    v[200] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1] * 12), (900, None), (901, [5, 5])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<int>")
    queries = vectors.filter("vec_id % 10 = 0")
    got = defaultdict(list)
    for r in topk.top_k(vectors, queries, 5, vector_block=64, query_block=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, 300, 10):
        want = sorted(((-int(v[q] @ v[i]), i) for i in range(300) if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert 900 not in got
    assert topk.top_k(vectors.limit(0), queries).count() == 0 and topk.top_k(vectors, queries.limit(0)).count() == 0


def brute_top_k(rows, k=5):
    """rows: (vec_id, list of whole numbers); the results of each row whose id is divisible by 50, all rows being rows of their own."""
    out = []
    for n, (i, q) in enumerate(rows):
        if i is not None and i % 50 == 0:
            scores = [(-sum(map(int.__mul__, q, v)), j is None, j or 0, j) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q)]
            out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def test_every_row_is_a_candidate(spark):
    rng = random.Random(31)
    v = [[rng.randrange(-9, 9) for _ in range(3)] for _ in range(30)]
    rows = [(rng.choice([0, 50, 100, 7, None, *range(20)]), rng.choice(v)) for _ in range(150)] + [(7, [256, 0, 0]), (7, [2304, 0, 0]), (50, [1, 0]), (51, [1, 0]), (0, []), (1, []), (100, [])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<int>")
    got = Counter(tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 50 = 0"), vector_block=40, query_block=10).collect())
    assert got == brute_top_k(rows)


def test_large_components(spark):
    rng = random.Random(32)
    rows = [(i, [rng.choice([1e10, -1e10, 3.0, -1e3, 0.5]) for _ in range(4)]) for i in range(120)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    frame = topk.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r["vec_id"]: [int(x) for x in r["v"]] for r in frame.collect()} == dict(whole)
    got = [tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 50 = 0"), vector_block=50).collect()]
    near = lambda s: max(min(s, 2**63 - 1), -(2**63 - 1))
    assert Counter(got) == Counter({(i, n, j, near(s)): c for (i, n, j, s), c in brute_top_k(whole).items()})
    middle = [(i, [rng.randrange(-(2**30), 2**30) for _ in range(4)]) for i in range(120)]  # beyond doubles, within longs
    frame = spark.createDataFrame(middle, "vec_id long, v array<long>")
    assert Counter(tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 50 = 0"), vector_block=50).collect()) == brute_top_k(middle)


def test_quantized(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (0, [0.25, -0.0]), (None, [1.0, 1e10]), (6, [1.0, 1e307])]
    got = topk.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or -1, r["v"]) for r in got) == sorted([(-1, [256, 2.56e12]), (-1, [128, -1]), (-1, [64, 0]), (5, [])])


# 2 SimHash


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = WORD.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_engines_hash(spark):
    h = spark.sql("SELECT xxhash64('a b c d')").first()[0] % (1 << 64)
    assert h == xxhash.xxh64_intdigest(b"a b c d", 42) == simhash.fingerprint("A b\tc  d")


def test_simhash_components(spark, odd, none):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = list(ODD_TEXTS)
    for k in range(60):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        texts.append(" ".join(w))
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    assert len(got) == len(texts) + 1
    prints = [brute_fingerprint(t) for t in texts]
    assert Counter(r["fp"] % (1 << 64) for r in got) == Counter(prints + prints[-1:])
    ids = [i if i != 3 else None for i in range(len(texts))]
    reach = {i: i for i in range(len(texts))}
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    reach[i] = reach[j] = min(reach[i], reach[j])
    groups = defaultdict(list)
    for i, r in reach.items():
        groups[r].append(ids[i])
    want = {ids[i]: min((x for x in groups[r] if x is not None), default=None) for i, r in reach.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(20):
            prints.add(v)
            v ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))})
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")

    def brute():
        root = {p: p for p in prints}
        for _ in range(25):
            for a in prints:
                for b in prints:
                    if ((a ^ b) % (1 << 64)).bit_count() <= 4:
                        root[a] = root[b] = min(root[a], root[b])
        return root

    want = brute()
    for bands, most in ((6, 8192), (7, 8192), (8, 8192), (6, 4)):  # the last deals buckets out as tiles
        found = components.components(simhash.links(fps, bands=bands, most_in_bucket=most))
        got = {p: p for p in prints} | {r["node"]: r["component"] for r in found.collect()}
        assert got == want


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 1), (1, 2), (2, 1)] + [(200, 200 + i) for i in range(50)]
    root = {n: n for ab in links if None not in ab for n in ab}
    for _ in range(60):
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    touched = {n for a, b in links if a is not None and a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root[n] for n in touched}


# 3 licences


def test_license_scan_looks_at_every_sentence(spark):
    texts = ["Released under CC-BY 4.0", "Released under CC-BY-SA-4.0.", "All rights\nreserved."]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["text"]: r["licenses"] for r in licenses.scan(rows).collect()} == dict(zip(texts, [["CC-BY-4.0"], ["CC-BY-SA-4.0"], ["Proprietary"]]))
    own = licenses.scan(spark.createDataFrame([("Free for all. More.",)], "text string"), {"free for all": "free"}, [("Free", ("free",))])
    assert own.first()["licenses"] == ["Free"]


def test_license_scan(spark, none):
    mit = "Copyright (c) 2020 Jo Doe. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    texts = [*ODD_TEXTS, mit, "Plain.\nReleased under the MIT License.\nMore text.", "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License,\nversion 3.", "All rights reserved.", "my license is mine", "You may obtain a copy of the License at: nowhere"]
    got = licenses.scan(documents(spark, texts).withColumn("licenses", F.lit("clash"))).collect()
    assert len(got) == len(texts) + 1
    by_text = {r["text"]: (r["licenses"], r["unmatched"]) for r in got}
    want = [["MIT"], ["MIT"], ["Apache-2.0", "CC-BY-NC-4.0"], ["GPL-3"], ["Proprietary"], [], []]
    assert [by_text[t][0] for t in texts[-7:]] == want and by_text[texts[-1]][1] == 1 and by_text[mit][1] == 0
    assert all(by_text[t] == ([], 0) for t in ODD_TEXTS)
    assert licenses.scan(none).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_TEXT = """Copyright (c) 2019, Jo Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
GPL_TEXT = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE_TEXT = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


@pytest.mark.parametrize("most", [0, 5000])
def test_licenses_as_they_are_distributed(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "MOST_SENTENCES", most)
    texts = {MIT_TEXT: ["MIT"], BSD_TEXT: ["BSD-3-Clause"], GPL_TEXT: ["GPL-3.0-or-later"], APACHE_TEXT: ["Apache-2.0"], "All  rights  reserved.": ["Proprietary"], "All rights\nreserved.": ["Proprietary"], "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nCopyright": ["GPL-3"]}
    texts |= {BSD_TEXT.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) "): ["BSD-3-Clause"], f"Notes\n{BSD_TEXT}": ["BSD-3-Clause"], MIT_TEXT.replace("\n", "\r\n"): ["MIT"], "\n\n".join(p.replace(" ", "\n") for p in MIT_TEXT.split("\n\n")): ["MIT"], "plain\nlines\nof text": []}
    rows = spark.createDataFrame([(t, "mine") for t in texts] + [(None, "mine"), ("", "mine")], "text string, x string").select("text", *[F.col("x").alias(c) for c in ("row", "scan", "__scan", "digest", "names")])
    got = licenses.scan(rows).collect()
    assert {r["text"]: r["licenses"] for r in got} == {**texts, None: [], "": []} and len(got) == len(texts) + 2
    assert all(r["unmatched"] == 0 for r in got if r["text"] in (BSD_TEXT, GPL_TEXT, APACHE_TEXT)) and all(r["scan"] == r["names"] == "mine" for r in got)


def test_custom_licence_tables(spark):
    rows = spark.createDataFrame([("This work is in the public domain. So there.",), ("so\nthere it is",)], "text string")
    known = spark.createDataFrame([("this work is in the public domain", "pd"), ("so there", "so"), ("so there", "so")], "sentence string, id string")
    want = [(["pd", "so"], ["PD"], 1), (["so"], [], 1)]
    rules = [("PD", ("pd",))]
    for table in (known, {"this work is in the public domain": "pd", "so there": "so"}):
        got = {r["text"]: (r["sentence_ids"], r["licenses"], r["unmatched"]) for r in licenses.scan(rows, table, rules).collect()}
        assert got["This work is in the public domain. So there."] == want[0]
    long = licenses.scan(spark.createDataFrame([("so\nthere\nit is",)], "text string"), known, rules).first()
    assert (long["sentence_ids"], long["unmatched"]) == (["so"], 1)


def test_longer_rules_go_first(spark):
    known, rules = {"a a": "a", "license b": "b"}, [("AB", ("a?", "b")), ("A", ("a",))]
    rows = spark.createDataFrame([("license b. a a license",), ("x",)], "text string")
    assert [r["licenses"] for r in licenses.scan(rows, {"license b": "b", "a a license": "a"}, rules).collect()] == [["AB", "A"], []]
    assert known


# 4 SentencePiece


def test_pieces_equal_the_library(spark, odd, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec = pieces.Codec(pieces.model_bytes())
    rng = random.Random(5)
    letters = "abcdefgh  \n\tABCéèç日本🙂.,;!()0123456789▁\x00"
    texts = [t for t in ODD_TEXTS if t is not None] + ["▁a▁▁b", "   lead", "<s> </s> <0x41>", "a" * 999] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for t in texts:
        want = sp.encode(t)
        assert codec.encode(t) == want and codec.decode(want) == sp.decode(want)
    for _ in range(400):
        ids = [rng.choice([0, 1, 2, *range(3, 259), *(rng.randrange(32000) for _ in range(99))]) for _ in range(rng.randrange(9))]
        assert codec.decode(ids) == sp.decode(ids)
    model = pieces.model_bytes()
    for r in pieces.digests(odd.withColumn("n_tokens", F.lit("clash")), model).collect():
        ids = sp.encode(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    there_and_back = pieces.decode(pieces.encode(odd, model).drop("text"), model)
    assert Counter(r["text"] for r in there_and_back.collect()) == Counter(r["text"] or "" for r in odd.collect())
    assert pieces.encode(none, model).count() == 0 and pieces.digests(none, model).count() == 0


def test_bounded_tables_start_afresh(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_PAIRS", 10)
    codec = pieces.Codec(pieces.model_bytes())
    codec.memo.most = 5
    want = pieces.Codec(pieces.model_bytes())
    for t in ("the quick brown fox jumps over the lazy dog", "another text with other words", "the quick brown fox"):
        assert codec.encode(t) == want.encode(t) and len(codec.memo) <= 5


# 5 quality rules


def brute_stats(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, none):
    rng = random.Random(6)
    texts = ODD_TEXTS + [" ".join(rng.choice("ab#c|") + rng.choice(["", "x\n", "é"]) for _ in range(rng.randrange(90))) for _ in range(150)]
    rows = documents(spark, texts).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = quality.judge(rows, []).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n, *rest = brute_stats(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n) and r["kept"] == (not r["base_failed"])
    assert quality.judge(none, []).count() == 0


def test_quality_keeps_other_columns(spark):
    names = ("row", "words", "__words", "lines", "chars", "bangs", "upper", "symbols")
    rows = spark.createDataFrame([("a b a b", "mine")], "text string, x string").select("text", *[F.col("x").alias(c) for c in names])
    got = quality.judge(rows, []).first()
    assert all(got[c] == "mine" for c in names) and got["n_words"] == 4


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(50)] + [(8, "eight"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (9, 1), (10, 1), (None, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: (r["quality"], r["text"]) for r in text.bounded_sample(docs, labels, 10, F.col("doc_id")).collect()}
    assert got[7][0] == 0 and got[7][1].startswith("text") and got[8] == (1, "eight") and got[9] == (1, None) and len(got) == 3
    assert {r["doc_id"] for r in text.bounded_sample(docs, labels, 1, -F.col("doc_id")).collect()} <= {10}


def test_decision_list_separates(spark):
    rng = random.Random(7)
    rows = [tuple(rng.random() for _ in quality.FEATURES) for _ in range(600)]
    bad = [r[1] > 0.7 or (r[3] > 0.5 and r[5] < 0.2) for r in rows]
    rules = quality.learn(rows, bad)
    got = [any(all(c.fits(r) for c in rule) for rule in rules) for r in rows]
    assert sum(g == b for g, b in zip(got, bad)) > 0.97 * len(rows)
    order = list(range(600))
    rng.shuffle(order)
    assert quality.learn([rows[i] for i in order], [bad[i] for i in order]) == rules
    frame = spark.createDataFrame([(*r, g) for r, g in zip(rows, got)], ", ".join(f"{f} double" for f in quality.FEATURES) + ", rejected boolean")
    assert frame.filter(quality.verdict(rules) == F.col("rejected")).count() == 0
    assert quality.learn([], []) == [] and quality.learn(rows, [True] * 600) == []


def test_quality_fit_with_odd_labels(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0), (2, 7), (5, 0), (5, 0)], "doc_id long, quality int")
    assert quality.fit(odd, labels) == [] and quality.fit(none, labels) == [] and quality.fit(odd, labels.limit(0)) == []


# 6 line dedup


def brute_dedup(docs, min_words=5):
    """docs: (doc_id, text) with different ids."""
    lines = [((i, k), x) for i, t in sorted(docs) if t is not None for k, x in enumerate(t.split("\n"))]
    words = {at: WORD.findall(x) for at, x in lines}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    compared = [at for at, _ in lines if len(words[at]) >= min_words]
    gone = {at for n, at in enumerate(compared) if any(near(words[at], words[before]) for before in compared[:n])}
    seen = set()
    for at, _ in lines:  # a short line must be equal
        if words[at] and tuple(words[at]) in seen:
            gone.add(at)
        seen.add(tuple(words[at]))
    out = {}
    for i, t in docs:
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
    return out


def test_line_dedup(spark, none):
    rng = random.Random(8)
    texts = list(ODD_TEXTS)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 4, 5, 6, 7, 9, 30]))] for _ in range(25)]
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = [f"n{rng.randrange(9)}"] * rng.randrange(2)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", " "]))
        texts.append("\n".join(lines))
    docs = list(enumerate(texts))
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_lines string")
    got = linededup.dedup(rows).collect()
    want = brute_dedup(docs)
    assert {r["doc_id"]: r["text"] for r in got} == want
    for r in got:
        n = 0 if texts[r["doc_id"]] is None else len(texts[r["doc_id"]].split("\n"))
        assert r["n_lines"] == n and r["n_removed"] >= 0
    assert linededup.dedup(none).count() == 0


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    line = "a line with six words here"
    rows = [(1, line), (1, line), (None, line), (2, line + " now"), (2, "something else entirely in this line"), (None, None)]
    got = Counter((r["doc_id"], r["text"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, line): 2, (None, ""): 1, (2, ""): 1, (2, "something else entirely in this line"): 1, (None, None): 1})


def test_short_lines_must_be_equal(spark):
    rows = [(1, "Read more here\nRead more there"), (2, "Read  more here\n\n \nRead more"), (3, "日本語の一行\n}"), (4, "日本語の一行\n}\n}")]
    names = ("d", "__d", "row", "kept", "__kept", "new", "lines")
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit("mine").alias(c) for c in names])
    got = linededup.dedup(docs).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == {1: (rows[0][1], 2, 0), 2: ("\n \nRead more", 4, 1), 3: (rows[2][1], 2, 0), 4: ("", 3, 3)}
    assert all(r[c] == "mine" for r in got for c in names)


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_line_dedup_without_broadcasts(spark, monkeypatch, most):
    monkeypatch.setattr(text, "MOST_BROADCAST", most)
    rows = [(i, f"user number {i % 7} has logged in today\nand then did thing {i} of all\nend") for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_dedup(rows)


def test_a_hot_template(spark):
    rows = [(i, f"user number {i} has logged in today") for i in range(500)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "" for i in range(1, 500))


# 7 mixing


@pytest.mark.parametrize("in_order", [0, 100])
def test_targets(spark, monkeypatch, in_order):
    monkeypatch.setattr(mixing, "MOST_IN_ORDER", in_order)
    rng = random.Random(9)
    for n in (1, 2, 3, 7):
        sizes = {f"s{i}": rng.choice([0, 5, 100, 10**6]) for i in range(n)}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        total, want, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
        while open_:
            share = {s: total * weights[s] / sum(weights[x] for x in open_) for s in open_}
            above = {s for s in open_ if share[s] > 2 * sizes[s]}
            if not above:
                want |= share
                break
            for s in above:
                want[s] = 2.0 * sizes[s]
                total -= want[s]
            open_ -= above
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


def test_mix(spark, odd, none):
    rng = random.Random(10)
    rows = [(i, " ".join("w" * 1 for _ in range(int(rng.paretovariate(1.1) * 20) % 3000)), None, rng.choice(["a", "a", "a", "b", None, ""]), 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mix_size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == 3000 and sorted(mixing.mix(docs).collect(), key=str) == sorted(got, key=str)
    for s in ("a", "b", None, ""):
        mine = [r for r in got if r["source"] == s]
        taken = sum(r["mix_copies"] * r["mix_size"] for r in mine)
        assert mine[0]["mix_source_size"] == sum(r["mix_size"] for r in mine)
        assert abs(taken - mine[0]["mix_target"]) <= 1.5 * max(r["mix_size"] for r in mine)
    assert max(r["mix_copies"] for r in got) <= 2
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0 and mixing.take(none).count() == 0
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["mix_copies"] for r in got)


def test_mix_of_clashing_columns_and_rows_without_ids(spark):
    rows = [(None, f"{i} " + "w " * (i % 7), "s", "mine", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, key int")
    for c in ("digest", "place", "bin", "size", "target", "__key"):
        docs = docs.withColumn(c, F.lit("mine"))
    got = mixing.mix(docs).collect()
    assert sorted(r["key"] for r in got) == [*range(400)] and all(r[c] == "mine" for r in got for c in ("row", "digest", "place", "bin", "size", "target", "__key"))
    taken = sum(r["mix_copies"] * r["mix_size"] for r in got)
    assert abs(taken - 1.5 * sum(r["mix_size"] for r in got)) < 20
    bins = {r["b"] for r in docs.select(F.substring(F.md5(F.concat(F.lit("text "), F.md5("text"))), 1, 2).alias("b")).collect()}
    assert len(bins) > 100  # rows without ids are spread


# 8 url filters


@pytest.mark.parametrize("shapes", [0, 4096])
def test_url_filters(spark, monkeypatch, shapes):
    monkeypatch.setattr(urlfilter, "MOST_SHAPES", shapes)
    urls = [None, "", "no scheme", "http://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "https://x.www.example.com/en/a", "http://net/es/", "http://a.net/fr/x", "http://a.net/de/", "http://com", "http://com/", "http://notcom/", "http://example.com?en/", "x://y://com/", "http://", "http://" + "a." * 3000 + "com/", "http://com/" + "p" * 10000]
    rows = spark.createDataFrame([(i if i != 4 else None, u, "clash") for i, u in enumerate(urls)] * 2, "page_id long, url string, verdict string")
    rows = rows.withColumns({c: F.lit("mine") for c in ("row", "head", "__head", "best", "short", "digest")})
    got = urlfilter.judge(rows, urlfilter.rule_table(spark)).collect()
    assert len(got) == 2 * len(urls) and all(r[c] == "mine" for r in got for c in ("row", "head", "__head", "best", "short", "digest"))
    for r in got:
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, a) for a, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
    none = urlfilter.rule_table(spark).limit(0)
    assert {r["verdict"] for r in urlfilter.judge(rows, none).collect()} == {"allow"}
    assert urlfilter.judge(rows.limit(0), urlfilter.rule_table(spark)).count() == 0


# 9 toxicity


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(11)
    common, bad = [f"word{i}" for i in range(60)], ["idiot", "loweiung", "moron"]

    def text(toxic):
        w = [rng.choice(common) for _ in range(60)]
        for _ in range(3 * toxic):
            k = rng.randrange(60)
            w[k] = rng.choice(bad) + ("" if rng.random() < 0.5 else rng.choice(["!", "heit", "x"]))
            w[k - 1] = "you"
        return " ".join(w)

    y = [int(rng.random() < 0.3) for _ in range(900)]
    docs = spark.createDataFrame([(i, text(t)) for i, t in enumerate(y)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y) if i < 600] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    right = [(got[i] >= toxicity.THRESHOLD) == bool(y[i]) for i in range(600, 900)]
    assert sum(right) > 0.95 * len(right) and all(0 <= s <= 1 for s in got.values())
    again = toxicity.fit(docs, labels)
    assert (again.lexicon, again.base, again.steps) == (model.lexicon, model.base, model.steps)


def test_toxicity_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    for docs, given in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        model = toxicity.fit(docs, given)
        scores = [r["score"] for r in toxicity.score(odd, model).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
        assert toxicity.score(none, model).count() == 0


def test_isotonic():
    raw, y = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 0, 1, 1])
    x, p = toxicity.isotonic(raw, y)
    assert list(p) == sorted(p) and math.isclose(p[0], 0) and math.isclose(p[-1], 1) and toxicity.isotonic(raw, y * 0) == ((), ())


def test_masked_words():
    f = toxicity.Features({"idio": 4.0})
    hits = [f.of(t)[0] for t in ("idiot", "1d10t!", "i d i o t", "fine words", None, "")]
    assert hits == [1, 1, 1, 0, 0, 0] and f.of("id!ot")[0] == 1 and f.of("id1ot")[11] > 0


# 10 language model


def brute_lm(train):
    """(counts of words, p(u, v, w)) by definition."""
    count, triples = Counter(), Counter()
    for t in train:
        w = ngrams.tokens(t)
        count.update(w)
        triples.update(zip([b" s", b" s", *w], [b" s", *w], w))
    pairs = Counter((v, w) for _, v, w in triples)
    ends = Counter(w for _, w in pairs)
    of = lambda c: ngrams.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    three, two, one = of(triples), of(pairs), of(ends)

    def following(grams):
        out = defaultdict(lambda: [0, 0, 0, 0])
        for (*context, _), k in grams.items():
            out[tuple(context)][0] += k
            out[tuple(context)][min(k, 3)] += 1
        return out

    after_two, after_one = following(triples), following(pairs)
    spread = sum(one[min(k, 3) - 1] for k in ends.values()) / len(pairs) if pairs else 1.0
    p1 = lambda w: (ends[w] - (one[min(ends[w], 3) - 1] if ends[w] else 0)) / max(len(pairs), 1) + spread / (len(count) + 1)

    def over(x, k, d, lower):
        return (k - (d[min(k, 3) - 1] if k else 0)) / x[0] + sum(d[j] * x[j + 1] for j in range(3)) / x[0] * lower if x else lower

    def p(u, v, w):
        return over(after_two.get((u, v)), triples[u, v, w], three, over(after_one.get((v,)), pairs[v, w], two, p1(w)))

    return count, p


FREQUENT = sorted((ngrams._hash(w), n) for w, n in ((b"w1", 3), (b"often", 5), (b"pair", 2), (b" <start>", 4)))
LAYOUTS = [ngrams.Layout(1), ngrams.Layout(5), ngrams.Layout(5, *map(tuple, zip(*FREQUENT)))]


@pytest.mark.parametrize("chunk", [50, 10**6])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_language_model(spark, odd, none, monkeypatch, chunk, layout):
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(ngrams, "SCORED_TOKENS", chunk)
    rng = random.Random(12)
    texts = [" ".join(f"W{int(rng.paretovariate(0.7)) % 50}" for _ in range(rng.randrange(30))) for _ in range(80)] + ODD_TEXTS[:7] + ["often pair " * 400]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    model = ngrams.train(train, layout)
    count, p = brute_lm(texts)
    assert (model.tokens, model.words) == (sum(count.values()), len(count))
    for context in ((b"w1", b"w2"), (b"w1", b"unknown"), (b"unknown", b"w1"), (b" s", b" s"), (b"often", b"pair")):
        assert math.isclose(sum(p(*context, w) for w in count) + p(*context, b"unknown"), 1, rel_tol=1e-9)
    own = [*ODD_TEXTS, "w1 w2 w3", "w1 unknown w1", "pair often w1 w49", *texts[:20]]
    other = documents(spark, own)
    for r in ngrams.score(other, model).collect():
        w = ngrams.tokens(r_text := next(t for i, t in enumerate(own) if (i if i != 3 else None) == r["doc_id"]))
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(count[x] > 0 for x in w)), r_text
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (model.tokens + model.words + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(*x)) for x in zip([b" s", b" s", *w], [b" s", *w], w)), rel_tol=1e-9)
    assert ngrams.score(none, model).count() == 0


def test_language_model_of_nothing(spark, odd, none):
    nothing = ngrams.train(none.select("text"))
    assert nothing.tokens == 0 and all(math.isfinite(r["score"]) for r in ngrams.score(odd, nothing).collect())
    one = ngrams.train(spark.createDataFrame([("a b",)], "text string"))
    assert all(math.isfinite(r["score"]) for r in ngrams.score(odd, one).collect())


@pytest.mark.parametrize("n", [1, 2, 27, 500])
def test_each_task_has_a_partition(spark, n):
    keys = ngrams.task_keys(n).tolist()
    rows = spark.createDataFrame([(k,) for k in keys], "task int").select(F.pmod(F.hash("task"), F.lit(n)).alias("p")).collect()
    assert [r["p"] for r in rows] == [*range(n)]


def test_layout_deals_frequent_words(spark):
    rng = random.Random(13)
    texts = spark.createDataFrame([(" ".join(["The", f"n{rng.randrange(9999)}", "the"]) + " ",) for _ in range(3000)], "text string")
    layout = ngrams.layout_of(texts, shard_bytes=3000)
    assert layout.shards > 10 and {ngrams._hash(b"the"), ngrams._hash(b" <start>")} == {*layout.frequent} and layout.dealt[layout.frequent.index(ngrams._hash(b"the"))] > 10
    where = layout.of_pairs(np.full(999, ngrams._hash(b"the"), dtype=np.uint64), np.arange(999, dtype=np.uint64))
    assert len({*where.tolist()}) > 10 and ngrams.layout_of(texts.limit(0)).shards == 1


@pytest.mark.parametrize("how", ["missing", "short"])
def test_a_model_without_all_its_files(spark, how):
    texts = spark.createDataFrame([(f"a b c{i} d",) for i in range(50)], "text string")
    model = ngrams.train(texts, ngrams.Layout(3))
    docs = spark.createDataFrame([(1, "a b c1 d")], "doc_id long, text string")
    assert ngrams.score(docs, model).count() == 1
    for name in os.listdir(model.folder):
        if name.startswith("grams-"):
            os.remove(f"{model.folder}/{name}") if how == "missing" else os.truncate(f"{model.folder}/{name}", 8)
    with pytest.raises(Exception, match="missing or not whole"):
        ngrams.score(docs, model).collect()


def test_mounted_folders_only():
    assert ngrams.mounted("file:///a/b%20c") == "/a/b c" and ngrams.mounted("/a") == "/a"
    with pytest.raises(ValueError):
        ngrams.mounted("hdfs://x/a")
