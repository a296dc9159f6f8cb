"""LM scoring: an interpolated, modified Kneser-Ney trigram model in sorted hash arrays.

Counting. Tasks turn tokens into trigrams (u, v, w), count them chunk by chunk in
sorted arrays, and send each shard its part as one row of arrays with a
vocabulary of its own; a very common trigram is one entry of a chunk. A shard has
the trigrams of its middle words v, so that in one place a trigram's count, how
many words u precede a pair v w, and what follows a context u v and a word v are
all known; only words have to be summed once more. Shards are as many as the
bytes of text ask for. Middle words that a sample shows to be frequent are dealt
over several shards by w; what follows their contexts is then summed up with the
words, from one row for each shard and context.

Scoring. The arrays lie in the shared folder, a file for each shard; workers map
those that they need into memory, look keys up by binary search, and sum log
probabilities for each text. The files are listed with their sizes when training
ends, and a file that is missing or short is an error. Nothing but totals reaches
the driver. Memory depends on the chunk and on the shard, which holds SHARD_BYTES
of text on average, not on the corpus.

With counts c and discounts D of counts 1, 2 and 3 or more, one set for each order,
    p(w | u v) = max(c(uvw) - D3(c(uvw)), 0) / c(uv.) + g(uv) p(w | v)
    p(w | v)   = max(N(.vw) - D2(N(.vw)), 0) / N(.v.) + g(v) p(w)
    p(w)       = max(N(.w) - D1(N(.w)), 0) / N(..) + g / (V + 1)
where N counts distinct trigrams (the second line) and pairs (the third), and g is
what the discounts leave over. A text starts with two start marks; an unseen
context leaves all to the lower order. Words are compared by 64-bit hashes; of the
sorted hashes of n-grams a shard keeps what its index doesn't tell, REST_BITS bits.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import crc_mod, shared_dir, table, words

#: Tokens that a task counts, and scores, at once.
CHUNK_TOKENS = 2_000_000
SCORED_TOKENS = 1_000_000
#: Bytes of text whose trigrams a shard holds, on average.
SHARD_BYTES = 8 << 20
#: Shards that one task merges, one after another; a chunk sends it one vocabulary for all of them.
GROUPED = 4
#: Counts are bytes; those of this many or more stand in a table of their own.
_MANY = 255
#: Bits of an n-gram's hash that stand beside its place in an index of runs of 8 to 16 keys: a strange one equals some key with a chance of 2^-20.
REST_BITS = 24
_START, _END = b" <start>", b" <end>"  # no words, as they hold a space


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


class _Numbers(dict):
    """Words -> numbers in the order in which they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, and one end."""
    found = (text or "").encode().lower().split()
    found.append(_END)
    return found


class _Chunk:
    """Texts as numbers of a vocabulary of their own."""

    def __init__(self):
        self.numbers, self.parts, self.lengths, self.size = _Numbers(), [], [], 0
        self.numbers[_START]

    def add(self, text: str | None) -> None:
        found = tokens(text)
        number = self.numbers.__getitem__
        self.parts.append(np.fromiter(map(number, found), dtype=np.int32, count=len(found)))
        self.lengths.append(len(found))
        self.size += len(found)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word number; word numbers of all tokens, of the tokens before them, and of those before these)."""
        hashes = np.fromiter(map(_hash, self.numbers), dtype=np.uint64, count=len(self.numbers))
        w = np.concatenate(self.parts)
        first = np.cumsum([0, *self.lengths[:-1]])
        v = np.concatenate((w[:1] * 0, w[:-1]))
        v[first] = 0
        u = np.concatenate((w[:1] * 0, v[:-1]))
        u[first] = 0
        return hashes, w, v, u


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _range(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash; shards are ranges of hashes, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def task_keys(n: int) -> np.ndarray:
    """An int for each of n tasks, which Spark's hash partitioning (Murmur3, seed 42) deals to a partition of its own of n."""
    turned = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    tried = 16 * n
    while True:
        k = turned(np.arange(tried, dtype=np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = (turned(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64)
        parts, first = np.unique(h % n, return_index=True)
        if len(parts) == n:
            return first.astype(np.int32)
        tried *= 2


@dataclass(frozen=True)
class Layout:
    """How many shards there are, and over how many of them the trigrams of each frequent middle word are dealt (sorted hashes)."""

    shards: int
    frequent: tuple[int, ...] = ()
    dealt: tuple[int, ...] = ()

    def split(self, v: np.ndarray) -> np.ndarray:
        """Over how many shards each word is dealt, 1 for most."""
        known, parts = np.array(self.frequent, dtype=np.uint64), np.array(self.dealt, dtype=np.uint64)
        if not len(known):
            return np.ones(len(v), dtype=np.uint64)
        at = np.minimum(np.searchsorted(known, v), len(known) - 1)
        return np.where(known[at] == v, parts[at], np.uint64(1))

    def of_pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Shard of the pairs v w and of all trigrams that end in them."""
        return (self._of_words(v) + (w % self.split(v)).astype(np.int64)) % self.shards

    def of_contexts(self, v: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Shard of what follows contexts (hashes) whose last word is v."""
        return np.where(self.split(v) > 1, _range(context, self.shards), self._of_words(v))

    def _of_words(self, v: np.ndarray) -> np.ndarray:
        return _range(_mixed(v, np.zeros_like(v)), self.shards)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of sorted keys starts."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = _starts(keys)
    return (keys[starts], *(np.add.reduceat(x[order], starts) if len(keys) else x for x in values))


def _sections(arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps({name: [a.dtype.str, len(a)] for name, a in arrays.items()}).encode()
    body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())
    return len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8) + body


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Whole or not at all, so that a task that runs again does no harm."""
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(_sections(arrays))
    os.replace(own, f"{folder}/{name}")


def _mapped(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(data[:8].tobytes(), "little")
    at, out = 8 + n + (-n % 8), {}
    for name, (kind, length) in json.loads(data[8 : 8 + n].tobytes()).items():
        size = length * np.dtype(kind).itemsize
        out[name] = data[at : at + size].view(kind)
        at += size + (-size % 8)
    return out


def _bucket_bits(n: int) -> int:
    return max(0, n.bit_length() - 4)


def _rest(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits - REST_BITS)) & np.uint64((1 << REST_BITS) - 1)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def _keyed(prefix: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sections for sorted hashes: where each bucket of first bits starts, and the bits after these."""
    bits = _bucket_bits(len(keys))
    rest = _rest(keys, bits)
    index = np.concatenate(([0], np.cumsum(np.bincount(_bucket(keys, bits), minlength=1 << bits)))).astype(np.uint32)
    return {prefix + "index": index, prefix + "high": (rest >> np.uint64(8)).astype(np.uint16), prefix + "low": rest.astype(np.uint8)}


def _place(arrays: dict[str, np.ndarray], prefix: str, keys: np.ndarray) -> np.ndarray:
    """Places of hashes among a section's, -1 for those that it lacks."""
    high, low = arrays[prefix + "high"], arrays[prefix + "low"]
    if not len(high):
        return np.full(len(keys), -1, dtype=np.int64)
    bits = _bucket_bits(len(high))
    bucket, want = _bucket(keys, bits), _rest(keys, bits).astype(np.int64)
    index = arrays[prefix + "index"]
    at, end = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
    last, left = end, end - at
    while len(left) and left.max() > 0:  # all bisect at once
        half = left >> 1
        middle = np.minimum(at + half, len(high) - 1)
        less = (left > 0) & ((high[middle].astype(np.int64) << 8 | low[middle]) < want)
        at, left = np.where(less, middle + 1, at), np.where(less, left - half - 1, half)
    here = np.minimum(at, len(high) - 1)
    return np.where((at < last) & ((high[here].astype(np.int64) << 8 | low[here]) == want), here, -1)


def _bytes(prefix: str, numbers: np.ndarray) -> dict[str, np.ndarray]:
    """Sections for rows of numbers (n, width) as bytes, with rows of which one is large apart."""
    large = np.flatnonzero((numbers >= _MANY).any(axis=1))
    kept = numbers.astype(np.uint8)
    kept[large] = _MANY
    return {prefix + "bytes": kept.ravel(), prefix + "large-at": large.astype(np.uint32), prefix + "large": numbers[large].astype(np.int64).ravel()}


def _numbers(arrays: dict[str, np.ndarray], prefix: str, at: np.ndarray, width: int) -> np.ndarray:
    out = arrays[prefix + "bytes"].reshape(-1, width)[at].astype(np.int64)
    large = np.flatnonzero((out == _MANY).all(axis=1))
    if len(large):
        out[large] = arrays[prefix + "large"].reshape(-1, width)[np.searchsorted(arrays[prefix + "large-at"], at[large])]
    return out


def _counts(name: str, keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Sections for counts by sorted hashes; those of one need no number."""
    several = counts > 1
    return {**_keyed(f"{name}-once-", keys[~several]), **_keyed(f"{name}-", keys[several]), **_bytes(f"{name}-", counts[several][:, None])}


def _followed(prefix: str, key: np.ndarray, stats: np.ndarray) -> dict[str, np.ndarray]:
    """Sections for what follows contexts, by sorted hashes: stats has the total and how many words follow once, twice and more often."""
    return {**_keyed(prefix, key), **_bytes(prefix, stats)}


def _kinds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


#: What a chunk sends to a task: hashes of words, and for each of the task's shards six columns: of each middle word v its number and how many
#: words u precede it; of each u v the number of u and how many words follow; of each trigram the number of w and the count. Sorted by v, u, w.
_PARTS = "task int, vocabulary binary, shards array<int>, grams array<binary>"
_PACKED = 6


def _small(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as hold them, compressed; the first byte tells."""
    most = int(numbers.max()) if len(numbers) else 0
    kind = "1" if most < 1 << 8 else "2" if most < 1 << 16 else "4" if most < 1 << 32 else "8"
    data = numbers.astype(f"<u{kind}").tobytes()
    return kind.encode() + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _large(data: bytes | pa.Buffer) -> np.ndarray:
    data = memoryview(data or b"")
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    plain = pa.decompress(data[9:], decompressed_size=int.from_bytes(data[1:9], "little"), codec="zstd")
    return np.frombuffer(plain, f"<u{bytes(data[:1]).decode()}").astype(np.int64)


def _count(batches, layout: Layout):
    keys = task_keys(-(-layout.shards // GROUPED))

    def flush(chunk: _Chunk):
        hashes, w, v, u = chunk.arrays()
        if len(hashes) < 1 << 21:  # three numbers fit into a long
            grams = v.astype(np.int64)
            for x in (u, w):
                grams <<= 21
                grams |= x
            grams.sort()
            first = _starts(grams)
            grams = grams[first]
            v, u, w = (((grams >> shift) & (2**21 - 1)).astype(np.int32) for shift in (42, 21, 0))
            del grams
        else:
            order = np.lexsort((w, u, v))
            u, v, w = u[order], v[order], w[order]
            first = _starts(u, v, w)
            u, v, w = u[first], v[first], w[first]
        count = np.diff(np.concatenate((first, [chunk.size]))).astype(np.int32)
        del first
        of = layout.of_pairs(hashes[v], hashes[w]).astype(np.int32)
        order = np.argsort(of, kind="stable").astype(np.int32)
        edges = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=layout.shards))))
        del of
        runs = lambda starts, n: np.diff(np.concatenate((starts, [n])))
        rows = []
        for task in range(0, layout.shards, GROUPED):
            shards = [k for k in range(task, min(task + GROUPED, layout.shards)) if edges[k] < edges[k + 1]]
            if not shards:
                continue
            used = np.zeros(len(hashes), dtype=bool)
            every = order[edges[task] : edges[shards[-1] + 1]]
            for numbers in (u[every], v[every], w[every]):
                used[numbers] = True
            local = np.cumsum(used, dtype=np.int32) - 1  # numbers in a vocabulary of their own
            packed = []
            for k in shards:
                here = order[edges[k] : edges[k + 1]]
                of_u, of_v = _starts(v[here], u[here]), _starts(v[here])
                columns = (local[v[here[of_v]]], runs(np.searchsorted(of_u, of_v), len(of_u)), local[u[here[of_u]]], runs(of_u, len(here)), local[w[here]], count[here])
                packed += map(_small, columns)
            rows.append((int(keys[task // GROUPED]), hashes[used].tobytes(), shards, packed))
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=["task", "vocabulary", "shards", "grams"])

    chunk = _Chunk()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for text in batch.column(0).slice(at, 64).to_pylist():
                chunk.add(text)
                if chunk.size >= CHUNK_TOKENS:
                    yield flush(chunk)
                    chunk = _Chunk()
    if chunk.size:
        yield flush(chunk)


#: What shards hand on: words (key, raw count, number of words before) and, of frequent words, what follows their contexts (key, stats).
_ON = "shard int, word binary, count binary, before binary, context binary, context_stats binary, single binary, single_stats binary, sums array<long>"
_ON_NAMES = [f.split()[0] for f in _ON.split(", ")]


def _merge(parts: pa.Table, folder: str, layout: Layout) -> pa.Table:
    """The task of some shards, one after another; what chunks sent stays as it came, compressed."""
    rows = []
    for batch in parts.to_batches():
        vocabulary, shards, grams = batch.column("vocabulary"), batch.column("shards"), batch.column("grams")
        rows += [(vocabulary[k].as_buffer(), shards[k].as_py(), grams[k].values) for k in range(batch.num_rows)]
    return pa.concat_tables([_merge_shard(k, rows, folder, layout) for k in sorted({k for _, shards, _ in rows for k in shards})])


def _merge_shard(shard: int, rows: list, folder: str, layout: Layout) -> pa.Table:
    """Writes a shard's trigrams, pairs and contexts, hands words and the contexts of frequent words on."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for vocabulary, shards, packed in rows:
        if shard not in shards:
            continue
        known, at = np.frombuffer(vocabulary, "<u8"), _PACKED * shards.index(shard)
        v, v_runs, u, u_runs, w, count = (_large(packed[k].as_buffer()) for k in range(at, at + _PACKED))
        for out, x in zip(columns, (np.repeat(known[u], u_runs), np.repeat(np.repeat(known[v], v_runs), u_runs), known[w], count)):
            out.append(x)
    u, v, w, count = (np.concatenate(c) for c in columns)
    columns.clear()
    context = _mixed(u, v)
    del u
    gram = _mixed(context, w)
    order = np.argsort(gram)
    first = _starts(gram[order])
    count = np.add.reduceat(count[order], first)
    order = order[first]
    gram, context, v, w = (x[order] for x in (gram, context, v, w))
    triple = _counts("triple", gram, count)
    thrice = _of_counts(count)

    # contexts u v: of those that v has whole here, those seen once are told by the pair's being known
    split = layout.split(v) > 1
    once = np.ones(len(v), dtype=np.int64)
    followed = lambda keep, key, counts: (lambda k, *s: (k, np.stack(s, axis=1).reshape(-1, 4)))(*_summed(key[keep], counts[keep], *(x[keep] for x in _kinds(counts))))
    key, stats = followed(~split, context, count)
    often = stats[:, 0] > 1
    contexts = _followed("context-", key[often], stats[often])
    on_context = followed(split, context, count)

    pair = _mixed(v, w)
    raw_order = np.argsort(pair)
    starts = _starts(pair[raw_order])
    preceded = np.add.reduceat(once[raw_order], starts)  # words u before v w
    raw = np.add.reduceat(count[raw_order], starts)
    pair, v, w = (x[raw_order[starts]] for x in (pair, v, w))
    split = layout.split(v) > 1
    key, stats = followed(~split, v, preceded)
    on_single = followed(split, v, preceded)
    _write(folder, f"grams-{shard}", {**triple, **_counts("pair", pair, preceded), **contexts, **_followed("single-", key, stats)})

    word, raw, before = _summed(w, raw, np.ones(len(w), dtype=np.int64))
    out: dict[int, list[bytes]] = {}

    def put(at: int, hashes: np.ndarray, shards: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(shards, kind="stable")
        edges = np.searchsorted(shards[order], np.arange(layout.shards + 1))
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            here = order[edges[k] : edges[k + 1]]
            row = out.setdefault(k, [b""] * 7)
            row[at] = hashes[here].tobytes()
            for n, x in enumerate(values, at + 1):
                row[n] = _small(x[here].ravel())

    put(0, word, _range(word, layout.shards), raw, before)
    put(3, on_context[0], _range(on_context[0], layout.shards), on_context[1])
    put(5, on_single[0], _range(on_single[0], layout.shards), on_single[1])
    sums = [len(gram), len(pair), int(preceded.sum()), *thrice, *_of_counts(preceded)]
    home = min(out)
    rows = [(k, *row, sums if k == home else [0] * len(sums)) for k, row in sorted(out.items())]
    kinds = [pa.int32(), *[pa.binary()] * 7, pa.list_(pa.int64())]
    return pa.table([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=_ON_NAMES)


_TOTALS = "tokens long, words long, pairs long, one long, two long, three long, four long, sums array<long>"


def _merge_words(parts: pa.Table, folder: str) -> pa.Table:
    shard = parts["shard"][0].as_py()
    hashes = lambda name: np.concatenate([np.frombuffer(b or b"", "<u8") for b in parts[name].to_pylist()])
    numbers = lambda name: np.concatenate([_large(b) for b in parts[name].to_pylist()])
    word, count, before = _summed(hashes("word"), numbers("count"), numbers("before"))
    sections = {"word-key": word, **_bytes("word-", np.stack([count, before], axis=1))}
    for name in ("context", "single"):
        key, *sums = _summed(hashes(name), *numbers(f"{name}_stats").reshape(-1, 4).T)
        sections |= _followed(f"{name}-", key, np.stack(sums, axis=1).reshape(-1, 4))
    _write(folder, f"words-{shard}", sections)
    row = [int(count.sum()), len(word), int(before.sum()), *_of_counts(before)]
    sums = np.sum(parts["sums"].to_pylist(), axis=0, dtype=np.int64).tolist()
    return pa.table({**{n: pa.array([x], pa.int64()) for n, x in zip(("tokens", "words", "pairs", "one", "two", "three", "four"), row)}, "sums": pa.array([sums], pa.list_(pa.int64()))})


def discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    """Of modified Kneser-Ney, for counts 1, 2 and 3 or more, from how many entries have counts 1 to 4; kept within the counts."""
    n1, n2, n3, n4 = counts_of_counts
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    wanted = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(wanted, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays of a model lie, and its totals."""

    folder: str
    layout: Layout
    tokens: int
    words: int
    pairs: int
    triple_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    spread: float  # of the probability of words, what goes evenly to all words and the unknown one


def mounted(folder: str) -> str:
    """A shared folder as a path that workers can map into memory."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"workers map the model into memory: spark.checkpoint.dir must be a mounted folder, not {folder}")
    return unquote(url.path) if url.scheme else folder


def layout_of(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> Layout:
    """A shard for each shard_bytes of text. Words that a sample shows to have half a shard's tokens or more are dealt over several.

    The sample is of some 2,400 bytes of text for each shard (4 MB at least), by a hash of the text. It says
    where entries go only: a frequent word that it misses makes a shard larger, and no count or score other.
    """
    size = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shards = max(1, -(-size // shard_bytes))
    if shards == 1:
        return Layout(1)
    share = min(1.0, max(4 << 20, 2400 * shards) / size)
    chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = chosen.select(F.explode(words(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") * (2 * shards) >= total).collect()  # 2 * shards words at most
    parts = sorted((_hash(r["word"].encode()), min(shards, 1 + math.ceil(4 * shards * r["n"] / total))) for r in often)
    start = (_hash(_START), min(shards, 8))  # texts begin at one context
    parts = sorted([*parts, start])
    return Layout(shards, tuple(h for h, _ in parts), tuple(n for _, n in parts))


def train(texts: DataFrame, layout: Layout | None = None) -> Model:
    """Counts a model over texts (text string): nulls count as empty texts, which have an end."""
    spark = texts.sparkSession
    folder = f"{mounted(shared_dir(spark))}/trigrams-{uuid.uuid4().hex}"
    layout = layout or layout_of(texts)
    os.makedirs(folder)
    tasks = -(-layout.shards // GROUPED)  # so many partitions, and keys that give each one of them, so that a task's part doesn't grow with the corpus
    parts = texts.select("text").mapInArrow(lambda batches: _count(batches, layout), _PARTS).repartition(tasks, "task")
    on = parts.groupBy("task").applyInArrow(lambda t: _merge(t, folder, layout), _ON)
    totals = on.repartition(tasks, "shard").groupBy("shard").applyInArrow(lambda t: _merge_words(t, folder), _TOTALS).collect()  # a row for each shard
    tokens_, words_, pairs, *of_words = (sum(r[k] for r in totals) for k in range(7))
    grams, distinct, _, *of_counts = (sum(r["sums"][k] for r in totals) for k in range(11))
    files = {name: os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder) if name.count(".") == 0}
    there = [_mapped(f"{folder}/{name}") for name in files if name.startswith("grams-")]
    if (grams, distinct) != tuple(sum(len(a[f"{name}-once-high"]) + len(a[f"{name}-high"]) for a in there) for name in ("triple", "pair")):
        raise RuntimeError(f"{folder} lacks arrays that tasks have written")
    with open(f"{folder}/files.json", "w") as f:
        json.dump(files, f)
    d = discounts(of_words)
    rest = words_ - of_words[0] - of_words[1]
    spread = (d[0] * of_words[0] + d[1] * of_words[1] + d[2] * rest) / pairs if pairs else 1.0
    return Model(folder, layout, tokens_, words_, pairs, discounts(of_counts[:4]), discounts(of_counts[4:]), d, spread)


class Lookup:
    """Maps a model's shards into memory while they are read; what stays mapped is one shard, however large the model."""

    def __init__(self, model: Model):
        self.model = model
        with open(f"{model.folder}/files.json") as f:
            self.files = json.load(f)

    def _shard(self, kind: str, k: int) -> dict[str, np.ndarray]:
        """A shard's arrays; none for a shard that nothing went to."""
        name = f"{kind}-{k}"
        if name not in self.files:
            return {}
        path = f"{self.model.folder}/{name}"
        if not os.path.exists(path) or os.path.getsize(path) != self.files[name]:
            raise FileNotFoundError(f"{path} is missing or not whole")
        return _mapped(path)

    def _each(self, kind: str, shards: np.ndarray):
        """(arrays, which) for each shard that is asked for and holds something."""
        order = np.argsort(shards, kind="stable")
        for here in np.split(order, _starts(shards[order])[1:]):
            if len(here) and (arrays := self._shard(kind, int(shards[here[0]]))):
                yield arrays, here

    def numbers(self, kind: str, prefix: str, shards: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """Rows of numbers by hashes, zero where they are missing."""
        out = np.zeros((len(keys), width), dtype=np.int64)
        for arrays, here in self._each(kind, shards):
            here = here[np.argsort(keys[here])]  # reads go through the arrays in order
            at = _place(arrays, prefix, keys[here])
            here, at = here[at >= 0], at[at >= 0]
            out[here] = _numbers(arrays, prefix, at, width)
        return out

    def counts(self, name: str, shards: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts of n-grams."""
        out = np.zeros(len(keys), dtype=np.int64)
        for arrays, here in self._each("grams", shards):
            here = here[np.argsort(keys[here])]  # reads go through the arrays in order
            out[here[_place(arrays, f"{name}-once-", keys[here]) >= 0]] = 1
            here = here[out[here] == 0]
            at = _place(arrays, f"{name}-", keys[here])
            here, at = here[at >= 0], at[at >= 0]
            out[here] = _numbers(arrays, f"{name}-", at, 1)[:, 0]
        return out

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Raw count and number of words before, of each word, by all bits of its hash."""
        out = np.zeros((len(hashes), 2), dtype=np.int64)
        for arrays, here in self._each("words", _range(hashes, self.model.layout.shards)):
            known = arrays["word-key"]
            if len(known):
                here = here[np.argsort(hashes[here])]
                at = np.minimum(np.searchsorted(known, hashes[here]), len(known) - 1)
                hit = known[at] == hashes[here]
                out[here[hit]] = _numbers(arrays, "word-", at[hit], 2)
        return out

    def _followers(self, prefix: str, v: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """What follows contexts that end in v: with v's trigrams, or with the words if v is frequent."""
        shards, split = self.model.layout.of_contexts(v, keys), self.model.layout.split(v) > 1
        out = np.zeros((len(keys), 4), dtype=np.int64)
        for kind, chosen in (("grams", np.flatnonzero(~split)), ("words", np.flatnonzero(split))):
            out[chosen] = self.numbers(kind, prefix, shards[chosen], keys[chosen], 4)
        return out

    def score(self, chunk: _Chunk) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, score."""
        m = self.model
        hashes, w, v, u = chunk.arrays()
        n = np.int64(len(hashes))
        off = lambda d: np.array([0.0, *d])
        left_over = lambda s, d: np.where(s[:, 0] > 0, s[:, 1:] @ np.array(d) / np.maximum(s[:, 0], 1), 1.0)

        count, before = self.words(hashes).T
        base = np.log10((count + 1) / (m.tokens + m.words + 1))
        word_p = (before - off(m.word_discounts)[np.minimum(before, 3)]) / max(m.pairs, 1) + m.spread / (m.words + 1)

        pairs, pair_at = np.unique(v * n + w, return_inverse=True)
        pv, pw = np.divmod(pairs, n)
        pair_shards = m.layout.of_pairs(hashes[pv], hashes[pw])
        preceded = self.counts("pair", pair_shards, _mixed(hashes[pv], hashes[pw]))
        single = self._followers("single-", hashes, hashes)
        pair_p = (preceded - off(m.pair_discounts)[np.minimum(preceded, 3)]) / np.maximum(single[pv, 0], 1) + left_over(single, m.pair_discounts)[pv] * word_p[pw]

        # a context seen once isn't kept, as the pair that it is tells of it
        contexts, context_at = np.unique(u * n + v, return_inverse=True)
        cu, cv = np.divmod(contexts, n)
        context = _mixed(hashes[cu], hashes[cv])
        followers = self._followers("context-", hashes[cv], context)
        known = np.where(contexts == 0, m.tokens > 0, self._pair_known(pairs, preceded, contexts))
        alone = (followers[:, 0] == 0) & known & (m.layout.split(hashes[cv]) == 1)
        followers[alone] = (1, 1, 0, 0)

        grams, gram_at = np.unique(context_at * len(pairs) + pair_at, return_inverse=True)
        gc, gp = np.divmod(grams, len(pairs))
        seen = self.counts("triple", pair_shards[gp], _mixed(context[gc], hashes[pw[gp]]))
        p = (seen - off(m.triple_discounts)[np.minimum(seen, 3)]) / np.maximum(followers[gc, 0], 1) + left_over(followers, m.triple_discounts)[gc] * pair_p[gp]
        starts = np.cumsum([0, *chunk.lengths[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        return np.array(chunk.lengths), add((count > 0)[w].astype(np.int64)), add(base[w]), add(np.log10(p)[gram_at])

    @staticmethod
    def _pair_known(pairs: np.ndarray, preceded: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Whether the model has a pair that is a context here; but for two start marks, every context here is a pair here."""
        at = np.minimum(np.searchsorted(pairs, contexts), len(pairs) - 1)
        return (pairs[at] == contexts) & (preceded[at] > 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id long, text).

    Scores are log10 probabilities of a text and its end. Nulls count as empty. Repeated rows stay. A file of
    the model that is missing or not whole is an error.
    """

    def run(batches):
        lookup = Lookup(model)

        def flush(ids, chunk):
            n, known, base, own = lookup.score(chunk)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.tokens] * len(ids), pa.int64()), pa.array(base), pa.array(own)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        ids, chunk = [], _Chunk()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(i)
                    chunk.add(text)
                    if chunk.size >= SCORED_TOKENS:
                        yield flush(ids, chunk)
                        ids, chunk = [], _Chunk()
        if ids:
            yield flush(ids, chunk)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10, -score / n_tokens)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of those not held out. A null doc_id has no remainder: its text is learned from and isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
