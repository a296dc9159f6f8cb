"""SentencePiece encoding and decoding of merge-type (BPE) models by a table over prefixes.

For such models the encoding of a text ends, for each of its prefixes, in one
token only: the prefix's encoding is that of a shorter prefix plus that token.
The table of these last tokens is filled from left to right. An automaton gives
the pieces that end at a position; a piece is the prefix's last token if the
rest's last token and it are compatible, that is, if encoding both strings
together gives just the two. Ids are then read off the table from the end.

A text is cut where no merge can reach over: before a space that follows
another character if no piece has such a place inside, and around characters
that no piece holds. Encodings of the parts are remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .text import table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Parts whose encodings a worker remembers at most; then it starts afresh. Longer ones aren't remembered, so that the table is bounded in bytes too.
MOST_PARTS = 300_000
LONGEST_PART = 256
MOST_PAIRS = 700_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


class Bounded(dict):
    """A memo of `make` that is emptied when it has `most` entries; strings of more than `longest` characters aren't kept."""

    def __init__(self, make, most: int, longest: int = LONGEST_PART):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encodes and decodes as the sentencepiece library does, for BPE models with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        import ahocorasick

        top = list(_fields(model))
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        normalizer = dict(_fields(next(v for k, v in top if k == 3)))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only BPE models with byte fallback can be used")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that leave characters and spaces as they are can be used")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.pieces, self.kinds, self.scores = [], [], []
        for k, v in top:
            if k == 1:
                p = dict(_fields(v))
                self.pieces.append(p[1].decode())
                self.scores.append(struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(p.get(3, NORMAL))
        if {USER, UNUSED} & {*self.kinds}:
            raise ValueError("models with user-defined or unused pieces can't be used")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_at = {i: b for b, i in self.bytes_of.items()}
        scores = sorted({-self.scores[i] for i in self.ids.values()})
        place = {x: k for k, x in enumerate(scores)}
        self.rank = {p: place[-self.scores[i]] for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self._merged(p) == [p]:  # pieces that merging never makes are no last tokens
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.length_of = [len(p) for p in self.pieces]
        self.written = [str(i) for i in range(len(self.pieces))]
        self.spaced = [p.replace(SPACE, " ") for p in self.pieces]
        self.after: dict[int, dict[int, bool]] = {}  # by left piece: whether a right piece is compatible
        self.tested = 0
        inside = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        line = "" if any("\n" in p for p in self.ids) else "\n"  # a line feed that no piece holds splits as well
        self.parts = re.compile("[\\s\\S]+" if inside else f"{'\\n|' if line else ''}{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+").findall
        self.known = {p for p in self.ids if len(p) == 1}
        if not self.known.issuperset(c for p in self.ids for c in p):
            raise ValueError("only models whose pieces consist of characters that are pieces can be used")
        self.memo = Bounded(self._remembered, MOST_PARTS)

    def _merged(self, text: str) -> list[str]:
        """What merging makes of a short text, by definition: the pair with the best score first, the left one of equals."""
        rank, never = self.rank, len(self.rank)
        parts = list(text)
        pairs = [rank.get(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < never:
            k = pairs.index(best)
            parts[k] += parts.pop(k + 1)
            del pairs[k]
            if k:
                pairs[k - 1] = rank.get(parts[k - 1] + parts[k], never)
            if k < len(pairs):
                pairs[k] = rank.get(parts[k] + parts[k + 1], never)
        return parts

    def _pair(self, left: int, right: int) -> bool:
        a, b = self.pieces[left], self.pieces[right]
        return self._merged(a + b) == [a, b]

    def _run(self, text: str) -> list[int]:
        """Ids of a text whose characters all are pieces."""
        if self.tested > MOST_PAIRS:
            self.after.clear()
            self.tested = 0
        last: list[int] = []  # by end of prefix
        after, filled = self.after, -1
        for end, (token, length) in self.automaton.iter(text):
            if end == filled:
                continue
            before = end - length
            if before >= 0:
                left = last[before]
                right = after.get(left)
                if right is None:
                    right = after[left] = {}
                fits = right.get(token)
                if fits is None:
                    fits = right[token] = self._pair(left, token)
                    self.tested += 1
                if not fits:
                    continue
            last.append(token)
            filled = end
        ids, end, length_of = [], len(last) - 1, self.length_of
        while end >= 0:
            token = last[end]
            ids.append(token)
            end -= length_of[token]
        ids.reverse()
        return ids

    def _part(self, part: str) -> list[int]:
        ids: list[int] = []
        start = 0
        for k, c in enumerate(part):
            if c not in self.known:
                ids += self._run(part[start:k]) if k > start else []
                ids += [self.bytes_of[b] for b in c.encode()]
                start = k + 1
        return ids + (self._run(part[start:]) if start < len(part) else [])

    def _remembered(self, part: str) -> tuple[str, int, str]:
        written, spaced = self.written, self.spaced
        if self.known.issuperset(part):
            ids = self._run(part)
            return ",".join([written[i] for i in ids]), len(ids), "".join([spaced[i] for i in ids])
        ids = self._part(part)
        return ",".join([written[i] for i in ids]), len(ids), self._raw(ids)

    def _split(self, text: str) -> list[str]:
        return self.parts(self.prefix + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def encode_array(self, text: str | None) -> np.ndarray:
        written = ",".join([p[0] for p in map(self.memo.__getitem__, self._split(text or ""))])
        return np.fromstring(written, dtype=np.int32, sep=",") if written else np.zeros(0, dtype=np.int32)

    def _raw(self, ids: list[int]) -> str:
        """The pieces' text with spaces, without regard to the start of a text."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_at.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(" ⁇ " if self.kinds[i] == UNKNOWN else "" if self.kinds[i] == CONTROL else self.pieces[i])
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self._raw(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(SPACE) else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text."""
        found = list(map(self.memo.__getitem__, self._split(text or "")))
        decoded = "".join([p[2] for p in found])
        decoded = decoded[1:] if self.prefix and found else decoded  # a text that isn't empty starts with the prefix
        return sum([p[1] for p in found]), hashlib.sha256(",".join([p[0] for p in found]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _utf8(run: bytes) -> str:
    """Bytes as UTF-8; each byte that is no part of a character becomes U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        i += n
    return "".join(out)


def _worker_codec(model: bytes) -> Codec:
    """The codec of this worker, kept from task to task with what it remembers; its tables are bounded."""
    kept = sys.modules.setdefault("_quarrylane_codecs", types.ModuleType("_quarrylane_codecs")).__dict__
    key = hashlib.sha256(model).hexdigest()
    if key not in kept:
        kept[key] = Codec(model)
    return kept[key]


def _mapped(df: DataFrame, model: bytes, column: str, schema: str, make) -> DataFrame:
    """df plus what make(codec, value) gives for each value of a column, as an Arrow map of whole rows; model is small and goes along."""
    added = StructType.fromDDL(schema).names
    kept = [c for c in df.columns if c not in added]
    types = StructType([*df.select(*kept).schema.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(types)

    def run(batches):
        codec = _worker_codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [make(codec, v) for v in part.column(column).to_pylist()]
                new = [pa.array([m[k] for m in made], arrow.field(len(kept) + k).type) for k in range(len(added))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names=arrow.names)

    return df.select(*kept).mapInArrow(run, types)


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """Adds ids array<int> to docs (text, ...): no ids for a null or empty text. Rows stay as many; a column named ids is replaced."""
    return _mapped(docs, model, "text", "ids array<int>", lambda codec, text: (codec.encode_array(text),))


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """Adds text string to rows (ids array<int>, ...); null ids give an empty text."""
    return _mapped(rows, model, "ids", "text string", lambda codec, ids: (codec.decode(ids or []),))


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to docs (text, ...), without carrying ids and decoded texts around."""
    return _mapped(docs, model, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda codec, text: codec.digest(text))


def model_bytes(path: str | None = None) -> bytes:
    """The model file, by default the public one that is installed; it is never copied."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public model and decoded again, as digests; null counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, model_bytes()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
