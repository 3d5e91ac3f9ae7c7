"""Byte-level BPE by contiguous rank arrays, encoding and decoding whole texts.

A short word is held as part boundaries plus an array with the rank of every
adjacent pair. The array is scanned for its minimum, the boundary there goes,
and the two neighbouring ranks are looked up again, until no pair has a rank.
The scan is linear and the array contiguous, which beats any heap for words of
ordinary length; above LONG_PARTS parts the same merges come from a heap over a
linked list, so that a text without spaces stays far from quadratic time.

Work is per task: the frame is never shuffled, each Python worker holds the
vocabulary and two generations of encoded words. A single space between two
characters that are no white space always starts a new pre-token, so texts are
cut there and most words come from the cache.

Defined cases: null and empty texts have no ids and decode to the empty text;
the text of a special token in a document is that token, as in the library;
repeated rows, null keys and extra columns pass through unchanged; the name of
the new column is the caller's and must be new.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_PARTS = 64
CACHE_WORDS = 600_000
#: One of these after letters is a pre-token of its own.
TAILS = ".,;:!?"
#: Fixed value: the split pattern that the public vocabulary's library applies ahead of the merges.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = 1 << 30
#: White space other than the plain space; the ideographic space U+3000 is the last.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_JOINT = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare file name is looked up where the worker has its public vocabularies."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def odd_space(text: str) -> bool:
    """Whether a space stands next to white space or at either end, hence is no plain joint between words."""
    return (text[:1] == " " or text[-1:] == " " or "  " in text
            or any(f" {c}" in text or f"{c} " in text for c in _OTHER_SPACE if c in text))


def chunks_of(text: str) -> list[str]:
    """Pieces between plain joints; all but the first stand for a space and the piece."""
    return _JOINT.split(text) if odd_space(text) else text.split(" ")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Generations(dict):
    """Values by key in two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary (a public rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class RankArrayBpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        byte_of = alphabet()
        vocab = held["model"]["vocab"]
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in held["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.first = [0] * 256
        for c, b in byte_of.items():
            self.first[b] = vocab[c]
        self.rank_of: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(held["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of.setdefault(vocab[left] << 20 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.cut_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.pretokens = regex.compile(PRETOKENS).findall
        self.heads = Generations(self.chunk, 20_000)
        self.rest = Generations(lambda word: self.chunk(" " + word))
        self.rest.tails = {c: packed(self.plain(c)) for c in TAILS}

    def short(self, ids: list[int]) -> list[int]:
        """Scan for the lowest rank, delete that boundary, refresh its neighbours."""
        get, merged, none = self.rank_of.get, self.merged, NO_RANK
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            one = ids[at] = merged[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | one, none)
            if at < len(ranks):
                ranks[at] = get(one << 20 | ids[at + 1], none)
        return ids

    def long(self, ids: list[int]) -> list[int]:
        """The same merges for very long words: a heap of ranks over a linked list."""
        get, n = self.rank_of.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = bytearray(b"\x01" * n)
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (rank := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merged[rank], 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (rank := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return [x for x, lives in zip(ids, alive) if lives]

    def plain(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.pretokens(text):
            ids = [self.first[b] for b in word.encode()]
            out += self.short(ids) if len(ids) <= LONG_PARTS else self.long(ids)
        return out

    def chunk(self, text: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        if text[1:].isalpha() and text[0] == " ":  # letters alone are one pre-token
            ids = [self.first[b] for b in text.encode()]
            return packed(self.short(ids) if len(ids) <= LONG_PARTS else self.long(ids))
        if text[-1:] in TAILS and text[1:-1].isalpha() and text[0] == " ":
            return self.rest[text[1:-1]] + self.rest.tails[text[-1]]
        ids, at = [], 0
        for hit in self.cut_special.finditer(text):
            ids += self.plain(text[at: hit.start()])
            ids.append(self.special[hit.group()])
            at = hit.end()
        return packed(ids + self.plain(text[at:]))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = chunks_of(text)
        head = self.heads[pieces[0]] if len(pieces[0]) < 200 else self.chunk(pieces[0])
        return head + b"".join(map(self.rest.__getitem__, pieces[1:]))

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        whole = b"".join(map(of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return whole.decode("utf-8", "replace")


_HELD: dict[str, RankArrayBpe] = {}


def encoder(vocabulary: str) -> RankArrayBpe:
    """One encoder for each vocabulary and Python worker."""
    path = vocabulary_path(vocabulary)
    if path not in _HELD:
        _HELD[path] = RankArrayBpe(path)
    return _HELD[path]


def _column(batch: pa.RecordBatch, name: str, values: Iterable, kind: pa.DataType, step: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch with one more column, in short runs so that little is held at a time."""
    schema = batch.schema.append(pa.field(name, kind))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        made = pa.array([next(values) for _ in range(part.num_rows)], kind)
        yield pa.RecordBatch.from_arrays([*part.columns, made], schema=schema)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The frame with `out`: a text's ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        encode_one = encoder(vocabulary).encode
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            yield from _column(batch, out, (encode_one(x.as_py() or "") for x in column), pa.binary())

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{out}` binary")


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame with `out`: the text of the ids; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        decode_one = encoder(vocabulary).decode
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            yield from _column(batch, out, (decode_one(x.as_py() or b"") for x in column), pa.string())

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, `{out}` string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; one row for each document."""
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    ids = encode(named, vocabulary).select("doc_id", "ids")
    back = decode(ids, vocabulary)
    return back.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

