"""Byte-pair encoding of a corpus with a public byte-level vocabulary, by a segment tree over the ranks of adjacent pairs.

Defined results. A null text and an empty text both have the ids [] (no text, no tokens). Special tokens are ordinary text. White
space is kept, blank texts have the tokens of their spaces. Texts of any length are encoded whole; invalid surrogates are replaced.
"""

from __future__ import annotations

import base64
import importlib.util
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the published splitting pattern of the byte-level 50k vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words whose ids a worker keeps.
WORDS = 1 << 17
BATCH_BYTES = 8 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabularies are; any other path may be passed to the operators instead."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent / name) if spec and spec.origin else f"/opt/tokenizers/{name}"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64 token and rank a line)."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def merge_by_tree(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word. Leaf i of the tree holds the rank of the pair that starts at part i; the root is the leftmost pair of the
    lowest rank. A merge touches the pairs left and right of it, each a point update up the tree, until no pair has a rank."""
    n = len(word)
    parts = [word[i : i + 1] for i in range(n)]
    if n == 1:
        return [ranks[word]]
    size = 1 << (n - 1).bit_length()
    none = len(ranks) * size + size
    # A key is rank * size + position, so the smallest key is the leftmost of the lowest rank.
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(parts[i] + parts[i + 1])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            key = a if a < b else b
            if tree[k] == key:
                break
            tree[k] = key
            k >>= 1

    while tree[1] < none:
        i = tree[1] % size
        j = after[i]
        parts[i] += parts[j]
        nxt = after[j]
        after[i] = nxt
        put(j, none)
        if nxt < n:
            before[nxt] = i
            r = get(parts[i] + parts[nxt])
            put(i, none if r is None else r * size + i)
        else:
            put(i, none)
        p = before[i]
        if p >= 0:
            r = get(parts[p] + parts[i])
            put(p, none if r is None else r * size + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Encoder:
    """Splits a text by the pattern and encodes its words, of which it keeps the latest."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.split = regex.compile(pattern)
        self.word = lru_cache(WORDS)(lambda w: merge_by_tree(w.encode("utf-8", "replace"), ranks))

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        word = self.word
        for m in self.split.findall(text):
            out += word(m) if len(m) < 64 else word.__wrapped__(m)
        return out


_encoders: dict[int, Encoder] = {}


def encode(df: DataFrame, key: str, text: str, path: str | None = None, count_only: bool = False) -> DataFrame:
    """(key, ids) of each row, or (key, n_tokens). The vocabulary, 50 thousand entries and under 1 MB, is read by the driver and
    broadcast as the file's bytes; each worker builds its encoder once. No shuffle: texts stay where they are read."""
    data = Path(path or vocabulary_path()).read_bytes()
    held = df.sparkSession.sparkContext.broadcast(data)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash(held.value)
        if mark not in _encoders:
            _encoders[mark] = Encoder(read_ranks(held.value))
        encoder = _encoders[mark]
        for b in batches:
            # Few long texts at a time: ids are far larger than text while they are Python numbers.
            step = max(1, min(b.num_rows, int(b.num_rows * BATCH_BYTES / max(1, b.nbytes)) or 1))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids = [encoder(t) for t in part.column(1).to_pylist()]
                last = pa.array([len(i) for i in ids], pa.int32()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), last], [key, "n_tokens" if count_only else "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens int" if count_only else "ids array<int>"))
