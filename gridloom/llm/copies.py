"""Records hidden as copies by formatting: canonical forms, once/repeatedly-seen Bloom filters, and exact grouping of the rest.

Defined results. Null equals null and nothing else; an empty text is not null. Byte-identical rows are copies. Rows that differ in
any compared column beyond letter case, width, white space, punctuation or the order of parts are different records; numbers keep
their digits and decimal marks, and plus and percent signs count. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.values import fold_width
from gridloom.runtime import cut

#: Filter bits per row and of one shard; the filter grows with the rows. Shards are probed in rounds of at most ROUND_BITS (64 MB), so
#: that its size never bounds the rows: each round builds, broadcasts and probes the filter of one part of the hash space.
BITS_PER_ROW = 12
SHARD_BITS = 1 << 20
ROUND_BITS = 1 << 29
HASHES = 4
FAN_IN = 64

# ASCII symbols that separate parts like punctuation; plus and percent signs are not among them.
_SYMBOLS = r"|~^`<>=$"
_PART = r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{M}]+|[+%‰]|[^\p{L}\p{M}\p{Nd}\p{P}\p{Z}\p{C}" + _SYMBOLS + "]"


def canonical(c: Column) -> Column:
    """A text's parts (words, numbers, signs) in lower case and narrow width, sorted."""
    text = F.regexp_replace(F.lower(fold_width(c)), r"\p{Cf}+", "")
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(f"({_PART})"), F.lit(1))), " ")


def _spots(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and HASHES bit positions of each 64-bit hash."""
    u = h.view(np.uint64)
    shard = ((u >> np.uint64(44)) % np.uint64(shards)).astype(np.int64)
    a, b = u & np.uint64(SHARD_BITS - 1), ((u >> np.uint64(20)) & np.uint64(SHARD_BITS - 1)) | np.uint64(1)
    return shard, ((a[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(SHARD_BITS)).astype(np.int64)


def _filter_of(bits: np.ndarray) -> bytes:
    out = np.zeros(SHARD_BITS, np.uint8)
    out[bits.ravel()] = 1
    return zlib.compress(np.packbits(out).tobytes(), 1)


def _bits(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


_FILTERS = "shard int, part int, once binary, twice binary"


def _partial(shards: int, first: int, last: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not held:
            return
        seen, n = np.unique(np.concatenate(held), return_counts=True)
        shard, spots = _spots(seen, shards)
        part = int(seen[0] & 0x7FFF)
        for s in np.unique(shard):
            if first <= s < last:
                mine = shard == s
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "part": pa.array([part], pa.int32()), "once": [_filter_of(spots[mine])], "twice": [_filter_of(spots[mine & (n > 1)])]})

    return build


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(SHARD_BITS // 8, np.uint8), np.zeros(SHARD_BITS // 8, np.uint8)
    for a, b in zip(pdf["once"], pdf["twice"]):
        bits = _bits(a)
        twice |= (once & bits) | _bits(b)
        once |= bits
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "part": [0], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


def mark_repeats(hashed: DataFrame, hash_column: str, rows: int, round_bits: int = ROUND_BITS) -> DataFrame:
    """``hashed`` with ``maybe``: true for all rows whose hash occurs more than once, and for about one in fifty others.

    Each partition builds, by shard of the hash space, a filter of the hashes it holds and one of those it holds twice or more.
    Merging ORs them, and what two sides both hold once goes to the second filter as well. Only filters are shuffled, never rows;
    the second filter is broadcast and probed in place. A round takes the shards that fit in ``round_bits`` and the rows whose
    hash falls in them; its rows are written before the next round starts.
    """
    spark = hashed.sparkSession
    shards = max(1, -(-rows * BITS_PER_ROW // SHARD_BITS))
    per_round = max(1, round_bits // SHARD_BITS)
    done = []
    for first in range(0, shards, per_round):
        last = min(shards, first + per_round)
        # The shard is taken from the upper bits of the hash, as in _spots.
        shard = F.pmod(F.shiftrightunsigned(hash_column, 44), F.lit(shards))
        mine = hashed.filter(shard.between(first, last - 1)) if shards > per_round else hashed
        partial = mine.select(hash_column).mapInArrow(_partial(shards, first, last), _FILTERS)
        partial = partial.groupBy("shard", F.pmod("part", F.lit(FAN_IN)).alias("g")).applyInPandas(_merge, _FILTERS)
        merged = partial.groupBy("shard").applyInPandas(_merge, _FILTERS).select("shard", "twice").collect()
        held = spark.sparkContext.broadcast({r.shard: bytes(r.twice) for r in merged})
        done.append(cut(mine.withColumn("maybe", _probe(held, shards, first, last)(hash_column)), "copies"))
        held.unpersist()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _probe(held: Broadcast, shards: int, first: int, last: int):
    @F.pandas_udf("boolean")
    def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros((last - first, SHARD_BITS // 8), np.uint8)
        for s, data in held.value.items():
            table[s - first] = _bits(data)
        for h in batches:
            shard, spots = _spots(h.to_numpy(np.int64), shards)
            shard -= first
            hit = np.ones(len(h), bool)
            for k in range(HASHES):
                hit &= (table[shard, spots[:, k] >> 3] >> (7 - (spots[:, k] & 7)).astype(np.uint8)) & 1 == 1
            yield pd.Series(hit)

    return maybe


def possible_repeats(hashed: DataFrame, hash_column: str, rows: int) -> DataFrame:
    """The rows whose hash may occur more than once: all that do, and a few others."""
    return mark_repeats(hashed, hash_column, rows).filter("maybe").drop("maybe")


def keyed_rows(df: DataFrame, row: str, same: list[str], alike: list[str], round_bits: int = ROUND_BITS) -> DataFrame:
    """(row, key, maybe) of every row. Equal keys are exact copies: equal as stored in ``same`` and in canonical form in ``alike``.
    Rows that aren't marked have no copy; the canonical forms are made once."""
    kinds = dict(df.dtypes)
    text = lambda c: F.col(f"`{c}`") if kinds[c] == "string" else F.col(f"`{c}`").cast("string")
    held = [*[text(c) for c in same], *[canonical(text(c)) for c in alike]]
    canon = df.select(F.col(row), *[c.alias(f"__gl_c{i}") for i, c in enumerate(held)])
    cols = [F.col(f"__gl_c{i}") for i in range(len(held))]
    # Lengths keep neighbouring values apart and tell null from empty.
    packed = F.concat_ws("|", *[F.when(t.isNull(), "-").otherwise(F.concat_ws(":", F.length(t), t)) for t in cols])
    hashed = canon.select(row, F.unhex(F.sha2(packed, 256)).alias("key"))
    hashed = cut(hashed.withColumn("__gl_h", F.xxhash64("key")), "keys")
    return mark_repeats(hashed, "__gl_h", hashed.count(), round_bits).select(row, "key", "maybe")


def records(df: DataFrame, row: str, same: list[str], alike: list[str], round_bits: int = ROUND_BITS) -> DataFrame:
    """One row per record: its smallest row id and its number of copies (1: no other). Rows that the filter excludes as repeats are
    emitted in place; only the others are shuffled, pre-aggregated by key."""
    keyed = keyed_rows(df, row, same, alike, round_bits)
    repeated = keyed.filter("maybe").groupBy("key").agg(F.min(row).alias(row), F.count("*").alias("copies")).select(row, "copies")
    return keyed.filter("not maybe").select(row, F.lit(1).cast("long").alias("copies")).unionByName(repeated)


def copy_pairs(df: DataFrame, row: str, same: list[str], alike: list[str], round_bits: int = ROUND_BITS) -> DataFrame:
    """All pairs of copies, smaller row id first. The join streams over each key's rows; nothing is collected by key.

    n copies of one record are n (n - 1) / 2 pairs, which is what is asked for here. Where groups may be very large, take ``records``
    and ``keyed_rows`` instead: one row per record and the membership of each row, of the size of the input.
    """
    groups = keyed_rows(df, row, same, alike, round_bits).filter("maybe").select(row, "key")
    many = groups.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    groups = groups.join(many, "key")
    a, b = groups.select("key", F.col(row).alias(f"{row}_a")), groups.select("key", F.col(row).alias(f"{row}_b"))
    return a.join(b, "key").filter(F.col(f"{row}_a") < F.col(f"{row}_b")).select(f"{row}_a", f"{row}_b")
