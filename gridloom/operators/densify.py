"""Greedy peeling of a sparse matrix to a target density, and the minimum-observation core."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranks import dense_ranks
from gridloom.runtime import cut

TARGET, MIN_OBS = 0.10, 2
#: Edges handled at once where a copy of all would double their room.
STEP = 1 << 18


def peel(cells: DataFrame, target: float = TARGET, axis: str = "col_key") -> DataFrame:
    """Drops the sparsest keys of ``axis`` first, and emptied keys of the other, until the density is at least ``target``.

    Dropping a column changes no other column's count, so the order is fixed beforehand by (count, key) and the state after k drops is
    a running sum; a row leaves when its last column does. The smallest k that meets the target is the answer. The running sums go
    over the columns' counts and the histogram of the rows' last columns, both as long as the list of columns, never over cells.
    """
    other = "row_key" if axis == "col_key" else "col_key"
    seen = cells.filter("value is not null").select("row_key", "col_key", "value")
    counts = seen.groupBy(axis).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rk", F.row_number().over(Window.orderBy("n", axis)))
    ranked = cut(ranked, "peel-ranks")
    placed = seen.join(ranked.select(axis, "rk"), axis)
    last = placed.groupBy(other).agg(F.max("rk").alias("rk")).groupBy("rk").agg(F.count("*").alias("leave"))
    run = Window.orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    after = ranked.join(last, "rk", "left").select("rk", F.sum("n").over(run).alias("gone"), F.sum(F.coalesce("leave", F.lit(0))).over(run).alias("left"))
    total = ranked.agg(F.sum("n").alias("cells"), F.count("*").alias("cols")).join(last.agg(F.sum("leave").alias("rows")))
    states = after.join(F.broadcast(total)).select(F.col("rk").alias("k"), (F.col("cells") - F.col("gone")).alias("c"), (F.col("rows") - F.col("left")).alias("r"), (F.col("cols") - F.col("rk")).alias("m"))
    states = states.unionByName(total.select(F.lit(0).alias("k"), F.col("cells").alias("c"), F.col("rows").alias("r"), F.col("cols").alias("m")))
    t = F.lit(Decimal(str(target)))
    k = states.filter((F.col("r") > 0) & (F.col("m") > 0) & (F.col("c") >= t * F.col("r") * F.col("m"))).agg(F.min("k").alias("k"))
    return placed.join(F.broadcast(k), F.col("rk") > F.col("k")).select("row_key", "col_key", "value")


def symmetric_peel(cells: DataFrame, target: float = TARGET) -> DataFrame:
    """Drops, one by one, the key of either axis with the lowest fill rate (a column before a row of the same rate, then the first).

    Sequential by definition: the edges go to one task as pairs of ranks, 8 bytes each, and in the room of these pairs become two lists of
    neighbours. Each drop updates only the dropped key's neighbours.
    """
    edges = cells.filter("value is not null").select(F.col("row_key").cast("string").alias("r"), F.col("col_key").cast("string").alias("c"))
    edges = cut(edges.filter("r is not null and c is not null"), "peel-edges")
    rows, cols = cut(dense_ranks(edges, ["r"], "i"), "peel-rows"), cut(dense_ranks(edges, ["c"], "j"), "peel-cols")
    coded = edges.join(rows, "r").join(cols, "c").select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    n = edges.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = _packed(batches, n)
        if not n:
            return
        i, j = _peel_pairs(packed, target)
        for k in range(0, len(i), 100_000):
            yield pd.DataFrame({"i": i[k : k + 100_000], "j": j[k : k + 100_000]})

    kept = coded.repartition(1).mapInPandas(run, "i int, j int")
    return kept.join(rows, "i").join(cols, "j").select(F.col("r").alias("row_key"), F.col("c").alias("col_key"))


def _packed(batches: Iterator[pd.DataFrame], n: int) -> np.ndarray:
    """The n pairs of the batches as column << 32 | row, each batch written to its place at once."""
    packed, at = np.empty(n, np.int64), 0
    for b in batches:
        if at + len(b) > n:
            raise ValueError(f"more than the {n} edges that were counted")
        packed[at : at + len(b)] = b["j"].to_numpy("int64") << 32 | b["i"].to_numpy("int64")
        at += len(b)
    if at < n:
        raise ValueError(f"{at} edges of the {n} that were counted")
    return packed


def _neighbours(packed: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of columns, then of rows: where each key's neighbours start, and the neighbours in order.

    Both lists of neighbours lie in the room of ``packed``, whose pairs are lost; what is held besides grows with the keys only.
    """
    packed.sort()
    size, last = 0, -1
    for a in range(0, len(packed), STEP):
        part = packed[a : a + STEP]
        part = part[np.diff(part, prepend=last) != 0]  # a pair given twice is one edge
        packed[size : size + len(part)] = part
        size, last = size + len(part), part[-1] if len(part) else last
    packed = packed[:size]
    col_at = np.searchsorted(packed, np.arange((packed[-1] >> 32) + 2, dtype=np.int64) << 32)
    halves, low = packed.view(np.int32), 0 if sys.byteorder == "little" else 1
    for a in range(0, size, STEP):
        b = min(a + STEP, size)
        halves[a:b] = halves[2 * a + low : 2 * b : 2].copy()
    rows, cols = halves[:size], halves[size:]
    counts = np.zeros(int(rows.max()) + 1, np.int64)
    for a in range(0, size, STEP):
        np.add.at(counts, rows[a : a + STEP], 1)
    row_at = np.concatenate([[0], np.cumsum(counts)])
    free = row_at[:-1].copy()
    for a in range(0, size, STEP):
        b = min(a + STEP, size)
        pairs = rows[a:b].astype(np.int64) << 32 | np.searchsorted(col_at, np.arange(a, b), "right") - 1
        pairs.sort()
        r = pairs >> 32
        first = np.flatnonzero(np.diff(r, prepend=-1))
        times, r = np.diff(first, append=b - a), r[first]
        cols[np.repeat(free[r] - first, times) + np.arange(b - a)] = pairs & 0xFFFFFFFF
        free[r] += times
    return [col_at, row_at], [rows, cols]


def _peel_pairs(packed: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
    """The (row, column) codes left by the symmetric peel of the pairs column << 32 | row, whose room is used up and holds the result.

    A key's place is count * keys + code, so the smallest place is the next key of its side; places only fall, so the smallest place of a
    block of keys falls with them and is taken again only where a key leaves.
    """
    gone = np.iinfo(np.int64).max
    ptr, adj = _neighbours(packed)
    place, least, live, size, block = [], [], [], [], []
    for side in range(2):  # columns, rows
        counts = np.diff(ptr[side])
        n = len(counts)
        width = 1 << max(4, n.bit_length() // 2)
        places = np.full(-(-n // width) * width, gone)
        places[:n] = np.where(counts > 0, counts * n + np.arange(n), gone)
        place.append(places), least.append(places.reshape(-1, width).min(1)), live.append(int((counts > 0).sum())), size.append(n), block.append(width)
    left = len(adj[0])
    while live[0] and live[1] and left < target * live[0] * live[1]:
        (nc, c), (nr, r) = (divmod(int(least[s].min()), size[s]) for s in range(2))
        s, k = (0, c) if nc * live[0] <= nr * live[1] else (1, r)
        o, at = 1 - s, k // block[s]
        place[s][k] = gone
        least[s][at] = place[s][at * block[s] : (at + 1) * block[s]].min()
        live[s] -= 1
        near = adj[s][ptr[s][k] : ptr[s][k + 1]]
        now = place[o][near]
        alive = now != gone
        near, now = near[alive], now[alive] - size[o]
        left -= len(near)
        empty = now < size[o]
        if empty.any():
            live[o] -= int(empty.sum())
            now[empty] = gone
        place[o][near] = now
        np.minimum.at(least[o], near // block[o], now)
        for at in set((near[empty] // block[o]).tolist()):
            least[o][at] = place[o][at * block[o] : (at + 1) * block[o]].min()
    end = 0
    for c in np.flatnonzero(place[0][: size[0]] != gone):
        x = adj[0][ptr[0][c] : ptr[0][c + 1]]
        x = x[place[1][x] != gone]
        adj[0][end : end + len(x)], adj[1][end : end + len(x)] = x, c  # never beyond what was read
        end += len(x)
    return adj[0][:end], adj[1][:end]


def core(cells: DataFrame, min_obs: int = MIN_OBS) -> DataFrame:
    """The largest part of the matrix in which every row and column has at least ``min_obs`` cells: rows and columns below the floor
    are dropped until none is left. Each round is written to the shared folder, so the plan doesn't grow with the rounds."""
    now = cut(cells.filter("value is not null").select("row_key", "col_key", "value"), "core")
    n = now.count()
    while True:
        for axis in ("row_key", "col_key"):
            keep = now.groupBy(axis).agg(F.count("*").alias("n")).filter(F.col("n") >= min_obs).select(axis)
            now = now.join(keep, axis, "left_semi")
        now = cut(now.select("row_key", "col_key", "value"), "core")
        left = now.count()
        if left == n:
            return now
        n = left


def summary(before: DataFrame, after: DataFrame, strategy: str, densifier: str, min_obs: int = MIN_OBS) -> DataFrame:
    """The one-row record of a densified slice."""

    def shape(df: DataFrame, p: str) -> DataFrame:
        return df.filter("value is not null").agg(F.count_distinct("row_key").alias(f"{p}r"), F.count_distinct("col_key").alias(f"{p}c"), F.count("*").alias(f"{p}n"))

    pct = lambda p: F.try_divide(F.col(f"{p}n") * 100.0, F.col(f"{p}r") * F.col(f"{p}c"))
    both = shape(before, "o").join(shape(after, "k"))
    return both.select(
        F.lit(strategy).alias("strategy"), F.lit(densifier).alias("densifier"), F.col("or").alias("orig_models"), F.col("oc").alias("orig_benchmarks"), F.round(pct("o"), 4).alias("orig_density_pct"), F.col("kr").alias("kept_models"),
        F.col("kc").alias("kept_benchmarks"), F.lit(min_obs).alias("min_obs"), F.round(pct("k"), 4).alias("density_pct"), F.round(100 - pct("k"), 4).alias("sparsity_pct"), F.round(F.try_divide(F.col("kn") * 100.0, F.col("on")), 2).alias("data_retained_pct"),
    )
