"""Texts packed into containers of fixed capacity, in tiers of context lengths.

Defined results. Every row gets a container: null and empty texts have no tokens and take no room. A text is split only if it exceeds
the largest capacity, into full containers and a rest that is packed like any text. Equal lengths are interchangeable; ties go by key.
An empty table gives an empty result. Capacities are positive and ascending.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import cut

# Parameters: context lengths of the tiers, and windows of the longest tier that one step takes.
CAPACITIES = (512, 1024, 2048, 4096)
STEP_WINDOWS = 8
#: Parts in which the pieces of one length are numbered, so that a hot length is no single task.
SALTS = 64


@dataclass
class Pattern:
    """``count`` equal containers of one tier: (length, how many, first offset) of the pieces each holds."""

    tier: int
    count: int
    parts: list[tuple[int, int, int]]
    used: int


def plan_tiers(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> list[Pattern]:
    """Containers for a histogram of lengths (1 to the largest capacity), longest first.

    Lengths are routed to the smallest tier that holds them. From the longest tier on, each length opens windows of its tier, and
    their gaps are filled with the longest pieces that fit, of its own tier and then of shorter ones. Equal windows are handled as
    one, so the work and the plan grow with the number of lengths, never with the number of texts.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left, reverse=True)
    out: list[Pattern] = []
    for length in lengths:
        if not left[length]:
            continue
        tier = next(c for c in capacities if c >= length)
        # A piece that fits its window twice or more fills it with its own kind first.
        stack = [Pattern(tier, left[length], [], 0)]
        many = min(tier // length, left[length])
        if many > 1:
            full, rest = divmod(left[length], many)
            stack = [Pattern(tier, full, [(length, many, 0)], many * length)] + ([Pattern(tier, 1, [(length, rest, 0)], rest * length)] if rest else [])
        else:
            stack = [Pattern(tier, left[length], [(length, 1, 0)], length)]
        left[length] = 0
        at = {id(p): 0 for p in stack}
        while stack:
            p = stack.pop()
            i = at.pop(id(p))
            while p.used < tier and i < len(lengths):
                gap, n = tier - p.used, lengths[i]
                if n > gap or not left[n]:
                    i += 1
                    continue
                many = min(gap // n, max(1, left[n] // p.count))
                windows = min(p.count, left[n] // many)
                if windows < p.count:
                    rest = Pattern(tier, p.count - windows, list(p.parts), p.used)
                    at[id(rest)] = i
                    stack.append(rest)
                    p.count = windows
                p.parts.append((n, many, p.used))
                p.used += many * n
                left[n] -= many * windows
            out.append(p)
    return out


def _slots(plan: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For each length, ascending intervals of piece numbers and where they go, as arrays sorted by (length, first number)."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for p in plan:
        for n, many, offset in p.parts:
            first = taken.get(n, 0)
            rows.append((n, first, base, many, offset, p.tier))
            taken[n] = first + many * p.count
        base += p.count
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(6))


def pack(lengths: DataFrame, key: str, size: str, capacities: tuple[int, ...] = CAPACITIES, step_windows: int = STEP_WINDOWS) -> DataFrame:
    """(key, piece, first_token, n_tokens, container_id, capacity, start, step) for every row of ``lengths`` (key, size).

    One pass counts pieces by length; the driver plans on that histogram, which has at most as many rows as the largest capacity.
    The pieces of each length are numbered in salted parts, whose sizes the same pass counts, and each piece finds its container
    by its number, with a search in the broadcast plan. Only keys and lengths are shuffled, once.
    Steps take the same number of tokens of each tier: containers are dealt to steps in the order of their filling.
    """
    top = capacities[-1]
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    pieces = lengths.select(F.col(key), n.alias("_n")).select(key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("_n") - 1) / top), F.lit(0)))).alias("piece"))
    pieces = pieces.select(key, F.col("piece").cast("int").alias("piece"), (F.col("piece") * top).alias("first_token"), F.least(F.lit(top).cast("long"), F.col("_n") - F.col("piece") * top).cast("int").alias("n_tokens"))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(SALTS)).cast("int"))
    # At most (capacity + 1) x SALTS rows.
    counts = pieces.groupBy("n_tokens", "_salt").agg(F.count("*").alias("n")).collect()
    by = np.zeros((top + 1, SALTS), np.int64)
    for r in counts:
        by[r.n_tokens, r._salt] = r.n
    begins = by.cumsum(1) - by
    plan = plan_tiers({int(k): int(v) for k, v in enumerate(by.sum(1)) if k and v}, capacities)
    lens, firsts, bases, manys, offsets, tiers = _slots(plan)
    containers = max(1, sum(p.count for p in plan))
    # Step of each container: within its tier, containers ordered by filling are dealt out in turn.
    order: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for p in plan:
        order.setdefault(p.tier, []).append((-p.used, base, p.count))
        base += p.count
    steps = max(1, -(-sum(p.tier * p.count for p in plan) // (top * step_windows)))
    runs = []
    for tier in sorted(order):
        rank = 0
        for _, first, count in sorted(order[tier]):
            runs.append((first, rank))
            rank += count
    runs.sort()
    run_first, run_rank = np.array([r[0] for r in runs] or [0], np.int64), np.array([r[1] for r in runs] or [0], np.int64)
    held = lengths.sparkSession.sparkContext.broadcast((begins, lens, firsts, bases, manys, offsets, tiers, run_first, run_rank))

    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        begins, lens, firsts, bases, manys, offsets, tiers, run_first, run_rank = held.value
        mark = lens * (1 << 40) + firsts
        for n_tokens, salt, number in batches:
            n, s = n_tokens.to_numpy(np.int64), salt.to_numpy(np.int64)
            r = begins[n, s] + number.to_numpy(np.int64) - 1
            k = np.clip(np.searchsorted(mark, n * (1 << 40) + r, "right") - 1, 0, max(0, len(mark) - 1))
            if len(mark):
                inside = r - firsts[k]
                container = bases[k] + inside // manys[k]
                start, capacity = offsets[k] + (inside % manys[k]) * n, tiers[k]
            else:
                container, start, capacity = np.zeros_like(n), np.zeros_like(n), np.full_like(n, top)
            none = n == 0
            container = np.where(none, r % containers, container)
            at = np.searchsorted(run_first, container, "right") - 1
            start = np.where(none, 0, start)
            step = (run_rank[at] + container - run_first[at]) % steps
            yield pd.DataFrame({"container_id": container, "capacity": np.where(none, 0, capacity).astype(np.int32), "start": start.astype(np.int32), "step": step})

    numbered = pieces.withColumn("_i", F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy(key, "piece")))
    put = F.pandas_udf(place, "container_id bigint, capacity int, start int, step bigint")
    return numbered.withColumn("_p", put("n_tokens", "_salt", "_i")).select(key, "piece", "first_token", "n_tokens", "_p.*")


def filling(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens and the share of the room that is used. Texts without tokens are left out."""
    per = packed.filter("n_tokens > 0").groupBy("capacity", "container_id").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * F.col("capacity")), 6).alias("used_share"))


def token_lengths(texts: DataFrame, key: str, counted: DataFrame) -> DataFrame:
    """The token counts, written once: tokenizing is the costly part and two passes follow."""
    return cut(counted.select(key, "n_tokens"), "lengths")
