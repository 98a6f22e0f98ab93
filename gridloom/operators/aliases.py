"""Registered ids that an unregistered name may mean: equal but for letter case, or similar by Ratcliff-Obershelp ratio."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import small_collect

CUTOFF, MOST = 0.8, 3
#: Registered ids that are sent to every task.
MAX_IDS = 2_000_000


def candidates(names: DataFrame, ids: DataFrame, column: str, cutoff: float = CUTOFF) -> DataFrame:
    """(name, rank, candidate): matches in another letter case first, then the up to three ids of the highest ratio of at least the
    cutoff. The registry is broadcast after its size is checked, and names stay where they are; per name only the ids
    whose length and letters allow the cutoff are compared, which drops no match.
    """
    listed = [r[0] for r in small_collect(ids.select(column).filter(F.col(column).isNotNull()).distinct(), MAX_IDS, column)]
    by_length: dict[int, list[str]] = {}
    for i in sorted(listed):
        by_length.setdefault(len(i), []).append(i)
    lower: dict[str, list[str]] = {}
    for i in sorted(listed):
        lower.setdefault(i.lower(), []).append(i)
    held = names.sparkSession.sparkContext.broadcast((by_length, lower))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length, lower = held.value
        for pdf in batches:
            out = []
            for name in pdf["name"]:
                n = len(name)
                # 2 x shorter / (sum of lengths) bounds the ratio.
                near = [i for length, group in by_length.items() if n + length and 2 * min(n, length) / (n + length) >= cutoff for i in group]
                found = [*lower.get(name.lower(), []), *difflib.get_close_matches(name, near, n=MOST, cutoff=cutoff)]
                out += [(name, k + 1, c) for k, c in enumerate(dict.fromkeys(found))]
            yield pd.DataFrame(out, columns=["name", "rank", "candidate"])

    return names.select("name").filter("name is not null").mapInPandas(run, "name string, rank int, candidate string")
