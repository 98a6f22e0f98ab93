"""Missing values filled from similar rows: k-prototypes clusters, their medians and modes, and coarser groups as fallback.

Defined results. Observed values are never changed. Each fill is marked by the level it came from; a value that no level can give
(the table states none at all) stays null with the mark ``none``. Ties of modes go to the smallest value. Null and
placeholder features are left out of the distance. An empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import cut

#: The first prototypes are taken from so many cells, in the order of a hash; every pass goes over all cells.
SEED_ROWS = 2_000
CLUSTERS = 8
PASSES = 10
#: Resolution of the standardised numeric features that are clustered, and the move of a mean below which it counts as settled.
CELL, SETTLED = 0.2, 0.05
#: Weight of a differing category against a squared standard deviation.
GAMMA = 0.7
#: Significant digits of the values that medians are taken of.
DIGITS = 4
#: Groups of a level that are broadcast.
FEW_GROUPS = 10_000


def _nearest(prototypes: list[dict], numeric: list[str], categorical: list[str]):
    """Function of Arrow batches of the features' columns to the number of the nearest prototype; a missing feature adds nothing."""
    means = np.array([[np.nan if p.get(c) is None else float(p[c]) for c in numeric] for p in prototypes])
    modes = [[p.get(c) for c in categorical] for p in prototypes]

    def nearest(*columns: pd.Series) -> pd.Series:
        far = np.zeros((len(columns[0]), len(prototypes)))
        for k in range(len(numeric)):
            gap = columns[k].to_numpy(float, na_value=np.nan)[:, None] - means[:, k]
            far += np.nan_to_num(gap * gap)
        for k in range(len(categorical)):
            code, values = pd.factorize(columns[len(numeric) + k])
            values = list(values)
            table = np.array([[GAMMA * (m[k] is not None and v != m[k]) for m in modes] for v in values] + [[0.0] * len(modes)])
            far += table[code]
        return pd.Series(far.argmin(1).astype("int32"))

    return nearest


def _assign(prototypes: list[dict], numeric: list[str], categorical: list[str]) -> Column:
    """The nearest prototype's number, by Arrow batch: as column expressions the distances took 9 microseconds a row, so 1."""
    return F.pandas_udf(_nearest(prototypes, numeric, categorical), "int")(*[F.col(c).cast("double") for c in numeric], *[F.col(c).cast("string") for c in categorical])


def feature_cells(features: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """All rows by distinct features: n rows and the mean of each numeric feature, which are grouped at a resolution of CELL.

    One scan and one aggregation; the passes of the clustering go over the cells, whose number is bounded by the features' ranges.
    """
    bins = [F.round(F.col(c) / CELL).alias(f"__gl_b{i}") for i, c in enumerate(numeric)]
    grouped = features.select(*bins, *numeric, *categorical).groupBy(*[f"__gl_b{i}" for i in range(len(numeric))], *categorical)
    return cut(grouped.agg(F.count("*").alias("__gl_n"), *[F.avg(c).alias(c) for c in numeric]).select("__gl_n", *numeric, *categorical), "cells")


def k_prototypes(features: DataFrame, numeric: list[str], categorical: list[str], clusters: int = CLUSTERS, passes: int = PASSES) -> list[dict]:
    """Prototypes (means of numeric and modes of categorical features) of ``clusters`` clusters.

    Numeric features should be standardised. Passes go on until no mean moves by more than SETTLED and no mode changes, ``passes`` of
    them at most. What reaches the driver is one row per cluster and one per cluster and categorical feature.
    """
    cells = feature_cells(features, numeric, categorical)
    seeds = cells.orderBy(F.xxhash64(*numeric, *categorical), *numeric, *categorical).limit(SEED_ROWS)
    sample = [r.asDict() for r in seeds.select(*numeric, *categorical).collect()]
    if not sample:
        return [dict.fromkeys([*numeric, *categorical])]
    # Spread seeds: each next one is the sampled cell farthest from those taken.
    gap = lambda r, p: sum((r[c] - p[c]) ** 2 for c in numeric if r[c] is not None and p[c] is not None) + sum(GAMMA for c in categorical if r[c] is not None and p[c] is not None and r[c] != p[c])
    sample.sort(key=lambda r: (-sum(v is not None for v in r.values()), str(sorted(r.items(), key=str))))
    chosen, near = [sample[0]], np.array([gap(r, sample[0]) for r in sample])
    while len(chosen) < clusters and near.max() > 0:
        chosen.append(sample[int(near.argmax())])
        near = np.minimum(near, [gap(r, chosen[-1]) for r in sample])
    for _ in range(passes):
        placed = cells.select(_assign(chosen, numeric, categorical).alias("cluster"), "__gl_n", *numeric, *categorical)
        # Sums by cluster and combination of categories first; from these few rows follow means and modes.
        weight = lambda c: F.when(F.col(c).isNotNull(), F.col("__gl_n"))
        sums = placed.groupBy("cluster", *categorical).agg(F.sum("__gl_n").alias("n"), *[x for c in numeric for x in (F.sum(F.col(c) * F.col("__gl_n")).alias(f"__gl_s_{c}"), F.sum(weight(c)).alias(f"__gl_k_{c}"))])
        # One row for the means (no feature named) and one per categorical feature for the modes.
        named = F.array(F.struct(F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("v")), *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical])
        long = sums.withColumn("__gl_x", F.explode(named)).filter("__gl_x.c is null or __gl_x.v is not null")
        totals = [x for c in numeric for x in (F.sum(f"__gl_s_{c}").alias(f"__gl_s_{c}"), F.sum(f"__gl_k_{c}").alias(f"__gl_k_{c}"))]
        top = long.groupBy("cluster", "__gl_x").agg(F.sum("n").alias("n"), *totals)
        top = top.groupBy("cluster", F.col("__gl_x.c").alias("c")).agg(F.min_by("__gl_x.v", F.struct(-F.col("n"), F.col("__gl_x.v"))).alias("v"), *[F.try_divide(F.sum(f"__gl_s_{c}"), F.sum(f"__gl_k_{c}")).alias(c) for c in numeric])
        moved = [dict(p) for p in chosen]
        for r in top.collect():
            for c in numeric if r.c is None else ():
                moved[r.cluster][c] = r[c] if r[c] is not None else moved[r.cluster][c]
            if r.c is not None:
                moved[r.cluster][r.c] = r.v
        still = all(abs((p[c] or 0.0) - (q[c] or 0.0)) <= SETTLED for p, q in zip(chosen, moved) for c in numeric) and all(p[c] == q[c] for p, q in zip(chosen, moved) for c in categorical)
        chosen = moved
        if still:
            break
    return chosen


def assign_clusters(df: DataFrame, prototypes: list[dict], numeric: list[str], categorical: list[str]) -> DataFrame:
    return df.withColumn("cluster", _assign(prototypes, numeric, categorical))


def _key(columns: list[str], by: list[str]) -> Column:
    """The group key of a level as one text; null where one of its columns is."""
    if not by:
        return F.lit("")
    texts = [F.get("__gl_keys", F.lit(columns.index(c))) for c in by]
    return F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])


def fill_targets(df: DataFrame, row: str, targets: dict[str, tuple[str, list[tuple[str, list[str]]]]]) -> DataFrame:
    """(row, field, number, text, level) of each missing field, filled from the first of its levels that has a value for it.

    ``targets`` gives for each field how it is filled (``median``, into number, or ``mode``, into text) and its levels: a name and the
    columns of its groups, finest first; no columns means all rows. One scan counts the values of all fields by their finest groups;
    the coarser levels are summed up from these counts. Medians are exact over values of DIGITS significant digits, which bounds what a group of any size
    holds. A second scan takes the rows that lack a field. Levels of few groups are broadcast (counted before), others are joined by
    group, where adaptive execution splits the rows of a hot group.
    """
    finest = {f: sorted({c for _, by in levels for c in by}) for f, (_, levels) in targets.items()}
    number = lambda f: F.col(f).cast("double") if targets[f][0] == "median" else F.lit(None).cast("double")
    text = lambda f: F.col(f).cast("string") if targets[f][0] == "mode" else F.lit(None).cast("string")
    keys = lambda f: F.array(*[F.col(c).cast("string") for c in finest[f]]).cast("array<string>")
    entry = lambda f: F.struct(F.lit(f).alias("field"), keys(f).alias("__gl_keys"), _digits(number(f)).alias("number"), text(f).alias("text"))
    stated = df.select(F.explode(F.array(*[F.when(F.col(f).isNotNull(), entry(f)) for f in targets])).alias("x")).filter("x is not null").select("x.*")
    counts = stated.groupBy("field", "__gl_keys", "number", "text").agg(F.count("*").alias("n"))

    def leveled(d: DataFrame) -> DataFrame:
        ways = F.coalesce(*[F.when(F.col("field") == f, F.array(*[F.struct(F.lit(i).alias("level"), _key(finest[f], by).alias("key")) for i, (_, by) in enumerate(levels)])) for f, (_, levels) in targets.items()])
        return d.withColumn("x", F.explode(ways)).select(*[c for c in d.columns if c != "__gl_keys"], "x.*").filter("key is not null")

    group = ["field", "level", "key"]
    summed = leveled(counts).groupBy(*group, "number", "text").agg(F.sum("n").alias("n"))
    found = summed.groupBy(*group).agg(F.percentile("number", 0.5, F.col("n")).alias("number"), F.min_by("text", F.struct(-F.col("n"), F.col("text"))).alias("text"))
    found = cut(found, "levels")
    lack = df.filter(reduce(or_, [F.col(f).isNull() for f in targets])).select(F.col(row).alias("__gl_row"), F.explode(F.array(*[F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"), keys(f).alias("__gl_keys"))) for f in targets])).alias("x"))
    lack = cut(lack.filter("x is not null").select("__gl_row", "x.*"), "gaps")
    sizes = [(r.field, r.level) for r in found.groupBy("field", "level").agg(F.count("*").alias("n")).collect() if r.n <= FEW_GROUPS]
    few = F.lit(False)
    for f, i in sizes:
        few = few | ((F.col("field") == f) & (F.col("level") == i))
    wanted = leveled(lack)
    # At most FEW_GROUPS groups for each level of each field.
    got = wanted.filter(few).join(F.broadcast(found.filter(few)), group).unionByName(wanted.filter(~few).join(found.filter(~few), group))
    best = got.groupBy("__gl_row", "field").agg(F.min_by(F.struct("number", "text", "level"), "level").alias("b"))
    names = F.coalesce(*[F.when((F.col("field") == f) & (F.col("b.level") == i), name) for f, (_, levels) in targets.items() for i, (name, _) in enumerate(levels)], F.lit("none"))
    return lack.select("__gl_row", "field").join(best, ["__gl_row", "field"], "left").select(F.col("__gl_row").alias(row), "field", "b.number", "b.text", names.alias("level"))


def _digits(x: Column) -> Column:
    """A number at DIGITS significant digits."""
    scale = F.pow(F.lit(10.0), DIGITS - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | ~scale.between(1e-300, 1e300), x).otherwise(F.rint(x * scale) / scale)


def fill_levels(df: DataFrame, row: str, target: str, levels: list[tuple[str, list[str]]], how: str) -> DataFrame:
    """(row, value, level) of each row that lacks ``target``: ``fill_targets`` of one field."""
    kind = dict(df.dtypes)[target]
    return fill_targets(df, row, {target: (how, levels)}).select(row, F.col("number" if how == "median" else "text").cast(kind).alias("value"), "level")


def with_fills(df: DataFrame, row: str, fills: dict[str, DataFrame]) -> DataFrame:
    """``df`` with the fills of each target in place and ``<target>_filled`` telling their level (null: observed)."""
    for target, got in fills.items():
        df = df.join(got.select(row, F.col("value").alias("__gl_v"), F.col("level").alias(f"{target}_filled")), row, "left").withColumn(target, F.coalesce(target, "__gl_v")).drop("__gl_v")
    return df
