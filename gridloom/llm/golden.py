"""One surviving value per group and field: token-level consensus by progressive alignment and weighted votes.

Defined results. Null and placeholder values are no candidates. A group whose candidates all hold one value takes it. Equal
distances to the consensus go to the heavier value, then to the smallest row id. Groups of one row, and groups without candidates,
give no row. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values (or profiles) that one alignment takes at most; larger groups are aligned by levels of this fan-in.
FAN_IN = 64

#: Fall of a row's weight with each later day and each more trusted tier of its group, and share of the row loaded first.
FALL, FIRST = 8.0, 0.7

_TOKEN = regex.compile(r"[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*|[^\s\p{L}\p{M}\p{N}]")

Profile = list[dict[str, float]]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def align(a: Profile, b: Profile) -> Profile:
    """Global alignment of two profiles; columns that meet add up their votes, the others stand alone (a gap for the other side)."""
    wa, wb = max((sum(c.values()) for c in a), default=1.0), max((sum(c.values()) for c in b), default=1.0)

    scale = 2 / (wa * wb)
    # Most columns of the shorter side hold one token: its votes are looked up instead of intersecting two columns.
    single = [next(iter(y.items())) if len(y) == 1 else None for y in b]

    def meet(i: int, j: int) -> float:
        x = a[i]
        if single[j]:
            token, weight = single[j]
            return scale * x.get(token, 0.0) * weight - 0.8
        y = b[j]
        small, large = (x, y) if len(x) < len(y) else (y, x)
        return scale * sum(v * large[t] for t, v in small.items() if t in large) - 0.8

    n, m, gap = len(a), len(b), -0.5
    best = [[gap * j for j in range(m + 1)]]
    for i in range(1, n + 1):
        left = gap * i
        row = [left]
        up = best[-1]
        for j in range(1, m + 1):
            left = max(up[j - 1] + meet(i - 1, j - 1), up[j] + gap, left + gap)
            row.append(left)
        best.append(row)
    out: Profile = []
    i, j = n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + meet(i - 1, j - 1):
            i, j = i - 1, j - 1
            col = dict(a[i])
            for t, v in b[j].items():
                col[t] = col.get(t, 0.0) + v
            out.append(col)
        elif i and best[i][j] == best[i - 1][j] + gap:
            i -= 1
            out.append(dict(a[i]))
        else:
            j -= 1
            out.append(dict(b[j]))
    return out[::-1]


def profile_of(values: list[tuple[str, float]]) -> Profile:
    """Progressive alignment, heaviest value first, so that the most trusted values lay out the columns."""
    ordered = sorted(values, key=lambda v: (-v[1], v[0]))
    out: Profile = [{t: ordered[0][1]} for t in tokens(ordered[0][0])]
    for text, weight in ordered[1:]:
        out = align(out, [{t: weight} for t in tokens(text)])
    return out


def consensus(profile: Profile, total: float) -> list[str]:
    """The heaviest token of each column (the one laid out first among equals), unless the gap (all weight not voted in the column) is heavier."""
    out = []
    for col in profile:
        token, weight = max(col.items(), key=lambda x: x[1])
        if weight >= total - sum(col.values()):
            out.append(token)
    return out


def distance(a: list[str], b: list[str]) -> int:
    """Token edit distance; a common beginning and end cost nothing."""
    k, e, short = 0, 0, min(len(a), len(b))
    while k < short and a[k] == b[k]:
        k += 1
    while e < short - k and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _closest(values: list[dict], goal: list[str]) -> tuple[int, float]:
    far = [distance(tokens(v["value"]), goal) for v in values]
    k = min(range(len(values)), key=lambda i: (far[i], -values[i]["weight"], values[i]["row"]))
    return k, 1 - far[k] / max(1, len(goal))


_CHOICE = "value string, row bigint, agreement double"


def _choose(groups: pd.Series) -> pd.DataFrame:
    """Alignment, votes and choice for each group's distinct values."""
    out = []
    for g in groups:
        values = [dict(v) for v in g]
        if len(values) == 1:
            out.append((values[0]["value"], values[0]["row"], 1.0))
            continue
        goal = consensus(profile_of([(v["value"], v["weight"]) for v in values]), sum(v["weight"] for v in values))
        k, agreement = _closest(values, goal)
        out.append((values[k]["value"], values[k]["row"], agreement))
    return pd.DataFrame(out, columns=["value", "row", "agreement"])


_PROFILE = "columns array<map<string,double>>, total double"


def _profile(groups: pd.Series) -> pd.DataFrame:
    out = [(profile_of([(v["value"], v["weight"]) for v in g]), sum(v["weight"] for v in g)) for g in groups]
    return pd.DataFrame(out, columns=["columns", "total"])


def _merge(groups: pd.Series) -> pd.DataFrame:
    out = []
    for g in groups:
        parts = sorted(([[dict(c) for c in p["columns"]], p["total"]] for p in g), key=lambda p: -p[1])
        merged, total = parts[0]
        for columns, weight in parts[1:]:
            merged, total = align(merged, columns), total + weight
        out.append((merged, total))
    return pd.DataFrame(out, columns=["columns", "total"])


def _goal(columns: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([consensus([dict(x) for x in c], t) for c, t in zip(columns, total)])


def _far(value: pd.Series, goal: pd.Series) -> pd.Series:
    return pd.Series([float(distance(tokens(v), list(g))) for v, g in zip(value, goal)])


def survivors(values: DataFrame, group: list[str]) -> DataFrame:
    """The chosen value of each group: ``group``, value, row, agreement (1: it is the consensus).

    ``values`` holds one row per group and distinct value, with its weight and its representative row, so a hot group is already
    reduced by partial aggregation. A group of one value takes it. The alignment is a tree of fan-in FAN_IN: its leaves align values,
    heaviest first, its inner nodes align profiles, heaviest first; a group of at most FAN_IN values is one leaf, so no task holds
    more than FAN_IN values or profiles of a group. Then each value is compared with its group's consensus.
    """
    sized = values.groupBy(*group).agg(F.count("*").alias("_n"))
    most = (sized.agg(F.max("_n")).first() or [None])[0] or 0
    item = F.struct("value", "weight", "row")
    several = values.join(sized.filter(F.col("_n") > 1), group) if most > 1 else None
    # Arrays of one value need no Python; grouping finds them without another join.
    fits = values if most <= FAN_IN else values.join(sized.filter(F.col("_n") <= FAN_IN).select(*group), group)
    small = fits.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("_g"))
    alone = small.filter(F.size("_g") == 1).select(*group, F.col("_g")[0]["value"].alias("value"), F.col("_g")[0]["row"].alias("row"), F.lit(1.0).alias("agreement"))
    if several is None:
        return alone
    done = small.filter(F.size("_g") > 1).select(*group, F.pandas_udf(_choose, _CHOICE)("_g").alias("_c")).select(*group, "_c.*")
    if most <= FAN_IN:
        return alone.unionByName(done)
    big = several.filter(F.col("_n") > FAN_IN)
    slots = F.ceil(F.col("_n") / (FAN_IN // 2))
    level = big.withColumn("_slot", F.pmod(F.xxhash64("value"), slots)).groupBy(*group, "_slot", "_n").agg(F.sort_array(F.collect_list(item)).alias("_g"))
    level = level.select(*group, "_slot", F.pandas_udf(_profile, _PROFILE)("_g").alias("_p")).select(*group, "_slot", F.col("_p"))
    left = -(-most // (FAN_IN // 2))
    while True:
        left = -(-left // FAN_IN)
        level = level.withColumn("_slot", F.floor(F.col("_slot") / FAN_IN)).groupBy(*group, "_slot").agg(F.collect_list("_p").alias("_g")).select(*group, "_slot", F.pandas_udf(_merge, _PROFILE)("_g").alias("_p"))
        if left <= 1:
            break
    goal = level.select(*group, F.pandas_udf(_goal, "array<string>")("_p.columns", "_p.total").alias("_goal"))
    far = big.drop("_n").join(goal, group).withColumn("_d", F.pandas_udf(_far, "double")("value", "_goal"))
    best = far.groupBy(*group).agg(F.min(F.struct("_d", (-F.col("weight")).alias("_w"), "row", "value", F.size("_goal").alias("_k"))).alias("_b"))
    best = best.select(*group, "_b.value", "_b.row", (1 - F.col("_b._d") / F.greatest("_b._k", F.lit(1))).alias("agreement"))
    return alone.unionByName(done).unionByName(best)


def ranked_values(rows: DataFrame, group: str, row: str, fields: list[str], day: Column, trust: dict[str, Column]) -> DataFrame:
    """One row per group, field and distinct value: its weight in the vote, its heaviest row, and ``winner``: the smallest row that no
    other excels in day or trust (null: there is none), which takes no part in the vote. ``trust`` gives a rank per field, small is good.

    The weight of a row falls by the factor FALL with each later day and with each more trusted tier that its group has. The rows
    of one day and tier share their weight: FIRST of it goes to the row that was loaded first, the rest equally to all of them. So
    many old or doubtful reports don't outvote one good report by their number, and the votes within a day and tier still count.
    """
    long = rows.select(group, row, day.alias("_day"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), trust[f].alias("_tier")) for f in fields])).alias("_x")).select(group, row, "_day", "_x.*")
    long = long.filter("value is not null").withColumn("_day", F.coalesce("_day", F.lit("0001-01-01").cast("date")))
    key = [group, "field_name"]
    per = long.groupBy(*key, "value", "_day", "_tier").agg(F.count("*").alias("_n"), F.min(row).alias("_row"))
    best = F.max(F.struct(F.col("_day").alias("day"), (-F.col("_tier")).alias("trust"), (-F.col("_row")).alias("row")))
    top = per.groupBy(*key).agg(best.alias("_top"), F.min("_tier").alias("_least"), F.min("value").alias("_low"), F.max("value").alias("_high"), F.min("_row").alias("_first"))
    top = top.withColumn("winner", F.when(F.col("_top.trust") == -F.col("_least"), -F.col("_top.row")))
    alone = top.filter("_low = _high").select(*key, F.col("_low").alias("value"), F.coalesce("winner", "_first").alias("row"), F.lit(1.0).alias("weight"), "winner")
    mixed = per.join(top.filter("_low <> _high").select(*key, "winner"), key)
    # A group has at most as many classes as days times tiers.
    classes = mixed.groupBy(*key, "_day", "_tier").agg(F.sum("_n").alias("n"), F.min("_row").alias("row"))
    classes = classes.groupBy(*key).agg(F.collect_list(F.struct(F.col("_day").alias("day"), F.col("_tier").alias("tier"), "n", "row")).alias("_classes"))
    met = mixed.join(classes, key)
    above = lambda name, better: F.size(F.array_distinct(F.transform(F.filter("_classes", better), lambda c: c[name])))
    behind = above("day", lambda c: c.day > F.col("_day")) + above("tier", lambda c: c.tier < F.col("_tier"))
    mine = F.get(F.filter("_classes", lambda c: (c.day == F.col("_day")) & (c.tier == F.col("_tier"))), F.lit(0))
    share = F.when(F.col("_row") == mine["row"], FIRST).otherwise(0.0) + (1 - FIRST) * F.col("_n") / mine["n"]
    weighed = met.withColumn("_w", F.greatest(F.pow(F.lit(FALL), -behind) * share, F.lit(1e-300)))
    votes = weighed.groupBy(*key, "value").agg(F.max_by("_row", F.struct(F.col("_w"), -F.col("_row"))).alias("row"), F.sum("_w").alias("weight"), F.first("winner").alias("winner"))
    return alone.unionByName(votes)
