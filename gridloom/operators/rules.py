"""Declarative rules over dimensions and facts. Nothing is written: each function returns the new tables.

Rule maps are hand-written and small. Sequential rules are resolved to one map on the driver, in rule order, so that a pass over the
facts is a single lookup whatever the number of rules; lookups are broadcast only after their size is checked.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.dedup import keep_first
from gridloom.runtime import checked_broadcast


def lookup(df: DataFrame, mapping: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Each column's value replaced by ``new`` where ``mapping`` (old, new) has it as ``old``; all at once, so chains don't run on."""
    small = checked_broadcast(mapping)
    for c in columns:
        df = df.join(small.select(F.col("old").alias("__gl_o"), F.col("new").alias("__gl_n")), F.col(c) == F.col("__gl_o"), "left").withColumn(c, F.coalesce("__gl_n", c)).drop("__gl_o", "__gl_n")
    return df


def chained(rules: dict[str, str], present: set[str]) -> dict[str, str]:
    """What each value becomes when the rules run one after the other; a rule whose source isn't present at the start is skipped."""
    out: dict[str, str] = {}
    for old, new in rules.items():
        if old not in present:
            continue
        for k, v in out.items():
            if v == old:
                out[k] = new
        out.setdefault(old, new)
    return {k: v for k, v in out.items() if k != v}


def mapping_frame(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rules.items()), "old string, new string")


def present_ids(dim: DataFrame, key: str, ids: Iterable[str]) -> set[str]:
    """Those of the (few) rule ids that the dimension holds."""
    ids = list(ids)
    return {r[0] for r in dim.filter(F.col(key).isin(ids)).select(key).distinct().collect()} if ids else set()


def remove(dim: DataFrame, key: str, facts: DataFrame, ref: str, ids: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Dimension and facts without the ids."""
    gone = sorted(present_ids(dim, key, ids))
    keep = lambda df, c: df.filter(F.col(c).isNull() | ~F.col(c).isin(gone)) if gone else df
    return keep(dim, key), keep(facts, ref)


def rename(dim: DataFrame, facts: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """model_id and model_name of both tables renamed, in rule order."""
    mapping = mapping_frame(dim, chained(rules, present_ids(dim, "model_id", rules)))
    return lookup(dim, mapping, ["model_id", "model_name"]), lookup(facts, mapping, ["model_name", "model_id"])


def remap(dim: DataFrame, facts: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Facts repointed to their target, present or not, and the old dimension rows dropped."""
    known = present_ids(dim, "model_id", rules)
    mapping = mapping_frame(dim, chained(rules, known))
    return (dim.filter(~F.col("model_id").isin(sorted(known))) if known else dim), lookup(facts, mapping, ["model_name", "model_id"])


def setup_extract(dim: DataFrame, facts: DataFrame, rules: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Facts folded into a base entity; the technique goes to ``setup`` only where that is the empty text."""
    known = present_ids(dim, "model_id", rules)
    setups = mapping_frame(dim, {k: s for k, (_, s) in rules.items() if k in known})
    small = checked_broadcast(setups.select(F.col("old").alias("__gl_o"), F.col("new").alias("__gl_s")))
    facts = facts.join(small, F.col("model_name") == F.col("__gl_o"), "left").withColumn("setup", F.when((F.col("setup") == "") & F.col("__gl_s").isNotNull(), F.col("__gl_s")).otherwise(F.col("setup"))).drop("__gl_o", "__gl_s")
    facts = lookup(facts, mapping_frame(dim, {k: b for k, (b, _) in rules.items() if k in known}), ["model_name", "model_id"])
    return (dim.filter(~F.col("model_id").isin(sorted(known))) if known else dim), facts


def merge_items(dim: DataFrame, facts: DataFrame, rules: dict[str, str], key: str = "benchmark_id") -> tuple[DataFrame, DataFrame]:
    """Items merged into a canonical one: blank canonical fields take the merged item's, facts are relabelled, merged items dropped.
    A rule whose source or target is missing, also through an earlier rule, is skipped."""
    alive = present_ids(dim, key, {*rules, *rules.values()})
    steps: list[tuple[str, str]] = []
    for old, new in rules.items():
        if old in alive and new in alive and old != new:
            steps.append((old, new))
            alive.discard(old)
    moved = chained(dict(steps), {o for o, _ in steps})
    # Fields come from the item itself, then from what was merged into it, in rule order.
    order = {old: i + 1 for i, (old, _) in enumerate(steps)}
    ranks = dim.sparkSession.createDataFrame([(o, moved[o], order[o]) for o, _ in steps], "__gl_o string, __gl_to string, __gl_rank int")
    tagged = dim.join(checked_broadcast(ranks), F.col(key) == F.col("__gl_o"), "left").withColumn("__gl_to", F.coalesce("__gl_to", key)).withColumn("__gl_rank", F.coalesce("__gl_rank", F.lit(0)))
    rest = [c for c in dim.columns if c != key]
    filled = [F.coalesce(F.min_by(F.col(c), F.when(F.btrim(F.col(c)) != "", F.col("__gl_rank"))), F.min_by(F.col(c), "__gl_rank")).alias(c) for c in rest]
    return tagged.groupBy(F.col("__gl_to").alias(key)).agg(*filled).select(*dim.columns), lookup(facts, mapping_frame(dim, moved), [key])


def apply_aliases(dim: DataFrame, facts: DataFrame, mapping: DataFrame, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """A simultaneous rename of both tables; dimension rows that then collide keep the first."""
    renamed = lookup(dim, mapping, ["model_id"])
    return keep_first(renamed, ["model_id"], ordinal), lookup(facts, mapping, ["model_name", "model_id"])


def upsert(dim: DataFrame, patch: DataFrame, key: str, overwrite: list[str], fill: list[str]) -> DataFrame:
    """Columns of ``patch`` (one row per key) over those of ``dim``: some always where they differ, some only into blanks."""
    p = checked_broadcast(patch.select(F.col(key).alias("__gl_k"), *[F.col(c).alias(f"_{c}") for c in (*overwrite, *fill)]))
    j = dim.join(p, F.col(key) == F.col("__gl_k"), "left")
    blank = lambda c: F.coalesce(F.btrim(F.col(c)), F.lit("")) == ""
    new = {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) for c in overwrite} | {c: F.when(blank(c), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in fill}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in dim.columns])


def guarded_update(dim: DataFrame, name: str, patch: DataFrame, column: str) -> DataFrame:
    """``column`` set from ``patch`` (name, value) for exact names, else for names that contain it if just one row does."""
    p = checked_broadcast(patch.select(F.col("name").alias("__gl_n"), F.col("value").alias("__gl_v")))
    exact = dim.join(p, F.col(name) == F.col("__gl_n"), "left")
    used = dim.join(p, F.col(name) == F.col("__gl_n"), "left_semi").select(F.col(name).alias("__gl_n")).distinct()
    loose = p.join(used, "__gl_n", "left_anti")
    hits = dim.select(name).join(checked_broadcast(loose), F.contains(F.lower(F.col(name)), F.lower("__gl_n"))).groupBy("__gl_n", "__gl_v").agg(F.count("*").alias("n"), F.min(name).alias("__gl_name")).filter("n = 1").select(F.col("__gl_name").alias("__gl_m"), F.col("__gl_v").alias("__gl_v2"))
    one = hits.groupBy("__gl_m").agg(F.min("__gl_v2").alias("__gl_v2"))
    return exact.join(checked_broadcast(one), F.col(name) == F.col("__gl_m"), "left").withColumn(column, F.coalesce("__gl_v", "__gl_v2", column)).select(*dim.columns)


def point_corrections(facts: DataFrame, row: str, drop: list[int], scores: dict[int, str], metrics: dict[str, str]) -> DataFrame:
    """Some rows dropped, some scores set, some metric names relabelled."""
    out = facts.filter(~F.col(row).isin(drop)) if drop else facts
    score: Column = F.col("score")
    for r, v in scores.items():
        score = F.when(F.col(row) == r, F.lit(v)).otherwise(score)
    return lookup(out.withColumn("score", score), mapping_frame(facts, metrics), ["metric_name"])


def add_missing(dim: DataFrame, key: str, facts: DataFrame, ref: str) -> DataFrame:
    """The dimension with a bare row for every referenced key it lacks, and without rows that nothing refers to."""
    refs = facts.select(F.col(ref).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return dim.join(refs, key, "left_semi").select(*dim.columns).unionByName(refs.join(dim.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_staged(facts: DataFrame, staged: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Staged rows that are new on the key, the first of each; rows whose key the facts hold are skipped. Nulls in keys match."""
    cond = None
    left = keep_first(staged, key, ordinal)
    right = facts.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    for c in key:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = one if cond is None else cond & one
    return left.join(right, cond, "left_anti").select(*staged.columns)
