"""Referential checks between facts and dimensions, exhaustion, and pending names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import checked_broadcast

EXHAUSTED_BELOW = 5


def fk_violations(facts: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Distinct values of ``key`` that the dimension doesn't hold; null is no reference."""
    ids = facts.select(F.col(key).alias("id")).filter("id is not null").distinct()
    return ids.join(dim.select(F.col(dim_key).alias("id")), "id", "left_anti")


def orphans(dim: DataFrame, dim_key: str, facts: DataFrame, key: str) -> DataFrame:
    """Distinct dimension keys that no fact refers to."""
    return fk_violations(dim, dim_key, facts, key)


def exhausted(facts: DataFrame, key: str, below: int = EXHAUSTED_BELOW) -> DataFrame:
    """Keys present in the facts with fewer rows than ``below``, and their number; keys without rows are orphans instead."""
    return facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") < below)


def pending_names(lines: DataFrame, line: str = "value") -> DataFrame:
    """Names of bold list lines of a text file, cut at a parenthesis, in lower case."""
    name = F.regexp_extract(line, r"^\*\*(.*?)\*\*", 1)
    return lines.select(F.lower(F.btrim(F.substring_index(name, "(", 1))).alias("pending")).filter("pending <> ''").distinct()


def pending_status(pending: DataFrame, dim: DataFrame, columns: list[str]) -> DataFrame:
    """(pending, found): whether a pending name is part of any of the columns' lower-case texts. Pending names are a hand-kept list,
    which is proven small before it is sent to every task; beyond that the join is refused rather than made quadratic."""
    listed = checked_broadcast(pending.select("pending").distinct())
    texts = F.concat_ws("\n", *[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    hits = dim.select(texts.alias("_t")).distinct().join(listed, F.col("_t").contains(F.col("pending"))).select("pending").distinct().withColumn("found", F.lit(True))
    return pending.select("pending").distinct().join(hits, "pending", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def staged_issues(facts: DataFrame, number: Column, in_models: Column, in_benchmarks: Column, key: tuple[str, ...]) -> DataFrame:
    """Number of rows per staging check: empty, non-numeric and out-of-range scores, unknown references, duplicate keys."""
    flags = facts.select(
        F.when(F.coalesce(F.btrim("score"), F.lit("")) == "", 1).alias("empty_score"), F.when(number.isNull(), 1).alias("non_numeric"), F.when((number < 0) | (number > 100), 1).alias("out_of_range"),
        F.when(~in_models, 1).alias("unknown_model"), F.when(~in_benchmarks, 1).alias("unknown_benchmark"),
    )
    names = flags.columns
    counted = flags.agg(*[F.count(c).alias(c) for c in names])
    long = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("n_rows")) for c in names])).alias("x")).select("x.*")
    repeated = facts.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("duplicate_key").alias("check_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return long.unionByName(repeated)
