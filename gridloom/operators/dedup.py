"""Duplicate evaluations: groups, kinds, and survivors by rank. Nulls in key columns group together; ``ordinal`` is the row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by two or more rows, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def classify(df: DataFrame, key: list[str], score: str) -> DataFrame:
    """Duplicate groups as redundant (one distinct score text) or conflict; '75' and '75.0' conflict, a null score is a text of its own."""
    per = df.groupBy(*key).agg(F.count("*").alias("n_rows"), (F.count_distinct(score) + F.max(F.col(score).isNull().cast("int"))).alias("n_scores"))
    return per.filter("n_rows > 1").withColumn("kind", F.when(F.col("n_scores") <= 1, "redundant").otherwise("conflict"))


def resolve(df: DataFrame, key: list[str], score: str, ordinal: str, tier: Column, year: Column) -> DataFrame:
    """All rows with ``kept``: the first of a redundant group, the best by (tier, latest year, order) of a conflict.

    Ranking is by window within a key: rows of one key are sorted, not collected, and a key shared by very many rows spills.
    The rank needs one shuffle, which the group's number of scores shares.
    """
    w = Window.partitionBy(*key)
    own = df.withColumn("_tier", tier).withColumn("_year", year)
    marked = own.withColumn("_conflict", (F.min(F.coalesce(score, F.lit(""))).over(w) != F.max(F.coalesce(score, F.lit(""))).over(w)))
    ranked = w.orderBy(F.when(F.col("_conflict"), F.col("_tier")).otherwise(0), F.when(F.col("_conflict"), -F.col("_year")).otherwise(0), ordinal)
    return marked.withColumn("kept", F.row_number().over(ranked) == 1).drop("_tier", "_year", "_conflict")


def keep_first(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The first row of each key, by a partial aggregation over struct rows: only one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), ordinal).alias("_r")).select(*key, "_r.*").select(*df.columns)


def keep_latest(df: DataFrame, key: list[str], day: Column, ordinal: str) -> DataFrame:
    """The row of each key with the latest day (none counts as oldest); ties go to the later row."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(day, F.lit("0001-01-01").cast("date")), F.col(ordinal))).alias("_r")).select(*key, "_r.*").select(*df.columns)


def versus_first(df: DataFrame, key: list[str], ordinal: str, compare: list[str]) -> DataFrame:
    """Later rows of a key with, for each compared column, whether it equals the key's first row."""
    w = Window.partitionBy(*key).orderBy(ordinal)
    firsts = df.withColumn("_n", F.row_number().over(w)).withColumn("_f", F.first(F.struct(*compare)).over(w))
    return firsts.filter("_n > 1").select(ordinal, *[F.col(c).eqNullSafe(F.col(f"_f.{c}")).alias(f"same_{c}") for c in compare])


def taxonomy(df: DataFrame, key: list[str], metric: str, source: str) -> DataFrame:
    """Number of duplicate groups that differ in metric, else in source, else in nothing."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(metric).alias("m"), F.count_distinct(source).alias("s")).filter("n > 1")
    kind = F.when(F.col("m") > 1, "different metrics").when(F.col("s") > 1, "different sources").otherwise("true duplicate")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


def split_true(df: DataFrame, key: list[str], metric: str, source: str, ordinal: str) -> DataFrame:
    """(ordinal, discarded): later rows of true duplicates (a single metric and at most one source) are discarded."""
    w = Window.partitionBy(*key)
    one = (F.min(metric).over(w).eqNullSafe(F.max(metric).over(w))) & (F.min(source).over(w).eqNullSafe(F.max(source).over(w)))
    return df.select(F.col(ordinal), (one & (F.row_number().over(w.orderBy(ordinal)) > 1)).alias("discarded"))


def issue_profile(df: DataFrame, number: Column, key: list[str]) -> DataFrame:
    """Rows, null scores, zero scores, blank ids and rows in duplicate groups, as one row."""
    flat = df.agg(F.count("*").alias("n_rows"), F.count_if(number.isNull()).alias("null_scores"), F.count_if(number == 0).alias("zero_scores"), F.count_if(F.coalesce(F.btrim("evaluation_id"), F.lit("")) == "").alias("blank_ids"))
    repeated = groups(df, key).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("duplicate_rows"))
    return flat.withColumn("_k", F.lit(0)).join(repeated.withColumn("_k", F.lit(0)), "_k").drop("_k")


def backfill(df: DataFrame, score: str, other: str, number: Column, other_number: Column, make_id: Column) -> DataFrame:
    """Zero or missing scores from the other score column, and blank evaluation ids from ``make_id``."""
    use = (number.isNull() | (number == 0)) & other_number.isNotNull()
    return df.withColumn(score, F.when(use, F.col(other)).otherwise(F.col(score))).withColumn("evaluation_id", F.when(F.coalesce(F.btrim("evaluation_id"), F.lit("")) == "", make_id).otherwise(F.col("evaluation_id")))
