"""From evaluations to a sparse matrix: names are collapsed and scores averaged twice (a mean of means, not a pooled mean)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_scores(facts: DataFrame, score: Column, fallback: Column) -> DataFrame:
    """``value`` from ``score``, or from ``fallback`` if no row at all has a number in ``score``."""
    probe = facts.select(score.alias("v")).filter("v is not null").limit(1).count()
    return facts.withColumn("value", score if probe else fallback)


def first_stated(facts: DataFrame, key: str, columns: list[str], ordinal: str) -> DataFrame:
    """Per key, each column's first value in row order that is neither null, blank nor 'nan', trimmed."""
    ok = lambda c: F.when(~F.lower(F.btrim(F.col(c))).isin("", "nan"), F.btrim(F.col(c)))
    return facts.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(ok(c), F.when(ok(c).isNotNull(), F.col(ordinal))).alias(c) for c in columns])


def pair_means(facts: DataFrame, entity: str, item: str) -> DataFrame:
    """Mean value per (entity, item); rows without either key vanish here."""
    return facts.filter(F.col(entity).isNotNull() & F.col(item).isNotNull()).groupBy(entity, item).agg(F.avg("value").alias("value"))


def collapsed_cells(means: DataFrame, key: Column, item: str) -> DataFrame:
    """The long matrix of a collapse key: the mean of its entities' means. Keys without any value don't appear."""
    return means.filter("value is not null").groupBy(key.alias("row_key"), F.col(item).alias("col_key")).agg(F.avg("value").alias("value"))


def pivot(cells: DataFrame, columns: list) -> DataFrame:
    """One row per row_key with the given columns, whose list is passed so that no extra pass finds them."""
    return cells.groupBy("row_key").pivot("col_key", columns).agg(F.first("value"))


def unpivot(wide: DataFrame, key: str) -> DataFrame:
    """The long matrix of a wide table; empty cells are left out."""
    values = [c for c in wide.columns if c != key]
    long = wide.select(F.col(f"`{key}`").alias("row_key"), *[F.col(f"`{c}`").cast("double") for c in values])
    return long.unpivot(["row_key"], values, "col_key", "value").filter("value is not null and not isnan(value)")
