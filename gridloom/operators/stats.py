"""Aggregates over facts and over long matrices (row_key, col_key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_stats(facts: DataFrame, entity: str, item: str, number: Column) -> DataFrame:
    """Distinct items, rows and mean score per entity. Distinct items are counted over (entity, item) pairs that a partial
    aggregation has already made few, so a hot entity is not one task's set."""
    pairs = facts.filter(F.col(entity).isNotNull()).groupBy(entity, item).agg(F.count("*").alias("_n"), F.sum(number).alias("_s"), F.count(number).alias("_k"))
    return pairs.groupBy(entity).agg(F.count(item).alias("n_items"), F.sum("_n").alias("n_rows"), F.try_divide(F.sum("_s"), F.sum("_k")).alias("mean_score"))


def with_stats(dim: DataFrame, key: str, stats: DataFrame, entity: str) -> DataFrame:
    """The dimension with its three derived columns as text: counts with one decimal, the mean with two, blank without scores."""
    s = stats.select(F.col(entity).alias("_k"), "n_items", "n_rows", "mean_score")
    j = dim.join(s, F.col(key) == F.col("_k"), "left")
    text = lambda f, c: F.format_string(f, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    new = {"benchmark_count": text("%.1f", "n_items"), "total_results": text("%.1f", "n_rows"), "avg_score": F.when(F.col("mean_score").isNotNull(), F.format_string("%.2f", "mean_score")).otherwise("")}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in dim.columns])


def matrix_stats(cells: DataFrame, name: str) -> DataFrame:
    """Entities, items, cells, filled cells, density and sparsity in percent of one long matrix."""
    rows, cols = F.count_distinct("row_key"), F.count_distinct("col_key")
    a = cells.filter("value is not null").agg(rows.alias("n_rows"), cols.alias("n_cols"), F.count("*").alias("non_null"))
    total = F.col("n_rows") * F.col("n_cols")
    density = F.round(F.try_divide(F.col("non_null") * 100.0, total), 4)
    return a.select(F.lit(name).alias("strategy"), "n_rows", "n_cols", total.alias("total_cells"), "non_null", density.alias("density_pct"), F.round(100.0 - density, 4).alias("sparsity_pct"))


def column_moments(cells: DataFrame) -> DataFrame:
    """Mean, sample standard deviation and count of the observed cells of each column."""
    return cells.filter("value is not null").groupBy("col_key").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))


def drop_degenerate(cells: DataFrame, min_obs: int = 2) -> DataFrame:
    """Without columns of fewer than ``min_obs`` observations or without variance (either is enough)."""
    good = cells.filter("value is not null").groupBy("col_key").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).filter((F.col("n") >= min_obs) & (F.col("n") > 1) & (F.col("lo") < F.col("hi")))
    return cells.join(good.select("col_key"), "col_key", "left_semi").select("row_key", "col_key", "value")


def fill_rates(cells: DataFrame, axis: str) -> DataFrame:
    """Observed cells per key of ``axis`` (row_key or col_key) and their share of the other axis."""
    other = "col_key" if axis == "row_key" else "row_key"
    seen = cells.filter("value is not null")
    size = seen.agg(F.count_distinct(other).alias("_size"))
    return seen.groupBy(axis).agg(F.count("*").alias("n")).join(F.broadcast(size)).withColumn("rate", F.round(F.col("n") / F.col("_size"), 6)).drop("_size")


def moment_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, min, median, max, mean, sample variance, skew and raw kurtosis with the sample deviation in the z-scores."""
    n = F.count(value)
    shrink = (n - 1) / n
    return df.groupBy(*by).agg(
        n.alias("n"), F.min(value).alias("min"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"),
        (F.skewness(value) * F.pow(shrink, 1.5)).alias("skew"), ((F.kurtosis(value) + 3) * F.pow(shrink, 2)).alias("kurtosis"),
    )


def coverage(facts: DataFrame, item: str, entity: str, items: DataFrame) -> DataFrame:
    """Distinct entities per item, for the items given."""
    pairs = facts.join(items, item, "left_semi").select(item, entity).filter(F.col(entity).isNotNull()).distinct()
    return pairs.groupBy(item).agg(F.count("*").alias("n_entities"))
