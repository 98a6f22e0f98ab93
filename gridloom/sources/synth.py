"""Synthetic sources, deterministic in their seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(*parts) -> Column:
    """A uniform number in (0, 1) that is a function of its parts."""
    h = F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(16**13 + 1))


def _normal(*parts) -> Column:
    return F.sqrt(-2 * F.ln(_unit(*parts, "u"))) * F.cos(6.283185307179586 * _unit(*parts, "v"))


def low_rank(spark: SparkSession, rows: int, cols: int, rank: int, seed: int = 1) -> DataFrame:
    """All cells of a random matrix of the given rank with unit mean square."""
    grid = spark.range(rows).select(F.col("id").alias("row_key")).withColumn("col_key", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    value = sum(_normal(seed, "r", k, F.col("row_key").cast("string")) * _normal(seed, "c", k, F.col("col_key").cast("string")) for k in range(rank)) / rank**0.5
    return grid.withColumn("value", value)


def not_at_random(spark: SparkSession, rows: int, cols: int, rank: int = 3, density: float = 0.12, seed: int = 100) -> DataFrame:
    """A low-rank table on percentage-like scales whose cells are observed more often in famous columns and active rows."""
    cells = low_rank(spark, rows, cols, rank, seed)
    col, row = F.col("col_key").cast("string"), F.col("row_key").cast("string")
    value = F.col("value") * (3 + 27 * _unit(seed, "scale", col)) + 20 + 70 * _unit(seed, "offset", col) + _normal(seed, "noise", row, col)
    fame = 1 - 0.5 * F.col("col_key") / max(1, cols - 1)
    active = 0.4 + 0.6 * _unit(seed, "active", row)
    seen = _unit(seed, "seen", row, col) < density * fame * active / (0.75 * 0.7)
    return cells.select("row_key", "col_key", F.round(value, 4).alias("value")).filter(seen)


def observation_weights(flavour: str, power: float = 1.0, groups: int = 2, strength: float = 2.0) -> Column:
    """Weight of a cell by the popularity of its column (1 / (j + 1)^power), the block of its row and column, or its value."""
    if flavour == "popularity":
        return 1 / F.pow(F.col("col_key") + 1, F.lit(power))
    if flavour == "block":
        return F.when(F.pmod("row_key", F.lit(groups)) == F.pmod("col_key", F.lit(groups)), strength).otherwise(1.0)
    return F.pow(F.abs("value"), F.lit(power))
