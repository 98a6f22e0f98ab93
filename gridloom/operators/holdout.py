"""Hash-deterministic holdouts, standardisation and held-out scores over long matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _draw(seed: int):
    """A key whose order is random but the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("row_key").cast("string"), F.col("col_key").cast("string")))


def holdout(cells: DataFrame, by: str = "col_key", share: float = 0.2, min_keep: int = 2, seed: int = 1) -> DataFrame:
    """The cells with ``held``: of each key of ``by`` up to ``share`` of its cells, leaving at least ``min_keep``."""
    seen = cells.filter("value is not null").select("row_key", "col_key", "value")
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    take = F.greatest(F.lit(0), F.least(F.floor(n * F.lit(share)), n - min_keep))
    return seen.withColumn("_take", take).withColumn("held", F.row_number().over(w.orderBy(_draw(seed))) <= F.col("_take")).drop("_take")


def sample_k(cells: DataFrame, k: int, seed: int = 1, weight: str | None = None) -> DataFrame:
    """``k`` cells of each row without replacement: uniformly, or by a weight column (exponential keys, smallest first)."""
    seen = cells.filter("value is not null")
    unit = (F.conv(F.substring(_draw(seed), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(16**13 + 1))
    order = [-F.ln(unit) / F.col(weight)] if weight else [_draw(seed)]
    return seen.withColumn("_i", F.row_number().over(Window.partitionBy("row_key").orderBy(*order))).filter(F.col("_i") <= k).select("row_key", "col_key", "value")


def moments(train: DataFrame) -> DataFrame:
    """Mean and deviation per column of the training cells; a deviation of zero or none counts as 1."""
    m = train.groupBy("col_key").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    return m.withColumn("sd", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0))


def zscores(cells: DataFrame, train: DataFrame) -> DataFrame:
    return cells.join(moments(train), "col_key").withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd")).drop("mu", "sd")


def score(held: DataFrame, predicted: DataFrame, train: DataFrame, balanced: bool = True) -> DataFrame:
    """rmse and r2 of predictions for held-out cells, in units of the training deviation, against predicting the training mean.

    Balanced: the mean over columns of each column's rmse, and 1 minus the ratio of the columns' mean errors to their mean baselines;
    otherwise all cells weigh the same.
    """
    j = held.select("row_key", "col_key", "value").join(predicted.select("row_key", "col_key", F.col("value").alias("p")), ["row_key", "col_key"]).join(moments(train), "col_key")
    e, b = F.pow((F.col("p") - F.col("value")) / F.col("sd"), 2), F.pow((F.col("value") - F.col("mu")) / F.col("sd"), 2)
    if not balanced:
        return j.agg(F.sqrt(F.avg(e)).alias("rmse"), (1 - F.try_divide(F.sum(e), F.sum(b))).alias("r2"), F.count("*").alias("n"))
    per = j.groupBy("col_key").agg(F.avg(e).alias("mse"), F.avg(b).alias("base"), F.count("*").alias("n"))
    return per.agg(F.avg(F.sqrt("mse")).alias("rmse"), (1 - F.try_divide(F.avg("mse"), F.avg("base"))).alias("r2"), F.sum("n").alias("n"))


def conditioning_sets(marked: DataFrame) -> DataFrame:
    """For each held-out cell the surviving cells of its row, as an array of (col_key, value): rows are as wide as the item list."""
    rest = marked.filter("not held").groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("col_key", "value"))).alias("given"))
    return marked.filter("held").select("row_key", "col_key", "value").join(rest, "row_key", "left")
