"""Reports: Markdown of loadings, congruence and checks, and the panels of a dashboard as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFF = 0.30


def loadings_report(loadings: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(position, item, factor, shown): items by their strongest factor and its loading, small loadings blank, two decimals."""
    w = Window.partitionBy("item").orderBy(F.abs("loading").desc(), "factor")
    top = loadings.withColumn("i", F.row_number().over(w)).filter("i = 1").select("item", F.col("factor").alias("home"), F.abs("loading").alias("strength"))
    placed = top.withColumn("position", F.row_number().over(Window.orderBy("home", F.col("strength").desc(), "item"))).select("item", "position")
    shown = F.when(F.abs("loading") >= cutoff, F.format_string("%.2f", "loading")).otherwise("")
    return loadings.join(placed, "item").select("position", "item", "factor", shown.alias("shown"))


def markdown(df: DataFrame, order: list[str], rows: int = 10_000) -> str:
    """A table of at most ``rows`` rows as Markdown; larger ones are refused."""
    got = df.orderBy(*order).limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows")
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(text, r)) + " |" for r in got)])


def integrity_report(checks: dict[str, DataFrame], examples: int = 10) -> str:
    """Per check its number of findings and the first examples; examples are a limit by design."""
    lines = []
    for name, df in checks.items():
        n = df.count()
        lines.append(f"{name}: {n}")
        lines += [f"  {r[0]}" for r in df.orderBy(df.columns[0]).limit(examples).collect()]
    return "\n".join(lines)


def scree(values: np.ndarray, cutoffs: np.ndarray) -> list[tuple[int, float, float]]:
    return [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(values, cutoffs))]


def curve_panel(curve: DataFrame, param: str, value: str) -> DataFrame:
    """A curve over a parameter with the gain of each step against the one before."""
    w = Window.orderBy(param)
    return curve.select(param, value, (F.lag(value).over(w) - F.col(value)).alias("gain"))


def sensitivity_summary(runs: DataFrame) -> DataFrame:
    """Quartiles of rmse per parameter over seeds, and how often it was the best of its seed."""
    best = runs.withColumn("i", F.row_number().over(Window.partitionBy("seed").orderBy(F.col("rmse").asc_nulls_last(), "param")))
    return best.groupBy("param").agg(
        F.count("*").alias("n"), F.percentile("rmse", 0.25).alias("q1"), F.percentile("rmse", 0.5).alias("median"), F.percentile("rmse", 0.75).alias("q3"), F.avg("r2").alias("mean_r2"), F.count_if(F.col("i") == 1).alias("times_best")
    )
