"""Readers: text tables under two null policies, rules, artefacts, pending lists, nested leaderboards."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.collapse import unpivot
from gridloom.schema import BENCHMARK_COLUMNS, MODEL_COLUMNS, RESULT_COLUMNS, text_schema

# What the second null policy reads as null.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
RULE_KINDS = ("merge_benchmark", "remove", "rename", "remap", "setup_extract")
NEVER = "\u0000never"


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV in which every column is text and the empty text is a value, never null."""
    df = spark.read.schema(text_schema(columns)).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", NEVER).option("emptyValue", "").csv(path)
    return df.fillna("")


def load_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """benchmarks, models and results of a data folder."""
    return tuple(read_text_table(spark, f"{folder}/{n}.csv", c) for n, c in (("benchmarks", BENCHMARK_COLUMNS), ("models", MODEL_COLUMNS), ("results", RESULT_COLUMNS)))


def na_as_null(df: DataFrame) -> DataFrame:
    """The other null policy: missing-value tokens of text columns become null."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns])


def read_matrix(spark: SparkSession, path: str, key: str = "collapse_key") -> DataFrame:
    """A wide CSV as a long matrix."""
    return unpivot(spark.read.option("header", True).option("inferSchema", True).csv(path), key)


def load_rules(path: str) -> dict:
    """A rules document; unknown kinds are reported and left out."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    for kind in sorted(set(doc) - set(RULE_KINDS)):
        warnings.warn(f"unknown rule kind {kind!r}", stacklevel=2)
    return {k: doc.get(k, {}) for k in RULE_KINDS}


def parse_artifact(name: Column) -> Column:
    """struct(method, densifier, strategy, kind) of a loadings file's path; null fields where it isn't one."""
    base = F.regexp_extract(name, r"([^/]+)\.csv$", 1)
    pattern = r"^([a-z]+)_([CSR]|raw)_(all_standard|all_aggressive)_(?:(bifactor|secondorder)_)?loadings$"
    part = lambda i: F.nullif(F.regexp_extract(base, pattern, i), F.lit(""))
    return F.struct(part(1).alias("method"), part(2).alias("densifier"), part(3).alias("strategy"), F.when(base.rlike(pattern), F.coalesce(part(4), F.lit("efa"))).alias("kind"))


def explode_leaderboards(tasks: DataFrame) -> DataFrame:
    """One row per task, dataset, leaderboard row and metric of nested tasks (datasets[].sota.rows[].metrics map)."""
    d = tasks.select("task", F.explode("datasets").alias("d"))
    r = d.select("task", F.col("d.dataset").alias("dataset"), F.explode("d.sota.rows").alias("r"))
    return r.select("task", "dataset", F.col("r.model_name").alias("model_name"), F.explode("r.metrics").alias("metric", "score"))


def unpivot_prefix(wide: DataFrame, key: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Columns such as rmse_r3 and r2_r3 as rows (key, param, one column per prefix)."""
    params = sorted({int(c.rsplit("_r", 1)[1]) for c in wide.columns if any(c.startswith(f"{p}_r") for p in prefixes)})
    rows = F.array(*[F.struct(F.lit(p).alias("param"), *[(F.col(f"{x}_r{p}").cast("double") if f"{x}_r{p}" in wide.columns else F.lit(None).cast("double")).alias(x) for x in prefixes]) for p in params])
    return wide.select(key, F.explode(rows).alias("x")).select(key, "x.*")
