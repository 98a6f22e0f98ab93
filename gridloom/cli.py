"""Command line over a data folder of canonical CSVs or Parquet tables: python -m gridloom.cli COMMAND FOLDER [--write].

Nothing is written without --write. ``verify`` ends with 1 only if a benchmark id is invalid.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions import text
from gridloom.operators import aliases, classify, collapse, dedup, densify, impute, integrity, rules, stats
from gridloom.plans.report import integrity_report, markdown
from gridloom.runtime import session
from gridloom.sources import readers, writers


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    if Path(folder, "results.parquet").exists():
        b, m, r = (spark.read.parquet(f"{folder}/{n}.parquet").fillna("") for n in ("benchmarks", "models", "results"))
    else:
        b, m, r = readers.load_tables(spark, folder)
    if "row_id" not in r.columns:
        r = r.withColumn("row_id", F.monotonically_increasing_id())
    return b, m, r


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    b, m, r = _tables(spark, a.folder)
    bad = integrity.fk_violations(r, "benchmark_id", b, "benchmark_id")
    checks = {
        "invalid benchmark ids": bad, "invalid model names": integrity.fk_violations(r, "model_name", m, "model_id"), "benchmarks without results": integrity.orphans(b, "benchmark_id", r, "benchmark_id"),
        "models without results": integrity.orphans(m, "model_id", r, "model_name"), "exhausted benchmarks": integrity.exhausted(r, "benchmark_id", a.threshold), "duplicate model ids": dedup.groups(m, ["model_id"]),
        "scores that are no number": r.filter(text.number(F.col("score")).isNull()).select("row_id"),
    }
    print(integrity_report(checks))
    return int(bad.limit(1).count() > 0)


def dupes(spark: SparkSession, a: argparse.Namespace) -> int:
    _, _, r = _tables(spark, a.folder)
    got = dedup.classify(r, list(schema.IDENTITY_KEY), "score").groupBy("kind").agg(F.count("*").alias("groups"), F.sum("n_rows").alias("n_rows"))
    print(markdown(got, ["kind"]))
    return 0


def dedup_rows(spark: SparkSession, a: argparse.Namespace) -> int:
    _, _, r = _tables(spark, a.folder)
    year = F.coalesce(text.number(F.col("year_evaluated")).cast("int"), F.lit(0))
    done = dedup.resolve(r, list(schema.IDENTITY_KEY), "score", "row_id", classify.source_tier(F.col("source_url")), year)
    print("kept", done.filter("kept").count(), "discarded", done.filter("not kept").count())
    writers.write_text_table(done.filter("kept").drop("kept", "row_id"), f"{a.out or a.folder}/results_clean", a.write)
    writers.write_text_table(done.filter("not kept").drop("kept", "row_id"), f"{a.out or a.folder}/results_duplicates", a.write, "append")
    return 0


def find_aliases(spark: SparkSession, a: argparse.Namespace) -> int:
    """Names without a model and up to three registered ids each: the same but for letter case, or of a ratio of at least the cutoff."""
    _, m, r = _tables(spark, a.folder)
    print(markdown(aliases.candidates(integrity.fk_violations(r, "model_name", m, "model_id").select(F.col("id").alias("name")), m, "model_id", a.cutoff), ["name", "rank"], 1_000_000))
    return 0


def apply_aliases(spark: SparkSession, a: argparse.Namespace) -> int:
    _, m, r = _tables(spark, a.folder)
    mapping = rules.mapping_frame(m, json.loads(Path(a.rules).read_text(encoding="utf-8")))
    m2, r2 = rules.apply_aliases(m.withColumn("_o", F.monotonically_increasing_id()), r, mapping, "_o")
    print("models", m2.count(), "results", r2.count())
    writers.write_text_table(m2.drop("_o"), f"{a.out or a.folder}/models_aliased", a.write)
    writers.write_text_table(r2.drop("row_id"), f"{a.out or a.folder}/results_aliased", a.write)
    return 0


def standardise(spark: SparkSession, a: argparse.Namespace) -> int:
    """merge, remove, rename, remap, extract, then duplicates and derived columns."""
    doc = readers.load_rules(a.rules)
    b, m, r = _tables(spark, a.folder)
    b, r = rules.merge_items(b, r, doc["merge_benchmark"])
    m, r = rules.remove(m, "model_id", r, "model_name", doc["remove"])
    m, r = rules.rename(m, r, doc["rename"])
    m, r = rules.remap(m, r, doc["remap"])
    m, r = rules.setup_extract(m, r, {k: (v["base"], v["setup"]) for k, v in doc["setup_extract"].items()})
    r = dedup.keep_first(r, list(schema.IDENTITY_KEY), "row_id")
    m = dedup.keep_first(m.withColumn("_o", F.monotonically_increasing_id()), ["model_id"], "_o").drop("_o")
    m = stats.with_stats(m, "model_id", stats.entity_stats(r, "model_name", "benchmark_id", text.number(F.col("score"))), "model_name")
    print("benchmarks", b.count(), "models", m.count(), "results", r.count())
    for n, df in (("benchmarks", b), ("models", m), ("results", r.drop("row_id"))):
        writers.write_text_table(df, f"{a.out or a.folder}/{n}_standard", a.write)
    return 0


def standardize_ids(spark: SparkSession, a: argparse.Namespace) -> int:
    _, m, r = _tables(spark, a.folder)
    mapping = m.select(F.col("model_id").alias("old"), text.standard_id(F.col("model_id")).alias("new")).filter("old <> new").distinct()
    m2, r2 = rules.apply_aliases(m.withColumn("_o", F.monotonically_increasing_id()), r, mapping, "_o")
    print("renamed", mapping.count(), "models", m2.count())
    writers.write_text_table(m2.drop("_o"), f"{a.out or a.folder}/models_standard", a.write)
    writers.write_text_table(r2.drop("row_id"), f"{a.out or a.folder}/results_standard", a.write)
    return 0


def categorize_models(spark: SparkSession, a: argparse.Namespace) -> int:
    _, m, _ = _tables(spark, a.folder)
    c = classify.categorize(*[F.col(x) for x in ("model_id", "model_name", "model_family", "developer", "model_type", "base_model")])
    print(markdown(m.select(c["category"].alias("category")).groupBy("category").agg(F.count("*").alias("n")), ["category"]))
    return 0


def recompute_stats(spark: SparkSession, a: argparse.Namespace) -> int:
    _, m, r = _tables(spark, a.folder)
    out = stats.with_stats(m, "model_id", stats.entity_stats(r, "model_name", "benchmark_id", text.number(F.col("score"))), "model_name")
    print("models", out.count())
    writers.write_text_table(out, f"{a.out or a.folder}/models_stats", a.write)
    return 0


def run_matrix(spark: SparkSession, a: argparse.Namespace) -> int:
    """Collapse, densify and impute: the sparse matrix, its slice of the target density, and the completed slice."""
    _, m, r = _tables(spark, a.folder)
    scored = collapse.numeric_scores(r.withColumn("model_id", F.coalesce(F.nullif("model_id", F.lit("")), "model_name")), text.number(F.col("score")), text.number(F.col("metric_score")))
    means = collapse.pair_means(scored, "model_id", "benchmark_id")
    meta = collapse.first_stated(scored, "model_id", ["model_family", "model_size"], "row_id")
    named = means.join(meta, "model_id", "left")
    keyed = text.with_fine_key(named, "model_id", "model_family", "model_size") if a.strategy == "standard" else named.withColumn("collapse_key", text.coarse_key(F.col("model_id"), F.col("model_family")))
    cells = collapse.collapsed_cells(keyed, F.col("collapse_key"), "benchmark_id")
    axis = {"C": "col_key", "R": "row_key"}.get(a.densifier)
    kept = densify.core(densify.peel(cells, a.target, axis) if axis else cells.join(densify.symmetric_peel(cells, a.target), ["row_key", "col_key"]))
    print(markdown(densify.summary(cells, kept, f"all_{a.strategy}", a.densifier), ["strategy"]))
    got = impute.impute(kept, a.method, tuple(a.params) if a.params else None)
    print(f"{got.param_name} = {got.best}", got.curve)
    writers.write_cells(got.cells, f"{a.out or a.folder}/imputed", a.method, a.densifier, f"all_{a.strategy}", a.write)
    return 0


COMMANDS = {
    "verify": verify, "dupes": dupes, "dedup": dedup_rows, "find-aliases": find_aliases, "apply-aliases": apply_aliases, "standardise": standardise, "standardize-ids": standardize_ids, "categorize-models": categorize_models,
    "recompute-stats": recompute_stats, "matrix": run_matrix,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("folder")
    p.add_argument("--write", action="store_true")
    p.add_argument("--out")
    p.add_argument("--rules")
    p.add_argument("--threshold", type=int, default=integrity.EXHAUSTED_BELOW)
    p.add_argument("--cutoff", type=float, default=0.8)
    p.add_argument("--strategy", choices=("standard", "aggressive"), default="standard")
    p.add_argument("--densifier", choices=("C", "R", "S"), default="C")
    p.add_argument("--target", type=float, default=densify.TARGET)
    p.add_argument("--method", choices=impute.IMPUTERS, default="mean")
    p.add_argument("--params", type=float, nargs="*")
    a = p.parse_args(argv)
    return COMMANDS[a.command](spark or session(), a)


if __name__ == "__main__":
    sys.exit(main())
