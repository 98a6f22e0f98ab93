"""Plans of the general data problems over the project's tables: p1 (wide), p2 (fill), p3 (orphans) and p6 (units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.values import PLACEHOLDERS, states_value
from gridloom.operators import fill, orphans, units, wide
from gridloom.runtime import cut, small_collect, table

DAY_US = 86_400_000_000
SCORE_COLUMNS = ("score", "metric_name", "metric", "metric_max_score")
#: Columns of the wide table, which the registry of benchmarks names.
MAX_COLUMNS = 5_000


def _catalog(spark: SparkSession, d: str) -> list[units.Metric]:
    return units.load_catalog(table(spark, d, "metric_units"))


# -- 1 ------------------------------------------------------------------------------------------------------------------------


def _scored_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "results").select("row_id", "model_name", "benchmark_id", *SCORE_COLUMNS)
    rows = rows.filter(states_value(F.col("model_name")) & states_value(F.col("benchmark_id")))
    read = units.read_scores(rows, _catalog(spark, d)).filter("score_states")
    return read.select("row_id", "model_name", "benchmark_id", F.col("score_num").cast("string").alias("number"))


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The grid of all models and all spellings of benchmarks, and the positions of the spellings."""
    named = table(spark, d, "results").filter(states_value(F.col("benchmark_id")))
    positions = wide.attribute_positions(named, "benchmark_id")
    return wide.attribute_grid(_scored_cells(spark, d), "model_name", "benchmark_id", "number", "row_id", positions), positions


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the wide table that hold a number, read from its typed columns: model_name, benchmark_id."""
    grid, positions = _grid(spark, d)
    return wide.unpivot_grid(grid, "model_name", "benchmark_id", positions).select("model_name", "benchmark_id")


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per model_name: one double column per registered benchmark, and the cells of all other benchmark spellings as a map.

    The registry gives the columns (it doesn't grow with results); a spelling it doesn't hold can't be a fixed column of a plan
    that must stay the same from day to day, and is kept in ``other_benchmarks``. Of several scores of a cell the last loaded counts.
    """
    grid, positions = _grid(spark, d)
    grid = cut(grid, "p1-grid")
    registered = table(spark, d, "benchmarks").select("benchmark_id").filter("benchmark_id is not null").distinct()
    rows = small_collect(registered.join(positions, "benchmark_id", "left"), MAX_COLUMNS, "benchmarks")
    table_ = wide.wide_table(grid, "model_name", [(r.benchmark_id, r.position, "double") for r in sorted(rows)])
    tail = positions.join(F.broadcast(registered), "benchmark_id", "left_anti")  # registered: at most MAX_COLUMNS rows
    other = wide.unpivot_grid(grid, "model_name", "benchmark_id", tail)
    other = other.groupBy("model_name").agg(F.map_from_entries(F.collect_list(F.struct("benchmark_id", "value"))).alias("other_benchmarks"))
    return table_.join(other, "model_name", "left")


# -- 2 ------------------------------------------------------------------------------------------------------------------------

_NUMERIC = ["z_score", "z_year", "z_size"]
_CATEGORICAL = ["metric_key", "language_", "model_type_", "source_type_"]


_LEVELS = {
    "score_common": ("median", [("cluster, metric, benchmark", ["cluster", "metric_key", "benchmark_id"]), ("metric, benchmark", ["metric_key", "benchmark_id"]), ("metric", ["metric_key"]), ("all", [])]),
    "model_name": ("mode", [("model_id", ["known_id"]), ("cluster, family", ["cluster", "family"]), ("cluster", ["cluster"]), ("all", [])]),
    "benchmark_id": ("mode", [("benchmark_name", ["known_name"]), ("cluster, metric", ["cluster", "metric_key"]), ("cluster", ["cluster"]), ("all", [])]),
}


def _fills(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their features and clusters, and the fills of all missing fields."""
    stated = lambda c: F.when(states_value(F.col(c)), F.col(c))
    # Features only group rows: there, a lookup of the placeholders as they stand is enough.
    plain = lambda c: F.when(~F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.col(c))
    raw = table(spark, d, "results")
    rows = raw.select(
        "row_id", *SCORE_COLUMNS, stated("model_name").alias("model_name"), stated("benchmark_id").alias("benchmark_id"), plain("model_id").alias("known_id"), plain("benchmark_name").alias("known_name"),
        plain("model_family").alias("family"), F.col("year_evaluated").try_cast("double").alias("year"), F.col("model_size").try_cast("double").alias("size"), *[plain(c).alias(f"{c}_") for c in ("language", "model_type", "source_type")],
    )
    # Told and fitted units, as in problem 6: scores of one metric are on one scale before they are compared, clustered or averaged.
    catalog = _catalog(spark, d)
    read = units.read_scores(rows, catalog).drop("score", "metric_name", "metric", "metric_max_score")
    common = units.with_common_units(cut(read, "p2-scores"), catalog)
    x = F.col("score_common")
    base = common.select(
        "row_id", "score_common", "model_name", "benchmark_id", "metric_key", "known_id", "known_name", "family", "language_", "model_type_", "source_type_",
        ((F.col("year") - 2024) / 1.5).alias("z_year"), (F.log1p("size") / 2).alias("z_size"), (F.signum(x) * F.log1p(F.abs(x)) / 2).alias("z_score"),
    )
    prototypes = fill.k_prototypes(base, _NUMERIC, _CATEGORICAL)
    placed = fill.assign_clusters(base, prototypes, _NUMERIC, _CATEGORICAL)
    return placed, fill.fill_targets(placed, "row_id", _LEVELS)


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every results row: row_id, score_common, model_name and benchmark_id with fills, and for each the level it was filled from
    (null: observed). Levels go from the row's cluster within its metric and benchmark, or its model, to the whole table."""
    rows, fills = _fills(spark, d)
    fills = cut(fills, "p2-fills")
    each = {t: fills.filter(F.col("field") == t).select("row_id", F.col("number" if how == "median" else "text").alias("value"), "level") for t, (how, _) in _LEVELS.items()}
    out = fill.with_fills(rows.select("row_id", *_LEVELS), "row_id", each)
    return out.select("row_id", *[c for t in _LEVELS for c in (t, f"{t}_filled")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The fields that were filled, or that nothing could fill: row_id, field_name."""
    _, fills = _fills(spark, d)
    return fills.select("row_id", F.when(F.col("field") == "score_common", "score").otherwise(F.col("field")).alias("field_name"))


# -- 3 ------------------------------------------------------------------------------------------------------------------------


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """row_id, t (loaded_at in microseconds), ref_table and key of each orphan reference."""
    refs = table(spark, d, "results").select("row_id", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("t"), F.explode(F.create_map(F.lit("models"), "model_name", F.lit("benchmarks"), "benchmark_id")).alias("ref_table", "key"))
    refs = refs.filter(states_value(F.col("key")))
    log = table(spark, d, "registry_log").filter("key_value is not null and table_name is not null")
    log = log.select(F.col("table_name").alias("ref_table"), F.col("key_value").alias("key"), "action", F.unix_micros(F.col("logged_at").cast("timestamp")).alias("at"), "log_id")
    runs = cut(orphans.validity_runs(log, ["ref_table", "key"], "at", F.col("action") == "added", "log_id"), "p3-runs")
    return orphans.orphan_references(refs, runs, ["ref_table", "key"], "t", DAY_US)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose key isn't in force at the row's loaded_at: row_id, ref_table."""
    return _orphans(spark, d).select("row_id", "ref_table")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per parent table and month of loading."""
    month = F.date_format(F.timestamp_micros("t"), "yyyy-MM").alias("month")
    return _orphans(spark, d).groupBy("ref_table", month).agg(F.count("*").alias("orphans"), F.countDistinct("key").alias("keys"))


# -- 6 ------------------------------------------------------------------------------------------------------------------------


def p6_converted(spark: SparkSession, d: str) -> DataFrame:
    """Every results row's score in the common unit of its metric, with the unit, how it was found and whether it is uncertain."""
    rows = table(spark, d, "results").select("row_id", *SCORE_COLUMNS)
    out = units.to_common_units(rows, _catalog(spark, d))
    return out.select("row_id", "metric_key", "score_common", "unit", "unit_source", "unit_posterior", "unit_uncertain", "other_unit")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose score states a value in another unit or scale than the common one: row_id."""
    return p6_converted(spark, d).filter("other_unit").select("row_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p2_found, p2_filled, p3_found, p3_report, p6_found, p6_converted)}

_BLANK = "regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')"
_STATED = (
    "(r.v is not null and regexp_matches(r.v, '[\\p{L}\\p{N}]') and trim(" + _BLANK.format("r.v") + ") not in ("
    + ", ".join(f"'{p}'" for p in PLACEHOLDERS if p) + ") and not regexp_matches(r.v, '^\\s*-?(1|9{2,})(\\.0+)?\\s*$') and not regexp_matches(lower(r.v), '^\\s*(see table|tba|tbd|err:?)\\s+\\w+\\s*$'))"
)

_P3 = f"""with refs as (select row_id, 'models' as ref_table, model_name as v, loaded_at as t from results union all select row_id, 'benchmarks', benchmark_id, loaded_at from results),
log as (select table_name, key_value, logged_at, max_by(action, log_id) as action from registry_log where key_value is not null and logged_at is not null group by 1, 2, 3)
select r.row_id, r.ref_table/*more*/ from refs r asof left join log l on r.ref_table = l.table_name and r.v = l.key_value and r.t >= l.logged_at where {_STATED} and coalesce(l.action, '') <> 'added'"""

ORACLES = {
    "p3_found": _P3,
    "p3_report": f"select ref_table, strftime(t, '%Y-%m') as month, count(*) as orphans, count(distinct v) as keys from ({_P3.replace('/*more*/', ', r.v, r.t')}) group by 1, 2",
}
