"""Matrix queries over long cells: statistics, densification, holdouts, imputers, one-sided completion and factor models.

Bindings: customer x part (very sparse), customer x supplier and part x supplier (medium), user x day and user x event type (dense),
and embedding x dimension (full).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import densify, factor, holdout, impute, osmc, stats
from gridloom.operators.collapse import pivot, unpivot
from gridloom.plans import report
from gridloom.plans.registry import Registry
from gridloom.runtime import cut, small_collect, table
from gridloom.sources import readers, synth

R = Registry()
query = R.query

# -- bindings -------------------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str, row: str, col: str, by_row: bool = False) -> DataFrame:
    """``by_row``: the lines are shuffled to their rows, so that neither the cells nor groups of a row's cells are shuffled again."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if by_row:
        j = j.select(row, col, "l_extendedprice").repartition(row)
    return j.groupBy(F.col(row).alias("row_key"), F.col(col).alias("col_key")).agg(F.avg("l_extendedprice").alias("value"))


def cp(spark, d):
    return _lines(spark, d, "o_custkey", "l_partkey")


def cs(spark, d, by_row=False):
    return _lines(spark, d, "o_custkey", "l_suppkey", by_row)


def ps(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row_key"), F.col("l_suppkey").alias("col_key")).agg(F.avg("l_extendedprice").alias("value"))


def ud(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("row_key"), F.dayofyear("ts").alias("col_key")).agg(F.avg("value").alias("value"))


def ut(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("row_key"), F.col("event_type").alias("col_key")).agg(F.avg("value").alias("value"))


def em(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_key"), F.posexplode("embedding").alias("col_key", "value")).withColumn("value", F.col("value").cast("double"))


CP = "select o_custkey as row_key, l_partkey as col_key, avg(l_extendedprice) as value from lineitem join orders on l_orderkey = o_orderkey group by 1, 2"
CS = "select o_custkey as row_key, l_suppkey as col_key, avg(l_extendedprice) as value from lineitem join orders on l_orderkey = o_orderkey group by 1, 2"
PS = "select l_partkey as row_key, l_suppkey as col_key, avg(l_extendedprice) as value from lineitem group by 1, 2"
UD = "select user_id as row_key, dayofyear(ts)::int as col_key, avg(value) as value from events group by 1, 2"
UT = "select user_id as row_key, event_type as col_key, avg(value) as value from events group by 1, 2"
EM = "select vec_id as row_key, unnest(range(0, len(embedding)))::int as col_key, unnest(embedding)::double as value from embeddings"


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# -- statistics -----------------------------------------------------------------------------------------------------------------

_STATS = "select '{0}' as strategy, count(distinct row_key) as n_rows, count(distinct col_key) as n_cols, count(distinct row_key) * count(distinct col_key) as total_cells, count(*) as non_null, round(count(*) * 100.0 / (count(distinct row_key) * count(distinct col_key)), 4) as density_pct, round(100.0 - round(count(*) * 100.0 / (count(distinct row_key) * count(distinct col_key)), 4), 4) as sparsity_pct from ({1})"


@query(_STATS.format("none", CP) + " union all " + _STATS.format("collapsed", f"select row_key % 10 as row_key, col_key, avg(value) as value from ({CP}) group by 1, 2"))
def flagship_density(spark: SparkSession, d: str) -> DataFrame:
    """Density of the entity x item matrix before and after entities are collapsed, by a mean of means."""
    cells = cp(spark, d)
    collapsed = cells.groupBy((F.col("row_key") % 10).alias("row_key"), "col_key").agg(F.avg("value").alias("value"))
    return stats.matrix_stats(cells, "none").unionByName(stats.matrix_stats(collapsed, "collapsed"))


@query(_STATS.format("CS", CS))
def matrix_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.matrix_stats(cs(spark, d), "CS")


@query(f"select col_key, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, count(*) as n from ({CS}) group by 1")
def column_moments(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.column_moments(cs(spark, d)), "mean", "sd")


@query(f"with c as ({CP}) select row_key, col_key, round(value, 6) as value from c where col_key in (select col_key from c group by 1 having count(*) >= 2 and min(value) < max(value))")
def drop_degenerate_cols(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.drop_degenerate(cp(spark, d)), "value")


@query(f"with c as ({CS}) select col_key, count(*) as n, round(count(*) / (select count(distinct row_key) from c), 6) as rate from c group by 1")
def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return stats.fill_rates(cs(spark, d), "col_key")


@query(
    "with s as (select event_type, value, avg(value) over w as m, stddev_samp(value) over w as sd from events window w as (partition by event_type)) select event_type, count(value) as n, round(min(value), 6) as min, round(quantile_cont(value, 0.5), 6) as median, round(max(value), 6) as max, round(avg(value), 6) as mean, round(var_samp(value), 6) as variance, round(avg(pow((value - m) / sd, 3)), 6) as skew, round(avg(pow((value - m) / sd, 4)), 6) as kurtosis from s group by 1"
)
def moment_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.moment_summary(table(spark, d, "events"), ["event_type"], "value"), "min", "median", "max", "mean", "variance", "skew", "kurtosis")


#: Event types become columns, so there may be this many at most.
MAX_EVENT_TYPES = 1_000


def _event_types(spark: SparkSession, d: str) -> list[str]:
    kinds = table(spark, d, "events").select("event_type").filter("event_type is not null").distinct()
    return sorted(r.event_type for r in small_collect(kinds, MAX_EVENT_TYPES, "event types"))


@query("select user_id as row_key, " + ", ".join(f"round(avg(value) filter (event_type = '{t}'), 6) as {t}" for t in ("click", "view", "purchase")) + " from events group by 1")
def pivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    kinds = _event_types(spark, d)
    return _rounded(pivot(ut(spark, d), kinds), *kinds)


@query(f"select row_key, col_key, round(value, 6) as value from ({UT}) where col_key in ('click', 'view', 'purchase')")
def unpivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(unpivot(pivot(ut(spark, d), _event_types(spark, d)), "row_key"), "value")


@query("select row_key, param, rmse, r2 from (select user_id as row_key, 1 as param, round(avg(value), 6) as rmse, round(min(value), 6) as r2 from events group by 1 union all select user_id, 2, round(max(value), 6), null from events group by 1)")
def unpivot_prefix(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "events").groupBy(F.col("user_id").alias("row_key")).agg(F.round(F.avg("value"), 6).alias("rmse_r1"), F.round(F.max("value"), 6).alias("rmse_r2"), F.round(F.min("value"), 6).alias("r2_r1"))
    return readers.unpivot_prefix(wide, "row_key", ("rmse", "r2"))


# -- densification --------------------------------------------------------------------------------------------------------------


def _peel_sql(cells: str, target: str, axis: str) -> str:
    other = "row_key" if axis == "col_key" else "col_key"
    return f"""with c as ({cells}), k as (select {axis}, count(*) as n, row_number() over (order by count(*), {axis}) as rk from c group by 1), p as (select c.*, rk from c join k using ({axis})),
    l as (select rk, count(*) as leave from (select {other}, max(rk) as rk from p group by 1) group by 1), t as (select (select count(*) from c) as cells, (select count(*) from k) as cols, (select sum(leave) from l) as rws),
    s as (select k.rk as k, cells - sum(n) over w as c, rws - sum(coalesce(leave, 0)) over w as r, cols - k.rk as m from k left join l using (rk), t window w as (order by k.rk) union all select 0, cells, rws, cols from t)
    select row_key, col_key from p where rk > (select min(k) from s where r > 0 and m > 0 and c >= {target} * r * m)"""


@query(_peel_sql(CP, "0.10", "col_key"))
def peel_col(spark: SparkSession, d: str) -> DataFrame:
    return densify.peel(cp(spark, d)).select("row_key", "col_key")


@query(_peel_sql(CS, "0.40", "row_key"))
def peel_row(spark: SparkSession, d: str) -> DataFrame:
    return densify.peel(cs(spark, d), 0.40, "row_key").select("row_key", "col_key")


@query()
def peel_sym(spark: SparkSession, d: str) -> DataFrame:
    """Sequential; compared with a rescan of the mask in the tests."""
    return densify.symmetric_peel(ps(spark, d), 0.5)


def _core_sql(cells: str, rounds: int) -> str:
    out = [f"c0 as ({cells})"]
    for i in range(rounds):
        out.append(f"c{i + 1} as (select * from c{i} where row_key in (select row_key from c{i} group by 1 having count(*) >= 2) and col_key in (select col_key from c{i} group by 1 having count(*) >= 2))")
    return f"with {', '.join(out)} select row_key, col_key from c{rounds}"


@query(_core_sql("select c_custkey as row_key, cast(floor(c_acctbal) as bigint) % 700 as col_key, 1.0 as value from customer union select o_custkey, cast(floor(o_totalprice) as bigint) % 90000, 1.0 from orders", 14))
def min_obs_core(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "customer").select(F.col("c_custkey").alias("row_key"), (F.floor("c_acctbal") % 700).alias("col_key")).union(table(spark, d, "orders").select("o_custkey", F.floor("o_totalprice") % 90000)).distinct()
    return densify.core(cells.withColumn("value", F.lit(1.0))).select("row_key", "col_key")


def _summary_sql(cells: str, kept: str, strategy: str, name: str) -> str:
    return f"""with o as ({cells}), q as ({kept}), a as (select count(distinct row_key) as r, count(distinct col_key) as c, count(*) as n from o), b as (select count(distinct row_key) as r, count(distinct col_key) as c, count(*) as n from q)
    select '{strategy}' as strategy, '{name}' as densifier, a.r as orig_models, a.c as orig_benchmarks, round(a.n * 100.0 / (a.r * a.c), 4) as orig_density_pct, b.r as kept_models, b.c as kept_benchmarks, 2 as min_obs, round(b.n * 100.0 / (b.r * b.c), 4) as density_pct,
    round(100 - b.n * 100.0 / (b.r * b.c), 4) as sparsity_pct, round(b.n * 100.0 / a.n, 2) as data_retained_pct from a, b"""


@query(_summary_sql(CS, _core_sql(_peel_sql(CS, "0.40", "col_key"), 6), "all_standard", "C"))
def densify_summary_c(spark: SparkSession, d: str) -> DataFrame:
    cells = cs(spark, d)
    return densify.summary(cells, densify.core(densify.peel(cells, 0.40)), "all_standard", "C")


@query(_summary_sql(CS, _core_sql(_peel_sql(CS, "0.40", "row_key"), 6), "all_standard", "R"))
def densify_summary_r(spark: SparkSession, d: str) -> DataFrame:
    cells = cs(spark, d)
    return densify.summary(cells, densify.core(densify.peel(cells, 0.40, "row_key")), "all_standard", "R")


@query()
def densify_summary_s(spark: SparkSession, d: str) -> DataFrame:
    cells = ps(spark, d)
    kept = densify.symmetric_peel(cells, 0.5).withColumn("value", F.lit(1.0))
    return densify.summary(cells, densify.core(kept), "all_standard", "S")


# -- holdouts and scores --------------------------------------------------------------------------------------------------------


def _held_sql(cells: str, by: str) -> str:
    return f"select row_key, col_key, value, row_number() over (partition by {by} order by md5('1|' || row_key || '|' || col_key)) <= greatest(0, least(floor(count(*) over (partition by {by}) * 0.2), count(*) over (partition by {by}) - 2)) as held from ({cells})"


@query(f"select row_key, col_key, held from ({_held_sql(CS, 'col_key')})")
def holdout_mask(spark: SparkSession, d: str) -> DataFrame:
    return holdout.holdout(cs(spark, d)).select("row_key", "col_key", "held")


@query(f"select row_key, col_key, held from ({_held_sql(CS, 'row_key')})")
def holdout_rows(spark: SparkSession, d: str) -> DataFrame:
    return holdout.holdout(cs(spark, d), "row_key").select("row_key", "col_key", "held")


@query(f"select row_key, col_key from (select *, row_number() over (partition by row_key order by md5('1|' || row_key || '|' || col_key)) as i from ({CS})) where i <= 3")
def sample_k(spark: SparkSession, d: str) -> DataFrame:
    return holdout.sample_k(cs(spark, d), 3).select("row_key", "col_key")


_MOMENTS = "select col_key, avg(value) as mu, case when stddev_samp(value) > 1e-12 then stddev_samp(value) else 1.0 end as sd from t group by 1"


@query(f"with t as ({UD}), m as ({_MOMENTS}) select row_key, col_key, round((value - mu) / sd, 6) as z from t join m using (col_key)")
def zscore_cols(spark: SparkSession, d: str) -> DataFrame:
    cells = ud(spark, d)
    return holdout.zscores(cells, cells).select("row_key", "col_key", F.round("z", 6).alias("z"))


_EVAL = f"with h as ({_held_sql(CS, 'col_key')}), t as (select * from h where not held), m as ({_MOMENTS}), g as (select avg(value) as p from t), e as (select col_key, pow((p - value) / sd, 2) as e, pow((value - mu) / sd, 2) as b from h join m using (col_key), g where held)"


def _flat_guess(spark, d):
    marked = cut(holdout.holdout(cs(spark, d)), "eval")
    train, held = marked.filter("not held"), marked.filter("held")
    overall = train.agg(F.avg("value").alias("value"))
    return held, held.select("row_key", "col_key").join(F.broadcast(overall)), train


@query(f"{_EVAL}, c as (select col_key, avg(e) as mse, avg(b) as base, count(*) as n from e group by 1) select round(avg(sqrt(mse)), 6) as rmse, round(1 - avg(mse) / avg(base), 6) as r2, cast(sum(n) as bigint) as n from c")
def score_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Held-out score of predicting the overall mean, column-balanced."""
    return _rounded(holdout.score(*_flat_guess(spark, d)), "rmse", "r2")


@query(f"{_EVAL} select round(sqrt(avg(e)), 6) as rmse, round(1 - sum(e) / sum(b), 6) as r2, count(*) as n from e")
def score_cellweighted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(holdout.score(*_flat_guess(spark, d), balanced=False), "rmse", "r2")


@query(f"with h as ({_held_sql(UD, 'row_key')}) select a.row_key, a.col_key, (select count(*) from h b where b.row_key = a.row_key and not b.held) as n_given, (select round(sum(b.value), 6) from h b where b.row_key = a.row_key and not b.held) as sum_given from h a where a.held")
def conditioning_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = holdout.conditioning_sets(holdout.holdout(ud(spark, d), "row_key"))
    total = F.aggregate("given", F.lit(0.0), lambda acc, x: acc + x["value"])
    return sets.select("row_key", "col_key", F.size("given").cast("bigint").alias("n_given"), F.round(total, 6).alias("sum_given"))


# -- imputers -------------------------------------------------------------------------------------------------------------------


@query(f"with c as ({CS}), r as (select distinct row_key from c), k as (select col_key, avg(value) as mu from c group by 1) select r.row_key, k.col_key, round(coalesce(c.value, k.mu), 6) as value from r cross join k left join c on c.row_key = r.row_key and c.col_key = k.col_key")
def mean_impute(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(impute.mean_impute(cs(spark, d, by_row=True)), "value")


@query(
    f"""with c as ({UD}), w as (select col_key, max(value) - min(value) as w from c group by 1), s as (select row_key, col_key, coalesce(value / nullif(w, 0), 0) as x from c join w using (col_key)),
    p as (select a.row_key, b.row_key as near, avg(abs(a.x - b.x)) as d from s a join s b on a.col_key = b.col_key and a.row_key <> b.row_key group by 1, 2), e as (select r.row_key, k.col_key from (select distinct row_key from c) r cross join (select distinct col_key from c) k where not exists (select 1 from c where c.row_key = r.row_key and c.col_key = k.col_key)),
    n as (select e.row_key, e.col_key, c.value as v, row_number() over (partition by e.row_key, e.col_key order by round(d, 9), near) as i from e join p using (row_key) join c on c.row_key = p.near and c.col_key = e.col_key),
    f as (select row_key, col_key, avg(v) as value from n where i <= 5 group by 1, 2) select row_key, col_key, round(value, 6) as value from c union all select row_key, col_key, round(value, 6) from f"""
)
def knn_impute(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(impute.knn_impute(ud(spark, d)), "value")


@query()
def softimpute_complete(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(impute.softimpute(cs(spark, d), 3), "value")


@query()
def softimpute_sweep(spark: SparkSession, d: str) -> DataFrame:
    got = impute.impute(ud(spark, d), "softimpute")
    return spark.createDataFrame([(float(p), float(e), float(q)) for p, e, q in got.curve], "param double, rmse double, r2 double").withColumn("best", F.col("param") == got.best)


@query()
def mice_impute(spark: SparkSession, d: str) -> DataFrame:
    return impute.chained_equations(ut(spark, d), m=20)


@query()
def missforest_impute(spark: SparkSession, d: str) -> DataFrame:
    return impute.forest_impute(ut(spark, d), trees=50, rounds=10)


@query()
def sensitivity_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = impute.sensitivity(ut(spark, d), "softimpute", (1, 2), 2)
    return report.sensitivity_summary(spark.createDataFrame(runs, "seed int, param int, rmse double, r2 double"))


# -- one-sided completion -------------------------------------------------------------------------------------------------------



@query()
def osmc_run(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rmse per rank of the user x event type cells, and the rank that the surrogate table is made at."""
    best, curve, _ = osmc.run_onesided(ut(spark, d), range(1, 6))
    return spark.createDataFrame([(r, float(e), r == best) for r, e in curve], "rank int, rmse double, best boolean")


@query()
def osmc_surrogate(spark: SparkSession, d: str) -> DataFrame:
    """The surrogate table at the selected rank: a row for each user, with a value for each day of the year."""
    return osmc.run_onesided(ud(spark, d))[2]


@query()
def osmc_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Curves over ranks of 20 fresh holdouts, with the rank that each chooses."""
    return spark.createDataFrame(osmc.sensitivity(ut(spark, d), range(1, 6)), "seed int, chosen int, rank int, rmse double")


_PAIRS = "select a.col_key as a, b.col_key as b, count(*) as n, sum(a.value * b.value) as s, sum(pow(a.value * b.value, 2)) as q from c a join c b on a.row_key = b.row_key and a.col_key <= b.col_key group by 1, 2"


@query(f"with c as ({UD}), p as ({_PAIRS}) select a, b, n, round(s / 1e3, 6) as s, round(q / 1e6, 4) as q from p")
def pair_products(spark: SparkSession, d: str) -> DataFrame:
    p = osmc.pair_products(ud(spark, d))
    return p.select("a", "b", "n", F.round(F.col("s") / 1e3, 6).alias("s"), F.round(F.col("q") / 1e6, 4).alias("q"))


@query(f"with c as ({EM}) select a.col_key as a, b.col_key as b, round(sum(a.value * b.value), 6) as theta from c a join c b on a.row_key = b.row_key group by 1, 2")
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(osmc.gram(em(spark, d)), "theta")


@query(f"with c as ({UT}) select a.col_key as a, b.col_key as b, round(sum(a.value * b.value), 4) as theta from c a join c b on a.row_key = b.row_key and a.col_key <> b.col_key group by 1, 2")
def gram_offdiag(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(osmc.gram(ut(spark, d), False), "theta", places=4)


_Z = f"with t as ({UT}), m as ({_MOMENTS}), c as (select row_key, col_key, (value - mu) / sd as value from t join m using (col_key)), p as ({_PAIRS})"


@query(f"{_Z}, l as (select sum(case when a <> b then 2 * (n * 0.25 - s + q) end) / sum(case when a <> b then 2 * n end) + sum(case when a = b then n * 0.25 - s + q end) / sum(case when a = b then n end) as loss from p) select round(loss, 6) as loss from l")
def osmc_loss(spark: SparkSession, d: str) -> DataFrame:
    """Loss of a factor of halves (every product of factors is 0.5) from the pair table alone."""
    z = holdout.zscores(ut(spark, d), ut(spark, d)).select("row_key", "col_key", F.col("z").alias("value"))
    t = osmc.pair_table(z)
    loss, _ = osmc.loss_and_gradient(np.full((len(t.items), 1), math.sqrt(0.5)), t)
    return spark.createDataFrame([(round(loss, 6),)], "loss double")


@query()
def osmc_theta(spark: SparkSession, d: str) -> DataFrame:
    z = holdout.zscores(ud(spark, d), ud(spark, d)).select("row_key", "col_key", F.col("z").alias("value"))
    t = osmc.pair_table(z)
    return osmc.theta_frame(z, osmc.fit(t, 2), t.items)


@query()
def osmc_predict(spark: SparkSession, d: str) -> DataFrame:
    marked = holdout.holdout(ud(spark, d), "row_key")
    z = cut(holdout.zscores(marked, marked.filter("not held")).withColumn("value", F.col("z")).drop("z"), "osmc")
    t = osmc.pair_table(z.filter("not held").drop("held"))
    return osmc.predict(holdout.conditioning_sets(z), osmc.fit(t, 2), t.items)


@query()
def surrogate(spark: SparkSession, d: str) -> DataFrame:
    cells = ut(spark, d)
    z = holdout.zscores(cells, cells).select("row_key", "col_key", F.col("z").alias("value"))
    t = osmc.pair_table(z)
    m = {r.col_key: r for r in holdout.moments(cells).collect()}
    return osmc.surrogate(cells.select("row_key").distinct(), osmc.fit(t, 2), t.items, np.array([m[i].mu for i in t.items]), np.array([m[i].sd for i in t.items]))


@query("select x, round(1 / (1 + exp(-x)), 9) as p, round(case when x >= 0 then -ln(1 + exp(-x)) else x - ln(1 + exp(x)) end, 9) as log_p from (select event_id % 41 - 20 as x from events)")
def logistic_fns(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x").cast("double")
    log_p = F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))
    return table(spark, d, "events").select((F.col("event_id") % 41 - 20).alias("x")).select("x", F.round(1 / (1 + F.exp(-x)), 9).alias("p"), F.round(log_p, 9).alias("log_p"))


@query(f"select row_key, col_key, round(1 / pow(col_key + 1, 0.7), 9) as popularity, case when row_key % 2 = col_key % 2 then 2.0::double else 1.0::double end as block, round(pow(abs(value), 2), 4) as by_value from ({UD})")
def mnar_weights(spark: SparkSession, d: str) -> DataFrame:
    w = synth.observation_weights
    return ud(spark, d).select("row_key", "col_key", F.round(w("popularity", 0.7), 9).alias("popularity"), w("block").alias("block"), F.round(w("value", 2.0), 4).alias("by_value"))


@query()
def synth_mnar(spark: SparkSession, d: str) -> DataFrame:
    return synth.not_at_random(spark, 200, 24)


# -- factor models --------------------------------------------------------------------------------------------------------------


@query(f"with c as ({EM}), m as (select col_key, stddev_samp(value) as sd from c group by 1) select a.col_key as a, b.col_key as b, round(case when a.col_key = b.col_key then 1.0 else coalesce(covar_samp(a.value, b.value) / nullif(any_value(ma.sd) * any_value(mb.sd), 0), 0) end, 6) as r from c a join c b on a.row_key = b.row_key join m ma on ma.col_key = a.col_key join m mb on mb.col_key = b.col_key group by 1, 2")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(factor.correlations(em(spark, d)), "r")


def _corr(spark, d):
    return factor.matrix_of(factor.correlations(em(spark, d)), "r")


@query()
def eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(factor.eigenvalues(_corr(spark, d)[0]))], "position int, value double")


@query()
def pa_nfactors(spark: SparkSession, d: str) -> DataFrame:
    """Parallel analysis: observed eigenvalues, their random cutoffs and the number of factors."""
    r, items = _corr(spark, d)
    values = factor.eigenvalues(r)
    cuts = factor.random_cutoffs(spark, table(spark, d, "embeddings").count(), len(items), 100)
    return spark.createDataFrame(report.scree(values, cuts), "position int, value double, cutoff double").withColumn("n_factors", F.lit(factor.n_factors(values, cuts)))


def _loadings(spark, d):
    r, items = _corr(spark, d)
    load, phi = factor.efa(r, 4)
    return r, items, load, phi


@query()
def efa_loadings(spark: SparkSession, d: str) -> DataFrame:
    _, items, load, _ = _loadings(spark, d)
    return factor.loadings_frame(spark, load, items)


@query()
def bifactor_omega(spark: SparkSession, d: str) -> DataFrame:
    r, _, load, phi = _loadings(spark, d)
    o = factor.hierarchy(r, load, phi)["omega"]
    return spark.createDataFrame([(k, float(v)) for k, v in o.items()], "name string, value double")


_LOAD = "select vec_id::varchar as item, i::int + 1 as factor, embedding[i::int + 1]::double as loading, label % 3 as method from embeddings, range(0, 4) t(i)"


def _fixed_loadings(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("item"), F.posexplode("embedding").alias("f", "loading"), (F.col("label") % 3).alias("method")).select("item", (F.col("f") + 1).alias("factor"), F.col("loading").cast("double").alias("loading"), "method")


@query(f"with l as ({_LOAD}), s as (select factor, sum(loading * loading) as ss from l group by 1), n as (select count(distinct item) as p from l) select factor, round(ss, 6) as ss, row_number() over (order by ss desc, factor)::int as position, round(ss / p, 6) as share, round(sum(ss / p) over (order by ss desc, factor rows unbounded preceding), 6) as cumulative from s, n")
def ss_loadings(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(factor.ss_loadings(_fixed_loadings(spark, d)), "ss", "share", "cumulative")


@query(
    f"""with l as ({_LOAD}), t as (select item, factor as home, abs(loading) as strength, row_number() over (partition by item order by abs(loading) desc, factor) as i from l), p as (select item, row_number() over (order by home, strength desc, item)::int as position from t where i = 1)
    select position, item, factor, case when abs(loading) >= 0.3 then printf('%.2f', loading) else '' end as shown from l join p using (item)"""
)
def loadings_report(spark: SparkSession, d: str) -> DataFrame:
    return report.loadings_report(_fixed_loadings(spark, d).drop("method"))


_METHODS = "select (vec_id // 10)::varchar as item, i::int + 1 as factor, avg(embedding[i::int + 1])::double as loading, (vec_id % 3)::int as method from embeddings, range(0, 4) t(i) group by all"


@query(
    f"""with l as ({_METHODS}), s as (select method, factor, row_number() over (partition by method order by sum(loading * loading) desc, factor) as pos from l group by 1, 2), h as (select method, md5(array_to_string(list_sort(list(distinct item)), '|')) as shape, count(distinct factor) as nf from l group by 1),
    x as (select shape, nf, l.method as m, item, pos, loading from l join s using (method, factor) join h using (method)), c as (select a.nf, a.m as method_a, b.m as method_b, a.pos, abs(sum(a.loading * b.loading) / nullif(sqrt(sum(a.loading * a.loading) * sum(b.loading * b.loading)), 0)) as c
    from x a join x b on a.shape = b.shape and a.nf = b.nf and a.item = b.item and a.pos = b.pos and a.m < b.m group by 1, 2, 3, 4) select nf, method_a, method_b, round(avg(c), 5) as congruence from c group by 1, 2, 3"""
)
def loading_congruence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("string").alias("item"), F.posexplode("embedding").alias("f", "v"), (F.col("vec_id") % 3).cast("int").alias("method"))
    load = e.groupBy("item", (F.col("f") + 1).alias("factor"), "method").agg(F.avg(F.col("v").cast("double")).alias("loading"))
    return _rounded(factor.congruence(load, [], "method"), "congruence", places=5)


# -- further operators ------------------------------------------------------------------------------------------------------------

_UNIT = "(cast('0x' || substr(md5('1|' || row_key || '|' || col_key), 1, 13) as bigint) + 1)::double / (pow(16, 13) + 1)"


@query(f"select row_key, col_key from (select *, row_number() over (partition by row_key order by -ln({_UNIT}) / (1 / pow(col_key % 7 + 1, 0.7))) as i from ({CS})) where i <= 3")
def sample_k_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Weighted draws without replacement by exponential keys."""
    cells = cs(spark, d).withColumn("w", 1 / F.pow(F.col("col_key") % 7 + 1, F.lit(0.7)))
    return holdout.sample_k(cells, 3, weight="w").select("row_key", "col_key")


@query(f"with l as ({_METHODS}) select a.item as a, b.item as b, round(sum(a.loading * b.loading), 6) as theta from l a join l b on a.factor = b.factor and a.method = 0 and b.method = 0 group by 1, 2")
def theta_hat(spark: SparkSession, d: str) -> DataFrame:
    """V V' of a loadings table of all rows and dimensions: a row of V is an array, so a pair of items is one product."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("string").alias("item"), F.posexplode("embedding").alias("factor", "v"))
    v = e.groupBy("item", "factor").agg(F.avg(F.col("v").cast("double")).alias("loading"))
    v = cut(v.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("factor", "loading"))), lambda x: x["loading"]).alias("x")), "theta")
    pair = v.select(F.col("item").alias("a"), "x").crossJoin(v.select(F.col("item").alias("b"), F.col("x").alias("y")))
    return pair.select("a", "b", F.round(F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6).alias("theta"))


@query(f"with l as ({_LOAD}), s as (select factor, sum(loading * loading) as ss from l group by 1) select factor, round(sum(ss / (select count(distinct item) from l)) over (order by ss desc, factor rows unbounded preceding), 6) as cumulative from s")
def variance_explained(spark: SparkSession, d: str) -> DataFrame:
    return factor.ss_loadings(_fixed_loadings(spark, d)).select("factor", F.round("cumulative", 6).alias("cumulative"))


@query(f"with c as (select user_id as row_key, event_type as col_key, avg(value) / 100 as value from events group by 1, 2), p as ({_PAIRS}), o as (select sum(n) as n, sum(s) as s, sum(q) as q from p where a <> b) select round(sqrt(q / n - pow(s / n, 2)), 6) as rmse, n::bigint as n from o")
def product_score(spark: SparkSession, d: str) -> DataFrame:
    """Error of predicting every product of two cells of a row by the mean product, from pair sums alone."""
    scaled = ut(spark, d).withColumn("value", F.col("value") / 100)
    o = osmc.pair_products(scaled).filter("a <> b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    return o.select(F.round(F.sqrt(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)), 6).alias("rmse"), "n")


@query(f"with h as ({_held_sql(CS, 'col_key')}), t as (select * from h where not held), m as ({_MOMENTS}), e as (select col_key, pow((mu - value) / sd, 2) as e from h join m using (col_key) where held), c as (select avg(e) as mse, count(*) as n from e group by col_key) select round(avg(sqrt(mse)), 6) as rmse, 0.0::double as r2, cast(sum(n) as bigint) as n from c")
def holdout_eval(spark: SparkSession, d: str) -> DataFrame:
    """Held-out score of the mean imputer, fitted on training cells only; by definition its r2 is 0."""
    marked = cut(holdout.holdout(cs(spark, d)), "held")
    train, held = marked.filter("not held").drop("held"), marked.filter("held").drop("held")
    means = train.groupBy("col_key").agg(F.avg("value").alias("value"))
    return holdout.score(held, held.select("row_key", "col_key").join(means, "col_key"), train).select(F.round("rmse", 6).alias("rmse"), (F.round("r2", 6) + 0.0).alias("r2"), "n")


@query("with c as (select event_id % 10 as param, round(avg(value), 6) as rmse from events group by 1) select param, rmse, round(lag(rmse) over (order by param) - rmse, 6) as gain from c")
def dashboard_panels(spark: SparkSession, d: str) -> DataFrame:
    """The data of a curve panel: a value per parameter and the gain of each step."""
    c = table(spark, d, "events").groupBy((F.col("event_id") % 10).alias("param")).agg(F.round(F.avg("value"), 6).alias("rmse"))
    return _rounded(report.curve_panel(c, "param", "rmse"), "gain")


@query(
    "with l as (select (vec_id // 20)::varchar as item, i::int + 1 as factor, avg(embedding[i::int + 1])::double as loading, (vec_id % 2)::int as method, 'kind' || (vec_id // 240) % 2 as kind from embeddings, range(0, 3) t(i) group by all), s as (select kind, method, factor, row_number() over (partition by kind, method order by sum(loading * loading) desc, factor) as pos from l group by 1, 2, 3), "
    "h as (select kind, method, md5(array_to_string(list_sort(list(distinct item)), '|')) as shape, count(distinct factor) as nf from l group by 1, 2), x as (select l.kind, shape, nf, l.method as m, item, pos, loading from l join s using (kind, method, factor) join h using (kind, method)), "
    "c as (select a.kind, a.nf, a.m as method_a, b.m as method_b, a.pos, abs(sum(a.loading * b.loading) / sqrt(sum(a.loading * a.loading) * sum(b.loading * b.loading))) as c from x a join x b on a.kind = b.kind and a.shape = b.shape and a.nf = b.nf and a.item = b.item and a.pos = b.pos and a.m < b.m group by 1, 2, 3, 4, 5) "
    "select kind, nf, method_a, method_b, round(avg(c), 5) as congruence from c group by 1, 2, 3, 4"
)
def congruence_report(spark: SparkSession, d: str) -> DataFrame:
    """Congruence of methods within each kind of loadings."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).cast("string").alias("item"), F.posexplode("embedding").alias("f", "v"), (F.col("vec_id") % 2).cast("int").alias("method"), F.concat(F.lit("kind"), (F.floor(F.col("vec_id") / 240) % 2).cast("string")).alias("kind"))
    load = e.groupBy("item", (F.col("f") + 1).alias("factor"), "method", "kind").agg(F.avg(F.col("v").cast("double")).alias("loading"))
    return _rounded(factor.congruence(load, ["kind"], "method"), "congruence", places=5)


@query()
def pa_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(factor.random_cutoffs(spark, 200, 12, 20))], "position int, cutoff double")


@query()
def second_order(spark: SparkSession, d: str) -> DataFrame:
    r, _, load, phi = _loadings(spark, d)
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(factor.hierarchy(r, load, phi)["second_order"])], "first_order_factor int, g double")


@query()
def osmc_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Subspace error of one-sided completion and of its three baselines on a planted low-rank table with four cells per row."""
    full = synth.low_rank(spark, 800, 16, 2, 5)
    t, sampled = osmc.pair_table(full), cut(holdout.sample_k(full, 4), "osmc")
    true = np.linalg.eigh(t.s)[1][:, ::-1][:, :2]
    seen = osmc.pair_table(sampled)
    off = seen.s - np.diag(np.diag(seen.s))
    bases = {
        "one-sided": osmc.singular_vectors(osmc.fit(seen, 2), 2), "direct": np.linalg.eigh(seen.s)[1][:, ::-1][:, :2], "without diagonal": np.linalg.eigh(off)[1][:, ::-1][:, :2], "full completion": osmc.full_completion(sampled, 2),
    }
    return spark.createDataFrame([(k, osmc.rowspace_error(b, true), osmc.mean_principal_angle(b, true)) for k, b in bases.items()], "method string, error double, angle double")


@query()
def propensity(spark: SparkSession, d: str) -> DataFrame:
    """Chance of each cell of the dense user x day table to be observed, from the mask alone. The driver holds the mask and the chances,
    some ten times 8 bytes a cell; they come and go as Arrow tables."""
    seen = ud(spark, d).filter("value is not null and row_key is not null and col_key is not null").select("row_key", "col_key").toArrow()
    rk, i = np.unique(seen["row_key"].to_numpy(), return_inverse=True)
    ck, j = np.unique(seen["col_key"].to_numpy(), return_inverse=True)
    mask = np.zeros((len(rk), len(ck)))
    mask[i, j] = 1
    p = osmc.propensity(mask)
    return spark.createDataFrame(pa.table({"row_key": np.repeat(rk, len(ck)).astype("int64"), "col_key": np.tile(ck, len(rk)).astype("int32"), "p": p.ravel()}), "row_key long, col_key int, p double")


@query(f"with l as ({_LOAD}) select method, factor, row_number() over (partition by method order by sum(loading * loading) desc, factor)::int as position from l group by 1, 2")
def ssq_factor_order(spark: SparkSession, d: str) -> DataFrame:
    """Position of each factor by its sum of squared loadings, within a method."""
    from pyspark.sql import Window

    ss = _fixed_loadings(spark, d).groupBy("method", "factor").agg(F.sum(F.col("loading") * F.col("loading")).alias("ss"))
    return ss.select("method", "factor", F.row_number().over(Window.partitionBy("method").orderBy(F.col("ss").desc(), "factor")).alias("position"))


_ZD = f"with t as ({UD}), m as ({_MOMENTS}), c as (select row_key, col_key, (value - mu) / sd as value from t join m using (col_key)), p as ({_PAIRS})"


@query(f"{_ZD}, l as (select sum(case when a <> b then 2 * (n * 0.0625 - 0.5 * s + q) end) / sum(case when a <> b then 2 * n end) + sum(case when a = b then n * 0.0625 - 0.5 * s + q end) / sum(case when a = b then n end) as loss from p) select round(loss, 6) as loss from l")
def osmc_ragged_loss(spark: SparkSession, d: str) -> DataFrame:
    """The loss over rows of different lengths, of a factor whose every product is 0.25."""
    cells = ud(spark, d)
    z = holdout.zscores(cells, cells).select("row_key", "col_key", F.col("z").alias("value"))
    t = osmc.pair_table(z)
    loss, _ = osmc.loss_and_gradient(np.full((len(t.items), 1), 0.5), t)
    return spark.createDataFrame([(round(loss, 6),)], "loss double")
