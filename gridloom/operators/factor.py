"""Correlation, parallel analysis, rotated and hierarchical factor models, and congruence of loadings.

Sums over entities are distributed; what is left is algebra on p x p matrices, done on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.impute import MAX_ITEMS

_cutoffs: dict[tuple, np.ndarray] = {}


def correlations(cells: DataFrame) -> DataFrame:
    """(a, b, r) of all ordered pairs of columns over the rows that observe both; undefined is 0, the diagonal 1.

    Pairs are made within each row's array and combined map-side as sums; no self-join of the cells is shuffled.
    """
    seen = cells.filter("value is not null").groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("col_key", "value"))).alias("g"))
    left = seen.select("g", F.explode("g").alias("a"))
    pair = left.select(F.col("a.col_key").alias("a"), F.col("a.value").alias("x"), F.explode("g").alias("b")).select("a", "x", F.col("b.col_key").alias("b"), F.col("b.value").alias("y"))
    stats = pair.groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    r = F.coalesce(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")), F.lit(0.0))
    return stats.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.when(F.isnan(r), 0.0).otherwise(r)).alias("r"))


def matrix_of(long: DataFrame, value: str) -> tuple[np.ndarray, list]:
    """A symmetric (a, b, value) table as a matrix on the driver."""
    rows = long.select("a", "b", value).limit(MAX_ITEMS * MAX_ITEMS + 1).collect()
    items = sorted({r.a for r in rows})
    if len(items) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    at = {c: i for i, c in enumerate(items)}
    out = np.zeros((len(items), len(items)))
    for r in rows:
        out[at[r.a], at[r.b]] = r[value]
    return out, items


def eigenvalues(r: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh(r)[::-1]


def random_cutoffs(spark, n: int, p: int, iters: int = 100, quantile: float = 0.95, seed: int = 1) -> np.ndarray:
    """Quantile per position of the eigenvalues of correlations of random normal n x p matrices; iterations are parallel tasks and
    results are kept by shape, iterations, quantile and seed."""
    key = (n, p, iters, quantile, seed)
    if key not in _cutoffs:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in pdf["id"]:
                    x = np.random.default_rng([seed, int(i)]).standard_normal((n, p))
                    yield pd.DataFrame({"position": np.arange(p), "value": np.linalg.eigvalsh(np.corrcoef(x.T).reshape(p, p))[::-1]})

        draws = spark.range(iters).repartition(min(iters, 64)).mapInPandas(run, "position int, value double")
        rows = draws.groupBy("position").agg(F.percentile("value", quantile).alias("cut")).collect()
        _cutoffs[key] = np.array([r.cut for r in sorted(rows, key=lambda r: r.position)])
    return _cutoffs[key]


def n_factors(values: np.ndarray, cutoffs: np.ndarray) -> int:
    return max(1, int((values > cutoffs).sum()))


def safe_n(r: np.ndarray, n: int, factors: int) -> int:
    return max(1, min(factors, len(r) - 1, n - 1, int(np.linalg.matrix_rank(r)) - 1))


def minres(r: np.ndarray, factors: int, iters: int = 500) -> np.ndarray:
    """Unrotated loadings with the smallest off-diagonal residual: alternately the leading eigenvectors of R with the current
    communalities in its diagonal, and the communalities of these."""
    h = 1 - 1 / np.maximum(np.diag(np.linalg.pinv(r + 1e-8 * np.eye(len(r)))), 1.0)
    load = np.zeros((len(r), factors))
    for _ in range(iters):
        w, q = np.linalg.eigh(r - np.diag(1 - h))
        load = q[:, ::-1][:, :factors] * np.sqrt(np.maximum(w[::-1][:factors], 1e-9))
        new = np.clip((load**2).sum(1), 0.005, 0.995)
        if np.abs(new - h).max() < 1e-8:
            break
        h = new
    return load * np.where(load.sum(0) < 0, -1, 1)


def varimax(load: np.ndarray, iters: int = 500) -> np.ndarray:
    p, k = load.shape
    rot, last = np.eye(k), 0.0
    norm = np.sqrt(np.maximum((load**2).sum(1, keepdims=True), 1e-12))
    x = load / norm
    for _ in range(iters):
        y = x @ rot
        u, s, v = np.linalg.svd(x.T @ (y**3 - y * (y**2).sum(0) / p))
        rot = u @ v
        if s.sum() < last * (1 + 1e-10):
            break
        last = s.sum()
    return load @ rot


def promax(load: np.ndarray, power: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Oblique loadings and factor correlations: least-squares fit of the varimax loadings to their signed powers."""
    if load.shape[1] == 1:
        return load, np.eye(1)
    y = varimax(load)
    t = np.linalg.lstsq(y, np.sign(y) * np.abs(y) ** power, rcond=None)[0]
    t = t * np.sqrt(np.diag(np.linalg.inv(t.T @ t)))
    inv = np.linalg.inv(t)
    return y @ t, inv @ inv.T


def efa(r: np.ndarray, factors: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotated loadings and factor correlations; fewer factors where that many fail."""
    for k in range(factors, 0, -1):
        try:
            load, phi = promax(minres(r, k))
            if np.isfinite(load).all() and np.isfinite(phi).all():
                order = np.argsort(-(load**2).sum(0))
                return load[:, order], phi[np.ix_(order, order)]
        except np.linalg.LinAlgError:
            continue
    return minres(r, 1), np.eye(1)


def hierarchy(r: np.ndarray, load: np.ndarray, phi: np.ndarray) -> dict:
    """Second-order loadings, Schmid-Leiman bifactor loadings and the omega coefficients."""
    if len(phi) == 1:
        return {"second_order": None, "bifactor": None, "omega": None}
    gamma = minres(phi, 1)[:, 0] if len(phi) > 2 else np.full(2, np.sqrt(max(0.0, min(0.99, phi[0, 1]))))
    gamma = np.clip(gamma, -0.999, 0.999)
    g, group = load @ gamma, load * np.sqrt(1 - gamma**2)
    h2 = np.clip(g**2 + (group**2).sum(1), 0, 1)
    total = r.sum()
    home = np.abs(group).argmax(1)
    per = []
    for k in range(len(phi)):
        mine = home == k
        t = r[np.ix_(mine, mine)].sum()
        per.append((k + 1, float(1 - (1 - h2[mine]).sum() / t) if t else 0.0, float(g[mine].sum() ** 2 / t) if t else 0.0, float(group[mine, k].sum() ** 2 / t) if t else 0.0))
    omega_h, omega_t = float(g.sum() ** 2 / total), float(1 - (1 - h2).sum() / total)
    return {"second_order": gamma, "bifactor": np.c_[g, group, h2, 1 - h2, np.where(h2 > 0, g**2 / np.maximum(h2, 1e-12), 0)], "omega": {"omega_h": omega_h, "omega_h_asymptotic": omega_h / omega_t if omega_t else 0.0, "omega_total": omega_t, "n_first_order": len(phi)}, "omega_group": per}


def loadings_frame(spark, load: np.ndarray, items: list) -> DataFrame:
    return spark.createDataFrame([(str(c), k + 1, float(load[i, k])) for i, c in enumerate(items) for k in range(load.shape[1])], "item string, factor int, loading double")


def ss_loadings(load: DataFrame) -> DataFrame:
    """Sum of squared loadings per factor, share of variance and its running sum in order of the former."""
    n = load.select(F.count_distinct("item").alias("_p"))
    from pyspark.sql import Window

    ss = load.groupBy("factor").agg(F.sum(F.col("loading") * F.col("loading")).alias("ss")).join(F.broadcast(n))
    w = Window.orderBy(F.col("ss").desc(), "factor")
    return ss.select("factor", "ss", F.row_number().over(w).alias("position"), (F.col("ss") / F.col("_p")).alias("share"), F.sum(F.col("ss") / F.col("_p")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def congruence(loadings: DataFrame, group: list[str], method: str) -> DataFrame:
    """Mean |cosine| over factors matched by their order of squared loadings, for each pair of methods with the same items and number
    of factors in a group; factors without any loading are left out."""
    from pyspark.sql import Window

    ss = loadings.groupBy(*group, method, "factor").agg(F.sum(F.col("loading") * F.col("loading")).alias("ss"))
    placed = ss.withColumn("pos", F.row_number().over(Window.partitionBy(*group, method).orderBy(F.col("ss").desc(), "factor"))).drop("ss")
    shape = loadings.groupBy(*group, method).agg(F.md5(F.array_join(F.array_sort(F.collect_set("item")), "|")).alias("shape"), F.count_distinct("factor").alias("nf"))
    x = loadings.join(placed, [*group, method, "factor"]).join(shape, [*group, method]).select(*group, "shape", "nf", F.col(method).alias("m"), "item", "pos", "loading")
    keys = [*group, "shape", "nf", "item", "pos"]
    pairs = x.select(*keys, F.col("m").alias("method_a"), F.col("loading").alias("la")).join(x.select(*keys, F.col("m").alias("method_b"), F.col("loading").alias("lb")), keys).filter("method_a < method_b")
    per = pairs.groupBy(*group, "nf", "method_a", "method_b", "pos").agg(F.abs(F.try_divide(F.sum(F.col("la") * F.col("lb")), F.sqrt(F.sum(F.col("la") * F.col("la")) * F.sum(F.col("lb") * F.col("lb"))))).alias("c"))
    return per.groupBy(*group, "nf", "method_a", "method_b").agg(F.avg("c").alias("congruence"))
