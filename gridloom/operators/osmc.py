"""One-sided matrix completion: the items' covariance from few cells per row, and what it predicts.

The loss over pairs of cells of a row depends on the data only through, per pair of items, the number of rows that observe both, the
sum of the products and the sum of their squares. One distributed aggregation gives this p x p table; fitting then needs no more jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import cut

from gridloom.operators.impute import MAX_ITEMS


def pair_products(cells: DataFrame) -> DataFrame:
    """(a, b, n, s, q) for a <= b: rows observing both, sum of products, sum of squared products. The pairs are made within each
    row's array, whose length is the number of items a row observes, so no join and one aggregation with map-side combine."""
    seen = cells.filter("value is not null").groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("col_key", "value"))).alias("g"))
    a = seen.select("g", F.posexplode("g").alias("i", "a"))
    ab = a.select(F.col("a.col_key").alias("a"), F.col("a.value").alias("x"), F.explode(F.expr("slice(g, i + 1, size(g))")).alias("b")).select("a", F.col("b.col_key").alias("b"), (F.col("x") * F.col("b.value")).alias("p"))
    return ab.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))


def gram(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """Both triangles of the Gram matrix of the zero-filled cells as (a, b, theta)."""
    half = pair_products(cells).select("a", "b", F.col("s").alias("theta"))
    off = half.filter("a <> b")
    full = off.unionByName(off.select(F.col("b").alias("a"), F.col("a").alias("b"), "theta"))
    return full.unionByName(half.filter("a = b")) if diagonal else full


@dataclass
class PairTable:
    items: list
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray


def pair_table(cells: DataFrame) -> PairTable:
    """The pair sums as symmetric matrices on the driver, for at most MAX_ITEMS items."""
    items = [r[0] for r in cells.select("col_key").distinct().orderBy("col_key").limit(MAX_ITEMS + 1).collect()]
    if len(items) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    at = {c: i for i, c in enumerate(items)}
    n, s, q = (np.zeros((len(items), len(items))) for _ in range(3))
    for r in pair_products(cells).toLocalIterator():
        i, j = at[r.a], at[r.b]
        n[i, j] = n[j, i] = r.n
        s[i, j] = s[j, i] = r.s
        q[i, j] = q[j, i] = r.q
    return PairTable(items, n, s, q)


def loss_and_gradient(v: np.ndarray, t: PairTable) -> tuple[float, np.ndarray]:
    """Mean squared residual of V V' over ordered pairs plus that over single cells, and its gradient."""
    theta = v @ v.T
    off = ~np.eye(len(v), dtype=bool)
    weight = np.where(off, 1 / max(1.0, t.n[off].sum()), 1 / max(1.0, np.trace(t.n)))
    loss = float((weight * (t.n * theta**2 - 2 * theta * t.s + t.q)).sum())
    return loss, 4 * (weight * (t.n * theta - t.s)) @ v


def fit(t: PairTable, rank: int, iters: int = 2000, lr: float = 0.05, init: float = 0.1, seed: int = 1) -> np.ndarray:
    """V (items x rank) by Adam from a small random start."""
    v = init * np.random.default_rng(seed).standard_normal((len(t.items), rank))
    m, u = np.zeros_like(v), np.zeros_like(v)
    for k in range(1, iters + 1):
        _, g = loss_and_gradient(v, t)
        m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g**2
        v -= lr * (m / (1 - 0.9**k)) / (np.sqrt(u / (1 - 0.999**k)) + 1e-8)
    return v


def singular_vectors(v: np.ndarray, rank: int) -> np.ndarray:
    return np.linalg.eigh(v @ v.T)[1][:, ::-1][:, :rank]


def theta_frame(cells: DataFrame, v: np.ndarray, items: list) -> DataFrame:
    theta = v @ v.T
    rows = [(a, b, float(theta[i, j])) for i, a in enumerate(items) for j, b in enumerate(items)]
    kind = dict(cells.dtypes)["col_key"]
    return cells.sparkSession.createDataFrame(rows, f"a {kind}, b {kind}, theta double")


def full_completion(cells: DataFrame, rank: int, lam: float = 0.1, passes: int = 12) -> np.ndarray:
    """Baseline: the right factor of a regularised factor model, as an orthonormal basis."""
    from gridloom.operators.impute import _blocks, _right_sums, _rows_of

    packed, _, _, items = _rows_of(cells)
    blocks = _blocks(cut(packed, "completion-rows"))
    b = np.random.default_rng(1).standard_normal((len(items), rank)) * 0.1
    for _ in range(passes):
        normal, right = _right_sums(blocks, b, lam)
        b = np.linalg.solve(normal + lam * np.eye(rank), right[:, :, None])[:, :, 0]
    return np.linalg.qr(b)[0]


def predict(given: DataFrame, v: np.ndarray, items: list) -> DataFrame:
    """(row_key, col_key, value) for cells with their conditioning sets: the conditional mean V_j' pinv(V_S) z_S."""
    return predict_each(given, [v], items).select("row_key", "col_key", F.col("values")[0].alias("value"))


def predict_each(given: DataFrame, factors: list[np.ndarray], items: list) -> DataFrame:
    """``predict`` under several factors at once: (row_key, col_key, values). The pseudo-inverse is made once for each conditioning set of a batch."""
    held = given.sparkSession.sparkContext.broadcast((factors, {c: i for i, c in enumerate(items)}))
    kinds = dict(given.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors, at = held.value
        for pdf in batches:
            known: dict[tuple, list[np.ndarray]] = {}
            out = []
            for c, g in zip(pdf["col_key"], pdf["given"]):
                use = [(at[x["col_key"]], x["value"]) for x in (g if g is not None else []) if x["col_key"] in at]
                if not use or c not in at:
                    out.append([0.0] * len(factors))
                    continue
                place, z = tuple(i for i, _ in use), np.array([x for _, x in use])
                if place not in known:
                    known[place] = [np.linalg.pinv(v[list(place)]) for v in factors]
                out.append([float(v[at[c]] @ (inverse @ z)) for v, inverse in zip(factors, known[place])])
            yield pd.DataFrame({"row_key": pdf["row_key"], "col_key": pdf["col_key"], "values": out})

    return given.select("row_key", "col_key", "given").mapInPandas(run, f"row_key {kinds['row_key']}, col_key {kinds['col_key']}, values array<double>")


def select_rank(t: PairTable, given: DataFrame, held: DataFrame, ranks: range = range(1, 11), iters: int = 1000) -> tuple[int, list[tuple[int, float]]]:
    """The rank of the smallest held-out rmse of z-values; 1 if nothing is held out. All ranks are scored in one job."""
    p = predict_each(given, [fit(t, r, iters) for r in ranks], t.items)
    e = held.select("row_key", "col_key", "value").join(p, ["row_key", "col_key"])
    got = e.agg(*[F.sqrt(F.avg(F.pow(F.col("values")[i] - F.col("value"), 2))).alias(str(r)) for i, r in enumerate(ranks)]).first()
    curve = [(r, float("inf") if got[str(r)] is None else got[str(r)]) for r in ranks]
    return (min(curve, key=lambda c: (c[1], c[0]))[0] if any(np.isfinite(e) for _, e in curve) else 1), curve


def run_onesided(cells: DataFrame, ranks: range = range(1, 11), seed: int = 1, iters: int = 2000) -> tuple[int, list[tuple[int, float]], DataFrame]:
    """The rank of the smallest held-out rmse, the curve over all ranks, and the surrogate table of the fit of all cells at that rank.
    The held-out cells are drawn by ``seed``; selection fits take half the iterations, at least 1,000."""
    from gridloom.operators import holdout

    z, stats = _z_cells(cells)
    marked = cut(holdout.holdout(z, "row_key", seed=seed), "onesided")
    train = pair_table(marked.filter("not held").drop("held"))
    best, curve = select_rank(train, holdout.conditioning_sets(marked), marked.filter("held"), ranks, max(1000, iters // 2))
    t = pair_table(z)
    moments = {r.col_key: r for r in stats.collect()}  # one row per item
    mu, sd = (np.array([getattr(moments[c], f) for c in t.items]) for f in ("mu", "sd"))
    return best, curve, surrogate(z.select("row_key").distinct(), fit(t, best, iters, seed=seed), t.items, mu, sd, seed)


def _z_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    from gridloom.operators import holdout

    seen = cells.filter("value is not null")
    stats = cut(holdout.moments(seen), "moments")
    return cut(seen.join(stats, "col_key").select("row_key", "col_key", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("value")), "z"), stats


def sensitivity(cells: DataFrame, ranks: range = range(1, 11), seeds: int = 20, iters: int = 1000) -> list[tuple[int, int, int, float]]:
    """(seed, chosen rank, rank, rmse) over fresh holdouts: the data isn't missing at random, so the spread over seeds is the message."""
    from gridloom.operators import holdout

    z, _ = _z_cells(cells)
    out = []
    for seed in range(1, seeds + 1):
        marked = cut(holdout.holdout(z, "row_key", seed=seed), "onesided")
        best, curve = select_rank(pair_table(marked.filter("not held").drop("held")), holdout.conditioning_sets(marked), marked.filter("held"), ranks, iters)
        out += [(seed, best, r, e) for r, e in curve]
    return out


def surrogate(rows: DataFrame, v: np.ndarray, items: list, mu: np.ndarray, sd: np.ndarray, seed: int = 1) -> DataFrame:
    """Random rows with the fitted covariance: z Q sqrt(L)' per row, rescaled; negative eigenvalues count as zero."""
    w, q = np.linalg.eigh(v @ v.T)
    root = q * np.sqrt(np.maximum(w, 0))
    held = rows.sparkSession.sparkContext.broadcast((root, mu, sd))
    kind = dict(rows.dtypes)["row_key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        root, mu, sd = held.value
        for pdf in batches:
            z = np.array([np.random.default_rng([seed, zlib.crc32(str(k).encode())]).standard_normal(len(mu)) for k in pdf["row_key"]]).reshape(-1, len(mu))
            yield pd.DataFrame({"row_key": pdf["row_key"], "v": np.nan_to_num((z @ root.T) * sd + mu).tolist()})

    wide = rows.select("row_key").mapInPandas(run, f"row_key {kind}, v array<double>")
    names = F.array(*[F.lit(c) for c in items])
    return wide.select("row_key", F.posexplode("v").alias("i", "value")).select("row_key", F.get(names, F.col("i")).alias("col_key"), "value")


def rowspace_error(est: np.ndarray, true: np.ndarray) -> float:
    """Squared Frobenius distance of two bases after the best rotation."""
    u, _, w = np.linalg.svd(est.T @ true)
    return float(((est @ u @ w - true) ** 2).sum())


def mean_principal_angle(a: np.ndarray, b: np.ndarray) -> float:
    """Mean principal angle of two subspaces, in degrees."""
    s = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)
    return float(np.degrees(np.arccos(np.clip(s, -1, 1))).mean())


def nuclear_projection(m: np.ndarray, radius: float) -> np.ndarray:
    """Nearest matrix whose singular values sum to at most ``radius``; the threshold is found by bisection."""
    u, s, w = np.linalg.svd(m, full_matrices=False)
    if s.sum() <= radius:
        return m
    lo, hi = 0.0, float(s.max())
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.maximum(s - mid, 0).sum() > radius else (lo, mid)
    return (u * np.maximum(s - hi, 0)) @ w


def propensity(mask: np.ndarray, tau: float = 1.0, gamma: float = 3.0, iters: int = 100, lr: float = 1.0) -> np.ndarray:
    """Probability of each cell to be observed, from the mask alone: logistic likelihood over a nuclear-norm ball, clipped."""
    a = np.zeros(mask.shape)
    for _ in range(iters):
        a = np.clip(nuclear_projection(a - lr * (1 / (1 + np.exp(-a)) - mask), tau * np.sqrt(mask.size)), -gamma, gamma)
    return 1 / (1 + np.exp(-a))
