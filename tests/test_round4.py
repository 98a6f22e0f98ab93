"""Changes of the fourth round: SoftImpute against a dense loop of its definition."""

from __future__ import annotations

import numpy as np
import pandas as pd

from gridloom.operators import holdout, impute
from gridloom.plans import matrix


def dense_softimpute(z, lam, rank, passes=3000):
    """M = S_lam(P(X) + P'(M)) from M = 0, its SVD cut at the rank cap."""
    m, seen = np.zeros(z.shape), ~np.isnan(z)
    for _ in range(passes):
        u, d, v = np.linalg.svd(np.where(seen, z, m), full_matrices=False)
        before, m = m, (u[:, :rank] * np.maximum(d[:rank] - lam, 0)) @ v[:rank]
        if ((m - before) ** 2).sum() <= 1e-12 * max(1e-12, (before**2).sum()):
            break
    return m


def scaled(x):
    return (x - np.nanmean(x, 0)) / np.nanstd(x, 0, ddof=1)


def noisy(spark, rows=90, cols=9, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((rows, 2)) @ rng.standard_normal((2, cols)) + rng.standard_normal((rows, cols))
    x = np.where(rng.random(x.shape) < 0.7, x, np.nan)
    i, j = np.where(~np.isnan(x))
    return x, spark.createDataFrame(pd.DataFrame({"row_key": i, "col_key": j, "value": x[i, j]}))


def as_matrix(df, shape):
    got = df.toPandas()
    out = np.full(shape, np.nan)
    out[got.row_key, got.col_key] = got.value
    return out


def test_softimpute_takes_the_lambda_of_its_path_and_the_thresholded_svd(spark, monkeypatch):
    """30 lambdas from the largest singular value of the training cells to its hundredth; the one of the least held-out rmse, fitted to all cells."""
    x, cells = noisy(spark)
    train = x.copy()
    for r in holdout.holdout(cells).filter("held").collect():
        train[r.row_key, r.col_key] = np.nan
    z, away = scaled(train), np.isnan(train) & ~np.isnan(x)
    truth = (x - np.nanmean(train, 0)) / np.nanstd(train, 0, ddof=1)
    top = np.linalg.svd(np.where(np.isnan(z), 0, z))[1][0]
    path = np.geomspace(top, top / 100, 30)
    errors = [np.sqrt(((dense_softimpute(z, lam, 3) - truth)[away] ** 2).mean()) for lam in path]
    used, run = [], impute.softimpute
    monkeypatch.setattr(impute, "softimpute", lambda c, r, lam: used.append(lam) or run(c, r, lam, thresh=1e-9))
    ((_, rmse, r2),) = (got := impute.impute(cells, "softimpute", (3,))).curve
    k = int(np.abs(path - used[0]).argmin())
    assert np.isclose(path[k], used[0]) and errors[k] < min(errors) + 5e-4
    by = [(((f - t)[a] ** 2).mean(), (t[a] ** 2).mean()) for f, t, a in zip(dense_softimpute(z, path[k], 3).T, truth.T, away.T) if a.any()]
    assert abs(rmse - np.mean([m**0.5 for m, _ in by])) < 3e-3 and abs(r2 - (1 - sum(m for m, _ in by) / sum(b for _, b in by))) < 6e-3
    done, want = as_matrix(got.cells, x.shape), dense_softimpute(scaled(x), path[k], 3) * np.nanstd(x, 0, ddof=1) + np.nanmean(x, 0)
    assert np.allclose(done[~np.isnan(x)], x[~np.isnan(x)]) and np.abs(done - want)[np.isnan(x)].max() < 1e-2
    used.clear()
    run(cells, 3)  # the completion that softimpute_complete registers: no lambda given
    assert np.allclose(used, path[k])


def test_softimpute_at_one_lambda_equals_its_definition(spark, monkeypatch):
    """On the driver and in tasks; a lambda that cuts off every singular value leaves the means."""
    x, cells = noisy(spark, seed=6)
    empty = np.isnan(x)
    for lam, most in ((3.0, impute.DRIVER_BYTES), (3.0, 0)):
        monkeypatch.setattr(impute, "DRIVER_BYTES", most)
        got = as_matrix(impute.softimpute(cells, 9, lam, thresh=1e-10), x.shape)
        want = dense_softimpute(scaled(x), lam, 9) * np.nanstd(x, 0, ddof=1) + np.nanmean(x, 0)
        assert np.allclose(got[empty], want[empty], atol=1e-3)
    got = as_matrix(impute.softimpute(cells, 3, 1e6), x.shape)
    assert np.allclose(got[empty], np.broadcast_to(np.nanmean(x, 0), x.shape)[empty])


def test_mean_impute_shuffles_its_cells_once_and_emits_item_by_item(spark, data, monkeypatch):
    """One evaluation of the join, whose lines go to their rows: no shuffle by cell or of a row's lists follows. Equal values are neighbours."""
    plans, cut = [], impute.cut
    monkeypatch.setattr(impute, "cut", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, tag))
    got = matrix.mean_impute(spark, data)
    assert len(plans) == 1 and plans[0].count("hashpartitioning(o_custkey") + plans[0].count("hashpartitioning(row_key") == 1
    assert "orders" not in got._jdf.queryExecution().optimizedPlan().toString()
    first = got.limit(5).toPandas()
    assert first.col_key.nunique() == 1 and first.row_key.nunique() == 5


def test_softimpute_settles_on_noise_in_few_passes(spark, monkeypatch):
    """Singular values of noise lie close together; 14 passes when this was written."""
    x = np.random.default_rng(8).standard_normal((200, 60))
    i, j = np.where(np.random.default_rng(9).random(x.shape) < 0.3)
    cells = spark.createDataFrame(pd.DataFrame({"row_key": i, "col_key": j, "value": x[i, j]}))
    calls, run = [], impute._passes
    monkeypatch.setattr(impute, "_passes", lambda *a: calls.append(1) or run(*a))
    impute.softimpute(cells, 3, 9.0)
    assert 2 < len(calls) < 30
