"""Queries over small tables of their own: no row, column or dimension is left out."""

import numpy as np
import pytest

from gridloom.plans import catalog


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    d, x = str(tmp_path_factory.mktemp("vectors")), np.random.default_rng(3).normal(size=(60, 6)).astype("float32").astype(float)
    rows = [(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    return d, x


def test_theta_hat_takes_all_rows_and_dimensions(spark, vectors):
    d, x = vectors
    v = x.reshape(6, 10, 6).mean(1)
    got = {(int(r.a), int(r.b)): r.theta for r in catalog.QUERIES["theta_hat"](spark, d).collect()}
    assert len(got) == 36
    assert all(abs(got[(a, b)] - (v @ v.T)[a, b]) < 1e-5 for a, b in got)


def test_loadings_queries_take_all_dimensions(spark, vectors):
    d, x = vectors
    rows = lambda name: catalog.QUERIES[name](spark, d).collect()
    ss = {r.factor: r.ss for r in rows("ss_loadings")}
    assert set(ss) == set(range(1, 7)) and all(abs(ss[f + 1] - (x[:, f] ** 2).sum()) < 1e-4 for f in range(6))
    assert abs(max(r.cumulative for r in rows("variance_explained")) - (x**2).sum() / 60) < 1e-4
    assert len(rows("loadings_report")) == 60 * 6
    assert {(r.method, r.factor) for r in rows("ssq_factor_order")} == {(m, f) for m in range(3) for f in range(1, 7)}
    for name in ("loading_congruence", "congruence_report"):
        got = rows(name)
        assert got and {r.nf for r in got} == {6}


def test_pivot_and_back_keep_every_event_type(spark, tmp_path):
    rows = [(1, "click", 1.0), (1, "click", 3.0), (1, "error", 4.0), (2, "signup", 5.0), (3, "view", 6.0), (3, "purchase", 7.0), (4, "new kind", 8.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    wide = catalog.QUERIES["pivot_matrix"](spark, str(tmp_path))
    assert set(wide.columns) == {"row_key", *(r[1] for r in rows)} and wide.count() == 4
    got = {(r.row_key, r.col_key): r.value for r in catalog.QUERIES["unpivot_matrix"](spark, str(tmp_path)).collect()}
    assert got == {(1, "click"): 2.0, (1, "error"): 4.0, (2, "signup"): 5.0, (3, "view"): 6.0, (3, "purchase"): 7.0, (4, "new kind"): 8.0}


def test_keep_latest_reads_every_spelling_of_a_date(spark, tmp_path):
    days = [("2023-01-01", "2024/05/30"), ("2023-01-01", "20240530"), ("2023-01-01", "2024-05-30T10:00:00Z"), ("2023-01-01", "May 3, 2024"), ("2023-01-01", "3 May 2024"), (None, "2023-01-01"), ("no date", "2023-01-01")]
    rows = [(10 * i + (1 - j), f"m{i}", day) for i, pair in enumerate(days) for j, day in enumerate(pair)]  # the newer row has the smaller id
    df = spark.createDataFrame(rows, "row_id long, model_name string, date_recorded string").selectExpr("*", "'b' as benchmark_id", "'acc' as metric_name", "'u' as source_url")
    df.write.parquet(f"{tmp_path}/results.parquet")
    assert {r.row_id for r in catalog.QUERIES["keep_latest"](spark, str(tmp_path)).collect()} == {10 * i for i in range(len(days))}


def test_names_of_all_scripts_are_cleaned(spark, tmp_path):
    names = {
        "Karotu 2024-05-03": ("Karotu", "Karotu 2024-05-03"), "Ka\u2013rotu\u00a02024-05-03": ("Ka\u2013rotu", "Ka\u2013rotu\u00a02024-05-03"), "\uff2b\uff21 (8B)": ("\uff2b\uff21 (8B)", "\uff2b\uff21 8B"), "tab\t20240503": ("tab", "tab\t20240503"),
        "\u65e5\u672c (notes) x": ("\u65e5\u672c (notes) x", "\u65e5\u672c  x"), "": ("", ""), None: (None, None), "x" * 50_000 + " 2024": ("x" * 50_000, "x" * 50_000 + " 2024"),
    }
    rows = [(i, n) for i, n in enumerate([*names, *names])]
    spark.createDataFrame(rows, "row_id long, model_name string").write.parquet(f"{tmp_path}/results.parquet")
    tidy = lambda v: v if v is None else v.strip()
    for name, column, i in (("strip_dates", "stripped", 0), ("clean_parens", "cleaned", 1)):
        got = {r.model_name: tidy(r[column]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {n: tidy(v[i]) for n, v in names.items()}
