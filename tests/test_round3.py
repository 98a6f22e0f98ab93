"""Cases of the second round's findings: each failed before its change."""

import subprocess
import sys
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from test_operators import cells_of, loop_symmetric

from gridloom.operators import densify, impute, osmc, wide
from gridloom.plans import catalog


def test_far_apart_attributes_cost_no_blocks_between_them(spark):
    far = (2**31 - 2) * wide.BLOCK
    positions = spark.createDataFrame([("a", 0), ("b", far)], "a string, position bigint")
    rows = spark.createDataFrame([("e", "a", "1", 1), ("e", "b", "2", 2), ("f", "b", "x", 3), ("g", "b", "4", 4)], "e string, a string, v string, o int")
    grid = wide.attribute_grid(rows, "e", "a", "v", "o", positions)
    assert {tuple(r) for r in wide.unpivot_grid(grid, "e", "a", positions).collect()} == {("e", "a", 1.0), ("e", "b", 2.0), ("g", "b", 4.0)}
    table = wide.wide_table(grid, "e", [("ca", 0, "double"), ("cb", far, "double"), ("none", None, "int")])
    assert {tuple(r) for r in table.collect()} == {("e", 1.0, 2.0, None), ("f", None, None, None), ("g", None, 4.0, None)}


def test_symmetric_peel_takes_a_million_cells_in_little_memory():
    """The kernel holds some 20 bytes an edge: sets and heaps of text keys took hundreds."""
    code = (
        "import resource, numpy as np\nfrom gridloom.operators import densify\n"
        "at = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3\n"
        "rng, before = np.random.default_rng(1), at()\np = rng.integers(0, 2_000, 1_000_000) << 32 | rng.integers(0, 40_000, 1_000_000)\n"
        "i, j = densify._peel_pairs(p, 0.5)\nassert len(i) and at() - before < 120, at() - before\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


@pytest.mark.parametrize("target", (1e-9, 0.9))
def test_symmetric_peel_works_in_the_room_of_its_pairs(target):
    """Beside the 8 bytes of an edge little may grow with the edges, whether all are kept or nearly all leave: it was 20 to 23 bytes an edge."""
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 1_000, 2_000_000) << 32 | rng.integers(0, 4_000, 2_000_000)
    room = pairs.copy()
    tracemalloc.start()
    rows, cols = densify._peel_pairs(room, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(pairs), peak / len(pairs)
    if target < 0.1:
        assert (np.sort(cols.astype(np.int64) << 32 | rows) == np.unique(pairs)).all()


def test_symmetric_peel_packs_all_counted_pairs_or_fails():
    pairs = pd.DataFrame({"i": np.arange(50, dtype=np.int32), "j": np.arange(50, dtype=np.int32) % 7})
    assert (densify._packed(iter([pairs[:20], pairs[20:]]), 50) == (pairs.j.astype("int64") * 2**32 + pairs.i)).all()
    for n in (49, 51):
        with pytest.raises(ValueError, match="counted"):
            densify._packed(iter([pairs]), n)


@pytest.mark.parametrize("target", (0.2, 0.5, 0.8))
def test_symmetric_peel_equals_its_loop_over_many_steps(target, monkeypatch):
    monkeypatch.setattr(densify, "STEP", 7)  # runs of equal pairs and of one row cross the borders of steps
    rng = np.random.default_rng(6)
    mask = rng.random((40, 25)) < rng.random(25) * 0.5
    rows, cols = (np.array(sorted(map(str, range(n)))) for n in mask.shape)
    r, c = np.where(mask[np.ix_(rows.astype(int), cols.astype(int))])
    i, j = densify._peel_pairs(np.tile(c << 32 | r, 3), target)
    assert len(i) == len({*zip(i.tolist(), j.tolist())})
    assert {*zip(rows[i], cols[j])} == loop_symmetric(mask, target)


def test_symmetric_peel_equals_its_loop_and_summary_counts_it(spark):
    rng = np.random.default_rng(5)
    mask = rng.random((40, 25)) < rng.random(25) * 0.5
    cells = cells_of(spark, np.where(mask, 1.0, np.nan))
    kept = densify.symmetric_peel(cells.unionByName(cells), 0.5)  # a cell given twice is one edge
    assert {(r.row_key, r.col_key) for r in kept.collect()} == loop_symmetric(mask, 0.5)
    assert densify.symmetric_peel(cells.filter("value is null"), 0.5).count() == 0


def long_cells(spark, items):
    """Two rows over many items: the first observes all of them, the second the first one only."""
    return spark.range(items).selectExpr("1L as row_key", "cast(id as int) as col_key", "cast(id % 7 as double) as value").unionByName(spark.createDataFrame([(2, 0, 4.0), (3, 1, None)], "row_key long, col_key int, value double"))


def test_mean_impute_takes_any_number_of_items(spark):
    got = impute.mean_impute(long_cells(spark, 5_200)).toPandas()
    assert len(got) == 3 * 5_200 and got.value.notna().all()
    at = got.set_index(["row_key", "col_key"]).value
    assert at[1, 0] == 0.0 and at[2, 0] == 4.0 and at[3, 0] == 2.0 and at[3, 5_199] == 5_199 % 7


def test_softimpute_takes_any_number_of_items(spark):
    rng = np.random.default_rng(2)
    full = np.outer(rng.standard_normal(12), rng.standard_normal(5_200))
    seen = rng.random(full.shape) < 0.6
    i, j = np.where(seen)
    cells = spark.createDataFrame(pd.DataFrame({"row_key": i, "col_key": j, "value": full[seen]}))
    got = impute.softimpute(cells, 1, 1e-3, passes=3).toPandas()
    assert len(got) == 12 * len(set(j)) and not got.duplicated(["row_key", "col_key"]).any()
    kept = got.set_index(["row_key", "col_key"]).value
    assert all(kept[a, b] == full[a, b] for a, b in zip(i[::500], j[::500]))


def test_leading_singular_values_equal_those_of_the_whole_matrix(spark):
    x = np.random.default_rng(3).standard_normal((60, 40)) * (1 + np.arange(40))
    packed = spark.createDataFrame([(i, list(range(40)), r.tolist()) for i, r in enumerate(x)], "row_key long, idx array<int>, val array<double>")
    top, q = impute._spectrum(packed, 40, 3)
    _, s, w = np.linalg.svd(x)
    assert np.allclose(top, s[:3], rtol=1e-5) and np.allclose(np.abs((q.T * w[:3]).sum(1)), 1, atol=1e-3)


def test_knn_compares_pairs_in_tasks_and_equals_a_loop(spark):
    """No join makes a row for each pair of cells; fills equal a loop over rows, with ties by key."""
    rng = np.random.default_rng(7)
    x = np.where(rng.random((70, 9)) < 0.6 * rng.random(9) + 0.1, rng.integers(0, 4, (70, 9)).astype(float), np.nan)
    cells = cells_of(spark, x)
    completed = impute.knn_impute(cells, 3)
    assert "Join" not in completed._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.row_key, r.col_key): r.value for r in completed.collect()}
    wide = np.nanmax(x, 0) - np.nanmin(x, 0)
    z = np.where(wide > 0, x / np.where(wide > 0, wide, 1), np.where(np.isnan(x), np.nan, 0))
    rows = [i for i in range(len(x)) if not np.isnan(x[i]).all()]
    for i in rows:
        near = sorted((round(float(np.nanmean(np.abs(z[i] - z[o]))), 9), o) for o in rows if o != i and not np.isnan(z[i] - z[o]).all())
        for j in range(x.shape[1]):
            donors = [x[o, j] for _, o in near if not np.isnan(x[o, j])][:3]
            want = x[i, j] if not np.isnan(x[i, j]) else np.mean(donors) if donors else np.nanmean(x[:, j])
            assert abs(got.pop((i, j)) - want) < 1e-9
    assert not got


def test_propensity_takes_more_than_two_million_cells(spark, tmp_path, monkeypatch):
    days = "timestamp_seconds(1704067200 + cast(id % 30 as int) * 86400) as ts"
    spark.range(2_010_000).selectExpr("id div 30 as user_id", days, "1.0D as value").filter("user_id <> 5 or day(ts) <> 3").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(osmc, "propensity", lambda mask: mask)
    got = catalog.QUERIES["propensity"](spark, str(tmp_path))
    assert got.dtypes == [("row_key", "bigint"), ("col_key", "int"), ("p", "double")] and got.count() == 2_010_000
    assert [(r.row_key, r.col_key) for r in got.filter("p = 0").collect()] == [(5, 3)]
