"""The general data problems on hand-made cases: gaps, ties, repeats, empty tables, clashing columns."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.functions.values import PLACEHOLDERS, recorded_day, states_value, url_host
from gridloom.operators import fill, orphans, units, wide

UNITS = "metric_key string, metric_title string, other_names string, common_unit string, min_score double, max_score double"
CATALOG = [
    ("accuracy", "Accuracy", "accuracy|Acc|Top-1 Accuracy", "percent", 0.0, 100.0), ("mcc", "MCC", "MCC|Matthews corr.", "coefficient", -1.0, 1.0), ("judge", "Judge Rating", "judge rating", "points of 10", 0.0, 10.0),
    ("latency", "Latency", "latency|Mean latency", "seconds", 0.0, None), ("cost", "Cost", "cost|Price", "US dollars per million tokens", 0.0, None), ("bpb", "BPB", "BPB", "bits per byte", 0.0, 16.0),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return units.load_catalog(spark.createDataFrame(CATALOG, UNITS))


@pytest.mark.parametrize(
    ("score", "name", "top", "num", "unit", "states"),
    [
        ("75.5", "Accuracy", None, 75.5, None, True), ("75,5", "Acc", None, 75.5, None, True), ("0.755", "accuracy (0-1)", None, 0.755, "fraction", True), ("0.7", "Accuracy", "1.0", 0.7, "fraction", True),
        ("75 %", "macro accuracy", None, 75.0, "pct", True), ("755‰", "Accuracy", None, 755.0, "permille", True), ("30 of 40", "Accuracy", None, 30.0, "ratio", True), ("50/40", "Accuracy", None, 50.0, "ratio", False),
        ("-9.99", "Accuracy", None, -9.99, None, False), ("-0.4", "MCC", None, -0.4, None, True), ("40%", "MCC", None, 40.0, "pct", True), ("-99.0", "MCC", None, None, None, False), ("4.1/5", "Judge Rating", None, 4.1, "of5", True),
        ("8.2/10", "Judge Rating", None, 8.2, "of10", True), ("3.3 (max 5)", "judge rating, strict", None, 3.3, "of5", True), ("67", "Judge rating", None, 67.0, None, True), ("1200 ms", "Mean latency", None, 1200.0, "ms", True),
        ("2 min", "latency", None, 2.0, "min", True), ("$0.02", "cost per 1k tokens", None, 0.02, "usd_1k", True), ("$3", "Price", None, 3.0, "usd", True), ("80 ct", "Price", None, 80.0, "cents", True), ("73.1 ± 0.4", "Acc", None, 73.1, None, True),
        ("73.1 (±0.4)", "Acc", None, 73.1, None, True), ("~73.1", "Acc", None, 73.1, None, True), ("７３．１", "Ａｃｃ", None, 73.1, None, True), ("73.1†", "Acc", None, 73.1, None, True), ("0.7 nats", "BPB", None, 0.7, "nats", True),
        ("see Table 4", "Acc", None, None, None, False), ("err: 504", "Acc", None, None, None, False), ("9999", "latency", None, None, None, False), (None, None, None, None, None, False), ("", "", "", None, None, False), ("5", "no such metric", None, 5.0, None, True),
        ("x" * 100_000, "Acc", None, None, None, False),
    ],
)
def test_scores_are_read_with_their_unit(score, name, top, num, unit, states, catalog):
    key, x, u, _, ok = units.ScoreReader(catalog)(score, name, None, top)
    assert (x, u, ok) == (num, unit, states)


def test_unlabelled_units_follow_the_mixture(spark, catalog):
    told = [(f"{30 + i % 60} %", "Accuracy") for i in range(300)]
    free = [(f"{30 + i % 60}.5", "Accuracy") for i in range(200)] + [(f"0.{30 + i % 60}", "Accuracy") for i in range(40)]
    df = spark.createDataFrame([(i, s, m, "own") for i, (s, m) in enumerate(told + free)], "row_id long, score string, metric_name string, unit string")
    got = units.to_common_units(df, catalog).collect()
    assert {r.score for r in got if r.other_unit} == {s for s, _ in free[200:]}
    assert all(20 < r.score_common < 100 for r in got)
    assert {r.unit_source for r in got} == {"told", "fitted"}


def test_units_of_an_empty_table(spark, catalog):
    df = spark.createDataFrame([], "row_id long, score string, metric_name string")
    assert units.to_common_units(df, catalog).count() == 0
    assert units.load_catalog(spark.createDataFrame([], UNITS)) == []


def test_placeholders_state_nothing(spark):
    rows = [(p,) for p in PLACEHOLDERS] + [("N/A",), ("—",), ("?",), ("<missing>",), (" \t\n",), ("-1",), ("999",), ("see Table 3",), (None,), ("Ｎ／Ａ",)]
    assert spark.createDataFrame(rows, "v string").filter(states_value(F.col("v"))).count() == 0
    good = [("a model",), ("5-shot",), ("o1",), ("日本",), ("-" * 40 + "a",), ("no tools",)]
    assert spark.createDataFrame(good, "v string").filter(states_value(F.col("v"))).count() == len(good)


def test_dates_and_hosts(spark):
    d = datetime.date(2024, 5, 3)
    rows = [("2024-05-03", d), ("2024/05/03", d), ("20240503", d), ("2024-05-03T23:59:00Z", d), ("May 3, 2024", d), ("3 May 2024", d), ("13 Foo 2024", None), ("2024-13-45", None), ("", None), (None, None)]
    got = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string").select("i", recorded_day(F.col("s")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [w for _, w in rows]
    urls = [("HTTPS://WWW.A.test:8443/x?y", "www.a.test"), ("http://u:p@b.test", "b.test"), ("c.test/x", "c.test"), ("", None), (None, None)]
    got = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(urls)], "i int, s string").select("i", url_host(F.col("s")).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [w for _, w in urls]


# -- wide -----------------------------------------------------------------------------------------------------------------------


def test_grid_round_trip_with_many_attributes(spark):
    rows = [(f"e{i % 7}", f"a{i % 45:03d}", str(i), i) for i in range(300)] + [("e0", "a000", "no number", 999), ("e8", "a001", "5", 1), ("e8", "a001", "6", 2)]
    df = spark.createDataFrame(rows, "e string, a string, v string, o int").withColumn("position", F.lit("clash")).withColumn("block", F.lit("clash"))
    positions = wide.attribute_positions(df, "a")
    grid = wide.attribute_grid(df, "e", "a", "v", "o", positions)
    assert {len(r.cells) for r in grid.collect()} == {wide.BLOCK}
    want = {}
    for e, a, v, o in rows:
        if o >= want.get((e, a), (-1,))[0]:
            want[(e, a)] = (o, v)
    got = {(r.e, r.a): r.value for r in wide.unpivot_grid(grid, "e", "a", positions).collect()}
    assert got == {k: float(v) for k, (_, v) in want.items() if v != "no number"}
    place = {r.a: r.position for r in positions.collect()}
    table = {r.e: r for r in wide.wide_table(grid, "e", [(f"c_{a}", p, "double" if a != "a003" else "int") for a, p in place.items()]).collect()}
    assert len(table) == 8
    assert table["e8"]["c_a001"] == 6.0 and table["e8"]["c_a044"] is None and table["e0"]["c_a000"] is None
    assert isinstance(next(t["c_a003"] for t in table.values() if t["c_a003"] is not None), int)


def test_grid_of_an_empty_table(spark):
    df = spark.createDataFrame([], "e string, a string, v string, o int")
    positions = wide.attribute_positions(df, "a")
    grid = wide.attribute_grid(df, "e", "a", "v", "o", positions)
    assert wide.unpivot_grid(grid, "e", "a", positions).count() == 0
    assert wide.wide_table(grid, "e", [("x", 0, "double")]).columns == ["e", "x"]


# -- fill -----------------------------------------------------------------------------------------------------------------------


def test_fill_levels_marks_and_fallbacks(spark):
    rows = [(1, "m", "b", 1.0), (2, "m", "b", 3.0), (3, "m", "b", 5.0), (4, "m", "b", None), (5, "m", "c", None), (6, "n", "c", None), (7, None, None, None)]
    df = spark.createDataFrame(rows, "id long, m string, b string, v double").withColumn("__x", F.lit(1))
    got = fill.fill_levels(df, "id", "v", [("mb", ["m", "b"]), ("m", ["m"]), ("all", [])], "median")
    assert {(r.id, r.value, r.level) for r in got.collect()} == {(4, 3.0, "mb"), (5, 3.0, "m"), (6, 3.0, "all"), (7, 3.0, "all")}
    full = fill.with_fills(df, "id", {"v": got})
    assert full.count() == 7 and full.filter("v is null").count() == 0 and full.filter("v_filled is null").count() == 3


def test_fill_modes_break_ties_by_value_and_can_fail(spark):
    df = spark.createDataFrame([(1, "g", "b"), (2, "g", "a"), (3, "g", None), (4, "h", None)], "id long, g string, v string")
    assert {(r.id, r.value, r.level) for r in fill.fill_levels(df, "id", "v", [("g", ["g"])], "mode").collect()} == {(3, "a", "g"), (4, None, "none")}
    none = df.withColumn("v", F.lit(None).cast("string"))
    assert {r.level for r in fill.fill_levels(none, "id", "v", [("g", ["g"]), ("all", [])], "mode").collect()} == {"none"}
    assert fill.fill_levels(df.limit(0), "id", "v", [("g", ["g"]), ("all", [])], "mode").count() == 0


def test_prototypes_find_planted_clusters(spark):
    rows = [(i, (0.0 if i % 2 else 8.0) + i % 5 / 10, None if i % 11 == 0 else ("x" if i % 2 else "y")) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, c string")
    protos = fill.k_prototypes(df, ["a"], ["c"], clusters=2)
    got = {r.id: r.cluster for r in fill.assign_clusters(df, protos, ["a"], ["c"]).collect()}
    assert len({got[i] for i in range(0, 200, 2)}) == 1 and len({got[i] for i in range(1, 200, 2)}) == 1 and got[0] != got[1]
    empty = fill.k_prototypes(df.limit(0), ["a"], ["c"])
    assert fill.assign_clusters(df, empty, ["a"], ["c"]).select("cluster").distinct().count() == 1


# -- orphans --------------------------------------------------------------------------------------------------------------------

LOG = [("k", "added", 10, 1), ("k", "added", 10, 2), ("k", "removed", 30, 4), ("k", "added", 50, 3), ("j", "removed", 5, 5), ("j", "added", 20, 6), ("j", "added", 25, 7)]


def test_orphans_by_validity_runs(spark):
    log = spark.createDataFrame(LOG, "key string, action string, t long, id long")
    runs = orphans.validity_runs(log, ["key"], "t", F.col("action") == "added", "id")
    assert {(r.key, r.run_start, r.run_end) for r in runs.collect()} == {("k", 10, 30), ("k", 50, None), ("j", 20, None)}
    refs = [(i, k, t, "clash") for i, (k, t) in enumerate([("k", 9), ("k", 10), ("k", 29), ("k", 30), ("k", 49), ("k", 50), ("k", 9_000), ("j", 19), ("j", 20), ("z", 20)])]
    df = spark.createDataFrame(refs, "row long, key string, at long, _runs string")
    for width in (1, 7, 1_000_000):
        assert {r.row for r in orphans.orphan_references(df, runs, ["key"], "at", width).collect()} == {0, 3, 4, 7, 9}
    assert orphans.orphan_references(df, runs, ["key"], "at", 10).columns == df.columns
    assert orphans.orphan_references(df, runs.limit(0), ["key"], "at", 10).count() == 10
    assert orphans.orphan_references(df.limit(0), runs, ["key"], "at", 10).count() == 0


def test_integer_runs_and_their_orphans(spark):
    keys = spark.createDataFrame([(k,) for k in [1, 2, 3, 3, 7, 8, 20, None, -4, -5]], "k long")
    for block in (4, 1 << 20):
        runs = orphans.integer_runs(keys, "k", block)
        refs = spark.createDataFrame([(k,) for k in [None, 0, 1, 3, 4, 7, 9, 20, 21, -5, -6]], "r long")
        assert {r.r for r in orphans.orphans_of_integers(refs, "r", runs, 8).collect()} == {0, 4, 9, 21, -6}


def test_cuts_are_written_to_the_shared_folder_and_cleaned(spark):
    from gridloom.runtime import clean, cut, shared_dir

    df = cut(spark.range(5), "test")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]
    clean(spark)
    assert cut(spark.range(3), "test").count() == 3


def test_observed_fills_are_in_the_common_unit(spark, data):
    from gridloom.plans import problems

    want = {r.row_id: r.score_common for r in problems.p6_converted(spark, data).filter("score_common is not null").collect()}
    got = {r.row_id: r.score_common for r in problems.p2_filled(spark, data).filter("score_common_filled is null").collect()}
    assert got == want
