"""Operators against loops, published identities and hand-made cases."""

import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli, schema
from gridloom.functions import text
from gridloom.operators import aliases, classify, collapse, dedup, densify, factor, holdout, impute, osmc, rules
from gridloom.plans import report
from gridloom.sources import readers, synth, writers


def frame(spark, rows, names):
    return spark.createDataFrame(rows, names)


# -- names and scores -------------------------------------------------------------------------------------------------------------

IDS = [("GPT 4_Turbo+", "gpt-4-turbo-plus"), ("--a--b", "a-b"), ("  X y ", "x-y"), ("", "")]


def test_text_normalisers(spark):
    df = frame(spark, IDS, "a string, b string")
    assert all(r.g == r.b for r in df.select("b", text.standard_id(F.col("a")).alias("g")).collect())
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("g")).first().g
    assert one(text.without_org, "org/model/x") == "model/x"
    assert one(text.parens_to_size, "m (instruct 70B beta) (none)") == "m 70B "
    assert one(text.version_dots, "x-3-5-sonnet") == "x-3.5-sonnet"
    assert one(text.without_dates, "m-2024-05-13---&---junk") == "m-"
    assert one(text.without_marks, "★ m ①") == "m"
    numbers = [("1.5d", None), (" 12 ", 12.0), ("nan", None), ("1e3", 1000.0), ("75%", None), ("", None), ("inf", None), ("1_000", None), (None, None)]
    got = frame(spark, numbers, "a string, b double").select("b", text.number(F.col("a")).alias("g")).collect()
    assert all(r.g == r.b for r in got)


# Inputs (id, family, size) and the key that the rules give them.
KEYS = [
    ("Org/Model 3-5 Sonnet 70B-instruct 2024-05-13", "Model 3", "70", "model-3.5-sonnet-70B"),
    ("model-3.1-8b-chat", "Model 3", None, "model-3.1-8B"),
    ("model-7", "Model", "7", "model-7B"),
    ("model-4.2-4.2-pro-32k", "Model", "", "model-4.2.4.2-pro"),
    ("x-1.5b", None, "1.5", "1.5B"),
    ("x-2m-12-13b", "", "13", "13B"),
    ("llama-2-13b (8B)", "123", "13", "llama-2-8B"),
    ("", "", "", "unknown"),
    (None, None, None, "unknown"),
    ("---", None, None, "---"),
    ("a13-3", "A13", None, "a13-3"),
    ("abc---&---junk-9", "Abc", "3", "abc-3B"),
    ("mid", "-mid", "x", "-mid-mid"),
    ("gpt-4-high reasoning-v2", "GPT-4", None, "gpt-4"),
    ("Marozadape-4-72B-Chat", "Marozadape 4", "72", "marozadape-4-72B"),
    ("Vozifeziku 2 7B", "Vozifeziku", "7", "vozifeziku-2-7B"),
    ("sufozowobe-70b-pro", None, "70", "sufozowobe-pro-70B"),
    ("Gunabatihu+-0.6B-Pro", "Gunabatihu+", "0.6", "gunabatihu-pro-0.6B"),
    ("Dicokonuve Vision (27B)", "Dicokonuve", None, "dicokonuve-vision-27B"),
]


def test_fine_key_by_table(spark):
    got = text.with_fine_key(frame(spark, [k[:3] for k in KEYS], "m string, f string, s string"), "m", "f", "s").collect()
    assert [(r.m, r.f, r.s, r.collapse_key) for r in got] == KEYS


def test_classifier_covers_its_branches(spark):
    rows = [("a", "a", "F", "Meta AI", "closed", ""), ("a", "a", "F", "ai", "open", ""), ("a", "a", "", "nobody here", "", "b"), ("a", "a", "", "OpenAI", "", ""), ("my-llama", "a", "", "nobody here", "", ""), ("zz", "zz-chat", "F", "", "", ""), ("zz", "zz", "F", "", "", ""), ("zz", "zz-sft", "", "", "", ""), ("zz", "zz", None, None, None, None)]
    df = frame(spark, rows, "i string, n string, f string, d string, t string, b string")
    got = [r.c.reason.split(" (")[0].split(":")[0] for r in df.select(classify.categorize(*[F.col(c) for c in "infdtb"]).alias("c")).collect()]
    assert got == ["Closed model from trusted dev", "Trusted dev", "Has base_model", "Open model from trusted dev", "Known from-scratch pattern", "Fine-tuned but family known", "From-scratch with family", "Fine-tuned name, no family/base_model/trusted dev", "No family/base_model, unclear origin"]


# -- duplicates and rules ---------------------------------------------------------------------------------------------------------


def test_resolution_ranks_conflicts_only(spark):
    rows = [(1, "k", "5", 3, 2025), (2, "k", "6", 1, 2023), (3, "k", "7", 1, 2024), (4, "r", "5", 3, 2020), (5, "r", "5", 1, 2024), (6, None, "1", 4, 0), (7, None, "1.0", 4, 0), (8, "e", None, 1, 1), (9, "e", "", 1, 1)]
    df = frame(spark, rows, "o long, k string, s string, t int, y int")
    done = dedup.resolve(df, ["k"], "s", "o", F.col("t"), F.col("y"))
    assert {r.o for r in done.filter("kept").collect()} == {3, 4, 6, 8}
    assert done.count() == len(rows)
    kinds = {r.k: r.kind for r in dedup.classify(df, ["k"], "s").collect()}
    assert kinds == {"k": "conflict", "r": "redundant", None: "conflict", "e": "conflict"}


def test_rules_run_in_sequence_and_aliases_at_once(spark):
    dim = frame(spark, [("A", "A"), ("B", "B"), ("S", "S")], "model_id string, model_name string")
    facts = frame(spark, [(1, "A", "A", ""), (2, "B", None, "x"), (3, "S", "S", ""), (4, "S", "S", "own"), (5, None, None, "")], "row_id long, model_name string, model_id string, setup string")
    names = lambda df: {r.row_id: r.model_name for r in df.collect()}
    assert names(rules.rename(dim, facts, {"A": "B", "B": "C", "Z": "A"})[1]) == {1: "C", 2: "C", 3: "S", 4: "S", 5: None}
    assert names(rules.lookup(facts, rules.mapping_frame(dim, {"A": "B", "B": "C"}), ["model_name"])) == {1: "B", 2: "C", 3: "S", 4: "S", 5: None}
    d2, f2 = rules.remap(dim, facts, {"A": "gone"})
    assert names(f2)[1] == "gone" and {r.model_id for r in d2.collect()} == {"B", "S"}
    d3, f3 = rules.setup_extract(dim, facts, {"S": ("A", "cot")})
    assert {(r.row_id, r.model_name, r.setup) for r in f3.collect()} >= {(3, "A", "cot"), (4, "A", "own")}
    assert rules.remove(dim, "model_id", facts, "model_name", ["A", "none"])[1].count() == 4


def test_merge_ports_blank_fields_and_skips_missing_targets(spark):
    dim = frame(spark, [("a", "", "x"), ("b", "from b", "y"), ("c", "from c", None), ("d", None, None)], "benchmark_id string, p string, q string")
    facts = frame(spark, [(1, "a"), (2, "b"), (3, "c"), (4, "d")], "row_id long, benchmark_id string")
    d, f = rules.merge_items(dim, facts, {"b": "a", "c": "a", "a": "c", "d": "nowhere"})
    assert {(r.benchmark_id, r.p, r.q) for r in d.collect()} == {("a", "from b", "x"), ("d", None, None)}
    assert {(r.row_id, r.benchmark_id) for r in f.collect()} == {(1, "a"), (2, "a"), (3, "a"), (4, "d")}


def test_alias_candidates_equal_difflib(spark):
    import difflib

    ids = ["alpha-7b", "Alpha-7B", "alpha-70b", "beta-chat", "gamma"]
    got = aliases.candidates(frame(spark, [("ALPHA-7B",), ("alpha-7",), ("zzz",), (None,)], "name string"), frame(spark, [(i,) for i in ids], "i string"), "i")
    assert [(r.rank, r.candidate) for r in got.filter("name = 'ALPHA-7B'").orderBy("rank").collect()][:2] == [(1, "Alpha-7B"), (2, "alpha-7b")]
    assert [r.candidate for r in got.filter("name = 'alpha-7'").orderBy("rank").collect()] == difflib.get_close_matches("alpha-7", sorted(ids), n=3, cutoff=0.8)
    assert got.filter("name = 'zzz'").count() == 0


# -- matrices ---------------------------------------------------------------------------------------------------------------------


def cells_of(spark, x):
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.where(~np.isnan(x)))]
    return spark.createDataFrame(rows, "row_key long, col_key long, value double")


def loop_peel(mask, target):
    rows, cols = list(range(len(mask))), list(range(mask.shape[1]))
    while rows and cols:
        sub = mask[np.ix_(rows, cols)]
        if sub.sum() >= target * sub.size - 1e-12:
            break
        cols.pop(int(sub.sum(0).argmin()))
        rows = [r for r in rows if mask[r, cols].any()]
    return {(r, c) for r in rows for c in cols if mask[r, c]}


def loop_symmetric(mask, target):
    rows, cols = [r for r in range(len(mask)) if mask[r].any()], [c for c in range(mask.shape[1]) if mask[:, c].any()]
    name = lambda keys, vals: min(zip(vals, map(str, keys)))
    while rows and cols:
        sub = mask[np.ix_(rows, cols)]
        if sub.sum() >= target * sub.size:
            break
        (nc, c), (nr, r) = name(cols, sub.sum(0)), name(rows, sub.sum(1))
        if nc * len(cols) <= nr * len(rows):
            cols.remove(int(c))
        else:
            rows.remove(int(r))
        rows = [r for r in rows if mask[r, cols].any()]
        cols = [c for c in cols if mask[rows, c].any()]
    return {(str(r), str(c)) for r in rows for c in cols if mask[r, c]}


@pytest.mark.parametrize("seed", range(3))
def test_peels_and_core_equal_their_loops(seed, spark):
    rng = np.random.default_rng(seed)
    mask = rng.random((25, 12)) < rng.random(12) * 0.6
    cells = cells_of(spark, np.where(mask, 1.0, np.nan))
    for target in (0.3, 0.6, 1.0):
        assert {(r.row_key, r.col_key) for r in densify.peel(cells, target).collect()} == loop_peel(mask, target)
    assert {(r.row_key, r.col_key) for r in densify.peel(cells, 0.5, "row_key").collect()} == {(c, r) for r, c in loop_peel(mask.T, 0.5)}
    assert {(r.row_key, r.col_key) for r in densify.symmetric_peel(cells, 0.6).collect()} == loop_symmetric(mask, 0.6)
    core = mask.copy()
    while True:
        nxt = core & (core.sum(1) >= 2)[:, None] & (core.sum(0) >= 2)[None, :]
        if (nxt == core).all():
            break
        core = nxt
    assert {(r.row_key, r.col_key) for r in densify.core(cells).collect()} == set(zip(*map(list, np.where(core))))


def test_two_level_means(spark):
    df = frame(spark, [("a1", "x", 1.0), ("a1", "x", 3.0), ("a2", "x", 10.0), ("b", None, 1.0), (None, "x", 1.0)], "e string, i string, value double")
    got = collapse.collapsed_cells(collapse.pair_means(df, "e", "i"), F.substring("e", 1, 1), "i").collect()
    assert [(r.row_key, r.col_key, r.value) for r in got] == [("a", "x", 6.0)]


def test_holdout_keeps_enough(spark):
    cells = synth.not_at_random(spark, 60, 8, density=0.3)
    got = holdout.holdout(cells).groupBy("col_key").agg(F.count_if("held").alias("h"), F.count("*").alias("n")).collect()
    assert all(r.h == max(0, min(math.floor(r.n * 0.2), r.n - 2)) for r in got)


def planted(spark, rows=120, cols=10, share=0.5, seed=3):
    rng = np.random.default_rng(seed)
    full = rng.standard_normal((rows, 2)) @ rng.standard_normal((2, cols)) * 5 + 50
    return full, np.where(rng.random(full.shape) < share, full, np.nan)


@pytest.mark.parametrize(("run", "least"), [(lambda c: impute.softimpute(c, 2), 0.85), (lambda c: impute.chained_equations(c, 3), 0.5), (lambda c: impute.knn_impute(c, 5), 0.3), (lambda c: impute.forest_impute(c, 20, 3), 0.3), (impute.mean_impute, -0.1)])
def test_imputers_recover_planted_structure(run, least, spark):
    full, x = planted(spark)
    got = {(r.row_key, r.col_key): r.value for r in run(cells_of(spark, x)).collect()}
    miss = np.isnan(x)
    pred = np.array([[got.get((i, j), np.nan) for j in range(x.shape[1])] for i in range(len(x))])
    known = ~np.isnan(x)
    assert np.allclose(pred[known], x[known])
    e, b = (pred - full)[miss], (np.nanmean(x, 0) - full)[miss]
    assert 1 - (e**2).sum() / (b**2).sum() > least


def test_predicting_the_training_mean_scores_zero(spark):
    cells = synth.not_at_random(spark, 80, 6, density=0.5)
    marked = holdout.holdout(cells).cache()
    train, held = marked.filter("not held"), marked.filter("held")
    guess = held.join(train.groupBy("col_key").agg(F.avg("value").alias("m")), "col_key").select("row_key", "col_key", F.col("m").alias("value"))
    for balanced in (True, False):
        assert abs(holdout.score(held, guess, train, balanced).first().r2) < 1e-9


def test_one_sided_gradient_and_recovery(spark):
    rng = np.random.default_rng(1)
    true = np.linalg.qr(rng.standard_normal((20, 2)))[0]
    x = rng.standard_normal((1500, 2)) @ true.T * math.sqrt(20 / 2)
    keep = np.argsort(rng.random(x.shape), 1)[:, :3]
    seen = np.full(x.shape, np.nan)
    np.put_along_axis(seen, keep, np.take_along_axis(x, keep, 1), 1)
    cells = cells_of(spark, seen)
    t = osmc.pair_table(cells)
    v = rng.standard_normal((20, 2)) * 0.3
    loss, grad = osmc.loss_and_gradient(v, t)
    direct_off = [((v[a] @ v[b] - r[a] * r[b]) ** 2) for r in seen for a in np.flatnonzero(~np.isnan(r)) for b in np.flatnonzero(~np.isnan(r)) if a != b]
    direct_dia = [((v[a] @ v[a] - r[a] ** 2) ** 2) for r in seen for a in np.flatnonzero(~np.isnan(r))]
    assert abs(loss - np.mean(direct_off) - np.mean(direct_dia)) < 1e-8
    for i, j in ((0, 0), (7, 1)):
        up, down = v.copy(), v.copy()
        up[i, j] += 1e-6
        down[i, j] -= 1e-6
        assert abs((osmc.loss_and_gradient(up, t)[0] - osmc.loss_and_gradient(down, t)[0]) / 2e-6 - grad[i, j]) < 1e-4
    est = osmc.singular_vectors(osmc.fit(t, 2, 1500), 2)
    zero = np.nan_to_num(seen)
    direct = np.linalg.eigh(zero.T @ zero)[1][:, ::-1][:, :2]
    assert osmc.rowspace_error(est, true) < min(1.0, osmc.rowspace_error(direct, true) + 1e-9)
    assert osmc.rowspace_error(true, true) < 1e-12 and osmc.mean_principal_angle(true, true @ np.array([[0, 1], [-1, 0]])) < 1e-3
    assert abs(np.linalg.svd(osmc.nuclear_projection(rng.standard_normal((8, 5)), 3.0), compute_uv=False).sum() - 3.0) < 1e-6
    p = osmc.propensity((rng.random((30, 10)) < 0.3).astype(float))
    assert p.shape == (30, 10) and (p > 0).all() and (p < 1).all()


def test_factor_models_find_planted_factors(spark):
    rng = np.random.default_rng(2)
    load = np.zeros((12, 3))
    for k in range(3):
        load[4 * k : 4 * k + 4, k] = 0.7 + 0.05 * np.arange(4)
    phi = np.full((3, 3), 0.4) + 0.6 * np.eye(3)
    r = load @ phi @ load.T
    np.fill_diagonal(r, 1.0)
    values = factor.eigenvalues(r)
    assert abs(values.sum() - 12) < 1e-9
    cuts = factor.random_cutoffs(spark, 500, 12, 20)
    assert factor.n_factors(values, cuts) == 3 and factor.safe_n(r, 500, 20) <= 11
    got, cor = factor.efa(r, 3)
    back = got @ cor @ got.T
    off = ~np.eye(12, dtype=bool)
    assert np.abs(back - r)[off].max() < 0.02
    assert {tuple(sorted(np.flatnonzero(np.abs(got[:, k]) > 0.4))) for k in range(3)} == {tuple(range(4 * k, 4 * k + 4)) for k in range(3)}
    h = factor.hierarchy(r, got, cor)
    assert 0 < h["omega"]["omega_h"] <= h["omega"]["omega_total"] <= 1
    assert ((h["bifactor"][:, -3] >= 0) & (h["bifactor"][:, -3] <= 1)).all()
    assert factor.hierarchy(r, got[:, :1], np.eye(1))["omega"] is None
    x = rng.standard_normal((300, 3))
    both = np.c_[x, x[:, 0], np.ones(300)]
    m, items = factor.matrix_of(factor.correlations(cells_of(spark, both)), "r")
    want = np.nan_to_num(np.corrcoef(both[:, :4].T))
    assert np.allclose(m[:4, :4], want, atol=1e-9) and m[4, 4] == 1 and not m[4, :4].any() and items == list(range(5))


def test_congruence_is_blind_to_order_and_sign(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((8, 3)) * [3, 2, 1]
    frames = factor.loadings_frame(spark, a, range(8)).withColumn("m", F.lit("a")).unionByName(factor.loadings_frame(spark, -a[:, [2, 0, 1]], range(8)).withColumn("m", F.lit("b")))
    got = factor.congruence(frames, [], "m").collect()
    assert len(got) == 1 and abs(got[0].congruence - 1) < 1e-9
    assert factor.congruence(frames.filter("m = 'a'"), [], "m").count() == 0


# -- sources, export and commands -----------------------------------------------------------------------------------------------------


def test_export_record_equals_a_plain_builder(spark, data):
    r = spark.read.parquet(f"{data}/results.parquet")
    b = {x.benchmark_id.lower(): x for x in spark.read.parquet(f"{data}/benchmarks.parquet").collect()}
    num = lambda s: float(s) if s is not None and re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", s) else None
    rows = {x.row_id: x for x in r.collect()}
    for x in writers.export_records(r, spark.read.parquet(f"{data}/benchmarks.parquet"), "0").collect():
        got, row = json.loads(x.record), rows[x.row_id]
        meta = b.get((row.benchmark_id or "").lower())
        name = (meta.benchmark_name if meta else None) or row.benchmark_id
        assert got["evaluation_id"] == hashlib.md5(f"{row.model_name or ''}_{row.benchmark_id or ''}_{row.source_url or ''}".encode()).hexdigest()
        assert got["evaluation_results"][0].get("evaluation_name") == name
        assert got["evaluation_results"][0]["score_details"]["score"] == (num(row.score) or 0.0)
        args = {k: v for k, v in (("temperature", num(row.generation_temperature)), ("max_tokens", None if num(row.generation_max_tokens) is None else int(num(row.generation_max_tokens))), ("top_p", num(row.generation_top_p))) if v is not None}
        assert got["evaluation_results"][0].get("generation_config", {}).get("generation_args", {}) == args
        assert got["model_info"]["developer"] == (row.model_developer or "unknown")
        assert ("inference_engine" in got["model_info"]) == bool(row.inference_engine)


def test_text_tables_round_trip(spark, tmp_path):
    rows = [("a", "", 'say "x", y'), ("NA", "nan", "line\nbreak"), ("ü", "null", " ")]
    df = frame(spark, rows, "x string, y string, z string")
    assert writers.write_text_table(df, str(tmp_path / "t")) is df and not (tmp_path / "t").exists()
    writers.write_text_table(df.coalesce(1), str(tmp_path / "t"), write=True)
    back = readers.read_text_table(spark, str(tmp_path / "t"), ["x", "y", "z"])
    assert {tuple(r) for r in back.collect()} == set(rows)
    assert {tuple(r) for r in readers.na_as_null(back).collect()} == {("a", None, 'say "x", y'), (None, None, "line\nbreak"), ("ü", None, " ")}


def test_workbook_rules_and_matrix_files(spark, tmp_path):
    import zipfile

    df = frame(spark, [("a<b", None)], "x string, y string")
    assert writers.write_workbook({"one": df}, str(tmp_path / "w.xlsx")) == {"one": 1}
    assert b"a&lt;b" in zipfile.ZipFile(tmp_path / "w.xlsx").read("xl/worksheets/sheet1.xml")
    (tmp_path / "r.json").write_text('{"rename": {"a": "b"}, "odd": {}}')
    with pytest.warns(UserWarning, match="odd"):
        assert readers.load_rules(str(tmp_path / "r.json"))["rename"] == {"a": "b"}
    (tmp_path / "m.csv").write_text("collapse_key,i1,i2\nr1,1.5,\nr2,,2\n")
    assert {tuple(r) for r in readers.read_matrix(spark, str(tmp_path / "m.csv")).collect()} == {("r1", "i1", 1.5), ("r2", "i2", 2.0)}
    nested = spark.createDataFrame([("t", [("d", (["m"], [("model", {"m": "1"})]))])], "task string, datasets array<struct<dataset:string,sota:struct<metrics:array<string>,rows:array<struct<model_name:string,metrics:map<string,string>>>>>>")
    assert [tuple(r) for r in readers.explode_leaderboards(nested).collect()] == [("t", "d", "model", "m", "1")]
    assert report.markdown(df.fillna("-"), ["x"]).splitlines()[-1] == "| a<b | - |"


def test_streams(spark, tmp_path):
    from gridloom.streaming import incremental

    rows = [(i, f"m{i % 3}", f"b{i % 5}", str(i), f"2024-01-0{1 + i % 4} 00:00:00") for i in range(40)]
    df = frame(spark, rows, "row_id long, model_name string, benchmark_id string, score string, t string").withColumn("loaded_at", F.col("t").cast("timestamp")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.append_new(stream(), str(tmp_path / "out"), ["model_name", "benchmark_id"], str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    q = incremental.append_new(stream(), str(tmp_path / "out"), ["model_name", "benchmark_id"], str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    once = incremental.first_reports(stream(), ["model_name", "benchmark_id"], "loaded_at")
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 15
    stats = incremental.windowed_stats(stream(), "model_name", text.number(F.col("score")), "loaded_at")
    q = stats.writeStream.format("memory").queryName("stats").outputMode("complete").option("checkpointLocation", str(tmp_path / "c4")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stats").agg(F.sum("n_rows")).first()[0] == 40


def test_commands(spark, data, tmp_path, capsys):
    assert cli.main(["verify", data], spark) == 1
    for command in ("dupes", "dedup", "categorize-models", "recompute-stats", "standardize-ids"):
        assert cli.main([command, data], spark) == 0
    (tmp_path / "rules.json").write_text(json.dumps({"rename": {}, "remove": ["none"]}))
    assert cli.main(["standardise", data, "--rules", str(tmp_path / "rules.json")], spark) == 0
    assert cli.main(["recompute-stats", data, "--out", str(tmp_path), "--write"], spark) == 0
    assert (tmp_path / "models_stats").exists()
    assert cli.main(["matrix", data, "--strategy", "aggressive", "--target", "0.2"], spark) == 0
    assert "all_aggressive" in capsys.readouterr().out


def test_integrity_of_random_masks():
    rng = random.Random(1)
    assert rules.chained({"a": "b", "b": "c", "c": "a"}, {"a", "b", "c"}) == {"b": "a", "c": "a"}
    for _ in range(50):
        keys = rng.sample("abcdef", 4)
        chain = {k: rng.choice("abcdefgh") for k in keys}
        want = {}
        for v in "abcdef":
            now = v
            for old, new in chain.items():
                if now == old:
                    now = new
            if now != v:
                want[v] = now
        assert rules.chained(chain, set("abcdef")) == want


@pytest.mark.parametrize(("cells", "target", "axis", "want"), [("cp", 0.05, "col_key", (880, 31, 1375)), ("cs", 0.40, "row_key", (760, 100, 30400)), ("ps", 0.40, "col_key", (1256, 3, 1671)), ("ud", 0.95, "row_key", (40, 30, 1140))])
def test_peeled_shapes_of_the_bindings(cells, target, axis, want, spark):
    from gridloom.plans import matrix

    kept = densify.peel(getattr(matrix, cells)(spark, "/root/testdata/sf0.01"), target, axis)
    assert tuple(kept.agg(F.count_distinct("row_key"), F.count_distinct("col_key"), F.count("*")).first()) == want
