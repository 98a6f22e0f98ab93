"""That the named methods decide rows: votes, soft TF-IDF, filters of many rounds, and quality rules."""

import random

from pyspark.sql import functions as F

from gridloom.llm import canonical, copies, golden, quality


def test_votes_decide_where_no_row_is_best(spark):
    rows = [(1, "g", "2024-05-03", 3, "5 shot greedy"), (2, "g", "2024-05-02", 1, "5 shot , greedy"), (3, "g", "2024-05-01", 1, "5 shot greedy decoding"), (4, "h", "2024-05-03", 1, "a b"), (5, "h", "2024-05-01", 2, "c"), (6, "h", "2024-05-01", 2, "c"), (7, "h", "2024-05-01", 2, "c")]
    df = spark.createDataFrame(rows, "row_id long, g string, day string, tier int, x string")
    ranked = golden.ranked_values(df, "g", "row_id", ["x"], F.col("day").cast("date"), {"x": F.col("tier")})
    got = {r.g: r for r in golden.survivors(ranked.select("g", "field_name", "value", "weight", "row"), ["g", "field_name"]).collect()}
    assert {(r.g, r.winner) for r in ranked.collect()} == {("g", None), ("h", 4)}
    assert got["h"].row == 4 and got["g"].row in (1, 2)


def test_large_groups_keep_a_heavy_value_at_any_fan_in(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("g", "f", f"w{rng.randint(0, 9)} x{rng.randint(0, 9)} {i}", 1.0, i) for i in range(60)] + [("g", "f", "the one value", 61.0, 100)]
    df = spark.createDataFrame(rows, "g string, field_name string, value string, weight double, row long")
    for fan in (4, 64):
        monkeypatch.setattr(golden, "FAN_IN", fan)
        assert [r.row for r in golden.survivors(df, ["g", "field_name"]).collect()] == [100]


def test_complete_entries_decide_between_equally_near_families(spark):
    entries = spark.createDataFrame([("Karotu 2 7B",), ("Kabotu 3 7B Chat",), ("Kabotu 2 13B",)], "e string")
    names = spark.createDataFrame([("Katotu 2 7B",), ("Katotu 3 7B chat",), ("Katotu 2 13B",), ("Katotu 5 7B",)], "n string")
    got = {r.n: r.e for r in canonical.map_names(names, "n", entries, "e").collect()}
    assert got == {"Katotu 2 7B": "Karotu 2 7B", "Katotu 3 7B chat": "Kabotu 3 7B Chat", "Katotu 2 13B": "Kabotu 2 13B", "Katotu 5 7B": ""}


def test_without_its_score_the_ranking_gives_other_rows(spark, monkeypatch):
    entries = spark.createDataFrame([(f"Karotu {v} {s}B",) for v in (2, 3, 4) for s in (7, 13)], "e string")
    names = spark.createDataFrame([(f"karotu-{v}-{s}b",) for v in (2, 3, 4) for s in (7, 13)], "n string")
    assert all(r.e for r in canonical.map_names(names, "n", entries, "e").collect())
    monkeypatch.setattr(canonical, "MIN_SCORE", 1.01)
    assert not any(r.e for r in canonical.map_names(names, "n", entries, "e").collect())


def test_kinds_of_any_registry_are_read_in_short_and_long(spark):
    entries = spark.createDataFrame([("Karotu 7B Thinking",), ("Karotu 7B",), ("Karotu 7B Planner",)], "e string")
    names = spark.createDataFrame([("karotu 7bthinking",), ("Karotu-7B-think",), ("Karotu 7B plnnr",), ("Karotu 7B (rerun)",)], "n string")
    got = {r.n: r.e for r in canonical.map_names(names, "n", entries, "e").collect()}
    assert got == {"karotu 7bthinking": "Karotu 7B Thinking", "Karotu-7B-think": "Karotu 7B Thinking", "Karotu 7B plnnr": "Karotu 7B Planner", "Karotu 7B (rerun)": "Karotu 7B"}


def test_many_rounds_give_the_rows_of_one(spark, monkeypatch):
    monkeypatch.setattr(copies, "BITS_PER_ROW", 4_000)  # 12 shards for 3,000 rows
    rng = random.Random(10)
    df = spark.createDataFrame([(i, f"m{rng.randint(0, 2_500)}", "s") for i in range(3_000)], "row_id long, a string, s string")
    one = {tuple(r) for r in copies.records(df, "row_id", ["s"], ["a"]).collect()}
    many = {tuple(r) for r in copies.records(df, "row_id", ["s"], ["a"], round_bits=2 * copies.SHARD_BITS).collect()}
    assert one == many and sum(n for _, n in one) == 3_000


def test_few_single_rows_are_taken_for_repeats(spark):
    rows = 120_000
    df = spark.range(rows).select(F.xxhash64("id").alias("h"))
    for round_bits in (copies.SHARD_BITS, copies.ROUND_BITS):
        assert copies.mark_repeats(df, "h", rows, round_bits).filter("maybe").count() < 0.05 * rows


def test_failed_block_rules_are_named(spark):
    rows = [(1, "- a list of things\n- another thing\n- one more"), (2, "answer key, prompt template, seed, table lookup, judge prompt"), (3, "We read it twice and it was not what the others had said."), (4, "accuracy on the translated items " * 40)]
    got = {r.doc_id: r for r in quality.text_quality(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[3].is_prose and not any(f.startswith("block_") for f in got[3].failures)
    assert "block_listed" in got[1].failures and "block_separators" in got[2].failures and "block_repeated" in got[4].failures
    assert all(got[i].is_prose == (got[i].prose_share >= quality.MIN_PROSE) for i in got)
