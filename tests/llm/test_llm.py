"""The training-data operators on hand-made cases and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, canonical, copies, golden, packing, quality

# -- 4: survivors ---------------------------------------------------------------------------------------------------------------


def test_alignment_votes_by_column():
    votes = [("5 shot greedy", 1.0), ("5 shot , greedy", 1.0), ("5 shot greedy decoding", 1.0)]
    assert golden.consensus(golden.profile_of(votes), 3.0) == ["5", "shot", "greedy"]
    assert golden.consensus(golden.profile_of([("a b", 1.0), ("x y z", 5.0)]), 6.0) == ["x", "y", "z"]
    assert golden.distance(["a", "b"], ["b"]) == 1 and golden.distance([], ["b"]) == 1


VALUES = "g string, field_name string, value string, weight double, row long"


def test_survivors_small_and_large_groups(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("one", "f", "same", 1.0, 7), ("tie", "f", "b a", 1.0, 2), ("tie", "f", "c d", 1.0, 1), ("long", "f", "w " * 2_000, 1.0, 1), ("long", "f", "w", 3.0, 2)]
    rows += [("big", "f", f"open book , {rng.randint(0, 10**6)} passages {i}", 1.0, i) for i in range(300)] + [("big", "f", "open book , ten passages", 200.0, 999)]
    df = spark.createDataFrame(rows, VALUES)
    got = {r.g: r for r in golden.survivors(df, ["g", "field_name"]).collect()}
    assert set(got) == {"one", "tie", "long", "big"}
    assert (got["one"].value, got["one"].agreement) == ("same", 1.0)
    assert got["big"].row == 999 and got["long"].row == 2
    assert golden.survivors(df.limit(0), ["g", "field_name"]).count() == 0


def test_rank_rule_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, f"g{rng.randint(0, 60)}", rng.choice([None, 1, 2, 3]), rng.randint(1, 3), rng.choice([None, "a", "b c", "d"])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, g string, d int, tier int, x string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))
    ranked = golden.ranked_values(df, "g", "row_id", ["x"], day, {"x": F.col("tier")})
    chosen = golden.survivors(ranked.select("g", "field_name", "value", "weight", "row"), ["g", "field_name"])
    won = {(r.g, r.winner) for r in ranked.filter("winner = row").collect()}
    picked = {(r.g, r.row) for r in chosen.collect()}
    want = set()
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g and r[4] is not None]
        best = [r for r in own if not any((o[2] or 0) > (r[2] or 0) or o[3] < r[3] for o in own)]
        if best:
            want.add((g, min(r[0] for r in best)))
    assert won == want
    assert want <= picked


# -- 5: canonical names ---------------------------------------------------------------------------------------------------------

ENTRIES = ["Marozadape-4-72B-Chat", "Marozadape 2 70B", "Marozadape+ 2 70B", "Vozifeziku-2-7B-Coder", "Vozifeziku 27B Coder", "Lokujafimu", "Gizowidaso 0.6B Instruct"]
NAMES = {
    "marozadape_4_72 b_chat": "Marozadape-4-72B-Chat", "72B Chat 4 Marozadape": "Marozadape-4-72B-Chat", "Marozdaape-4-72B-Chat": "Marozadape-4-72B-Chat", "Some Labs: Marozadape-4-72B-cht (2024-05-01)": "Marozadape-4-72B-Chat",
    "Ｍａｒｏｚａｄａｐｅ ２ ７０Ｂ": "Marozadape 2 70B", "Marozadape+ 2 70B": "Marozadape+ 2 70B", "MAROZADAPE+ 2 70b (ours)": "Marozadape+ 2 70B", "Vozifeziku 2 7B code": "Vozifeziku-2-7B-Coder", "Vozifeziku-27B-Coder ①": "Vozifeziku 27B Coder",
    "Vozifeziku 2 27B Coder": "", "Vozifeziku 27B": "", "gizowidaso 600M instr. [fp16]": "Gizowidaso 0.6B Instruct", "Lókujafimu": "Lokujafimu", "human baseline (Lokujafimu study)": "", "Lokujafimu+": "", "wholly other": "", "Lоkujаfimu": "Lokujafimu",
    "Marozadape 72B Chat": "", "": "", "a" * 5_000: "", "+": "", "7B": "",
}


def test_names_map_to_entries(spark):
    names = spark.createDataFrame([(n, "clash") for n in [*NAMES, *NAMES, None]], "model_name string, size string")
    entries = spark.createDataFrame([(e, "clash") for e in [*ENTRIES, ENTRIES[0], None]], "model_id string, kind string")
    got = {r.model_name: r.model_id for r in canonical.map_names(names, "model_name", entries, "model_id").collect()}
    assert got == NAMES
    assert canonical.map_names(names.limit(0), "model_name", entries, "model_id").count() == 0
    assert {r.model_id for r in canonical.map_names(names, "model_name", entries.limit(0), "model_id").collect()} == {""}


def test_repair_finds_every_word_within_the_edits(spark):
    rng = random.Random(3)
    vocabulary = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 10))) for _ in range(80)})
    typed = {rng.choice(vocabulary) for _ in range(20)}
    for w in rng.choices(vocabulary, k=120):
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdefgh") + w[i:], w[:i] + rng.choice("abcdefgh") + w[i + 1 :]])
        typed.add(w)
    typed = sorted(t for t in typed if len(t) > 2)
    got = {r.token: r.word for r in canonical.repair_tokens(spark.createDataFrame([(t,) for t in typed], "token string"), spark.createDataFrame([(v,) for v in vocabulary], "word string")).collect()}

    def edits(a, b):
        d = golden.distance(list(a), list(b))
        limit = 2 if min(len(a), len(b)) >= 7 else 1
        return None if d > limit else 1 if d == 2 and sorted(a) == sorted(b) else d

    for t in typed:
        if t in vocabulary:
            assert got[t] == t
            continue
        near = [(edits(t, v), v) for v in vocabulary if edits(t, v) is not None]
        best = [v for d, v in near if d == min(near)[0]] if near else []
        assert got.get(t) == (best[0] if len(best) == 1 else None), t


# -- 7: copies ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Top-1 Accuracy, micro", "MICRO  top 1 accuracy", True), ("A 0.6B", "a-0.6 b", True), ("A 0.6B", "A 06B", False), ("A 2 7B", "A 27B", False), ("A+ 7B", "A 7B", False), ("EM %", "EM", False), ("Ａ ７Ｂ", "a7b", True), ("a|b", "b, a", True),
        ("a​ b", "ab", False), ("", "-", True), ("★ a", "a", False), ("a/b", "a b", True),
    ],
)
def test_canonical_forms(a, b, same, spark):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(copies.canonical(F.col("a")).alias("a"), copies.canonical(F.col("b")).alias("b")).first()
    assert (r.a == r.b) == same


def test_copies_equal_brute_force(spark):
    rng = random.Random(4)
    forms = ["Alpha 1.5B", "alpha-1.5b", "1.5B, ALPHA", "Alpha 15B", "Beta", "beta.", "", None, "x" * 20_000]
    rows = [(i, rng.choice(forms), rng.choice(["m", "M", None]), rng.choice(["s", "S", None, ""])) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a string, key string, __h string")
    pairs = {(r.row_id_a, r.row_id_b) for r in copies.copy_pairs(df, "row_id", ["__h"], ["a", "key"]).collect()}
    canon = {r.row_id: (r.c, r.k, r["__h"]) for r in df.select("row_id", copies.canonical(F.col("a")).alias("c"), copies.canonical(F.col("key")).alias("k"), "__h").collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(range(400), 2) if canon[a] == canon[b]}
    got = copies.records(df, "row_id", ["__h"], ["a", "key"]).collect()
    assert sum(r.copies for r in got) == 400 and len(got) == len(set(canon.values()))
    assert copies.records(df.limit(0), "row_id", ["__h"], ["a", "key"]).count() == 0


def test_filters_keep_every_repeat_and_drop_most_others(spark):
    df = spark.range(20_000).repartition(7).select(F.xxhash64(F.when(F.col("id") < 1_000, F.col("id") % 400).otherwise(F.col("id"))).alias("h"), "id")
    kept = {r.id for r in copies.possible_repeats(df, "h", 20_000).collect()}
    assert set(range(1_000)) <= kept and len(kept) < 1_500


# -- 8: BPE ---------------------------------------------------------------------------------------------------------------------


def test_ids_equal_the_public_library(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = ["", None, " ", "\n\n", "<|endoftext|> x", "日本" * 2_000, "a" * 3_000, "\U0001f642‍" * 500, "it's  we'll\t\r\n 12345"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-i - 1, x) for i, x in enumerate(extra)], "doc_id long, text string")).withColumn("ids", F.lit("clash"))
    rows = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got == {k: t.encode(v or "", add_special_tokens=False).ids for k, v in rows.items()}
    assert {r.doc_id: r.n_tokens for r in bpe.encode(df, "doc_id", "text", count_only=True).collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_tree_equals_rescanning():
    rng = random.Random(5)
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(300):
        a, b = rng.choice(list(ranks)), rng.choice([w for w in ranks if w and w[0] in b"abcd"])
        if a and a[0] in b"abcd":
            ranks.setdefault(a + b, len(ranks))

    def slow(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(300):
        word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40)))
        assert bpe.merge_by_tree(word, ranks) == slow(word)


# -- 9: packing -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_whole_and_tight(seed, spark):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 17, 100, 300, 511, 512, 513, 900, 2_000, 4_096, 4_097, 9_000, rng.randint(1, 4_000)]) for _ in range(1_500)] + [None, 30_000]
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], "doc_id long, n int, _salt string")
    rows = packing.pack(df, "doc_id", "n").collect()
    by_doc, by_box = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.n_tokens:
            by_box.setdefault((r.container_id, r.capacity), []).append((r.start, r.start + r.n_tokens))
    assert set(by_doc) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == (s or 0)
        assert len(own) == max(1, -(-(s or 0) // 4_096))
        assert [r.first_token for r in own] == [4_096 * k for k in range(len(own))]
    assert len({c for c, _ in by_box}) == len(by_box)
    for (_, capacity), spans in by_box.items():
        spans.sort()
        assert spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
    used = sum(e - b for s in by_box.values() for b, e in s)
    assert used / sum(c for _, c in by_box) > 0.97


def test_packing_empty_and_only_blank(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n int")
    assert {r.n_tokens for r in packing.pack(df, "doc_id", "n").collect()} == {0}
    assert packing.pack(df.limit(0), "doc_id", "n").count() == 0
    assert packing.plan_tiers({}) == []


def test_packing_gives_the_same_rows_again(spark):
    df = spark.range(3_000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(1_500))).cast("int").alias("n"))
    first = {tuple(r) for r in packing.pack(df, "doc_id", "n").collect()}
    assert first == {tuple(r) for r in packing.pack(df.repartition(7), "doc_id", "n").collect()}


# -- 10: quality ----------------------------------------------------------------------------------------------------------------

PROSE = [
    "Scores were taken from the public page and were not rounded.", "Nach der Korrektur des Schlüssels stieg der Wert um 1.3 Punkte.", "Les auteurs ne précisent pas quelle consigne a été utilisée.",
    "Los autores no dicen qué plantilla usaron para las respuestas.", "这些题目是在2022年重新编写的，没有使用翻译。", "i have looked at fifty wrong answers by hand, and in a third of them the answer key was to blame",
    "# Title\nThe dataset covers 1251 languages, though almost half of the items are\nin English. Most of the errors come from causal reasoning, where the\nmodel answers before it has read the whole item.", "> To be fair, it was never\n> meant to test this at all.",
]
JUNK = [
    "- random seed\n- the win rate with five examples in the prompt\n- code repair", "Model\tA\tB\nx\t1.5\t2.5\ny\t3.5\t4.5", "| Model | A |\n| --- | --- |\n| x | 1 |", '{"model": "x", "score": 0.5}\n{"model": "y", "score": 0.6}', "=====\n-----\n.....",
    "table lookup, plan revision, calibration, the F1 score in the zero-shot setting, answer key, tool calling, numeracy", "Home | Terms | Sign in | Docs | Next » | Share", "1.1 table lookup ........ 12\n2.3 answer key ........ 14",
    "Temperature dialogue following choice rewrote surprising item theorem. Parser theorem answer transfer unit steady checked.", "42 6.8 68.08 19 36.4 2.6 36.4 37.4 80.5", "Gorawino hito wesu lewaku wamu si labati. Porituta lijara habecu ruxe wigado xode.",
    "<table><tr><td>Model</td><td>A</td></tr><tr><td>x</td><td>1.5</td></tr></table>", "2025-08-21 21:14:07 INFO worker=10 step=12888 loss=0.41", "the win rate on the translated items " * 40,
]


def test_prose_and_junk(spark):
    rows = [(i, t) for i, t in enumerate(PROSE + JUNK)] + [(100, None), (101, ""), (102, " \n\t"), (103, (PROSE[0] + " ") * 20_000), (104, JUNK[0] + "\n\n" + PROSE[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_t", F.lit("clash")).withColumn("prose_share", F.lit(1))
    got = {r.doc_id: r for r in quality.text_quality(df, "doc_id", "text").collect()}
    assert [i for i in range(len(PROSE)) if not got[i].is_prose] == []
    assert [JUNK[i - len(PROSE)] for i in range(len(PROSE), len(PROSE) + len(JUNK)) if got[i].is_prose] == []
    assert all("prose_share" in got[i].failures for i in range(len(PROSE), len(PROSE) + len(JUNK)))
    for i in (100, 101, 102):
        assert got[i].is_prose is None and got[i].failures == [] and got[i].n_words == 0
    assert got[103].is_prose and got[103].n_chars == 20_000 * (len(PROSE[0]) + 1)
    assert quality.text_quality(df.limit(0), "doc_id", "text").count() == 0


# -- queries --------------------------------------------------------------------------------------------------------------------


def test_queries_run_and_have_their_columns(spark, data):
    from gridloom.llm import queries

    want = {"p4_found": ["evaluation_id", "field_name", "row_id"], "p5_found": ["model_name", "model_id"], "p7_found": ["row_id_a", "row_id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"]}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, data)
        assert df.columns == columns
        rows = df.collect()
        assert rows
        if name != "p8_ids":
            assert len(set(rows)) == len(rows)
