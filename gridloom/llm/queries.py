"""Plans of the training-data problems over the project's tables: p4, p5, p7, p8, p9 and p10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.values import recorded_day, states_value, url_host
from gridloom.llm import bpe, canonical, copies, golden, packing, quality
from gridloom import schema
from gridloom.operators import units
from gridloom.runtime import cut, small_collect, table

#: Hosts of the trust table; it doesn't grow and is read by the driver.
MAX_HOSTS = 10_000

# -- 4 ------------------------------------------------------------------------------------------------------------------------


def trust_tier(url: Column, hosts: dict[str, int]) -> Column:
    """Tier of the longest listed host that the URL's host equals or is a subdomain of; one below the lowest tier otherwise."""
    below = max(hosts.values(), default=0) + 1
    if not hosts:
        return F.lit(below)
    listed = F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv])
    parts = F.split(url_host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.coalesce(F.get(F.filter(F.transform(suffixes, lambda s: F.element_at(listed, s)), lambda t: t.isNotNull()), F.lit(0)), F.lit(below))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "results").filter("evaluation_id is not null")
    several = results.groupBy("evaluation_id").agg(F.count("*").alias("n")).filter("n > 1").select("evaluation_id")
    rows = results.select("evaluation_id", "row_id", "date_recorded", "source_url", "setup", "score", "metric_name", "metric", "metric_max_score").join(several, "evaluation_id")
    read = units.read_scores(rows, units.load_catalog(table(spark, d, "metric_units")))
    hosts = {r.host.strip().lower(): r.trust_tier for r in small_collect(table(spark, d, "source_trust").filter("host is not null and trust_tier is not null"), MAX_HOSTS, "source_trust")}
    stated = lambda c: F.when(states_value(F.col(c)), F.col(c)).alias(c)
    rows = cut(read.select("evaluation_id", "row_id", recorded_day(F.col("date_recorded")).alias("day"), trust_tier(F.col("source_url"), hosts).alias("tier"), F.when(F.col("score_states"), F.col("score")).alias("score"), stated("source_url"), stated("setup")), "p4-rows")
    fields = ["score", "source_url", "setup"]
    return golden.ranked_values(rows, "evaluation_id", "row_id", fields, F.col("day"), {f: F.col("tier") for f in fields})


def p4_golden(spark: SparkSession, d: str) -> DataFrame:
    """The surviving value of each evaluation and field, as the weighted votes chose it: evaluation_id, field_name, value, row_id,
    agreement, and whether the rank rule names the same row (``rank_agrees``; null: the rule names none)."""
    values = cut(_ranked(spark, d), "p4-values")
    chosen = golden.survivors(values.select("evaluation_id", "field_name", "value", "weight", "row"), ["evaluation_id", "field_name"])
    ruled = values.filter("winner is not null").select("evaluation_id", "field_name", "winner").distinct()
    out = chosen.join(ruled, ["evaluation_id", "field_name"], "left")
    return out.select("evaluation_id", "field_name", "value", F.col("row").alias("row_id"), F.round("agreement", 6).alias("agreement"), (F.col("winner") == F.col("row")).alias("rank_agrees"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The survivors that the exact rank check confirms: no candidate is more recent and none more trusted. A survivor of the vote
    that the check doesn't confirm is no case; nothing is taken from the check itself."""
    return p4_golden(spark, d).filter("rank_agrees").select("evaluation_id", "field_name", "row_id")


# -- 5 ------------------------------------------------------------------------------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct model_name that isn't a model_id, with the model_id it names or ''."""
    models = table(spark, d, "models").select("model_id").filter("model_id is not null")
    names = table(spark, d, "results").select("model_name").distinct().filter(states_value(F.col("model_name")))
    names = cut(names.join(models.hint("merge"), F.col("model_name") == F.col("model_id"), "left_anti"), "p5-names")
    return canonical.map_names(names, "model_name", models, "model_id")


# -- 7 ------------------------------------------------------------------------------------------------------------------------

_ALIKE = ["model_name", "benchmark_id", "metric_name"]


def _same(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("row_id", "loaded_at", *_ALIKE)]


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record, its smallest row_id, with its number of copies."""
    results = table(spark, d, "results")
    return copies.records(results, "row_id", _same(results), _ALIKE)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of copies: row_id_a, row_id_b."""
    results = table(spark, d, "results")
    return copies.copy_pairs(results, "row_id", _same(results), _ALIKE)


# -- 8, 9, 10 -----------------------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and ids of each document; [] for null and empty texts."""
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container, or containers where it exceeds the largest capacity."""
    docs = table(spark, d, "documents")
    lengths = packing.token_lengths(docs, "doc_id", bpe.encode(docs, "doc_id", "text", count_only=True))
    return packing.pack(lengths, "doc_id", "n_tokens")


def p9_filling(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and used share of the room, per capacity."""
    return packing.filling(p9_packed(spark, d))


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    """Text statistics, failed rules and is_prose of every document."""
    return quality.text_quality(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text most of which isn't natural prose: doc_id."""
    return p10_quality(spark, d).filter("not is_prose").select("doc_id")


QUERIES = {f.__name__: f for f in (p4_found, p4_golden, p5_found, p7_found, p7_records, p8_ids, p9_packed, p9_filling, p10_found, p10_quality)}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_NARROW = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")
_PARTS = r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{M}]+|[+%‰]|[^\p{L}\p{M}\p{Nd}\p{P}\p{Z}\p{C}|~^`<>=$]"


def _form(c: str) -> str:
    narrow = f"regexp_replace(lower(translate({c}, '{_WIDE}', '{_NARROW}')), '\\p{{Cf}}+', '', 'g')"
    return f"array_to_string(list_sort(regexp_extract_all({narrow}, '{_PARTS}')), ' ')"


_RESULT_COLUMNS = [c for c in schema.RESULT_COLUMNS if c not in _ALIKE]
_KEYED = f"select row_id, md5(concat_ws('|', {', '.join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in [*_RESULT_COLUMNS, *map(_form, _ALIKE)])})) as k from results"

ORACLES: dict[str, str] = {
    "p7_found": f"with t as materialized ({_KEYED}) select a.row_id as row_id_a, b.row_id as row_id_b from t a join t b on a.k = b.k and a.row_id < b.row_id",
    "p7_records": f"select min(row_id) as row_id, count(*) as copies from ({_KEYED}) group by k",
}
