"""Curation queries over results, models and benchmarks: integrity, duplicates, rules, names, statistics and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions import text
from gridloom.functions.values import recorded_day
from gridloom.operators import aliases, classify, collapse, dedup, integrity, rules, stats
from gridloom.plans.registry import Registry
from gridloom.runtime import table
from gridloom.sources import readers, writers

R = Registry()
query = R.query

IDENTITY = list(schema.IDENTITY_KEY)
KEY_SQL = ", ".join(IDENTITY)
# The guarded number of the oracles.
NUM = r"case when regexp_matches({0}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') then try_cast(trim({0}) as double) end"


def num(c: str) -> str:
    return NUM.format(c)


def _tier_sql(c: str) -> str:
    cases = " ".join(f"when {' or '.join(f'''contains(lower(coalesce({c}, '')), '{p}')''' for p in parts)} then {t}" for t, parts in schema.TRUST_TIERS.items())
    return f"case {cases} else {schema.UNKNOWN_TIER} end"


YEAR_SQL = f"coalesce(cast(trunc({num('year_evaluated')}) as int), 0)"


def _year() -> object:
    return F.coalesce(text.number(F.col("year_evaluated")).cast("int"), F.lit(0))


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results")


# -- scans and projections ------------------------------------------------------------------------------------------------------


@query(f"select row_id, {', '.join(f'case when {c} not in ({", ".join(repr(t) for t in readers.NA_TOKENS)}) then {c} end as {c}' for c in ('model_name', 'benchmark_id', 'score', 'setup'))} from results")
def scan_na_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Missing-value tokens as nulls."""
    return readers.na_as_null(results(spark, d).select("row_id", "model_name", "benchmark_id", "score", "setup"))


@query("select row_id, coalesce(model_name, '') as model_name, coalesce(setup, '') as setup from results")
def scan_string_csv(spark: SparkSession, d: str) -> DataFrame:
    """The text policy: a missing value is the empty text."""
    return results(spark, d).select("row_id", "model_name", "setup").fillna("")


@query(f"select row_id, {num('score')} as score_numeric from results")
def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("row_id", text.number(F.col("score")).alias("score_numeric"))


@query(
    "select model_id, trim(regexp_replace(replace(translate(lower(trim(model_id)), ' _', '--'), '+', '-plus'), '-+', '-', 'g'), '-') as standard_id from models"
)
def standardize_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "models").select("model_id", text.standard_id(F.col("model_id")).alias("standard_id"))


_DATES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({0}, '(?s)-+&.*$', ''), '-_. '), '\bmedium[-_ ]+effort\b', '', 'g'), '\bhigh[-_ ]+reasoning\b', '', 'g'), '\b\d{{4}}[-_/]\d{{2}}[-_/]\d{{2}}\b', '', 'g'), '\b20\d{{6}}\b', '', 'g'), '\b\d{{2}}[-_/]\d{{2}}\b', '', 'g'), '\b\d{{4}}\b', '', 'g')"
_PARENS = r"regexp_replace(regexp_replace({0}, '\((?:[^)]*?[^A-Za-z0-9_)])??(\d+(?:\.\d+)?[mbMB])\b[^)]*\)', '\1', 'g'), '\([^)]*\)', '', 'g')"
_ASCII = "regexp_matches(model_name, '^[ -~]*$')"


@query(f"select distinct model_name, {_DATES.format('model_name')} as stripped from results where {_ASCII}")
def strip_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates stripped from every name. The SQL holds for names of printable ASCII only: word borders of others differ between engines."""
    return results(spark, d).select("model_name").distinct().select("model_name", text.without_dates(F.col("model_name")).alias("stripped"))


@query(f"select distinct model_name, {_PARENS.format('model_name')} as cleaned from results where {_ASCII}")
def clean_parens(spark: SparkSession, d: str) -> DataFrame:
    """Parentheses cleaned in every name. The SQL holds for names of printable ASCII only."""
    return results(spark, d).select("model_name").distinct().select("model_name", text.parens_to_size(F.col("model_name")).alias("cleaned"))


@query("select distinct model_name, regexp_replace(model_name, '^[^/]*/', '') as bare from results")
def strip_org_prefix(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("model_name").distinct().select("model_name", text.without_org(F.col("model_name")).alias("bare"))


@query(f"select distinct model_name, trim(translate(model_name, '{schema.STATUS_MARKS}', '')) as cleaned from results")
def clean_markers(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("model_name").distinct().select("model_name", text.without_marks(F.col("model_name")).alias("cleaned"))


@query("select benchmark_id, 'own_' || trim(regexp_replace(lower(trim(benchmark_name)), '[^a-z0-9]+', '_', 'g'), '_') as slug from benchmarks")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmarks").select("benchmark_id", text.slug(F.col("benchmark_name"), "own_").alias("slug"))


@query(
    "select doc_id, (" + " or ".join(f"contains(lower(text), '{k}')" for k in ("benchmark", "reasoning", "knowledge")) + ") and not (" + " or ".join(f"contains(lower(text), '{k}')" for k in ("video", "audio")) + ") as relevant from documents"
)
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.has_keyword(F.col("text"), ("benchmark", "reasoning", "knowledge"), ("video", "audio")).alias("relevant"))


@query(
    f"with v as (select row_id, metric_name, {num('score')} as v from results) select row_id, case when metric_name in ({', '.join(repr(m) for m in schema.ABSOLUTE_METRICS)}) then round(v, 6) when v between 0 and 1 then least(round(v * 100, 4), 100.0) else round(v, 4) end as normalized from v"
)
def normalize_score(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("row_id", text.scaled_score(F.col("score"), F.col("metric_name")).alias("normalized"))


@query(
    """with t as (select event_id, round(value, 0) / 100 as agg, case when event_id % 3 = 0 then 'NOOP' else 'MEAN' end as kind, event_id % 2 as children, [null, round(value, 0) / 50] as res from events)
    select event_id, case when kind <> 'NOOP' and agg is not null then case when agg between 0 and 1 then round(agg * 100, 2) when agg > 1 and agg <= 100 and children <= 1 then round(agg, 2) end
    when res[2] between 0 and 1 then round(res[2] * 100, 2) else round(res[2], 2) end as score from t"""
)
def extract_score(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("event_id", (F.round("value", 0) / 100).alias("agg"), F.when(F.col("event_id") % 3 == 0, "NOOP").otherwise("MEAN").alias("kind"), (F.col("event_id") % 2).alias("children"), F.array(F.lit(None).cast("double"), F.round("value", 0) / 50).alias("res"))
    return t.select("event_id", text.leaderboard_score(F.col("agg"), F.col("kind"), F.col("children"), F.col("res")).alias("score"))


@query(f"select row_id, {_tier_sql('source_url')} as tier, {YEAR_SQL} as year from results")
def trust_tier(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("row_id", classify.source_tier(F.col("source_url")).alias("tier"), _year().alias("year"))


def _any_sql(c: str, parts: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{p}')" for p in parts) + ")"


_TRUSTED_SQL = "(developer <> '' and (" + " or ".join(f"contains(lower(trim(developer)), '{t.lower()}') or contains('{t.lower()}', lower(trim(developer)))" for t in schema.TRUSTED_DEVELOPERS) + "))"


@query(
    f"""with m as (select model_id, coalesce(model_name, '') as model_name, coalesce(model_family, '') as family, coalesce(developer, '') as developer, lower(coalesce(model_type, '')) as kind, coalesce(base_model, '') as base from models),
    f as (select *, {_TRUSTED_SQL} as trusted, {_any_sql("lower(model_id || ' ' || model_name || ' ' || developer)", schema.FROM_SCRATCH)} as scratch, {_any_sql("lower(model_name)", schema.FINE_TUNE_WORDS)} as tuned,
    case when developer = '' then 'unknown' else developer end as dev, case when kind = '' then 'unknown' else kind end as typ from m)
    select model_id, case when kind = 'closed' and trusted then 'KEEP' when trusted and family <> '' then 'KEEP' when base <> '' then 'KEEP' when trusted then 'KEEP' when scratch then 'KEEP' when family <> '' then 'KEEP' when tuned then 'REMOVE' else 'FLAG' end as category,
    case when kind = 'closed' and trusted then 'Closed model from trusted dev (' || developer || ')' when trusted and family <> '' then 'Trusted dev (' || developer || ') with clear family (' || family || ')' when base <> '' then 'Has base_model: ' || base
    when trusted then 'Open model from trusted dev (' || developer || ')' when scratch then 'Known from-scratch pattern' when family <> '' and tuned then 'Fine-tuned but family known: ' || family when family <> '' then 'From-scratch with family: ' || family
    when tuned then 'Fine-tuned name, no family/base_model/trusted dev (dev: ' || dev || ')' else 'No family/base_model, unclear origin (dev: ' || dev || ', type: ' || typ || ')' end as reason from f"""
)
def categorize(spark: SparkSession, d: str) -> DataFrame:
    c = classify.categorize(*[F.col(x) for x in ("model_id", "model_name", "model_family", "developer", "model_type", "base_model")])
    return table(spark, d, "models").select("model_id", c.alias("c")).select("model_id", "c.category", "c.reason")


@query("select coalesce(model_type, '') as model_type, count(*) as n from models group by 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "models").groupBy(F.coalesce("model_type", F.lit("")).alias("model_type")).agg(F.count("*").alias("n"))


@query(
    rf"""with c as (select model_id, lower(trim(model_family)) as fam, {_DATES.format(_PARENS.format("regexp_replace(lower(trim(model_id)), '^[^/]*/', '')"))} as mid from models),
    t as (select model_id, fam, list_filter(list_transform(regexp_split_to_array(fam, '[\s\-_/]'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: regexp_matches(x, '[a-z]')) as f,
    list_filter(list_transform(regexp_split_to_array(mid, '[\-_/\s]'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: regexp_matches(x, '[a-z]')) as m from c)
    select model_id, coalesce(case when not regexp_matches(fam, '^\d+(\.\d+)?b?$') then f[1] end, m[1], 'unknown') as collapse_key from t"""
)
def collapse_key_aggressive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "models").select("model_id", text.coarse_key(F.col("model_id"), F.col("model_family")).alias("collapse_key"))


@query()
def collapse_key_standard(spark: SparkSession, d: str) -> DataFrame:
    """A fold over tokens; checked by a table of cases in the tests."""
    return text.with_fine_key(table(spark, d, "models").select("model_id", "model_family", "model_size"), "model_id", "model_family", "model_size")


@query("select row_id, md5(concat_ws('_', coalesce(model_name, ''), coalesce(benchmark_id, ''), coalesce(source_url, ''))) as evaluation_key from results")
def evaluation_id(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("row_id", writers.evaluation_id(F.col("model_name"), F.col("benchmark_id"), F.col("source_url")).alias("evaluation_key"))


@query(r"select row_id, nullif(regexp_extract(p, '/([a-z]+)_[CSR]_all_standard_loadings\.csv$', 1), '') as method, nullif(regexp_extract(p, '_([CSR])_all_standard', 1), '') as densifier, case when regexp_matches(p, '/[a-z]+_[CSR]_all_standard_loadings\.csv$') then 'all_standard' end as strategy, case when regexp_matches(p, '/[a-z]+_[CSR]_all_standard_loadings\.csv$') then 'efa' end as kind from (select row_id, '/out/knn_' || case row_id % 4 when 0 then 'C' when 1 then 'S' when 2 then 'R' else 'X' end || '_all_standard_loadings.csv' as p from results)")
def parse_artifact_name(spark: SparkSession, d: str) -> DataFrame:
    letter = F.element_at(F.array(*map(F.lit, "CSRX")), (F.col("row_id") % 4 + 1).cast("int"))
    return results(spark, d).select("row_id", readers.parse_artifact(F.concat(F.lit("/out/knn_"), letter, F.lit("_all_standard_loadings.csv"))).alias("a")).select("row_id", "a.*")


@query(r"select distinct lower(trim(split_part(regexp_extract(l, '^\*\*(.*?)\*\*', 1), '(', 1))) as pending from (select '**' || model_name || ' (new)** to do' as l from models) where trim(split_part(regexp_extract(l, '^\*\*(.*?)\*\*', 1), '(', 1)) <> ''")
def pending_names(spark: SparkSession, d: str) -> DataFrame:
    return integrity.pending_names(table(spark, d, "models").select(F.concat(F.lit("**"), F.col("model_name"), F.lit(" (new)** to do")).alias("value")))


@query("with p as (select distinct lower(n_name) as pending from nation union select distinct lower(left(benchmark_name, 6)) from benchmarks where benchmark_name is not null) select pending, exists (select 1 from benchmarks b where contains(lower(coalesce(b.benchmark_name, '')) || chr(10) || lower(coalesce(b.benchmark_id, '')), pending)) as found from p")
def pending_found(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmarks")
    p = table(spark, d, "nation").select(F.lower("n_name").alias("pending")).union(b.filter("benchmark_name is not null").select(F.lower(F.substring("benchmark_name", 1, 6)))).distinct()
    return integrity.pending_status(p, b, ["benchmark_name", "benchmark_id"])


@query("with t as (select user_id as task, list(struct_pack(dataset := event_type, score := value)) as rows from events group by 1) select task, r.dataset as dataset, r.score as score from (select task, unnest(rows) as r from t)")
def explode_nested(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(F.col("user_id").alias("task")).agg(F.collect_list(F.struct(F.col("event_type").alias("dataset"), F.col("value").alias("score"))).alias("rows"))
    return t.select("task", F.explode("rows").alias("r")).select("task", "r.*")


# -- joins ----------------------------------------------------------------------------------------------------------------------


@query("select r.row_id, m.developer, b.category from results r join models m on r.model_name = m.model_id join benchmarks b on r.benchmark_id = b.benchmark_id")
def join_results_dims(spark: SparkSession, d: str) -> DataFrame:
    m, b = table(spark, d, "models").select(F.col("model_id").alias("_m"), "developer"), table(spark, d, "benchmarks").select(F.col("benchmark_id").alias("_b"), "category")
    r = results(spark, d).select("row_id", "model_name", "benchmark_id")
    return r.join(m, F.col("model_name") == F.col("_m")).join(b, F.col("benchmark_id") == F.col("_b")).select("row_id", "developer", "category")


@query("select distinct 'models' as dim, model_name as id from results where model_name is not null and model_name not in (select model_id from models) union all select distinct 'benchmarks', benchmark_id from results where benchmark_id is not null and benchmark_id not in (select benchmark_id from benchmarks)")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    out = integrity.fk_violations(r, "model_name", table(spark, d, "models"), "model_id").select(F.lit("models").alias("dim"), "id")
    return out.unionByName(integrity.fk_violations(r, "benchmark_id", table(spark, d, "benchmarks"), "benchmark_id").select(F.lit("benchmarks").alias("dim"), "id"))


@query("select 'models' as dim, model_id as id from models m where not exists (select 1 from results r where r.model_name = m.model_id) union all select 'benchmarks', benchmark_id from benchmarks b where not exists (select 1 from results r where r.benchmark_id = b.benchmark_id)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    out = integrity.orphans(table(spark, d, "models"), "model_id", r, "model_name").select(F.lit("models").alias("dim"), "id")
    return out.unionByName(integrity.orphans(table(spark, d, "benchmarks"), "benchmark_id", r, "benchmark_id").select(F.lit("benchmarks").alias("dim"), "id"))


@query("select distinct model_name as id from results where model_name is not null and not exists (select 1 from models k where k.model_id = results.model_name)")
def orphan_names(spark: SparkSession, d: str) -> DataFrame:
    return integrity.fk_violations(results(spark, d), "model_name", table(spark, d, "models"), "model_id")


@query("with m as (select distinct model_name as old, lower(model_name) as new from results where model_name in (select model_id from models)) select r.row_id, coalesce(m.new, r.model_name) as model_name from results r left join m on r.model_name = m.old")
def apply_aliases(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "models").select(F.col("model_id").alias("old"), F.lower("model_id").alias("new"))
    return rules.lookup(results(spark, d).select("row_id", "model_name"), m, ["model_name"])


@query("select m.model_id, f.id as alias from (select distinct model_name as id from results where model_name is not null and not exists (select 1 from models k where k.model_id = results.model_name)) f join models m on lower(f.id) = lower(m.model_id)")
def alias_candidates_ci(spark: SparkSession, d: str) -> DataFrame:
    """Names that differ from a registered id in letter case only."""
    names = integrity.fk_violations(results(spark, d), "model_name", table(spark, d, "models"), "model_id")
    return names.join(table(spark, d, "models").select("model_id", F.lower("model_id").alias("_l")), F.lower("id") == F.col("_l")).select("model_id", F.col("id").alias("alias"))


@query("with t as (select benchmark_id, avg(case when model_type = 'open' then v end) as a, avg(case when model_type = 'closed' then v end) as b from (select *, " + num("score") + " as v from results) where benchmark_id is not null group by 1) select benchmark_id, round(a, 6) as open_mean, round(b, 6) as closed_mean from t where a is not null and b is not null")
def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    v = results(spark, d).withColumn("v", text.number(F.col("score"))).filter("benchmark_id is not null")
    mean = lambda k: F.round(F.avg(F.when(F.col("model_type") == k, F.col("v"))), 6)
    return v.groupBy("benchmark_id").agg(mean("open").alias("open_mean"), mean("closed").alias("closed_mean")).dropna()


@query(f"select row_id, same_score from (select row_id, row_number() over w as n, score is not distinct from first_value(score) over w as same_score from results window w as (partition by {KEY_SQL} order by row_id)) where n > 1")
def dupe_vs_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.versus_first(results(spark, d).select("row_id", "score", *IDENTITY), IDENTITY, "row_id", ["score"])


@query("with p as (select model_name, min(model_developer) as dev, min(model_family) as fam from results where coalesce(model_developer, '') <> '' group by 1) select m.model_id, coalesce(nullif(p.dev, ''), m.developer) as developer, case when coalesce(trim(m.model_family), '') = '' then coalesce(p.fam, m.model_family) else m.model_family end as model_family from models m left join p on m.model_id = p.model_name")
def enrich_fill(spark: SparkSession, d: str) -> DataFrame:
    p = results(spark, d).filter("coalesce(model_developer, '') <> ''").groupBy(F.col("model_name").alias("model_id")).agg(F.min("model_developer").alias("developer"), F.min("model_family").alias("model_family"))
    return rules.upsert(table(spark, d, "models").select("model_id", "developer", "model_family"), p, "model_id", ["developer"], ["model_family"])


@query("with p as (select model_name as name, 'seen' as value from models where model_id like 'B%'), e as (select m.model_id, m.model_name, case when exists (select 1 from p where p.name = m.model_name) then 'seen' else coalesce(m.license, '') end as license from models m) select model_id, license from e")
def guarded_update(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "models").select("model_id", "model_name", F.coalesce("license", F.lit("")).alias("license"))
    p = m.filter(F.col("model_id").like("B%")).select(F.col("model_name").alias("name"), F.lit("seen").alias("value")).distinct()
    return rules.guarded_update(m, "model_name", p, "license").select("model_id", "license")


@query("select row_id, score from results where model_name = 'Humecavomi-70B-Chat'")
def readme_one_model(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).filter(F.col("model_name") == "Humecavomi-70B-Chat").select("row_id", "score")


@query("select benchmark_id, category from benchmarks where contains(lower(category), 'reason')")
def readme_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmarks").filter(F.contains(F.lower("category"), F.lit("reason"))).select("benchmark_id", "category")


@query("select row_id, language from results where language in ('German', 'Hindi', 'Chinese')")
def readme_isin(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).filter(F.col("language").isin("German", "Hindi", "Chinese")).select("row_id", "language")


@query("select benchmark_id, count(distinct model_name) as n_entities from results where benchmark_id in (select benchmark_id from benchmarks) group by 1 having count(distinct model_name) > 0")
def category_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage(results(spark, d), "benchmark_id", "model_name", table(spark, d, "benchmarks").select("benchmark_id"))


# -- duplicates -----------------------------------------------------------------------------------------------------------------


@query("select benchmark_id, count(*) as n_rows from results where benchmark_id is not null group by 1 having count(*) < 5")
def exhaustion(spark: SparkSession, d: str) -> DataFrame:
    return integrity.exhausted(results(spark, d), "benchmark_id")


@query(f"select {KEY_SQL}, count(*) as n_rows from results group by {KEY_SQL} having count(*) > 1")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.groups(results(spark, d), IDENTITY)


@query(f"select {KEY_SQL}, count(*) as n_rows, count(distinct coalesce(score, chr(1))) as n_scores, case when count(distinct coalesce(score, chr(1))) <= 1 then 'redundant' else 'conflict' end as kind from results group by {KEY_SQL} having count(*) > 1")
def dup_classify(spark: SparkSession, d: str) -> DataFrame:
    return dedup.classify(results(spark, d), IDENTITY, "score")


_RESOLVE = f"""with t as (select row_id, score, min(coalesce(score, '')) over (partition by {KEY_SQL}) <> max(coalesce(score, '')) over (partition by {KEY_SQL}) as conflict, {_tier_sql('source_url')} as tier, {YEAR_SQL} as yr, {KEY_SQL} from results),
k as (select row_id, score, row_number() over (partition by {KEY_SQL} order by case when conflict then tier else 0 end, case when conflict then -yr else 0 end, row_id) as n from t) select row_id, score from k where n {{0}} 1"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return dedup.resolve(results(spark, d).select("row_id", "score", "year_evaluated", *IDENTITY), IDENTITY, "score", "row_id", classify.source_tier(F.col("source_url")), _year())


@query(_RESOLVE.format("="))
def dedup_resolve_clean(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).filter("kept").select("row_id", "score")


@query(_RESOLVE.format(">"))
def dedup_resolve_discarded(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).filter("not kept").select("row_id", "score")


@query(f"select min(row_id) as row_id from results group by {KEY_SQL}")
def dedup_results(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first(results(spark, d).select("row_id", *IDENTITY), IDENTITY, "row_id").select("row_id")


@query("select lower(model_id) as model_id, min(model_id) as first_id from models group by 1")
def dedup_models(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "models").select(F.lower("model_id").alias("model_id"), F.col("model_id").alias("first_id"))
    return dedup.keep_first(m, ["model_id"], "first_id")


_DAY = "case when regexp_matches(date_recorded, '^\\d{4}-\\d{2}-\\d{2}$') then try_cast(date_recorded as date) end"


@query(f"select row_id from (select row_id, row_number() over (partition by benchmark_id, model_name, metric_name, source_url order by coalesce({_DAY}, date '0001-01-01') desc, row_id desc) as n from results) where n = 1")
def keep_latest(spark: SparkSession, d: str) -> DataFrame:
    key = list(schema.STAGING_KEY)
    return dedup.keep_latest(results(spark, d).select("row_id", "date_recorded", *key), key, recorded_day(F.col("date_recorded")), "row_id").select("row_id")


@query("with g as (select count(*) as n, count(distinct metric_name) as m, count(distinct source_url) as s from results group by model_name, benchmark_id having count(*) > 1) select case when m > 1 then 'different metrics' when s > 1 then 'different sources' else 'true duplicate' end as kind, count(*) as n_groups, cast(sum(n) as bigint) as n_rows from g group by 1")
def dup_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return dedup.taxonomy(results(spark, d), ["model_name", "benchmark_id"], "metric_name", "source_url")


@query("select row_id, (min(metric_name) over w is not distinct from max(metric_name) over w) and (min(source_url) over w is not distinct from max(source_url) over w) and row_number() over (partition by model_name, benchmark_id, score order by row_id) > 1 as discarded from results window w as (partition by model_name, benchmark_id, score)")
def dup_split(spark: SparkSession, d: str) -> DataFrame:
    return dedup.split_true(results(spark, d), ["model_name", "benchmark_id", "score"], "metric_name", "source_url", "row_id")


@query(f"with v as (select *, {num('score')} as v from results) select count(*) as n_rows, count(*) filter (v is null) as null_scores, count(*) filter (v = 0) as zero_scores, count(*) filter (coalesce(trim(evaluation_id), '') = '') as blank_ids, (select coalesce(cast(sum(n) as bigint), 0) from (select count(*) as n from results group by {KEY_SQL} having count(*) > 1)) as duplicate_rows from v")
def issue_profile(spark: SparkSession, d: str) -> DataFrame:
    return dedup.issue_profile(results(spark, d), text.number(F.col("score")), IDENTITY)


@query(f"select row_id, case when ({num('score')} is null or {num('score')} = 0) and {num('metric_score')} is not null then metric_score else score end as score, case when coalesce(trim(evaluation_id), '') = '' then md5(concat_ws('_', coalesce(model_name, ''), coalesce(benchmark_id, ''), coalesce(source_url, ''))) else evaluation_id end as evaluation_id from results")
def backfill_scores(spark: SparkSession, d: str) -> DataFrame:
    made = writers.evaluation_id(F.col("model_name"), F.col("benchmark_id"), F.col("source_url"))
    out = dedup.backfill(results(spark, d), "score", "metric_score", text.number(F.col("score")), text.number(F.col("metric_score")), made)
    return out.select("row_id", "score", "evaluation_id")


# -- rules ----------------------------------------------------------------------------------------------------------------------

_RENAME = {"Humecavomi-70B-Chat": "Macukaxaco 2 13B Coder", "Macukaxaco 2 13B Coder": "renamed-a", "not there": "renamed-b"}
_GONE = ["Humecavomi-70B-Chat", "Macukaxaco 2 13B Coder", "not there"]
_THERE = "(select model_id from models where model_id in ('Humecavomi-70B-Chat', 'Macukaxaco 2 13B Coder'))"
_SEQ = f"case when {{0}} in {_THERE} and {{0}} in ('Humecavomi-70B-Chat', 'Macukaxaco 2 13B Coder') then case when 'Macukaxaco 2 13B Coder' in {_THERE} then 'renamed-a' else 'Macukaxaco 2 13B Coder' end else {{0}} end"


@query(f"select row_id, model_name from results where model_name is null or model_name not in {_THERE}")
def rule_remove(spark: SparkSession, d: str) -> DataFrame:
    return rules.remove(table(spark, d, "models"), "model_id", results(spark, d), "model_name", _GONE)[1].select("row_id", "model_name")


@query(f"select row_id, {_SEQ.format('model_name')} as model_name, {_SEQ.format('model_id')} as model_id from results")
def rule_rename(spark: SparkSession, d: str) -> DataFrame:
    """Rules run in sequence, so a chain of two ends at the second target."""
    return rules.rename(table(spark, d, "models").select("model_id", "model_name"), results(spark, d), _RENAME)[1].select("row_id", "model_name", "model_id")


@query(f"select model_id from models where model_id not in {_THERE}")
def rule_remap(spark: SparkSession, d: str) -> DataFrame:
    return rules.remap(table(spark, d, "models"), results(spark, d), _RENAME)[0].select("model_id")


@query(f"select row_id, case when setup = '' and model_name in {_THERE} and model_name = 'Humecavomi-70B-Chat' then 'chat' else setup end as setup, case when model_name = 'Humecavomi-70B-Chat' and model_name in {_THERE} then 'Humecavomi-70B' else model_name end as model_name from results")
def rule_setup_extract(spark: SparkSession, d: str) -> DataFrame:
    return rules.setup_extract(table(spark, d, "models"), results(spark, d), {"Humecavomi-70B-Chat": ("Humecavomi-70B", "chat")})[1].select("row_id", "setup", "model_name")


@query("""with r as (select 'quenddialog' as o, 1 as k union all select 'orrerygraph', 2), t as (select coalesce(case when r.o is not null then 'veldlaw' end, b.benchmark_id) as benchmark_id, coalesce(k, 0) as k, b.category, b.year from benchmarks b left join r on b.benchmark_id = r.o)
select benchmark_id, coalesce(min_by(category, k) filter (trim(category) <> ''), min_by(category, k) filter (category is not null)) as category, coalesce(min_by(year, k) filter (trim(year) <> ''), min_by(year, k) filter (year is not null)) as year from t group by 1""")
def rule_merge_items(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmarks").select("benchmark_id", "category", "year")
    return rules.merge_items(b, results(spark, d).select("row_id", "benchmark_id"), {"quenddialog": "veldlaw", "orrerygraph": "veldlaw", "veldlaw": "gone"})[0]


@query(f"select row_id, case when row_id = 5 then '12.5' else score end as score, case when metric_name = 'Acc' then 'Accuracy' else metric_name end as metric_name from results where row_id not in (1, 2, 3)")
def point_corrections(spark: SparkSession, d: str) -> DataFrame:
    return rules.point_corrections(results(spark, d).select("row_id", "score", "metric_name"), "row_id", [1, 2, 3], {5: "12.5"}, {"Acc": "Accuracy"})


@query("select distinct r.model_name as model_id, m.developer from results r left join models m on r.model_name = m.model_id where r.model_name is not null")
def add_missing_dims(spark: SparkSession, d: str) -> DataFrame:
    return rules.add_missing(table(spark, d, "models").select("model_id", "developer"), "model_id", results(spark, d), "model_name")


@query("with t as (select row_id, case when model_name in ('Macukaxaco 2 13B Coder', 'Kozozukahu 6B') then 'Humecavomi-70B-Chat' else model_name end as m, benchmark_id, metric_name, source_url, " + YEAR_SQL + " as y from results) select row_id from (select row_id, row_number() over (partition by m, benchmark_id, metric_name, source_url order by y desc, row_id) as n from t) where n = 1")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    key = list(schema.STAGING_KEY)
    r = results(spark, d).select("row_id", "year_evaluated", *key)
    merged = rules.lookup(r, rules.mapping_frame(r, {"Macukaxaco 2 13B Coder": "Humecavomi-70B-Chat", "Kozozukahu 6B": "Humecavomi-70B-Chat"}), ["model_name"])
    rank = F.struct(-_year(), F.col("row_id"))
    return merged.groupBy(*key).agg(F.min_by("row_id", rank).alias("row_id")).select("row_id")


_SCORE = num("score")


@query(f"""with v as (select *, {_SCORE} as v from results) select 'empty_score' as check_name, count(*) filter (coalesce(trim(score), '') = '') as n_rows from v union all select 'non_numeric', count(*) filter (v is null) from v union all select 'out_of_range', count(*) filter (v < 0 or v > 100) from v
union all select 'unknown_model', count(*) filter (model_name is null or model_name not in (select model_id from models)) from v union all select 'unknown_benchmark', count(*) filter (benchmark_id is null or benchmark_id not in (select benchmark_id from benchmarks)) from v
union all select 'duplicate_key', coalesce(cast(sum(n) as bigint), 0) from (select count(*) as n from results group by benchmark_id, model_name, metric_name, source_url having count(*) > 1)""")
def staging_validate(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "models").select(F.col("model_id").alias("_m"), F.lit(True).alias("_in_m"))
    b = table(spark, d, "benchmarks").select(F.col("benchmark_id").alias("_b"), F.lit(True).alias("_in_b"))
    r = results(spark, d).join(m, F.col("model_name") == F.col("_m"), "left").join(b, F.col("benchmark_id") == F.col("_b"), "left")
    return integrity.staged_issues(r, text.number(F.col("score")), F.coalesce("_in_m", F.lit(False)), F.coalesce("_in_b", F.lit(False)), schema.STAGING_KEY)


@query("with s as (select min(row_id) as row_id from results where row_id % 5 = 0 group by benchmark_id, model_name, metric_name, source_url), k as (select r.* from s join results r using (row_id)) select k.row_id from k where not exists (select 1 from results f where f.row_id % 5 <> 0 and f.benchmark_id is not distinct from k.benchmark_id and f.model_name is not distinct from k.model_name and f.metric_name is not distinct from k.metric_name and f.source_url is not distinct from k.source_url)")
def staging_merge(spark: SparkSession, d: str) -> DataFrame:
    """One part of the rows as staged rows, the other as the facts they are merged into."""
    key = list(schema.STAGING_KEY)
    r = results(spark, d).select("row_id", *key)
    return rules.merge_staged(r.filter("row_id % 5 <> 0"), r.filter("row_id % 5 = 0"), key, "row_id").select("row_id")


# -- statistics and export ------------------------------------------------------------------------------------------------------


@query(f"select model_name, count(distinct benchmark_id) as n_items, count(*) as n_rows, round(avg({_SCORE}), 6) as mean_score from results where model_name is not null group by 1")
def model_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.entity_stats(results(spark, d), "model_name", "benchmark_id", text.number(F.col("score"))).withColumn("mean_score", F.round("mean_score", 6))


@query("select m.model_id, printf('%.1f', coalesce(s.n, 0)) as benchmark_count, printf('%.1f', coalesce(s.k, 0)) as total_results from (select model_id from models) m left join (select model_name, count(distinct benchmark_id)::double as n, count(*)::double as k from results group by 1) s on m.model_id = s.model_name")
def recompute_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.entity_stats(results(spark, d), "model_name", "benchmark_id", text.number(F.col("score")))
    return stats.with_stats(table(spark, d, "models"), "model_id", s, "model_name").select("model_id", "benchmark_count", "total_results")


@query("select model_name, min_by(trim(model_family), row_id) filter (lower(trim(model_family)) not in ('', 'nan')) as model_family, min_by(trim(model_size), row_id) filter (lower(trim(model_size)) not in ('', 'nan')) as model_size from results where model_name is not null group by 1")
def first_nonnull_meta(spark: SparkSession, d: str) -> DataFrame:
    return collapse.first_stated(results(spark, d), "model_name", ["model_family", "model_size"], "row_id")


_PAIRS = f"select model_name, benchmark_id, avg({_SCORE}) as value from results where model_name is not null and benchmark_id is not null group by 1, 2"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    r = collapse.numeric_scores(results(spark, d), text.number(F.col("score")), text.number(F.col("metric_score")))
    return collapse.pair_means(r, "model_name", "benchmark_id")


@query(f"select model_name, benchmark_id, round(value, 6) as value from ({_PAIRS})")
def avg_by_pair(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("value", F.round("value", 6))


@query(f"select p.model_name, p.benchmark_id, round(p.value, 6) as value, m.model_family from ({_PAIRS}) p left join models m on p.model_name = m.model_id")
def collapse_join_meta(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "models").select(F.col("model_id").alias("_m"), "model_family")
    return _pairs(spark, d).join(m, F.col("model_name") == F.col("_m"), "left").select("model_name", "benchmark_id", F.round("value", 6).alias("value"), "model_family")


_KEY10 = "lower(left(model_name, 4))"


@query(f"select {_KEY10} as row_key, benchmark_id as col_key, round(avg(value), 6) as value from ({_PAIRS}) where value is not null group by 1, 2")
def collapse_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the names' means, with the first letters of a name as its collapse key."""
    return collapse.collapsed_cells(_pairs(spark, d), F.lower(F.substring("model_name", 1, 4)), "benchmark_id").withColumn("value", F.round("value", 6))


@query(f"select distinct model_name as model_id, {_KEY10} as collapse_key from results where model_name is not null")
def collapse_mapping(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).filter("model_name is not null").select(F.col("model_name").alias("model_id"), F.lower(F.substring("model_name", 1, 4)).alias("collapse_key")).distinct()


@query("select column_name, least(60, greatest(length(column_name), w) + 2)::int as width from (select max(length(model_name)) as model_name, max(length(benchmark_id)) as benchmark_id, max(length(score)) as score from (select * from results order by row_id limit 20)) unpivot include nulls (w for column_name in (model_name, benchmark_id, score))")
def xlsx_col_widths(spark: SparkSession, d: str) -> DataFrame:
    """Widths follow the header and the first 20 rows by design."""
    return writers.column_widths(results(spark, d).select("row_id", "model_name", "benchmark_id", "score"), "row_id")


@query()
def export_eee_json(spark: SparkSession, d: str) -> DataFrame:
    """The nested record of every result; its text is compared with an independent builder in the tests."""
    return writers.export_records(results(spark, d), table(spark, d, "benchmarks"), "0")


@query("select row_id, try_cast(date_recorded as varchar) as date_recorded, case when regexp_matches(date_recorded, '^\\d{4}-\\d{2}-\\d{2}') then try_cast(date_recorded[1:10] as date) when regexp_matches(date_recorded, '^\\d{4}/\\d{2}/\\d{2}$') then try_cast(replace(date_recorded, '/', '-') as date) when regexp_matches(date_recorded, '^\\d{8}$') then cast(try_strptime(date_recorded, '%Y%m%d') as date) when regexp_matches(date_recorded, '^[A-Za-z]{3} \\d') then cast(try_strptime(date_recorded, '%b %-d, %Y') as date) else cast(try_strptime(date_recorded, '%-d %B %Y') as date) end as day from results")
def recorded_days(spark: SparkSession, d: str) -> DataFrame:
    """The day of every spelling of a date."""
    return results(spark, d).select("row_id", "date_recorded", recorded_day(F.col("date_recorded")).alias("day"))


@query()
def alias_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Registered ids that each unregistered model_id of results may mean."""
    m = table(spark, d, "models")
    names = integrity.fk_violations(results(spark, d), "model_id", m, "model_id").select(F.col("id").alias("name"))
    return aliases.candidates(names, m, "model_id")


_PIPE_KEY = ", ".join(f"coalesce({c}, chr(1))" for c in IDENTITY)


@query(
    f"""with there as {_THERE}, r as (select row_id, case when benchmark_id = 'quenddialog' then 'veldlaw' else benchmark_id end as benchmark_id, case when model_name = 'Humecavomi-70B-Chat' and model_name in (select model_id from models) then 'renamed' else model_name end as model_name,
    case when model_id = 'Humecavomi-70B-Chat' and model_id in (select model_id from models) then 'renamed' else model_id end as model_id, metric_name, setup, reasoning_enabled, num_shot_sample, source_url, language from results
    where model_name is null or not (model_name = 'Macukaxaco 2 13B Coder' and model_name in (select model_id from models))) select min(row_id) as row_id from r group by {_PIPE_KEY}"""
)
def standardise_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """merge, remove, rename, then duplicates: the rows that are left."""
    b, m, r = table(spark, d, "benchmarks"), table(spark, d, "models").select("model_id", "model_name"), results(spark, d).select("row_id", *IDENTITY)
    b, r = rules.merge_items(b, r, {"quenddialog": "veldlaw"})
    m, r = rules.remove(m, "model_id", r, "model_name", ["Macukaxaco 2 13B Coder"])
    m, r = rules.rename(m, r, {"Humecavomi-70B-Chat": "renamed"})
    return dedup.keep_first(r, IDENTITY, "row_id").select("row_id")
