"""Name and score normalisers as column expressions. A null stays null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.schema import ABSOLUTE_METRICS, COMMON_SIZES, DROPPED_TOKENS, STATUS_MARKS, VARIANT_TOKENS

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(c: Column) -> Column:
    """The double a text writes out in full, else null; unlike a bare cast it takes neither suffixes nor nan or inf."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def standard_id(c: Column) -> Column:
    """Lower case, space and underscore as hyphen, plus spelled out, single hyphens, none at the ends."""
    s = F.replace(F.translate(F.lower(F.btrim(c)), " _", "--"), F.lit("+"), F.lit("-plus"))
    return strip_chars(F.regexp_replace(s, "-+", "-"), "-")


def without_org(c: Column) -> Column:
    """What follows the first slash, or all of it."""
    return F.regexp_replace(c, r"^[^/]*/", "")


def without_dates(c: Column) -> Column:
    """Without a hyphen-and-ampersand tail, effort phrases, dates and four-digit numbers, in this order."""
    s = strip_chars(F.regexp_replace(c, r"(?s)-+&.*$", ""), "-_. ")
    for pattern in (r"\bmedium[-_ ]+effort\b", r"\bhigh[-_ ]+reasoning\b", r"\b\d{4}[-_/]\d{2}[-_/]\d{2}\b", r"\b20\d{6}\b", r"\b\d{2}[-_/]\d{2}\b", r"\b\d{4}\b"):
        s = F.regexp_replace(s, pattern, "")
    return s


def parens_to_size(c: Column) -> Column:
    """Each parenthesis becomes the size (70b, 1.5M) in it, or nothing."""
    sized = F.regexp_replace(c, r"\((?:[^)]*?[^A-Za-z0-9_)])??(\d+(?:\.\d+)?[mbMB])\b[^)]*\)", "$1")
    return F.regexp_replace(sized, r"\([^)]*\)", "")


def version_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"\b(\d+)[-_](\d+)\b", "$1.$2")


def without_marks(c: Column) -> Column:
    return F.btrim(F.translate(c, STATUS_MARKS, ""))


def slug(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), strip_chars(F.regexp_replace(F.lower(F.btrim(c)), "[^a-z0-9]+", "_"), "_"))


def has_keyword(c: Column, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    """No excluded keyword and some included one, as parts of the lower-case text."""
    t = F.lower(c)
    yes = F.exists(F.array(*map(F.lit, include)), lambda k: F.contains(t, k))
    return yes & ~F.exists(F.array(*map(F.lit, exclude)), lambda k: F.contains(t, k)) if exclude else yes


def scaled_score(score: Column, metric: Column) -> Column:
    """Fractions as percentages (at most 100), rounded to 4 places; scores of absolute metrics as they are, to 6."""
    v = number(score)
    return F.when(metric.isin(*ABSOLUTE_METRICS), F.round(v, 6)).when(v.between(0, 1), F.least(F.round(v * 100, 4), F.lit(100.0))).otherwise(F.round(v, 4))


def leaderboard_score(aggregate: Column, kind: Column, children: Column, results: Column) -> Column:
    """Score of a leaderboard row: its aggregate unless its kind is NOOP, where a count over several children is none, else the
    first of its per-task results; fractions as percentages, 2 places."""
    scale = lambda v: F.when(v.between(0, 1), F.round(v * 100, 2)).otherwise(F.round(v, 2))
    first = F.get(F.filter(results, lambda v: v.isNotNull()), F.lit(0))
    usable = F.when(aggregate.between(0, 1) | ((aggregate > 1) & (aggregate <= 100) & (children <= 1)), scale(aggregate))
    return F.when((kind != "NOOP") & aggregate.isNotNull(), usable).otherwise(scale(first))


def coarse_key(model_id: Column, family: Column) -> Column:
    """First token with a letter of the family, else of the cleaned id, else ``unknown``."""
    first = lambda s, sep: F.get(F.filter(F.transform(F.split(s, sep), lambda t: F.regexp_replace(t, "[^a-z0-9]", "")), lambda t: t.rlike("[a-z]")), F.lit(0))
    fam = F.lower(F.btrim(family))
    by_family = F.when(~fam.rlike(r"^\d+(\.\d+)?b?$"), first(fam, r"[\s\-_/]"))
    by_id = first(without_dates(parens_to_size(without_org(F.lower(F.btrim(model_id))))), r"[\-_/\s]")
    return F.coalesce(by_family, by_id, F.lit("unknown"))


def with_fine_key(df: DataFrame, model_id: str, family: str, size: str, out: str = "collapse_key") -> DataFrame:
    """Adds the conservative key: family with merged versions, kept tokens, size.

    The id is cleaned and, after the family's first word, cut into tokens. One fold over the tokens keeps (base, versions of the
    family in order of appearance, kept tokens, versions seen, size): dropped words and context lengths fall out, a size replaces
    an earlier one, a version that extends a family version (or is extended by it) replaces it in the base, and others are kept once.
    Each stage is a column of its own, so that no stage is evaluated more than once.
    """
    none = F.array().cast("array<string>")
    mid, fam, declared = F.col(model_id), F.col("_fam"), F.col("_declared")
    df = df.withColumn("_id", version_dots(without_dates(parens_to_size(without_org(F.btrim(F.lower(F.coalesce(mid, F.lit(""))))))))).withColumn("_fam", F.btrim(F.regexp_replace(F.coalesce(family, F.lit("")), r"[^A-Za-z0-9\s.\-]", "")))
    df = df.withColumn("_fam", F.when((fam != "") & ~fam.rlike(r"^\d+(\.\d+)?$"), fam)).withColumn("_head", F.lower(F.get(F.split(fam, r"[-\s]"), F.lit(0)))).withColumn("_declared", number(F.col(size)))
    df = df.withColumn("_at", F.call_function("position", F.col("_head"), F.col("_id")))
    suffix = F.when(fam.isNull(), F.col("_id")).when(F.col("_at") > 0, strip_chars(F.call_function("substring", F.col("_id"), F.col("_at") + F.length("_head")), "-_. ")).otherwise(F.col("_id"))
    df = df.withColumn("_tokens", F.filter(F.transform(F.split(suffix, r"[^A-Za-z0-9.]+"), lambda t: strip_chars(t, ". ")), lambda t: t != "")).withColumn("_base", F.lower(F.regexp_replace(fam, r"\s+", "-")))
    plain = lambda x: F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(F.regexp_replace(x.cast("string"), r"0+$", ""))
    dropped_set = F.array(*map(F.lit, DROPPED_TOKENS))
    start = F.struct(
        F.coalesce("_base", F.lit("")).alias("base"), F.when(F.col("_base").isNull(), none).otherwise(F.array_distinct(F.regexp_extract_all("_base", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))).alias("known"), none.alias("kept"), none.alias("seen"), F.lit(None).cast("string").alias("size")
    )

    def step(acc: Column, token: Column) -> Column:
        dropped = F.array_contains(dropped_set, token) | token.rlike(r"^\d+[kK]$|^[12][mM]$")
        variant = token.isin(*VARIANT_TOKENS)
        sized = token.rlike(r"^\d+(\.\d+)?[bB]$")
        value = F.regexp_replace(token, "[bB]$", "").try_cast("double")
        bare = token.rlike(r"^\d+(\.\d+)?$")
        is_size = sized | (bare & (F.coalesce(F.abs(declared - value) < 0.01, F.lit(False)) | value.isin(*map(float, COMMON_SIZES))))
        hit = F.get(F.filter(acc["known"], lambda v: token.startswith(v) | v.startswith(token)), F.lit(0))
        longer = F.when(F.length(token) > F.length(hit), token).otherwise(hit)
        fresh = hit.isNull() & ~F.array_contains(acc["seen"], token)
        made = lambda **new: F.struct(*[new.get(k, acc[k]).alias(k) for k in ("base", "known", "kept", "seen", "size")])
        kept = F.concat(acc["kept"], F.array(token))
        return (
            F.when(dropped, acc).when(variant, made(kept=kept)).when(is_size, made(size=F.concat(plain(value), F.lit("B"))))
            .when(bare & hit.isNotNull(), made(base=F.replace(acc["base"], hit, longer), known=F.concat(F.filter(acc["known"], lambda v: v != hit), F.array(longer))))
            .when(bare & fresh, made(kept=kept, seen=F.concat(acc["seen"], F.array(token)))).when(~bare & (F.length(token) > 2), made(kept=kept)).otherwise(acc)
        )

    df = df.withColumn("_folded", F.aggregate("_tokens", start, step))
    folded = F.col("_folded")
    fallback = F.when(F.btrim(F.col(size)).rlike(r"^\d+$"), F.concat(F.format_string("%d", declared.cast("long")), F.lit("B")))
    df = df.withColumn("_parts", F.concat(F.when(F.col("_base").isNull(), none).otherwise(F.array(folded["base"])), folded["kept"], F.array_compact(F.array(F.coalesce(folded["size"], fallback)))))
    blank = F.coalesce(F.btrim(mid), F.lit("")) == ""
    key = F.array_join("_parts", "-")
    done = df.withColumn(out, F.when(F.col("_base").isNotNull(), key).when(blank, "unknown").when(F.size("_parts") == 0, mid).otherwise(key))
    return done.drop("_id", "_fam", "_head", "_declared", "_at", "_tokens", "_base", "_folded", "_parts")
