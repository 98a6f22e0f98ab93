"""Source tiers and the ordered keep / flag / remove cascade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import schema


def _any_part(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def source_tier(url: Column, tiers: dict[int, tuple[str, ...]] | None = None, unknown: int = schema.UNKNOWN_TIER) -> Column:
    """First tier of which a host fragment is part of the URL, in lower case."""
    text, out = F.lower(F.coalesce(url, F.lit(""))), F.lit(unknown)
    for tier, parts in sorted((tiers or schema.TRUST_TIERS).items(), reverse=True):
        out = F.when(_any_part(text, parts), tier).otherwise(out)
    return out


def trusted_developer(developer: Column) -> Column:
    """A trusted name is part of the developer, or the developer is part of a trusted name."""
    d = F.lower(F.btrim(developer))
    known = F.array(*[F.lit(t.lower()) for t in schema.TRUSTED_DEVELOPERS])
    return F.coalesce((developer != "") & F.exists(known, lambda t: F.contains(d, t) | F.contains(t, d)), F.lit(False))


def categorize(model_id: Column, name: Column, family: Column, developer: Column, model_type: Column, base: Column) -> Column:
    """struct(category, reason); the first rule that applies decides. Nulls count as empty."""
    mid, name, family, developer, base = (F.coalesce(c, F.lit("")) for c in (model_id, name, family, developer, base))
    kind = F.lower(F.coalesce(model_type, F.lit("")))
    trusted = trusted_developer(developer)
    scratch = _any_part(F.lower(F.concat_ws(" ", mid, name, developer)), schema.FROM_SCRATCH)
    tuned = _any_part(F.lower(name), schema.FINE_TUNE_WORDS)
    or_unknown = lambda c: F.when(c == "", "unknown").otherwise(c)
    said = lambda category, *reason: F.struct(F.lit(category).alias("category"), F.concat(*reason).alias("reason"))
    t = F.lit
    return (
        F.when((kind == "closed") & trusted, said("KEEP", t("Closed model from trusted dev ("), developer, t(")")))
        .when(trusted & (family != ""), said("KEEP", t("Trusted dev ("), developer, t(") with clear family ("), family, t(")")))
        .when(base != "", said("KEEP", t("Has base_model: "), base))
        .when(trusted, said("KEEP", t("Open model from trusted dev ("), developer, t(")")))
        .when(scratch, said("KEEP", t("Known from-scratch pattern")))
        .when((family != "") & tuned, said("KEEP", t("Fine-tuned but family known: "), family))
        .when(family != "", said("KEEP", t("From-scratch with family: "), family))
        .when(tuned, said("REMOVE", t("Fine-tuned name, no family/base_model/trusted dev (dev: "), or_unknown(developer), t(")")))
        .otherwise(said("FLAG", t("No family/base_model, unclear origin (dev: "), or_unknown(developer), t(", type: "), or_unknown(kind), t(")")))
    )
