"""Scores in one unit: reading of written numbers, unit cues, and a log-scale mixture where no unit is told.

Defined results. A null, blank or placeholder score reads as no number (``score_num`` null, ``score_states`` false). A number that
no unit its metric allows can hold states no value. A metric name that resolves to no metric leaves the unit unknown: the number
is kept, ``unit`` is null and the row is never converted. Empty tables give empty results; further columns pass through.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.values import SENTINELS
from gridloom.runtime import small_collect

#: The catalog is configuration: it is read by the driver and may have this many metrics at most.
MAX_METRICS = 10_000
BINS_PER_DECADE = 20
#: Spellings that a worker keeps.
MEMO = 1 << 16
SPREAD = 1.5  # bins, width of the smoothing kernel
ZERO_BIN = -9999
#: Rows that the density's prior is worth against the rows with a told unit.
PRIOR_ROWS = 50.0
#: Posterior below which an assigned unit is flagged as uncertain.
SURE = 0.9

# Factors of each unit to the common unit of its metrics; a ratio brings its own factor.
FAMILIES: dict[str, dict[str, float]] = {
    "percent": {"pct": 1.0, "fraction": 100.0, "permille": 0.1},
    "coefficient": {"coefficient": 1.0, "pct": 0.01, "permille": 0.001},
    "points of 10": {"of10": 1.0, "of5": 2.0, "of100": 0.1},
    "bits per byte": {"bits": 1.0, "nats": 1 / math.log(2)},
    "seconds": {"s": 1.0, "ms": 0.001, "min": 60.0},
    "tokens per second": {"tok_s": 1.0, "tok_min": 1 / 60, "ktok_s": 1000.0},
    "US dollars per million tokens": {"usd": 1.0, "cents": 0.01, "usd_1k": 1000.0},
    "kilowatt hours": {"kwh": 1.0, "wh": 0.001, "mj": 1 / 3.6},
}

# Unit cues behind a number.
_AFTER = (
    ("pct", r"^(%|pct\b|percent)"), ("permille", r"^(‰|permille|per mille)"), ("ratio", r"^(/|of\b|out of\b|\(max)\s*\d"),
    ("nats", r"^nats?\b"), ("bits", r"^bits?\b"), ("ms", r"^(ms|msec|millisec)"), ("ktok_s", r"^k\s?tok"), ("tok_min", r"^tok\w*\s?(/|per)\s?min"),
    ("tok_s", r"^tok\w*\s?(/|per)\s?s"), ("min", r"^min"), ("s", r"^(s|secs?|seconds?)\b"), ("cents", r"^(ct|cents?|¢)"), ("kwh", r"^(kwh|kilowatt)"),
    ("wh", r"^(wh|watt)"), ("mj", r"^(mj|megajoule)"),
)

# Unit cues in a metric name, in lower case with punctuation other than % and $ as spaces.
_IN_NAME = (
    ("of100", r"\b(out of 100|100 points)\b"), ("of10", r"\b(out of 10|10 points|1 10|0 10)\b"), ("of5", r"\b(out of 5|five point|5 points|1 5)\b"),
    ("pct", r"%|\bpercent(age)?\b|\b0 100\b|\btimes 100\b|\bx100\b|\b100 100\b"), ("permille", r"\bper ?mille\b"), ("fraction", r"\b(0 1|share|proportion|fraction)\b"),
    ("nats", r"\bnats\b"), ("bits", r"\bbits per byte\b"), ("ms", r"\b(ms|msec|milliseconds?)\b"), ("ktok_s", r"\bk ?tok"), ("tok_min", r"\btok\w* (per )?min"),
    ("tok_s", r"\btok\w* (per )?s"), ("usd_1k", r"\b(1k tok\w*|thousand tokens)\b"), ("cents", r"\bcents?\b"), ("kwh", r"\b(kwh|kilowatt hours?)\b"), ("mj", r"\b(mj|megajoules?)\b"),
    ("wh", r"\b(wh|watt hours?)\b"), ("min", r"\bminutes?\b"), ("s", r"\bseconds?\b"),
)


@dataclass(frozen=True)
class Metric:
    key: str
    names: tuple[str, ...]
    common: str
    low: float | None
    high: float | None
    units: tuple[tuple[str, float], ...]  # the common unit first


def _spaced(text: str) -> str:
    return " ".join("".join(ch if ch.isalnum() else " " for ch in text.lower()).split())


def load_catalog(metric_units: DataFrame) -> list[Metric]:
    """The metrics of a units table with columns metric_key, metric_title, other_names, common_unit, min_score and max_score."""
    out = []
    for r in small_collect(metric_units, MAX_METRICS, "metric_units"):
        names = {_spaced(x) for x in (r.metric_key, r.metric_title or "", *(r.other_names or "").split("|"))} - {""}
        units = FAMILIES.get(r.common_unit, {"common": 1.0})
        out.append(Metric(r.metric_key, tuple(sorted(names)), next(iter(units)), r.min_score, r.max_score, tuple(units.items())))
    return sorted(out, key=lambda m: m.key)


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


# A number is grouped by thousands (1,234.5 or 1.234,5 or 12 345), or has one decimal mark, which may be a comma (83,477 is 83.477).
_GROUPED = re.compile(r"[+\-−]?\d{1,3}(?:(?P<g>[, '’.])\d{3}(?:(?P=g)\d{3})+(?:(?!(?P=g))[.,]\d+)?|(?P<h>[,.])\d{3}(?!(?P=h))[.,]\d+|[ '’]\d{3}(?:[.,]\d+)?)(?![\d.,])")
_SHAPE = re.compile(r"([~≈<>$€£ ]*)([+\-−]?(?:\d+(?:[.,]\d+)?|[.,]\d+)(?:[eE][+-]?\d+)?)(?!\d*[.,]\d)(.*)", re.S)
_PLAIN = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)")
_ERROR = re.compile(r"\(?±\s*[\d.,]+\)?")
_DIGITS = re.compile(r"\d+")


class ScoreReader:
    """Reads one written score under one metric name; what it learns of a spelling is kept for the next row with it."""

    def __init__(self, catalog: list[Metric]):
        self.by = {m.key: m for m in catalog}
        self.alias = {n: m.key for m in catalog for n in m.names}
        names = sorted(self.alias, key=lambda n: (-len(n), n))
        self.names = re.compile(r"(?<![a-z0-9])(" + "|".join(map(re.escape, names)) + r")(?![a-z0-9])") if names else None
        self.after = [(u, re.compile(p)) for u, p in _AFTER]
        self.in_name = [(u, re.compile(p)) for u, p in _IN_NAME]
        self.metric = lru_cache(MEMO)(self._metric)
        self.written = lru_cache(MEMO)(self._written)

    def _metric(self, name: str | None) -> tuple[str | None, str | None]:
        """The metric and the unit that a metric name tells."""
        text = re.sub(r"[^a-z0-9%$]+", " ", unicodedata.normalize("NFKC", name or "").lower()).strip()
        hit = self.names.search(text) if self.names else None
        rest = text if not hit else text[: hit.start()] + " | " + text[hit.end() :]
        return self.alias[hit.group(1)] if hit else None, next((u for u, p in self.in_name if p.search(rest)), None)

    def _written(self, score: str | None) -> tuple[float | None, str | None, float | None, bool]:
        """The number, the unit told beside it, the denominator of a ratio, and whether it stands alone. A text that is no
        finite number, or is followed by another number that no unit explains, has none of them."""
        text = re.sub(r"[\s\u200b-\u200f\u2060\ufeff]+", " ", unicodedata.normalize("NFKC", score or "")).strip()
        if _PLAIN.fullmatch(text):
            x = float(text)
            return (x if math.isfinite(x) else None), None, None, True
        lead = len(text) - len(text.lstrip("~≈<>$€£ "))
        grouped = _GROUPED.match(text, lead)
        if grouped:
            marks = [ch for ch in grouped.group() if ch in ".,"]
            group = grouped["g"] or grouped["h"] or next(ch for ch in grouped.group() if ch in " '’")
            digits = grouped.group().replace(group, "")
            if group in ".," and len(set(marks)) == 1 and len(marks) == 1:
                digits = grouped.group()
            text = text[:lead] + digits.replace(",", ".") + text[grouped.end() :]
        hit = _SHAPE.fullmatch(text)
        if not hit:
            return None, None, None, False
        x = float(hit.group(2).replace(",", ".").replace("−", "-"))
        rest = _ERROR.sub("", hit.group(3).lower().strip(), count=1).strip()
        if not math.isfinite(x) or rest[:1].isdigit():
            return None, None, None, False
        unit = next((u for u, p in self.after if p.search(rest)), None) or ("usd" if "$" in hit.group(1) else None)
        return x, unit, float(_DIGITS.search(rest).group()) if unit == "ratio" else None, not rest

    def __call__(self, score: str | None, name: str | None, metric: str | None, top: str | None) -> tuple:
        x, after, of, alone = self.written(score)
        key, told = self.metric(name)
        if key is None and metric:
            key = self.metric(metric)[0]
        if key is None and alone and x in SENTINELS:
            x = None
        if x is None or key is None:
            return key, x, None, None, x is not None
        m = self.by[key]
        units, common = dict(m.units), m.common
        if after == "ratio":
            unit = {5.0: "of5", 10.0: "of10", 100.0: "of100"}.get(of, "ratio") if common == "of10" else "ratio"
        elif after and after in units and not (after == "usd" and told == "usd_1k"):
            unit = after
        elif told and told in units:
            unit = told
        else:
            unit = _TOP.get((common, (top or "").strip().removesuffix(".0")))
        if unit == "ratio":
            factor = (10.0 if common == "of10" else 1.0 if common == "coefficient" else 100.0) / of if of else None
        else:
            factor = units.get(unit)
        if factor is None:
            unit = None
        low, high = -math.inf if m.low is None else m.low - 1e-9, math.inf if m.high is None else m.high + 1e-9
        # Negative runs of nines always stand in for a missing value, positive ones unless a told unit holds them, and -1 where its told
        # unit, else the common unit, can't hold it.
        if alone and x in SENTINELS and (x <= -99.0 or x > 0 and factor is None or not low <= x * (factor or 1.0) <= high):
            return key, None, None, None, False
        factors = [factor] if factor is not None else list(units.values())
        return key, x, unit, factor, any(low <= x * f <= high for f in factors)


# The unit that a stated upper bound tells, by common unit.
_TOP = {("pct", "1"): "fraction", ("pct", "100"): "pct", ("of10", "5"): "of5", ("of10", "10"): "of10", ("of10", "100"): "of100"}

#: Columns that the operators add; a table's own columns of these names, and any that begin with __gl_, are replaced.
ADDED = ("metric_key", "score_num", "unit", "factor", "score_states", "unit_source", "unit_posterior", "unit_uncertain", "score_common", "other_unit")
_READ = "metric_key string, score_num double, unit string, factor double, score_states boolean"


def read_scores(df: DataFrame, catalog: list[Metric]) -> DataFrame:
    """Add metric_key, score_num (as stated), unit (told, else null), factor (of the told unit) and score_states.

    Needs score and metric_name; metric and metric_max_score are used where present. The unit is told by what follows the number,
    else by the metric name, else by the stated upper bound. An Arrow function on purpose: as one Catalyst expression the sixty
    patterns exceed the 64 KB that the JVM compiles (measured: 79 s for 100,000 rows, interpreted); spellings repeat, so the
    function mostly looks them up.
    """

    @F.pandas_udf(_READ)
    def read(score: pd.Series, name: pd.Series, metric: pd.Series, top: pd.Series) -> pd.DataFrame:
        reader = _reader(tuple(catalog))
        rows = [reader(*row) for row in zip(score, name, metric, top)]
        return pd.DataFrame(rows, columns=["metric_key", "score_num", "unit", "factor", "score_states"], dtype=object).astype({"score_num": float, "factor": float, "score_states": bool})

    has = set(df.columns)
    text = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    read_ = read(*map(text, ("score", "metric_name", "metric", "metric_max_score")))
    return df.withColumn("__gl_read", read_).select(*[f"`{c}`" for c in df.columns if c not in ADDED], "__gl_read.*")


@lru_cache(4)
def _reader(catalog: tuple[Metric, ...]) -> ScoreReader:
    return ScoreReader(list(catalog))


def _bin(x: Column) -> Column:
    return F.when(x == 0, F.lit(ZERO_BIN)).otherwise(F.floor(F.log10(F.abs(x)) * BINS_PER_DECADE).cast("int"))


def fit_units(read: DataFrame, catalog: list[Metric], sweeps: int = 40) -> dict[tuple[str, int], tuple[str, float, float]]:
    """For each metric and magnitude of a number without a told unit: its likeliest unit, that unit's factor and the posterior.

    One aggregation over all rows counts numbers by metric, told unit and log bin. On the driver (metrics x units x bins, bounded
    by the catalog and the range of doubles) each metric's density over the log of the common unit is taken from the rows with a
    told unit; the numbers without one follow a mixture of that density shifted by each unit's known factor, and EM fits the
    shares of the units. EM refits the density as well, with the untold rows weighted by PRIOR_ROWS / (PRIOR_ROWS + told rows).
    """
    counts = read.filter("score_states and metric_key is not null").groupBy("metric_key", "unit", "factor", _bin(F.col("score_num")).alias("bin")).agg(F.count("*").alias("n"))
    # Ratios bring any factor, so they are folded into the common unit before the counts leave the cluster.
    common_bin = F.when(F.col("bin") == ZERO_BIN, F.col("bin")).otherwise((F.col("bin") + F.round(F.log10("factor") * BINS_PER_DECADE)).cast("int"))
    told = F.col("factor").isNotNull()
    counts = counts.select("metric_key", told.alias("told"), F.when(told, common_bin).otherwise(F.col("bin")).alias("bin"), "n").groupBy("metric_key", "told", "bin").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    by = {m.key: m for m in catalog}
    out: dict[tuple[str, int], tuple[str, float, float]] = {}
    for key in sorted({r.metric_key for r in rows} & by.keys()):
        m = by[key]
        mine = [r for r in rows if r.metric_key == key and r.bin != ZERO_BIN]
        out[(key, ZERO_BIN)] = (m.common, 1.0, 1.0)
        free = {r.bin: r.n for r in mine if not r.told}
        if not free:
            continue
        shifts = [round(math.log10(f) * BINS_PER_DECADE) for _, f in m.units]
        lo = min([r.bin for r in mine]) + min(shifts) - 10
        size = max([r.bin for r in mine]) + max(shifts) + 10 - lo
        seen = np.zeros(size)
        for r in mine:
            if r.told:
                seen[r.bin - lo] += r.n
        wide = np.arange(-8, 9)
        kernel = np.exp(-0.5 * (wide / SPREAD) ** 2)
        smooth = lambda v, k=kernel: (lambda y: (y + 1e-7 * y.sum() + 1e-12) / (y + 1e-7 * y.sum() + 1e-12).sum())(np.convolve(v, k / k.sum(), "same"))
        bins, n = np.array(sorted(free)), np.array([free[b] for b in sorted(free)], float)
        top = m.high if m.high is not None else math.inf
        at = 10 ** (bins / BINS_PER_DECADE)
        can = np.array([[a * f <= top * (1 + 1e-9) for _, f in m.units] for a in at])
        can[~can.any(1), 0] = True
        # Told rows are evidence against a prior of PRIOR_ROWS: the more of them, the less the untold rows shape the density.
        trust = PRIOR_ROWS / (PRIOR_ROWS + seen.sum())
        base = seen.copy()
        np.add.at(base, bins - lo, trust * n)
        density, share = smooth(base), np.r_[0.9, np.full(len(shifts) - 1, 0.1 / max(1, len(shifts) - 1))][: len(shifts)]
        where = bins[:, None] - lo + np.array(shifts)[None, :]
        for _ in range(sweeps):
            post = share * density[where] * can
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            share = (post * n[:, None]).sum(0) + 1e-3
            share /= share.sum()
            base = seen.copy()
            np.add.at(base, where, trust * post * n[:, None])
            density = smooth(base)
        for b, p in zip(bins, post):
            best = int(p.argmax())
            out[(key, int(b))] = (m.units[best][0], m.units[best][1], float(p[best]))
    return out


def to_common_units(df: DataFrame, catalog: list[Metric]) -> DataFrame:
    """``read_scores`` plus score_common, unit, factor, unit_source (told, fitted or none), unit_posterior, unit_uncertain and
    other_unit: whether the score states a value in another unit than the common one."""
    return with_common_units(read_scores(df, catalog), catalog)


def with_common_units(read: DataFrame, catalog: list[Metric]) -> DataFrame:
    """``to_common_units`` of scores that are already read; they are scanned twice."""
    fitted = fit_units(read, catalog)
    spark = read.sparkSession
    rows = [(k, b, u, f, p) for (k, b), (u, f, p) in fitted.items()]
    # At most metrics x log bins of a double rows.
    units = F.broadcast(spark.createDataFrame(rows, "metric_key string, __gl_bin int, __gl_u string, __gl_f double, __gl_p double"))
    known = {m.key: m.common for m in catalog}
    joined = read.withColumn("__gl_bin", F.when(F.col("score_states") & F.col("factor").isNull(), _bin(F.col("score_num")))).join(units, ["metric_key", "__gl_bin"], "left")
    source = F.when(~F.col("score_states"), "none").when(F.col("factor").isNotNull(), "told").when(F.col("__gl_u").isNotNull(), "fitted").otherwise("none")
    return (
        joined.withColumn("unit_source", source)
        .withColumn("unit", F.when(F.col("score_states"), F.coalesce("unit", "__gl_u")))
        .withColumn("factor", F.when(F.col("score_states"), F.coalesce("factor", "__gl_f")))
        .withColumn("unit_posterior", F.when(F.col("unit_source") == "fitted", F.col("__gl_p")).when(F.col("unit_source") == "told", 1.0))
        .withColumn("unit_uncertain", F.coalesce(F.col("unit_posterior") < SURE, F.lit(False)))
        .withColumn("score_common", F.when(F.col("score_states"), F.col("score_num") * F.coalesce("factor", F.lit(1.0))))
        .withColumn("other_unit", F.col("score_states") & F.col("unit").isNotNull() & (F.col("unit") != F.element_at(_map(known), F.col("metric_key"))) if known else F.lit(False))
        .drop("__gl_bin", "__gl_u", "__gl_f", "__gl_p")
    )
