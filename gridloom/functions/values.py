"""Whether a freely typed field states a value, and folding of its spelling. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand in for a missing value, after lower case and with punctuation as spaces.
PLACEHOLDERS = (
    "", "n a", "na", "none", "null", "nil", "nan", "unknown", "unk", "tbd", "tba", "missing", "undefined", "unspecified", "empty", "blank",
    "not reported", "not available", "not applicable", "not given", "not stated", "not specified", "not provided", "not known", "not recorded",
    "pending", "to be announced", "to be determined", "no data", "no value", "see appendix", "see paper", "see table", "see text", "see notes",
    "x", "xx", "xxx", "dnf", "oom", "timeout", "error", "failed", "nd", "n d",
)

# Numbers that stand in for a missing value.
SENTINELS = (-1.0, -99.0, -999.0, -9999.0, 9999.0, 99999.0, 999999.0)

LONGEST_PLACEHOLDER = 24

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def fold_width(c: Column) -> Column:
    """Full-width characters as their narrow forms."""
    return F.when(c.rlike("[！-～　]"), F.translate(c, _WIDE, _NARROW)).otherwise(c)


def states_value(c: Column) -> Column:
    """False for null, blank, punctuation only, a placeholder text or a sentinel number; true otherwise."""
    bare = F.trim(F.regexp_replace(F.lower(fold_width(c)), r"[^\p{L}\p{N}]+", " "))
    short = ~bare.isin(*PLACEHOLDERS) & ~c.rlike(r"^\s*-?(1|9{2,})(\.0+)?\s*$") & ~c.rlike(r"(?i)^\s*(see table|tba|tbd|err:?)\s+\w+\s*$")
    long_ = c.rlike(r"[\p{L}\p{N}]")
    return c.isNotNull() & F.when(F.length(c) > LONGEST_PLACEHOLDER, long_).otherwise(short)


def recorded_day(c: Column) -> Column:
    """The day of a date written as 2024-05-30, 2024/05/30, 20240530, 2024-05-30T..., 'May 3, 2024' or '3 May 2024'; else null."""
    t = F.trim(c)
    iso = F.regexp_replace(F.regexp_extract(t, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1), "/", "-")
    return (
        F.when(t.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"), iso.try_cast("date"))
        .when(t.rlike(r"^\d{8}$"), F.concat_ws("-", t.substr(1, 4), t.substr(5, 2), t.substr(7, 2)).try_cast("date"))
        .when(t.rlike(r"^[A-Za-z]{3,9}\.? \d{1,2},? \d{4}$"), _worded(F.regexp_extract(t, r"^([A-Za-z]{3})", 1), F.regexp_extract(t, r" (\d{1,2}),? \d{4}$", 1), t.substr(-4, 4)))
        .when(t.rlike(r"^\d{1,2}\.? [A-Za-z]{3,9}\.?,? \d{4}$"), _worded(F.regexp_extract(t, r" ([A-Za-z]{3})", 1), F.regexp_extract(t, r"^(\d{1,2})", 1), t.substr(-4, 4)))
    )


def _worded(month: Column, day: Column, year: Column) -> Column:
    pos = F.call_function("position", F.lower(month), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    m = ((pos + 2) / 3).cast("int")
    return F.when((pos > 0) & (pos % 3 == 1), F.concat_ws("-", year, F.lpad(m.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date"))


def url_host(c: Column) -> Column:
    """Lower-case host of a URL with or without scheme, user and port; null where there is none."""
    authority = F.regexp_extract(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#\s]+)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$|\.$", "")
    return F.nullif(host, F.lit(""))
