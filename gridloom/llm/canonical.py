"""Freely typed names mapped to the entries of a reference list: token repair by edit distance, then soft TF-IDF over entries.

Defined results. A name that names no entry is reported with an empty entry. Of entries that score equally the first by id is taken.
A slip that is equally near to several families is kept as all of them, and the complete entries decide; one that is equally
near to several kinds is not repaired. Null and placeholder names are not reported. Empty tables give empty results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import cut

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухікѕјԁһԛԝвмнтαοερτυνκι", "aeopcyxiksjdhqwbmhtaoeptuvki")
# Usual short names of kinds that no rule derives (vision-language, instruction-tuned).
KIND_ALIASES = {"vl": "vision", "it": "instruct"}
# Words of results that are of people, chance or several models, and so of no single model.
NO_MODEL = frozenset({"human", "humans", "expert", "experts", "crowd", "crowdworkers", "annotators", "random", "chance", "guess", "majority", "oracle", "ensemble", "committee"})
_BILLION, _MILLION = frozenset({"b", "bn", "bil", "billion", "billions"}), frozenset({"m", "mn", "mil", "million", "millions"})

_DATE = regex.compile(r"(?<!\d)(?:19|20)\d{2}([-/._ ]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])(?!\d)")
_TOKEN = regex.compile(r"\d+(?:\.\d+)?|[^\W\d_]+|\+")
_GLUED = regex.compile(r"(?<=\d)(b)(?=[^\W\d_]{3,})")
# Units of a number that is neither version nor size.
_OTHER_UNITS = frozenset({"bit", "bits", "shot", "shots", "k"})
_MARK = regex.compile(r"[\p{So}\p{No}\p{Sk}\p{Cf}]")

#: Edits that are forgiven, by length of the shorter word.
LONG_WORD, LONG_EDITS, SHORT_WORD, SHORT_EDITS = 8, 2, 4, 1

#: Score that the best entry must reach: a family's slips lower it to about 0.75, another family is at most at 0.3.
MIN_SCORE = 0.6

_PARSED = "words array<string>, numbers array<string>, size string, none boolean"


def parse_name(name: str) -> tuple[list[str], list[str], str, bool]:
    """Words, numbers, size in billions and whether the name is of no model. A plus sign stays with its word; dates and marks are
    dropped, and so are numbers with a unit that isn't a size."""
    text = unicodedata.normalize("NFKC", _MARK.sub(" ", name)).casefold().translate(LOOKALIKES)
    text = "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn")
    found = _TOKEN.findall(_GLUED.sub(r"\1 ", _DATE.sub(" ", text)))
    words, numbers, sizes, i = [], [], [], 0
    while i < len(found):
        t, after = found[i], found[i + 1] if i + 1 < len(found) else ""
        if t[0].isdigit():
            if after in _BILLION:
                sizes.append(f"{float(t):g}")
                i += 1
            elif after in _MILLION:
                sizes.append(f"{float(t) / 1000:g}")
                i += 1
            elif after not in _OTHER_UNITS:
                numbers.append(f"{float(t):g}")
        elif t in ("+", "plus"):
            if words:
                words[-1] += "+"
        elif t not in ("v", "version") or not after[:1].isdigit():
            words.append(t)
        i += 1
    return words, numbers, " ".join(sizes), bool(NO_MODEL & set(words))


def _parse(df: DataFrame, column: str) -> DataFrame:
    @F.pandas_udf(_PARSED)
    def parse(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_name(n) for n in names], columns=["words", "numbers", "size", "none"])

    return df.withColumn("__gl_p", parse(column)).select(*df.columns, "__gl_p.*")


def _variants(word: str, edits: int) -> list[str]:
    """The word and all it becomes by up to ``edits`` deletions; two words within that many edits share one of these."""
    out = level = {word}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return sorted(out)


def _neighbours(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(lambda w: _variants(w, LONG_EDITS if len(w) >= LONG_WORD - LONG_EDITS else SHORT_EDITS if len(w) >= SHORT_WORD - SHORT_EDITS else 0))


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame, ties: bool = False) -> DataFrame:
    """(token, word, edits) for each distinct token that is a vocabulary word or within the forgiven edits of a single nearest one;
    with ``ties``, of each nearest one.

    Candidates come from an equality join on deletion variants, which finds every pair within the edits; no token is compared with
    the whole vocabulary. A swap of two neighbouring letters counts as one edit among equals: it leaves the letters as they are.
    """
    words = vocabulary.select("word")
    exact = tokens.join(words.hint("merge"), tokens["token"] == words["word"], "left")
    exact = cut(exact, "tokens") if ties else exact
    rest = exact.filter("word is null").select("token").filter(F.length("token") >= SHORT_WORD - SHORT_EDITS)
    exact = exact.filter("word is not null").select("token", "word", F.lit(0).alias("edits"))
    left = rest.withColumn("_v", F.explode(F.pandas_udf(_neighbours, "array<string>")("token")))
    right = words.filter(F.length("word") >= SHORT_WORD).withColumn("_v", F.explode(F.pandas_udf(_neighbours, "array<string>")("word")))
    # Spark sizes the variants by the words before the explosion, which is far too small for a broadcast; both sides are shuffled.
    pairs = left.join(right.hint("merge"), "_v").select("token", "word").distinct()
    limit = F.when(F.least(F.length("token"), F.length("word")) >= LONG_WORD - 1, LONG_EDITS).otherwise(SHORT_EDITS)
    swap = F.array_sort(F.split("token", "")) == F.array_sort(F.split("word", ""))
    scored = pairs.withColumn("_d", F.levenshtein("token", "word")).filter(F.col("_d") <= limit)
    scored = scored.withColumn("edits", F.when(swap & (F.col("_d") == 2), 1).otherwise(F.col("_d")))
    by_edits = scored.groupBy("token", "edits").agg(F.array_sort(F.collect_list("word")).alias("_words"))
    near = by_edits.groupBy("token").agg(F.min(F.struct("edits", "_words")).alias("_b")).select("token", "_b.*")
    near = near if ties else near.filter(F.size("_words") == 1)
    return exact.unionByName(near.select("token", F.explode("_words").alias("word"), "edits"))


def _kind_forms(kinds: DataFrame) -> DataFrame:
    """(form, word): ways to write a kind short or long. ``a:`` and a prefix of three letters or more, or the kind without its inner
    vowels; ``s:`` and the kind itself, which a longer word may begin with. A form of two kinds is none."""
    w = F.col("word")
    prefixes = F.transform(F.sequence(F.lit(3), F.length(w)), lambda n: F.substring(w, F.lit(1), n))
    bare = F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, 2, 1_000_000), "[aeiou]", ""))
    short = F.transform(F.array_union(F.when(F.length(w) >= 3, prefixes).otherwise(F.array(w)), F.array(bare)), lambda f: F.concat(F.lit("a:"), f))
    long_ = F.when(F.length(w) >= SHORT_WORD, F.array(F.concat(F.lit("s:"), w))).otherwise(F.array().cast("array<string>"))
    forms = kinds.select(F.explode(F.concat(short, long_)).alias("form"), "word")
    return forms.groupBy("form").agg(F.min("word").alias("word"), F.count("*").alias("n")).filter("n = 1").select("form", "word")


def map_names(names: DataFrame, name: str, entries: DataFrame, entry: str) -> DataFrame:
    """(name, entry) of each distinct name: the entry that it names, or ''.

    An entry's tokens are its family (the first word), plus sign, version, size and kind. A name's tokens are repaired against the words of all
    entries; words that stay unknown are remarks. All entries of the families that a name may hold are ranked by soft TF-IDF over
    the complete token sets: tokens count by their rarity among the entries, a repaired token by its similarity. The best entry is named
    if it scores MIN_SCORE or more and an exact check finds no token of the name or the entry left over.
    """
    ref = _parse(entries.select(entry).filter(F.col(entry).isNotNull()).distinct(), entry)
    ref = ref.withColumn("family", F.get("words", F.lit(0))).filter("family is not null")
    others = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    ref = ref.select(
        entry, F.regexp_replace("family", r"\++$", "").alias("family"), F.when(F.col("family").endswith("+"), "+").otherwise("").alias("plus"),
        F.array_join(F.array_sort(F.array_distinct("numbers")), " ").alias("version"), "size", F.array_join(F.array_sort(F.array_distinct(others)), " ").alias("kind"), others.alias("_others"), "numbers",
    )
    ref = cut(ref, "entries")
    families = ref.select(F.col("family").alias("word")).distinct()
    kinds = ref.select(F.explode("_others").alias("word")).distinct().join(families.hint("merge"), "word", "left_anti")
    versions = ref.select(F.explode("numbers").alias("n")).select(F.concat(F.lit("#"), "n").alias("word")).distinct()
    roles = [t.withColumn("role", F.lit(r)) for t, r in ((families, "family"), (kinds, "kind"), (versions, "version"))]
    vocabulary = cut(roles[0].unionByName(roles[1]).unionByName(roles[2]), "vocabulary")

    total = float(max(1, ref.count()))
    fields = ("family", "plus", "version", "size", "kind")
    # How many entries hold a token: one aggregation for all fields.
    counted = ref.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    counted = counted.filter("x.v <> ''").select("x.f", "x.v", F.log1p(F.lit(total) / F.col("n")).alias("w"))
    for f in fields:
        ref = ref.join(counted.filter(F.col("f") == f).select(F.col("v").alias(f), F.col("w").alias(f"_w_{f}")).hint("merge"), f, "left").withColumn(f"_w_{f}", F.coalesce(f"_w_{f}", F.lit(0.0)))
    ref = cut(ref.select(entry, *fields, *[f"_w_{f}" for f in fields]), "weighed")

    # Parsing is the costly part and several joins follow, so its results are written once.
    parsed = cut(_parse(names.select(name).filter(F.col(name).isNotNull()).distinct(), name), "names")
    aliases = F.create_map(*[F.lit(x) for kv in KIND_ALIASES.items() for x in kv])
    raw = F.concat("words", F.transform("numbers", lambda n: F.concat(F.lit("#"), n)))
    words = parsed.filter("not none").select(name, F.explode(raw).alias("raw"))
    words = words.select(name, F.when(F.col("raw").endswith("+"), "+").otherwise("").alias("plus"), F.regexp_replace("raw", r"\++$", "").alias("token"))
    words = words.withColumn("token", F.coalesce(F.element_at(aliases, F.col("token")), F.col("token")))
    repaired = repair_tokens(words.select("token").distinct(), vocabulary, ties=True)
    spelled = words.select("token").distinct().filter(~F.col("token").startswith("#"))
    starts = F.transform(F.sequence(F.lit(SHORT_WORD), F.length("token") - 1), lambda n: F.concat(F.lit("s:"), F.substring(F.col("token"), F.lit(1), n)))
    looked = F.concat(F.array(F.concat(F.lit("a:"), "token")), F.when(F.length("token") > SHORT_WORD, starts).otherwise(F.array().cast("array<string>")))
    formed = spelled.select("token", F.explode(looked).alias("form")).join(_kind_forms(kinds).hint("merge"), "form").select("token", "word", F.lit(LONG_EDITS + 1).alias("edits"))
    # A form counts only for a token that no edit repairs.
    both = repaired.unionByName(formed.distinct()).groupBy("token", "word").agg(F.min("edits").alias("edits"))
    both = both.join(vocabulary.hint("merge"), "word").groupBy("token").agg(F.collect_set(F.struct("edits", "word", "role")).alias("_c"))
    # The nearest words of each token; of several, only families are kept.
    nearest = F.filter("_c", lambda c: c.edits == F.array_min(F.transform("_c", lambda x: x.edits)))
    both = both.select("token", F.filter(nearest, lambda c: (F.size(nearest) == 1) | (c.role == "family")).alias("_c"))
    hit = words.join(both.hint("merge"), "token").select(name, "plus", F.length("token").alias("_len"), F.explode("_c").alias("_c")).select(name, "plus", "_len", "_c.*")
    of = lambda role: F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == role, F.regexp_replace("word", "^#", "")))), " ")
    read = hit.groupBy(name).agg(F.collect_set(F.when(F.col("role") == "family", F.struct("word", "plus", (1 - F.col("edits") / F.greatest("_len", F.lit(1))).alias("sim")))).alias("_f"), of("kind").alias("kind_"), of("version").alias("version_"))
    read = read.join(parsed.select(name, F.col("size").alias("size_")).hint("merge"), name).select(name, "kind_", "version_", "size_", F.explode("_f").alias("_f"))
    read = read.select(name, F.col("_f.word").alias("family"), F.col("_f.plus").alias("plus_"), "_f.sim", "kind_", "version_", "size_")

    ranked = read.join(ref.hint("merge"), "family")
    unseen = F.log1p(F.lit(total))
    sq = lambda c: c * c
    equal = {f: F.col(f) == F.col(f"{f}_") for f in fields[1:]}
    dot = F.col("sim") * sq(F.col("_w_family")) + sum(F.when(e, sq(F.col(f"_w_{f}"))).otherwise(0.0) for f, e in equal.items())
    own = sq(F.col("_w_family")) + sum(F.when(e, sq(F.col(f"_w_{f}"))).when(F.col(f"{f}_") == "", 0.0).otherwise(sq(unseen)) for f, e in equal.items())
    theirs = sum(sq(F.col(f"_w_{f}")) for f in fields)
    whole = equal["plus"] & equal["version"] & equal["size"] & equal["kind"]
    ranked = ranked.select(name, entry, (dot / F.sqrt(own * theirs)).alias("score"), whole.alias("whole"))
    top = ranked.groupBy(name).agg(F.min_by(F.struct(entry, "score", "whole"), F.struct(-F.col("score"), F.col(entry))).alias("_t"))
    named = top.filter(F.col("_t.whole") & (F.col("_t.score") >= MIN_SCORE)).select(name, F.col(f"_t.{entry}").alias(entry))
    return parsed.select(name).join(named.hint("merge"), name, "left").withColumn(entry, F.coalesce(entry, F.lit("")))
