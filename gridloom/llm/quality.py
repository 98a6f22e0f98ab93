"""Per-document text statistics and fixed-threshold rules that tell natural prose from lists, tables and junk.

Defined results. Null, empty and blank texts have zero counts, null ratios and is_prose null: they are neither prose nor junk. A text
of headings alone is not prose. Texts are read whole, of any length, in any language; languages without a word list are judged by
sentence marks and short words. An empty table gives an empty result; only the key and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of prose, by language; the first list of each holds words that sentences have and noun phrases lack.
SENTENCE_WORDS = {
    "en": "is are was were be been being am has have had do does did can could will would may might must shall should that which who whom whose what why how when where whether while if unless although though because since until than as not no nor but yet so it he she they we you i us them him me this these those there here nobody nothing neither whoever please still then only also even most more less never always both",
    "de": "ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können konnte muss müssen soll sollte darf dass ob wenn weil während als wie was wer warum nicht kein keine noch nur auch aber oder denn sondern er sie es wir ich ihr sich uns dieser diese dieses hier dort deshalb",
    "fr": "est sont était étaient sera a ont avait avons été être peut peuvent doit que qui quoi dont où pourquoi comment quand si ne pas plus ni mais car donc lorsque alors même il elle ils elles nous vous je on se ce cette ces celles ceux",
    "es": "es son era eran fue fueron está están estaba ha han había hay puede pueden debe que quien cual donde cuando como cómo por qué si no ni pero porque aunque mientras sino él ella ellos nosotros se lo le este esta estos eso casi ya ninguno ninguna todo",
    "it": "è sono era erano ha hanno può che chi dove quando come perché se non né ma anche mentre si questo questa questi",
    "pt": "é são era eram foi foram está tem têm pode que quem onde quando como porque se não nem mas também enquanto isso este esta",
    "nl": "is zijn was waren wordt worden heeft hebben kan dat die wie wat waarom als niet geen maar omdat terwijl ook nog het zij wij ik er",
}
LINK_WORDS = {
    "en": "the a an of and or to in on at by for with from into over under about between after before without through during against of its their our your his her one two each every all some any other another such",
    "de": "der die das den dem des ein eine einen einem einer eines und zu zum zur in im an am auf aus bei mit nach von vom vor über unter um für durch ohne gegen bis seit",
    "fr": "le la les l un une des du de d et ou à au aux en dans sur sous par pour avec sans entre vers chez depuis leur leurs son sa ses",
    "es": "el la los las un una unos unas de del y o a al en con sin sobre entre para por desde hasta su sus más menos",
    "it": "il lo la i gli le un una di del della dei e o a al in nel con su per tra da dal",
    "pt": "o a os as um uma de do da dos das e ou em no na com sem por para entre",
    "nl": "de een van en of in op aan met voor door naar uit bij te tot over",
}
COMMON = {w for words in (*SENTENCE_WORDS.values(), *LINK_WORDS.values()) for w in words.split()}
SENTENCE = {w for words in SENTENCE_WORDS.values() for w in words.split()}
# Characters of Chinese and Japanese that sentences have and lists of terms lack.
CJK_FUNCTION = set("的是在了没不这与也会被并为那我他她们吗呢很但而就都还只让使はがをにでとものかです")

# Published thresholds (Gopher, C4 and FineWeb filters).
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN_WORD, MAX_MEAN_WORD = 3.0, 10.0
MAX_SYMBOLS, MAX_BULLETS, MAX_ELLIPSES = 0.1, 0.9, 0.3
MIN_ALPHA_WORDS, MIN_COMMON, MIN_LINE_ENDS = 0.8, 2, 0.12
#: Share of the text in sentences below which it isn't prose.
MIN_PROSE = 0.5

# Published line rules (C4: few words; Gopher: list lines, share of words with letters, common words; RefinedWeb: digits) as
# thresholds of a block of running lines, and the share of separators that only enumerations reach.
MIN_BLOCK_WORDS, MIN_BLOCK_COMMON, MIN_BLOCK_SENTENCE, MAX_BLOCK_SEPARATORS, MAX_BLOCK_DIGITS = 3, 0.18, 0.04, 0.25, 0.45
MIN_CJK_CHARS, MIN_CJK_COMMON = 5, 0.04
# Blocks of several short lines (FineWeb: share of lines with a sentence mark), distinct pairs of words of run-on blocks (Gopher), and the words and common words with which
# a block with sentence marks needs no further sentence words.
MIN_LINES, MIN_LINE_MARKS, SHORT_LINE, MAX_SENTENCE, MIN_DISTINCT_PAIRS, ENOUGH_WORDS, ENOUGH_COMMON = 3, 0.12, 36, 50, 0.3, 8, 0.3

_BREAK = r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"
_LIST = (
    r"^\s*(?:[-*•·▪‣+]\s|\d{1,3}[.)]\s|\(?[a-zA-Z\d]{1,2}\)\s|\[[ xX\d]*\]\s|\d+(?:\.\d+)+\s|\||<(?:table|tr|td|li|ul|div|th)\b|\{\s*[\"']|\d{4}-\d\d-\d\d[ T]\d\d:"
    r"|[\pL_]{2,20}\s*[:=]\s*\S+(?:\s\S+){0,7}$)|\t.*\t|\|.*\|.*\||\.{5,}|·.*·"
)
_HEADING = r"^\s*(?:#{1,6}\s.*|(?:Hello|Hi|Dear|Regards|Thanks)\b[^.]{0,30},?)\s*$"
_either = lambda words: " (?:" + "|".join(sorted(words)) + ") "


def _lines(texts: pa.Array) -> tuple[pd.DataFrame, pa.Array]:
    """One row per line of all texts: its text's number, its length and its counts. Columns are computed at once for the whole batch.
    Also the lines' words, two spaces apart."""
    split = pc.split_pattern_regex(texts, _BREAK)
    line = pc.replace_substring_regex(pc.list_flatten(split), r"^\s*(?:>\s?)+", "")
    count = lambda c, pattern: pc.count_substring_regex(c, pattern).to_numpy()
    core = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(line), r"[^\pL\pM]+", "  "))
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    bare = pc.binary_join_element_wise(space, core, space, none)
    cjk = count(line, r"[\p{Han}\p{Hiragana}\p{Katakana}]")
    mixed = np.flatnonzero(cjk)
    words = pc.count_substring(core, "  ").to_numpy() + pc.greater(pc.binary_length(core), 0).to_numpy(zero_copy_only=False)
    latin = words.astype(np.int64)
    latin[mixed] = count(line.take(pa.array(mixed)), r"[\p{Latin}\p{Cyrillic}]+")
    return pd.DataFrame(
        {
            "line": np.arange(len(line)), "text": pc.list_parent_indices(split).to_numpy(), "chars": pc.utf8_length(pc.utf8_trim_whitespace(line)).to_numpy(), "words": words,
            "common": count(bare, _either(COMMON)), "sentence": count(bare, _either(SENTENCE)), "separators": count(line, r"[,;|·/\t]|\s[-–—]\s"), "digits": count(line, r"\d"),
            "cjk": cjk, "cjk_common": count(line, "[" + "".join(sorted(CJK_FUNCTION)) + "]"), "latin": latin,
            "ends": count(line, r"[.!?…。！？।؟][\"”»')\]]*\s|[.!?…。！？।؟][\"”»')\]]*$"), "ascii": pc.match_substring_regex(line, "[A-Za-z]").to_numpy(zero_copy_only=False),
            "listed": pc.match_substring_regex(line, _LIST).to_numpy(zero_copy_only=False), "heading": pc.match_substring_regex(line, _HEADING).to_numpy(zero_copy_only=False),
        }
    ), core


_SUMS = ("chars", "words", "common", "sentence", "separators", "digits", "cjk", "cjk_common", "latin", "ends", "ascii")
_REASONS = ("listed", "few_words", "few_common_words", "few_sentence_words", "few_sentence_marks", "repeated", "separators", "digits")
_STATS = "prose_share double, common_words bigint, sentence_words bigint, " + ", ".join(f"{r}_share double" for r in _REASONS)


def _judge(lines: pd.DataFrame, core: pa.Array, n: int) -> pd.DataFrame:
    """Per text: the share of its characters, headings aside, in blocks that pass all rules, and in blocks that fail each rule.

    A block is a run of lines that aren't list lines, up to a blank line, so a wrapped paragraph is judged as a whole; a list line is a block of its own."""
    lines = lines[~lines["heading"] | (lines["chars"] == 0)]
    text, blank, listed = lines["text"].to_numpy(), lines["chars"].to_numpy() == 0, lines["listed"].to_numpy()
    new = np.ones(len(lines), bool)
    new[1:] = (text[1:] != text[:-1]) | blank[1:] | blank[:-1] | listed[1:] | listed[:-1]
    starts = np.flatnonzero(new)
    s = {c: np.add.reduceat(lines[c].to_numpy(np.int64), starts) if len(starts) else np.zeros(0, np.int64) for c in _SUMS}
    of, listed = text[starts], listed[starts]
    n_lines = np.diff(np.append(starts, len(lines)))
    words, chars = np.maximum(s["words"], 1), np.maximum(s["chars"], 1)
    # Run-on blocks are counted by pairs of words: repeated phrases have few distinct ones.
    repeated = np.zeros(len(starts), bool)
    number = lines["line"].to_numpy()
    for b in np.flatnonzero(s["words"] > MAX_SENTENCE * (s["ends"] + 1)):
        own = [w for i in range(starts[b], starts[b] + n_lines[b]) for w in core[int(number[i])].as_py().split()]
        repeated[b] = len(set(zip(own, own[1:]))) < MIN_DISTINCT_PAIRS * (len(own) - 1)
    cjk = (s["cjk"] > 0) & (s["cjk"] >= 0.8 * s["latin"])
    # Scripts without a list of common words: running text has words and sentence marks.
    foreign = ~cjk & (s["ascii"] == 0) & (s["words"] >= 7) & (s["ends"] > 0)
    latin = ~cjk & ~foreign
    fails = {
        "listed": listed,
        "few_words": np.where(cjk, s["cjk"] < MIN_CJK_CHARS, s["words"] < MIN_BLOCK_WORDS),
        "few_common_words": np.where(cjk, s["cjk_common"] < np.maximum(1, MIN_CJK_COMMON * s["cjk"]), latin & (s["common"] < MIN_BLOCK_COMMON * words)),
        "few_sentence_words": latin & (s["sentence"] < np.maximum(1, MIN_BLOCK_SENTENCE * words)) & ~((s["ends"] > 0) & (s["words"] >= ENOUGH_WORDS) & (s["common"] >= ENOUGH_COMMON * words)),
        "few_sentence_marks": latin & (n_lines >= MIN_LINES) & (s["ends"] < MIN_LINE_MARKS * n_lines) & (s["chars"] < SHORT_LINE * n_lines),
        "repeated": repeated,
        "separators": ~cjk & (s["separators"] > MAX_BLOCK_SEPARATORS * words),
        "digits": s["digits"] > MAX_BLOCK_DIGITS * chars,
    }
    good = ~np.logical_or.reduce(list(fails.values()))
    total = np.bincount(of, s["chars"], n)
    share = lambda mask: np.divide(np.bincount(of[mask], s["chars"][mask], n), total, out=np.zeros(n), where=total > 0)
    out = {"prose_share": share(good), "common_words": np.bincount(of, s["common"], n).astype(int), "sentence_words": np.bincount(of, s["sentence"], n).astype(int)}
    return pd.DataFrame(out | {f"{r}_share": share(fails[r]) for r in _REASONS})


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        column = pa.array(texts.fillna(""), pa.large_string())
        yield _judge(*_lines(column), len(texts))


def text_quality(df: DataFrame, key: str, text: str) -> DataFrame:
    """Statistics, failed rules and is_prose for each row. Document counts are column expressions; the counts of lines and blocks are
    made in one Arrow pass, column by column.

    Each block of a text passes or fails fixed rules (list marks, words, common words, sentence words, sentence marks, repetition,
    separators, digits); a text is prose if at least MIN_PROSE of its characters are in blocks that pass all of them. For other
    texts ``failures`` names prose_share and, as block_*, the rules that its blocks fail. The published rules for whole web pages are
    recorded in ``failures`` as well, but don't decide: they ask for 50 words, and texts here may be single sentences."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = ~t.rlike(r"[^\s\p{Z}\p{Cf}]")
    out = df.select(F.col(key), t.alias("_t"), blank.alias("_blank"), F.pandas_udf(_read, _STATS)(F.col(text)).alias("_r")).select("*", "_r.*")
    t = F.col("_t")
    lines = F.filter(F.split(t, r"\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    n_lines = F.size(lines)
    share = lambda pattern: F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(pattern))), n_lines)
    words = F.size(F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: w != ""))
    out = out.select(
        key, "_blank", F.length(t).alias("n_chars"), words.alias("n_words"), F.try_divide(F.length(F.regexp_replace(t, r"[\s\p{Z}]+", "")), words).alias("mean_word_length"),
        F.try_divide(F.regexp_count(t, F.lit(r"#|\.\.\.|…")), words).alias("symbol_ratio"), F.try_divide(F.size(F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: w.rlike(r"\p{L}"))), words).alias("alpha_word_share"),
        share(r"[.!?:;。！？…][\"”»')]*\s*$").alias("line_end_share"), share(r"^\s*([-*•·‣]|\d+[.)])\s").alias("bullet_share"), share(r"(\.\.\.|…)\s*$").alias("ellipsis_share"),
        "common_words", F.try_divide("common_words", words).alias("common_word_share"), "sentence_words", "prose_share", *[f"{r}_share" for r in _REASONS],
    )
    rules = (
        ("too_few_words", F.col("n_words") < MIN_WORDS), ("too_many_words", F.col("n_words") > MAX_WORDS), ("mean_word_length", ~F.col("mean_word_length").between(MIN_MEAN_WORD, MAX_MEAN_WORD)),
        ("symbol_ratio", F.col("symbol_ratio") > MAX_SYMBOLS), ("bullet_share", F.col("bullet_share") > MAX_BULLETS), ("ellipsis_share", F.col("ellipsis_share") > MAX_ELLIPSES),
        ("alpha_word_share", F.col("alpha_word_share") < MIN_ALPHA_WORDS), ("common_words", F.col("common_words") < MIN_COMMON), ("line_end_share", F.col("line_end_share") < MIN_LINE_ENDS), ("prose_share", F.col("prose_share") < MIN_PROSE),
        *[(f"block_{r}", (F.col("prose_share") < MIN_PROSE) & (F.col(f"{r}_share") > 0)) for r in _REASONS],
    )
    failures = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    prose = F.when(~F.col("_blank"), F.col("prose_share") >= MIN_PROSE)
    return out.withColumn("failures", F.when(~F.col("_blank"), failures).otherwise(F.array().cast("array<string>"))).withColumn("is_prose", prose).drop("_blank")
