"""Per-document text statistics as column expressions (no Python): counts used by the quality rules and classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import SPACE_CHARS, SPACE_CLASS, hashed, text_or_empty, words

# The symbol characters counted by the base rules, and the window of the repeat rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
PUNCTUATION = ".,;:!?'\"()-"
# Character classes, in the order of the ``chars`` array.
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")

# Function words that are frequent in ordinary prose, by language.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"),
}


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _runs(items: Column) -> Column:
    """(value, count) of each distinct value of a sorted array, from the places where the value changes."""
    ends = F.filter(
        F.sequence(F.lit(0), F.size(items) - 1), lambda i: ~F.get(items, i).eqNullSafe(F.get(items, i + 1))
    )
    return F.transform(
        ends,
        lambda e, k: F.struct(
            F.get(items, e).alias("word"), (e - F.when(k == 0, F.lit(-1)).otherwise(F.get(ends, k - 1))).alias("n")
        ),
    )


def base_statistics(docs: DataFrame, keep: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """The kept columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``_t`` (the text).

    Repeated words are those inside some 8-word window that occurs twice or more in the text. Windows are compared
    by a 64-bit hash of their word hashes; they are sorted only in texts where one repeats. A covered stretch is
    counted from the start positions: each start adds 8 words or the distance to the next start.
    """
    t = F.col("_t")
    out = docs.select(*keep, text_or_empty().alias("_t"))
    names = [c for c in out.columns if c != "_t"]
    line_has_word = lambda x: _removed(x, SPACE_CHARS) != F.lit("")
    out = out.select(
        *names,
        "_t",
        hashed(words(t)).alias("_wh"),
        F.length(_removed(t, SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_removed(t, SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), line_has_word).alias("_lines"),
    )
    wh = F.col("_wh")
    out = out.select(
        *names,
        "_t",
        "_wh",
        F.size("_wh").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_wh") > WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_wh") - WINDOW),
                lambda i: F.xxhash64(*(F.get(wh, i + k) for k in range(WINDOW))),
            ),
        ).alias("_windows"),
    )
    win = F.col("_windows")
    out = out.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct(win)) < F.size(win),
            F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_windows")
    srt = F.col("_sorted")
    repeated = F.filter(
        srt,
        lambda x, i: F.coalesce(F.get(srt, i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(srt, i + 1)["h"] == x["h"], F.lit(False)),
    )
    out = out.withColumn("_starts", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("_sorted")
    starts = F.col("_starts")
    covered = F.aggregate(
        F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")


def histograms(stats: DataFrame) -> DataFrame:
    """Adds ``chars`` (characters by class), ``n_tokens`` (letter runs) and ``common`` (counts of common words)."""
    names = [c for c in stats.columns if c != "_t"]
    vocabulary = sorted({w for group in COMMON_WORDS.values() for w in group})
    stripped = F.regexp_replace("_t", "\\p{Ll}+", "")
    out = stats.select(
        *names,
        "_t",
        stripped.alias("_a"),
        F.split(F.lower("_t"), "[^\\p{L}]+").alias("_tokens"),
    )
    out = out.select(
        *names,
        F.length("_t").alias("_l0"),
        F.length("_a").alias("_l1"),
        F.regexp_replace(F.regexp_replace("_a", SPACE_CLASS + "+", ""), "\\p{Lu}+", "").alias("_b"),
        F.length(F.regexp_replace("_a", SPACE_CLASS + "+", "")).alias("_l2"),
        # The split leaves an empty token before the first or after the last letter run.
        (
            F.size("_tokens")
            - (F.get("_tokens", F.lit(0)) == F.lit("")).cast("int")
            - ((F.size("_tokens") > 1) & (F.element_at("_tokens", -1) == F.lit(""))).cast("int")
        )
        .cast("long")
        .alias("n_tokens"),
        F.sort_array(F.filter("_tokens", lambda w: w.isin(vocabulary))).alias("_common"),
    )
    b = F.col("_b")
    no_digit, no_punct = _removed(b, "0123456789"), _removed(_removed(b, "0123456789"), PUNCTUATION)
    rest = _removed(no_punct, SYMBOLS)
    chars = F.array(
        F.col("_l0") - F.col("_l1"),
        F.col("_l2") - F.length(b),
        F.length(b) - F.length(no_digit),
        F.col("_l1") - F.col("_l2"),
        F.length(no_digit) - F.length(no_punct),
        F.length(no_punct) - F.length(rest),
        F.length(rest),
    )
    common = F.col("_common")
    runs = F.when(F.size(common) > 0, _runs(common)).otherwise(
        F.array().cast("array<struct<word:string,n:int>>")
    )
    return out.select(*names, "n_tokens", F.transform(chars, lambda x: x.cast("long")).alias("chars"), runs.alias("common"))
