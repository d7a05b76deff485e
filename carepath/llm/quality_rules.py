"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules fail a text of fewer than 20 words, or with more than 30 % of its words inside repeated 8-word windows.
The method compares two histograms of a document with references of its language by the Jensen-Shannon distance
(base 2, so 0 to 1): characters by class, and common words (with one bin for all other words). Digits are left out of
the class histogram: one phone or card number would weigh more in a short clean text than markup does in junk. References are learned
from the corpus itself, for each value of ``lang`` that the table holds (null is one of them): the class reference is
the median share over the language's documents, which a third of junk does not move; the word reference sums the
documents whose class histogram agrees with it. A distance counts only for documents long enough for a stable histogram
(MIN_CHARS, MIN_TOKENS). The rule is the same for a language of any size; one with a single long document has nothing
to compare it with, and its distance is 0.

Defined results: a null text is empty, has no words and fails; texts without letters fail by their length or keep
their base verdict; repeated rows each get a row; an empty table gives no rows. Only the columns doc_id, text and lang
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm import statistics as st
from carepath.llm.common import BROADCAST_BYTES, stage, text_or_empty, without

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_CHARS, MIN_TOKENS = 150, 60
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.19, 0.6
REFERENCE_BYTES = 4096  # a language's reference: a share for each class and each common word
# Places of the compared classes in the ``chars`` array.
COMPARED = tuple(k for k, name in enumerate(st.CLASSES) if name != "digit")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _term(p: Column, q: Column) -> Column:
    """One bin's part of twice the Jensen-Shannon divergence, with 0 log 0 = 0."""
    part = lambda x: F.when(x > 0, x * F.log2(F.lit(2.0) * x / (p + q))).otherwise(F.lit(0.0))
    return part(p) + part(q)


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def _distance(doubled: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(0.5) * doubled))


def language_key(lang: Column) -> Column:
    """The language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def text_key(text: Column) -> Column:
    """A hash that tells texts under one id (or under no id) apart."""
    return F.xxhash64(text)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, text key, counts, base_failed, _lang, chars, n_tokens, common), one row per document, staged."""
    own = (F.col("doc_id"), text_key(text_or_empty()).alias("_text_key"), language_key(F.col("lang")).alias("_lang"))
    stats = st.base_statistics(docs, own).drop("_wh")
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stage(st.histograms(stats).withColumn("base_failed", failed))


def _with_reference(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows with the reference of their language. References are one row a language: broadcast as long as they are few,
    else a join that Spark may split where a language holds many rows."""
    reference = stage(reference)
    few = reference.count() * REFERENCE_BYTES <= BROADCAST_BYTES
    return rows.join(F.broadcast(reference) if few else reference, "_lang", "left")


def score(measured: DataFrame) -> DataFrame:
    """Adds char_distance, word_distance (null where a guard holds) and kept."""
    n_chars = sum((F.get("chars", k) for k in COMPARED), F.lit(0.0))
    rows = measured.withColumn("_n", n_chars)
    sound = rows.where(~F.col("base_failed") & (F.col("_n") >= MIN_CHARS))
    medians = F.array(*(F.percentile_approx(F.get("chars", k) / F.col("_n"), 0.5, 10000) for k in COMPARED))
    by_class = sound.groupBy("_lang").agg(medians.alias("_m"))
    total = _total(F.col("_m"))
    by_class = by_class.select("_lang", F.when(total > 0, F.transform("_m", lambda x: x / total)).alias("_class_ref"))
    rows = _with_reference(rows, by_class)
    classes = sum(
        (_term(F.get("chars", k) / F.col("_n"), F.get("_class_ref", i)) for i, k in enumerate(COMPARED)), F.lit(0.0)
    )
    rows = rows.withColumn(
        "char_distance", F.when(F.col("_class_ref").isNotNull() & (F.col("_n") >= MIN_CHARS), _distance(classes))
    )
    usual = rows.where(~F.col("base_failed") & (F.col("char_distance") <= MAX_CHAR_DISTANCE))
    tokens = usual.groupBy("_lang").agg(F.sum("n_tokens").alias("_all"))
    by_word = (
        usual.select("_lang", F.explode("common").alias("c"))
        .groupBy("_lang", F.col("c.word").alias("word"))
        .agg(F.sum("c.n").alias("n"))
        .join(tokens, "_lang")
        .groupBy("_lang")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("n") / F.col("_all")))).alias("_word_ref"))
    )
    rows = _with_reference(rows, by_word)
    rows = rows.withColumn(
        "_pq",
        F.transform(
            "common",
            lambda c: F.struct(
                (c["n"] / F.col("n_tokens")).alias("p"),
                F.coalesce(F.element_at("_word_ref", c["word"]), F.lit(0.0)).alias("q"),
            ),
        ),
    ).withColumn("_q_all", _total(F.map_values("_word_ref")))
    p_seen, q_seen = _total(F.transform("_pq", lambda x: x["p"])), _total(F.transform("_pq", lambda x: x["q"]))
    doubled = (
        _total(F.transform("_pq", lambda x: _term(x["p"], x["q"])))
        + _term(F.greatest(F.lit(0.0), 1 - p_seen), F.greatest(F.lit(0.0), 1 - F.col("_q_all")))
        + (F.col("_q_all") - q_seen)
    )
    rows = rows.withColumn("word_distance", F.when(F.col("_word_ref").isNotNull() & (F.col("n_tokens") >= MIN_TOKENS), _distance(doubled)))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False))
    kept = kept & ~F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return rows.select("doc_id", "_text_key", "_lang", *COUNTS, "base_failed", "char_distance", "word_distance", kept.alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, char_distance, word_distance, kept) of every document."""
    return score(measure(docs)).drop("_text_key", "_lang")


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns and rows otherwise as they are."""
    rejected = score(measure(docs)).where(~F.col("kept")).select("doc_id", "_text_key", "_lang")
    own = {"doc_id": F.col("doc_id"), "_text_key": text_key(text_or_empty()), "_lang": language_key(F.col("lang"))}
    return without(docs, rejected, own, key_bytes=40)
