"""Cohort selection: ids present in every source, a position split without overlap, split checks, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.functions.scalar import percent
from carepath.operators.ordering import row_index_with_total

TRAIN, TEST, UNUSED = "train", "test", "unused"


def intersect_ids(*frames: DataFrame, col: str = "hadm_id") -> DataFrame:
    """Distinct ids present in every frame.

    Each side is de-duplicated with a map-side partial aggregate before its shuffle, and the semi joins then
    reuse that hash partitioning, so every input crosses the network once, already de-duplicated.
    """
    sides = [f.select(F.col(col).cast("long").alias(col)).where(F.col(col).isNotNull()).distinct() for f in frames]
    return reduce(lambda a, b: a.join(b, col, "left_semi"), sides)


def split_by_position(
    ids: DataFrame,
    train_frac: float | None = 0.8,
    train_size: int | None = None,
    test_size: int | None = None,
    col: str = "hadm_id",
) -> DataFrame:
    """Sort ids ascending; the first block is train, the next block is test -> (hadm_id, split, rn).

    With ``train_size``/``test_size`` (the reference's fixed 50,000 / 5,000) ids beyond both blocks are ``unused``:
    every id keeps a row. With ``train_frac`` the first floor(frac * n) are train and all others test. Positions
    come from the distributed ``row_index`` either way.
    """
    numbered, n = row_index_with_total(ids.select(col), [col], "rn")
    n_train = int(train_size) if train_size is not None else int(n * float(train_frac))
    n_used = n_train + int(test_size or 0) if train_size is not None else n
    split = F.when(F.col("rn") <= F.lit(n_train), F.lit(TRAIN)).when(F.col("rn") <= F.lit(n_used), F.lit(TEST))
    return numbered.select(F.col(col).alias("hadm_id"), split.otherwise(F.lit(UNUSED)).alias("split"), "rn")


def split_check(cohort: DataFrame, admissions: DataFrame) -> DataFrame:
    """Leakage checks as (check_name, n): admissions on both sides, and subjects on both sides of the split."""
    per_adm = cohort.groupBy("hadm_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    shared_adm = per_adm.where(F.col("lo") != F.col("hi")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    per_subject = (
        cohort.select("hadm_id", "split")
        .join(admissions.select("hadm_id", "subject_id"), "hadm_id")
        .groupBy("subject_id")
        .agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    )
    shared_subj = per_subject.where(F.col("lo") != F.col("hi")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return shared_adm.select(F.lit("shared_admissions").alias("check_name"), "n").unionByName(
        shared_subj.select(F.lit("shared_subjects").alias("check_name"), "n")
    )


def note_coverage(cohort: DataFrame, note_ids: DataFrame) -> DataFrame:
    """Per split: admissions with and without a note, and note rows beyond one per admission (a positional
    lookup of notes by id would multiply those) -> (split, n, with_note, without_note, note_rows,
    duplicate_note_rows). Notes are counted per id map-side before the join."""
    per_id = note_ids.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("_c"))
    joined = cohort.select("hadm_id", "split").join(per_id, "hadm_id", "left")
    c = F.coalesce(F.col("_c"), F.lit(0))
    return joined.groupBy("split").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum((c > 0).cast("long")).cast("long").alias("with_note"),
        F.sum((c == 0).cast("long")).cast("long").alias("without_note"),
        F.sum(c).cast("long").alias("note_rows"),
        F.sum(F.greatest(c - F.lit(1), F.lit(0))).cast("long").alias("duplicate_note_rows"),
    )


def unique_labels(labels: DataFrame, order_col: str | None = None) -> DataFrame:
    """One label per admission. With ``order_col`` the last row in that order wins (the reference's
    dictionary keeps the last value it reads); without one, a positive wins, so the result does not depend
    on file order. Partial aggregation keeps a repeated id cheap."""
    if order_col is None:
        return labels.groupBy("hadm_id").agg(F.max("label").alias("label"))
    return labels.groupBy("hadm_id").agg(F.max_by("label", order_col).alias("label"))


def attach_labels(df: DataFrame, labels: DataFrame, default: int = 0) -> DataFrame:
    """Left join the 0/1 label; a missing label becomes ``default`` and is flagged in ``label_missing``.
    Labels are made unique per admission first, so a repeated id cannot multiply rows."""
    lab = unique_labels(labels.select("hadm_id", "label")).select("hadm_id", F.col("label").alias("_label"))
    return (
        df.join(lab, "hadm_id", "left")
        .withColumn("label_missing", F.col("_label").isNull())
        .withColumn("label", F.coalesce(F.col("_label"), F.lit(default)).cast("int"))
        .drop("_label")
    )


def cohort_stats(cohort: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split: n, positives, positive rate %, missing labels."""
    return (
        attach_labels(cohort.select("hadm_id", "split"), labels)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).cast("long").alias("n"),
            F.sum("label").cast("long").alias("n_pos"),
            F.sum(F.col("label_missing").cast("int")).cast("long").alias("n_missing_label"),
        )
        .withColumn("rate_pct", F.round(percent("n_pos", "n"), 6))
    )


def class_weights(cohort: DataFrame, labels: DataFrame, split: str = TRAIN) -> DataFrame:
    """Balanced class weights n / (2 * count(class)) over one split -> (label, n, weight)."""
    rows = attach_labels(cohort.where(F.col("split") == split).select("hadm_id"), labels)
    per_class = rows.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("n"))
    # Two numbers pass the driver; the per-class rows stay a table.
    total, classes = per_class.agg(F.sum("n"), F.count(F.lit(1))).first()
    weight = F.lit(float(total or 0)) / (F.lit(classes) * F.col("n"))
    return per_class.select("label", "n", weight.alias("weight"))
