"""Training examples: sequences joined with the note vector and the outcome label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from carepath.functions.vector import is_ml_vector
from carepath.operators.cohort import attach_labels


def unique_vectors(note_vectors: DataFrame, order_col: str | None = None) -> DataFrame:
    """One vector per admission -> (hadm_id, vec): the last one in ``order_col`` order (the reference's dictionary
    keeps the last it reads). Without an order, or between ties, the largest vector wins, so the result does not
    depend on file order. Arrays come out as ``array<float>``, Spark ML vectors as they are."""
    vec = F.col("vec") if is_ml_vector(note_vectors, "vec") else F.col("vec").cast("array<float>")
    value = F.unwrap_udt(vec) if is_ml_vector(note_vectors, "vec") else vec
    order = F.struct(F.col(order_col), value) if order_col else value
    return note_vectors.groupBy("hadm_id").agg(F.max_by(vec, order).alias("vec"))


def assemble_examples(
    sequences: DataFrame, note_vectors: DataFrame, labels: DataFrame, vector_order: str | None = None
) -> DataFrame:
    """Sequences that have a note vector (inner join), with the label (missing -> 0). Several vectors or labels of an
    admission count as one, so no example is multiplied.

    -> (hadm_id, split, input_ids, labels, vec ARRAY<FLOAT>, label INT, label_missing)
    """
    return attach_labels(sequences.join(unique_vectors(note_vectors, vector_order), "hadm_id"), labels)


def modality_drop_counts(sequences: DataFrame, note_vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split: sequences kept (a vector exists), dropped (none), and kept rows whose label is missing."""
    has_vec = note_vectors.select("hadm_id").distinct().withColumn("_has", F.lit(True))
    marked = attach_labels(sequences.select("hadm_id", "split").join(has_vec, "hadm_id", "left"), labels)
    kept = F.col("_has").isNotNull()
    return marked.groupBy("split").agg(
        F.sum(kept.cast("int")).cast("long").alias("kept"),
        F.sum((~kept).cast("int")).cast("long").alias("dropped"),
        F.sum((kept & F.col("label_missing")).cast("int")).cast("long").alias("missing_label"),
    )


def assemble_counted(
    sequences: DataFrame, note_vectors: DataFrame, labels: DataFrame, vector_order: str | None = None
) -> tuple[DataFrame, Observation]:
    """``assemble_examples`` with its counts taken in the same pass: kept, dropped (no vector) and, of the kept,
    missing_label. The observation is filled by the first action on the examples. The tables should come from a
    ``session.counting_session``."""
    vectors = unique_vectors(note_vectors, vector_order)
    marked = attach_labels(sequences.join(vectors, "hadm_id", "left"), labels)
    kept = F.col("vec").isNotNull()
    counts = Observation()
    seen = marked.observe(
        counts,
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("dropped"),
        F.count_if(kept & F.col("label_missing")).alias("missing_label"),
    )
    return seen.where(kept), counts
