"""Code vocabulary: dense ids in sorted code order, fitted on the train split only; encode and decode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.operators.cohort import TRAIN
from carepath.operators.ordering import row_index_with_total

# Fixed values of the reference's numbering: 0 pads, known codes take 1..n, the unknown token takes n+1.
PAD_ID = 0
UNK_TOKEN = "<UNK>"
LABEL_PAD = -100


@dataclass(frozen=True)
class Vocabulary:
    table: DataFrame  # (code STRING, code_id LONG), ids 1..n
    size: int  # n, known codes only

    @property
    def unk_id(self) -> int:
        return self.size + 1

    @property
    def size_with_unknown(self) -> int:
        """The size the reference prints (known codes plus the unknown token)."""
        return self.size + 1

    @property
    def model_size(self) -> int:
        """Rows of an id-indexed table: padding, known codes and the unknown token."""
        return self.size + 2

    def with_unknown(self) -> DataFrame:
        spark = self.table.sparkSession
        unk = spark.createDataFrame([(UNK_TOKEN, self.unk_id)], "code string, code_id long")
        return self.table.unionByName(unk)


def build_vocab(
    diagnoses: DataFrame, cohort: DataFrame | None = None, split: str = TRAIN, code_col: str = "icd_code"
) -> Vocabulary:
    """Distinct codes of one split's admissions, numbered 1..n in binary string order.

    ``diagnoses`` either carries ``split`` already (joined to the cohort once, see ``with_split``) or is
    semi-joined to the split's ids from ``cohort``.
    """
    if "split" in diagnoses.columns:
        rows = diagnoses.where(F.col("split") == split)
    else:
        rows = diagnoses.join(cohort.where(F.col("split") == split).select("hadm_id"), "hadm_id", "left_semi")
    codes = (
        rows.select(F.col(code_col).alias("code"))
        .where(F.col("code").isNotNull())
        .distinct()
    )
    table, n = row_index_with_total(codes, ["code"], "code_id")
    return Vocabulary(table.select("code", "code_id"), n)


def with_split(diagnoses: DataFrame, cohort: DataFrame) -> DataFrame:
    """Diagnoses of cohort admissions with their ``split``. Nothing is cached: each reader prunes the join to its
    own columns, and AQE splits the partition of an admission that holds a large part of the rows."""
    return diagnoses.join(cohort.select("hadm_id", "split"), "hadm_id")


def encode_codes(diagnoses: DataFrame, vocab: Vocabulary, code_col: str = "icd_code") -> DataFrame:
    """Add ``code_id``; codes outside the vocabulary map to the unknown id."""
    lookup = vocab.table.withColumnRenamed("code", code_col)
    return diagnoses.join(lookup, code_col, "left").withColumn(
        "code_id", F.coalesce(F.col("code_id"), F.lit(vocab.unk_id)).cast("long")
    )


def decode_codes(df: DataFrame, vocab: Vocabulary, id_col: str = "code_id", out_col: str = "code") -> DataFrame:
    """Reverse lookup id -> code (the unknown id decodes to the unknown token)."""
    table = vocab.with_unknown().select(F.col("code_id").alias(id_col), F.col("code").alias(out_col))
    return df.join(table, id_col, "left")
