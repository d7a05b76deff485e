"""Driver-table reader and the adapters that map them onto the clinical shapes.

Mapping (admissions = ``orders``, diagnoses = ``lineitem``):
  subject_id = o_custkey, hadm_id = o_orderkey, hospital_expire_flag = (o_orderstatus = 'F');
  diagnosis hadm_id = l_orderkey, seq_num = l_linenumber, code = part key as text or the part's brand.
Only the projected columns are read (the scan's ReadSchema shows the pruning).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, hadm_id, hospital_expire_flag)."""
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("subject_id"),
        F.col("o_orderkey").cast("long").alias("hadm_id"),
        (F.col("o_orderstatus") == F.lit("F")).cast("int").alias("hospital_expire_flag"),
    )


def mortality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hadm_id, label) over all admissions (not only the cohort)."""
    return admissions(spark, sf_dir).select("hadm_id", F.col("hospital_expire_flag").alias("label"))


def diagnoses(spark: SparkSession, sf_dir: str, code: str = "partkey") -> DataFrame:
    """(hadm_id, seq_num, icd_code); ``code`` = 'partkey' (part key as text) or 'brand' (the part's brand)."""
    li = read_table(spark, sf_dir, "lineitem")
    base = li.select(
        F.col("l_orderkey").cast("long").alias("hadm_id"),
        F.col("l_linenumber").cast("int").alias("seq_num"),
        F.col("l_partkey").cast("long").alias("_partkey"),
    )
    if code == "partkey":
        return base.select("hadm_id", "seq_num", F.col("_partkey").cast("string").alias("icd_code"))
    if code == "brand":
        part = read_table(spark, sf_dir, "part").select(
            F.col("p_partkey").cast("long").alias("_partkey"), F.col("p_brand").alias("icd_code")
        )
        return base.join(part, "_partkey").select("hadm_id", "seq_num", "icd_code")
    raise ValueError(f"unknown code source {code!r}")


def note_ids(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Admission ids that carry a note: 'embeddings' (vec_id), 'documents' (doc_id) or 'lineitem' (l_orderkey)."""
    col = {"embeddings": "vec_id", "documents": "doc_id", "lineitem": "l_orderkey"}[source]
    return read_table(spark, sf_dir, source).select(F.col(col).cast("long").alias("hadm_id"))


def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hadm_id, vec ARRAY<FLOAT>) from ``embeddings``."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("hadm_id"), F.col("embedding").cast("array<float>").alias("vec")
    )


def note_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hadm_id, cluster): the ``embeddings.label`` column standing in for a fitted note cluster."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("hadm_id"), F.col("label").cast("long").alias("cluster")
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hadm_id, text) from ``documents``."""
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("hadm_id"), F.col("text")
    )


def event_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as coded sequences: (hadm_id = user_id, ts, seq = event_id, icd_code = event_type)."""
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("hadm_id"),
        F.col("ts"),
        F.col("event_id").cast("long").alias("event_id"),
        F.col("event_type").alias("icd_code"),
    )


def score_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hadm_id, y, z) over labelled documents: y = toxic, z = (n_chars * 7919 % 100003) / 4000 - 12 (raw logit with
    many distinct values, some outside the clamp), NaN for every 97th id."""
    lab = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("long").alias("hadm_id"), F.col("toxic").cast("double").alias("y")
    )
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("hadm_id"),
        F.when(F.col("doc_id") % F.lit(97) == 0, F.lit(float("nan")))
        .otherwise((F.col("n_chars") * F.lit(7919) % F.lit(100003)).cast("double") / F.lit(4000.0) - F.lit(12.0))
        .alias("z"),
    )
    return lab.join(docs, "hadm_id")
