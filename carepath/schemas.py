"""Explicit schemas of the clinical inputs and of every stored artifact (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw clinical tables: only the columns the pipeline touches. Codes are strings: leading zeros matter.
ADMISSIONS = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("hospital_expire_flag", T.IntegerType()),
    ]
)

NOTES = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

DIAGNOSES = T.StructType(
    [
        T.StructField("hadm_id", T.LongType()),
        T.StructField("seq_num", T.IntegerType()),
        T.StructField("icd_code", T.StringType()),
    ]
)

# Artifacts.
COHORT = T.StructType(
    [
        T.StructField("hadm_id", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("rn", T.LongType()),
    ]
)

LABELS = T.StructType([T.StructField("hadm_id", T.LongType()), T.StructField("label", T.IntegerType())])

VOCAB = T.StructType([T.StructField("code", T.StringType()), T.StructField("code_id", T.LongType())])

SEQUENCES = T.StructType(
    [
        T.StructField("hadm_id", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("input_ids", T.ArrayType(T.LongType())),
        T.StructField("labels", T.ArrayType(T.LongType())),
    ]
)

NOTE_VECTORS = T.StructType(
    [T.StructField("hadm_id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))]
)

SCORES = T.StructType(
    [
        T.StructField("hadm_id", T.LongType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("p", T.DoubleType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("metric_1", T.DoubleType()),
        T.StructField("metric_2", T.DoubleType()),
        T.StructField("metric_3", T.DoubleType()),
    ]
)

# Results-file header as the reference writes it (fixed values).
REPORT_CSV_HEADER = ["Task", "Model", "Top-1 / AUC", "Top-5 / AUPRC", "Top-10"]

TRAINING_LOG = T.StructType([T.StructField("value", T.StringType())])
