"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, PII masking, BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage as Parquet into the shared
checkpoint folder and rereads it as the next stage's documents. All stages but the last return the columns of
``documents``. The result has one row per document kept: doc_id, lang, source, n_tokens, ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm import bagminhash, bpe_lexicon, decontaminate, pii_crf, quality_rules
from carepath.llm.common import stage
from carepath.session import checkpoint_dir
from carepath.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return bagminhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, whole or edited."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kind."""
    return pii_crf.redact(docs, pii_crf.fit(pii_crf.labelled_table(spark)))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document."""
    encoded = bpe_lexicon.encode(docs, keep=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("bpe", bpe_stage),
]

# No stage is expressible in SQL as a whole; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables between stages are removed; the result itself is a checkpoint."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    try:
        for k, (name, function) in enumerate(STAGES):
            out = f"{folder}/{k}-{name}"
            function(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
        return stage(docs)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
