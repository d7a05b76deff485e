"""Clinical sources and sinks: CSV scans with explicit schemas, one-time Parquet landing, artifact storage.

CSV inputs are gzip files in practice: unsplittable, so each file is read by one task. They are landed once
as Parquet (splittable, column-pruned, predicate push-down) and every stage reads the Parquet after that.
Codes stay strings (no inference: '0389' must not become 389) and notes are read multi-line with quote
escaping (a note spans lines and contains quotes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carepath.schemas import ADMISSIONS, DIAGNOSES, NOTES
from carepath.session import counting_session

# The raw files' column orders (header names) for the columns the pipeline reads.
ADMISSIONS_COLUMNS = ["subject_id", "hadm_id", "hospital_expire_flag"]
NOTES_COLUMNS = ["subject_id", "hadm_id", "text"]
DIAGNOSES_COLUMNS = ["hadm_id", "seq_num", "icd_code"]


def _raw_csv(
    spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False, keep_empty: bool = False
) -> DataFrame:
    """The schema's columns of a CSV with a header, all as text (no inference)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if keep_empty:  # what a file shows as null is nothing at all; a pair of quotes stays an empty text
        reader = reader.option("nullValue", "\0")
    if multiline:
        reader = reader.option("multiLine", True).option("escape", '"').option("quote", '"')
    raw = reader.option("enforceSchema", False).csv(path)
    for field in schema.fields:
        if field.name not in raw.columns:
            raise ValueError(f"{path}: column {field.name!r} missing (found {raw.columns})")
    return raw.select(*schema.names)


def _typed(field: T.StructField) -> Column:
    c = F.col(field.name)
    return (c if isinstance(field.dataType, T.StringType) else c.try_cast(field.dataType)).alias(field.name)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False, keep_empty: bool = False
) -> DataFrame:
    """Header-driven CSV read: every column as text first, then typed with ``try_cast``. An empty text is null unless
    ``keep_empty`` tells it from a missing one by its quotes."""
    return _raw_csv(spark, path, schema, multiline, keep_empty).select(*[_typed(f) for f in schema.fields])


def write_csv(df: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """Text files with a header that ``read_csv(multiline=True, keep_empty=True)`` reads back exactly: quotes where a text needs them,
    doubled inside, white space and line breaks kept; a null is nothing, an empty text a pair of quotes."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\n")
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("compression", compression or "none").csv(path)


def land_counted(
    spark: SparkSession, source: str, schema: T.StructType, target: str, multiline: bool = False
) -> dict[str, int]:
    """Land a CSV as Parquet and count in the same pass -> {"rows": n, "rejected_<column>": n, ...}: values that are
    there and do not parse. The counters ride on the write (``observe``), so the text is parsed once."""
    raw = _raw_csv(counting_session(spark), source, schema, multiline)
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    counted = Observation()
    bad = [
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f"rejected_{f.name}")
        for f in typed
    ]
    out = raw.observe(counted, F.count(F.lit(1)).alias("rows"), *bad).select(*[_typed(f) for f in schema.fields])
    land_parquet(out, target)
    return dict(counted.get)


def count_rejects(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """(file, column, rows, rejected): per file and typed column, the values that are there and do not parse (they are
    null in the typed table). A pass of its own over the raw text; run it once when an extract lands."""
    reader = spark.read.option("header", True)
    if multiline:
        reader = reader.option("multiLine", True).option("escape", '"').option("quote", '"')
    raw = reader.csv(path).withColumn("_file", F.input_file_name())
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    checks = [
        F.struct(
            F.lit(f.name).alias("column"),
            (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias("bad"),
        )
        for f in typed
    ]
    cells = raw.select(F.col("_file").alias("file"), F.explode(F.array(*checks)).alias("c"))
    return cells.groupBy("file", F.col("c.column").alias("column")).agg(
        F.count(F.lit(1)).cast("long").alias("rows"), F.sum(F.col("c.bad").cast("long")).alias("rejected")
    )


def read_admissions(spark: SparkSession, path: str) -> DataFrame:
    """(subject_id, hadm_id, hospital_expire_flag)."""
    return read_csv(spark, path, ADMISSIONS)


def read_notes(spark: SparkSession, path: str, with_text: bool = True) -> DataFrame:
    """(subject_id, hadm_id[, text]); notes span lines and embed quotes."""
    df = read_csv(spark, path, NOTES, multiline=True)
    return df if with_text else df.select("subject_id", "hadm_id")


def read_diagnoses(spark: SparkSession, path: str) -> DataFrame:
    """(hadm_id, seq_num, icd_code) with the code kept as text."""
    return read_csv(spark, path, DIAGNOSES)


def land_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, files_per_partition: int | None = None) -> None:
    """Write once as Parquet (overwrite). ``partition_by`` gives directory partitions for pruning."""
    out = df
    if files_per_partition:
        out = out.repartition(files_per_partition, *(partition_by or []))
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def write_artifact(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Stage outputs (cohort, vocabulary, sequences, vectors, scores, report) as Parquet; ``split`` partitions
    let a reader of one split skip the other's files."""
    land_parquet(df, path, partition_by)


def write_bucketed(
    df: DataFrame, table: str, path: str, key: str = "hadm_id", buckets: int = 200, partition_by: list[str] | None = None
) -> DataFrame:
    """Store rows as an external Parquet table bucketed and sorted by ``key``, and return it. Tables with the same
    number of buckets join on the key without an exchange; ``partition_by`` columns also prune whole folders. Rows are
    dealt to the buckets before the write, so each bucket of a partition is one file."""
    writer = df.repartition(buckets, key).write.format("parquet").mode("overwrite").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)
