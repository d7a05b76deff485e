"""Helpers shared by the training-data operators: stages, hash folds, word hashes and byte-bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.session import materialize

# The six white-space characters that end a word, as a regex class, as text, and its complement.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

SLICE_BYTES = 2_000_000
BATCH_ROWS = 256


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and cut its lineage."""
    return materialize(df)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, an Arrow batch sent to Python holds BATCH_ROWS rows at most, or the session's own limit if lower.

    ``mapInArrow`` ends a batch by rows alone (Spark's default is 10,000), whatever its bytes. The JVM doubles a batch's
    vectors while it fills them, outside the heap, and Python holds a copy, both for each task at work.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name, "10000"))
    if 0 < own <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def stage_in_small_batches(df: DataFrame) -> DataFrame:
    """``stage`` for a job that sends long rows to Python."""
    with small_batches(df.sparkSession):
        return stage(df)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string")), F.lit(folds)).cast("int")


def held_out(doc_id: str | Column, folds: int, remainder: int) -> Column:
    """True for ids whose fold is ``remainder``, and for null ids (they are never learned from)."""
    return F.coalesce(fold(doc_id, folds) == F.lit(remainder), F.lit(True))


def text_or_empty(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order; white space at either end makes no empty word."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(inner == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS + "+"))


def hashed(tokens: Column) -> Column:
    """64-bit hash of each token."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def byte_slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``limit`` bytes of ``column`` (one row at least).

    Python memory follows the slice, not the batch: ten thousand long texts never expand at once.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
            size = pc.multiply(pc.fill_null(pc.list_value_length(col), 0), 8)
        else:
            size = pc.fill_null(pc.binary_length(col), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()  # the worker may wait for its next task, or for none


def gathered(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Join consecutive batches up to about ``limit`` bytes, so that small batches of short rows cost no more calls."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def lists(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets (rows + 1) of a list column; a null list is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


class HashLookup:
    """Places of 64-bit keys in a fixed set. Keys are mixed by an odd factor; the top 20 bits of the product say where
    to look among the sorted products, and a few steps at most follow."""

    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        mixed = np.ascontiguousarray(keys, np.int64).view(np.uint64) * self.ODD
        self.place = np.append(np.argsort(mixed, kind="stable"), 0)
        self.mixed = np.append(mixed[self.place[:-1]], np.uint64(0))
        top = (self.mixed[:-1] >> np.uint64(44)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << 20) + 1))
        self.steps = int(np.diff(self.first).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key in the given order, -1 where it is not there."""
        mixed = np.ascontiguousarray(wanted, np.int64).view(np.uint64) * self.ODD
        top = (mixed >> np.uint64(44)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(mixed), -1, np.int64)
        left = np.flatnonzero(at < end)
        for _ in range(self.steps):
            hit = self.mixed[at[left]] == mixed[left]
            out[left[hit]] = self.place[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra columns of the input can never clash with the operator's own."""
    return df.select(*names)


# A set of keys is broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 8 * 1024 * 1024


def few(rows: DataFrame, row_bytes: int = 24) -> bool:
    """Whether staged rows fit into a broadcast. A shuffle of few rows still writes files for each task."""
    return rows.count() * row_bytes <= BROADCAST_BYTES


def small_side(rows: DataFrame, row_bytes: int = 24) -> DataFrame:
    """Staged rows as one side of a join: broadcast if they are few, so that the other side stays where it is."""
    return F.broadcast(rows) if few(rows, row_bytes) else rows


def _filter(docs: DataFrame, keys: DataFrame, on: dict[str, Column], key_bytes: int, how: str) -> DataFrame:
    side = small_side(stage(keys.select([F.col(k).alias(f"_key_{k}") for k in on]).distinct()), key_bytes)
    condition = None
    for name, value in on.items():
        same = value.eqNullSafe(F.col(f"_key_{name}"))
        condition = same if condition is None else condition & same
    return docs.join(side, condition, how)


def without(docs: DataFrame, keys: DataFrame, on: dict[str, Column], key_bytes: int = 24) -> DataFrame:
    """``docs`` without the rows whose key is in ``keys``. ``on`` gives, for each key column, the value in ``docs``;
    nulls match nulls. The keys are staged and counted: a small set is broadcast, so the texts stay where they are."""
    return _filter(docs, keys, on, key_bytes, "left_anti")


def only(docs: DataFrame, keys: DataFrame, on: dict[str, Column], key_bytes: int = 24) -> DataFrame:
    """``docs`` with only the rows whose key is in ``keys``; otherwise as ``without``."""
    return _filter(docs, keys, on, key_bytes, "left_semi")
