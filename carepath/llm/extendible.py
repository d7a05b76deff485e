"""Sharding by extendible hashing: a bucket that exceeds its byte limit splits on one more bit of the key's hash.

The directory starts at a depth where an average bucket holds two to four limits; from there each bucket that exceeds
the limit, and no other, splits on the next bit. Bytes are summed once per cell, SPARE_BITS deeper than the start,
and the splits are read off these sums; only cells that still exceed the limit are summed again, ROUND_BITS deeper.
Rows whose hashes agree in all 64 bits cannot be split by bits: they fill overflow pages of ``limit // largest row``
rows (one at least). The directory stays a table; only scalars (total bytes, cells left) reach the driver.

Defined results: a null text has 0 bytes; a null key hashes like any other value; repeated rows share a hash and
split into pages if they must; a single row above the limit has a page of its own, the only shards above the limit;
an empty table has no shards. Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import stage
from carepath.operators.ordering import row_index

SHARD_BYTES = 16 * 1024 * 1024
SPARE_BITS = 5
ROUND_BITS = 8
HASH_BITS = 64
OUTPUT = ("shard", "depth", "shard_bytes", "shard_rows")


def prefix(hash_col: Column, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit hash, as a number."""
    return F.shiftrightunsigned(hash_col, HASH_BITS - depth) if depth else F.lit(0).cast("long")


def _bits(node: Column, depth: Column) -> Column:
    """The bits of a prefix as text; the root is the empty text."""
    return F.when(depth == 0, F.lit("")).otherwise(F.right(F.lpad(F.bin(node), HASH_BITS, "0"), depth))


def split_cells(cells: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """(cell, n_bytes, n_rows) at ``depth`` -> (cell, over, shard, depth, shard_bytes, shard_rows).

    The bucket of a cell is the first node on its path from ``start`` whose bytes fit; ``over`` marks cells where
    none does. All windows of a cell lie in its start node (2 ** (depth - start) cells at most): one shuffle.
    """
    root = F.shiftrightunsigned("cell", depth - start) if depth > start else F.col("cell")
    out = cells.withColumn("_root", root).repartition("_root")
    levels = list(range(start, depth + 1))
    for d in levels:
        node = F.shiftrightunsigned("cell", depth - d) if d < depth else F.col("cell")
        out = out.withColumn(f"_n{d}", node)
        w = Window.partitionBy("_root", f"_n{d}")
        out = out.withColumn(f"_b{d}", F.sum("n_bytes").over(w)).withColumn(f"_r{d}", F.sum("n_rows").over(w))
    at = F.lit(None)
    for d in reversed(levels):
        fit = F.struct(
            F.col(f"_n{d}").alias("node"), F.lit(d).alias("depth"), F.col(f"_b{d}").alias("n"), F.col(f"_r{d}").alias("rows")
        )
        at = F.when(F.col(f"_b{d}") <= limit, fit) if d == depth else F.when(F.col(f"_b{d}") <= limit, fit).otherwise(at)
    out = out.withColumn("_at", at)
    return out.select(
        "cell",
        F.col("_at").isNull().alias("over"),
        _bits(F.col("_at.node"), F.col("_at.depth")).alias("shard"),
        F.col("_at.depth").alias("depth"),
        F.col("_at.n").alias("shard_bytes"),
        F.col("_at.rows").alias("shard_rows"),
    )


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows (with ``_h``, ``_bytes``) that no bit separates. Positions come from a range shuffle
    on (hash, row number), so one hash with any number of rows spreads over all tasks."""
    numbered = stage(rows.withColumn("_uid", F.monotonically_increasing_id()))
    placed = stage(row_index(numbered, ["_h", "_uid"], "_pos"))
    per_hash = placed.groupBy("_h").agg(F.min("_pos").alias("_first"), F.max("_bytes").alias("_largest"))
    page_rows = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("_largest"))))
    paged = placed.join(per_hash, "_h").withColumn(
        "shard",
        F.concat(
            _bits(F.col("_h"), F.lit(HASH_BITS)),
            F.lit("."),
            F.floor((F.col("_pos") - F.col("_first")) / page_rows).cast("string"),
        ),
    )
    sizes = paged.groupBy("shard").agg(F.sum("_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return paged.join(sizes, "shard").withColumn("depth", F.lit(HASH_BITS)).drop("_uid", "_pos", "_first", "_largest")


def shard(
    docs: DataFrame,
    limit: int = SHARD_BYTES,
    key: Column | None = None,
    n_bytes: Column | None = None,
) -> DataFrame:
    """``docs`` plus (shard, depth, shard_bytes, shard_rows); ``key`` defaults to doc_id, ``n_bytes`` to the text's."""
    key = F.col("doc_id") if key is None else key
    n_bytes = F.octet_length(F.col("text")) if n_bytes is None else n_bytes
    columns = [c for c in docs.columns if c not in OUTPUT]
    # The input's columns travel in one struct, so none can clash with the columns that the split works with.
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(1).alias("_none"))
    packed = docs.select(row.alias("_row"), F.xxhash64(key).alias("_h"), F.coalesce(n_bytes.cast("long"), F.lit(0)).alias("_bytes"))
    out = _split(packed, limit)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in columns], *OUTPUT)


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """(_row, _h, _bytes) -> _row and the OUTPUT columns."""
    if limit < 1:
        raise ValueError("the byte limit must be positive")
    kept = ("_row", *OUTPUT)
    narrow = rows.select("_h", "_bytes")
    total = narrow.agg(F.sum("_bytes")).first()[0] or 0
    start = min(HASH_BITS - SPARE_BITS, max(0, math.floor(math.log2(max(1, total / limit))) - 1))
    depth, done = start + SPARE_BITS, []
    while True:
        cells = narrow.groupBy(prefix(F.col("_h"), depth).alias("cell")).agg(
            F.sum("_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")
        )
        placed = stage(split_cells(cells, start, depth, limit))
        joined = rows.withColumn("cell", prefix(F.col("_h"), depth)).join(placed, "cell")
        done.append(joined.where(~F.col("over")).select(*kept))
        left = placed.where("over").select("cell")
        if not left.take(1):
            break
        inside = rows.withColumn("cell", prefix(F.col("_h"), depth)).join(left, "cell", "left_semi").drop("cell")
        if depth == HASH_BITS:
            done.append(_pages(inside, limit).select(*kept))
            break
        rows, start = inside, depth + 1
        narrow, depth = rows.select("_h", "_bytes"), min(HASH_BITS, depth + ROUND_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
