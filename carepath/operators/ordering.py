"""Distributed positions, deterministic shuffles and fixed-size batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.session import materialize, shuffle_partitions

_POS_BITS = 33  # monotonically_increasing_id = partition_id << 33 | position within partition


def row_index(
    df: DataFrame,
    order_cols: Sequence[str],
    name: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a 1-based position in the global order of ``order_cols``; see ``row_index_with_total``."""
    return row_index_with_total(df, order_cols, name, num_partitions)[0]


def sorted_partitions(df: DataFrame, order_cols: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``order_cols``, checkpointed, with ``_mid`` (increasing in that order)
    and ``_part`` (the number of the range partition). Both survive recomputation."""
    parts = num_partitions or shuffle_partitions(df.sparkSession)
    staged = (
        df.repartitionByRange(parts, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return materialize(staged).withColumn("_part", F.shiftright("_mid", _POS_BITS).cast("int"))


def with_positions(staged: DataFrame, name: str = "rn") -> tuple[DataFrame, int]:
    """Add the 1-based global position to the rows of ``sorted_partitions`` and return the row count too.

    The row count of each partition (one number per partition) comes back to the driver and returns as a broadcast
    table of offsets.
    """
    counts = dict(staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, running = [], 0
    for part in sorted(counts):
        offsets.append((part, running))
        running += counts[part]
    # One row per partition, broadcast once per executor (a plan literal would travel with every task).
    table = staged.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _off long")
    pos = F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    out = staged.join(F.broadcast(table), "_part").withColumn(name, (F.col("_off") + pos + F.lit(1)).cast("long"))
    return out.drop("_off"), running


def row_index_with_total(
    df: DataFrame,
    order_cols: Sequence[str],
    name: str = "rn",
    num_partitions: int | None = None,
) -> tuple[DataFrame, int]:
    """Add a 1-based position in the global order of ``order_cols`` and return the row count too.

    Distributed: a range shuffle sorts the rows into ordered partitions, each row takes its position inside
    its partition, and the frame is checkpointed so the positions stay fixed under recomputation.
    Rows tied on ``order_cols`` get distinct, arbitrary positions among themselves.
    """
    out, total = with_positions(sorted_partitions(df, order_cols, num_partitions), name)
    return out.drop("_mid", "_part"), total


def shuffle_key(id_col: str | Column, seed: int) -> Column:
    """Deterministic pseudo-random order key, the same in any engine (unlike ``rand()``): md5 of ``seed:id``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", F.lit(str(int(seed))), c.cast("string")))


def batch_ids(rn: str | Column, batch_size: int) -> Column:
    """Fixed-size batch number from a 1-based position."""
    c = F.col(rn) if isinstance(rn, str) else rn
    return F.floor((c - F.lit(1)) / F.lit(batch_size)).cast("long")
