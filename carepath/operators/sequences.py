"""Ordered code sequences per admission, next-step pairs, batches, code frequencies and length profiles."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from carepath.operators.ordering import batch_ids, row_index, shuffle_key
from carepath.operators.vocab import LABEL_PAD, PAD_ID
from carepath.session import materialize, shuffle_partitions


def ordered_codes(
    encoded: DataFrame, keys: tuple[str, ...] = ("hadm_id",), order_cols: tuple[str, ...] = ("seq_num",)
) -> DataFrame:
    """Per key, the code ids ordered by ``order_cols`` then ``code_id`` (ties broken, so the order is total)
    -> (keys..., codes).

    The list is built by ``collect_list`` per key (partial aggregation before the shuffle): it holds the
    events of one admission, the reference's sequence model.
    """
    ev = F.struct(*[F.col(c) for c in order_cols], F.col("code_id"))
    return encoded.groupBy(*keys).agg(F.sort_array(F.collect_list(ev)).alias("_ev")).select(
        *keys, F.transform("_ev", lambda e: e["code_id"]).alias("codes")
    )


def _with_split(encoded: DataFrame, cohort: DataFrame | None) -> DataFrame:
    if "split" in encoded.columns:
        return encoded
    return encoded.join(cohort.select("hadm_id", "split"), "hadm_id")


def build_sequences(encoded: DataFrame, cohort: DataFrame | None = None, min_codes: int = 2) -> DataFrame:
    """(hadm_id, split, input_ids, labels): inputs drop the last code, labels drop the first.

    Admissions with fewer than ``min_codes`` codes are dropped (nothing to predict). ``encoded`` either
    carries ``split`` already or is joined to ``cohort`` here.
    """
    joined = _with_split(encoded, cohort)
    seqs = ordered_codes(joined, ("hadm_id", "split"))
    n = F.size("codes")
    return seqs.where(n >= F.lit(min_codes)).select(
        "hadm_id",
        "split",
        F.slice("codes", 1, n - 1).alias("input_ids"),
        F.slice("codes", 2, n - 1).alias("labels"),
    )


def next_pairs(sequences: DataFrame) -> DataFrame:
    """One row per prediction step: (hadm_id, split, pos, prev, next), array form."""
    z = F.arrays_zip(F.col("input_ids").alias("prev"), F.col("labels").alias("next"))
    return sequences.select("hadm_id", "split", F.posexplode(z).alias("pos", "_p")).select(
        "hadm_id", "split", F.col("pos").cast("long").alias("pos"), F.col("_p.prev").alias("prev"),
        F.col("_p.next").alias("next"),
    )


_PAIR = "hadm_id long, split string, pos long, prev long, next long"
_EDGE = "_rows long, _first_hadm long, _first_code long, _first_run long, _last_hadm long, _last_code long, _last_split string, _last_run long"


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the sorted rows (hadm_id, split, code_id) of one range partition, and at its end one row that says how
    the partition begins and ends. ``pos`` counts from the admission's first row in this partition; ``_part`` is set on
    pairs of the first admission, which may have begun before."""
    part = TaskContext.get().partitionId()
    rows, first = 0, None
    last: tuple | None = None  # hadm_id, code_id, split, rows of the admission so far
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hadm, code = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hadm_id", "code_id"))
        new = np.concatenate([[last is None or last[0] != hadm[0]], hadm[1:] != hadm[:-1]])
        begun = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        nth = np.arange(n) - begun
        if not new[0]:
            nth[begun < 0] = np.arange((begun < 0).sum()) + last[3]
        before = np.concatenate([[last[1] if last else 0], code[:-1]])
        if first is None:
            first = [int(hadm[0]), int(code[0]), 0]
        inside = hadm == first[0]
        first[2] += int(inside.sum())
        at = np.flatnonzero(~new)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hadm[at]),
                batch.column("split").take(pa.array(at)),
                pa.array(nth[at] - 1),
                pa.array(before[at]),
                pa.array(code[at]),
                pa.array(np.full(len(at), part, np.int32), mask=~inside[at]),
                *[pa.nulls(len(at), f.type) for f in _EDGE_FIELDS],
            ],
            _STEP_NAMES,
        )
        rows += n
        last = (int(hadm[-1]), int(code[-1]), batch.column("split")[n - 1].as_py(), int(nth[-1]) + 1)
    if rows:
        edge = [rows, *first, last[0], last[1], last[2], last[3]]
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())],
                pa.array([part], pa.int32()),
                *[pa.array([v], f.type) for v, f in zip(edge, _EDGE_FIELDS)],
            ],
            _STEP_NAMES,
        )


_EDGE_FIELDS = [
    pa.field(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split(" ") for c in _EDGE.split(", "))
]
_STEP_NAMES = [*(c.split(" ")[0] for c in _PAIR.split(", ")), "_part", *(f.name for f in _EDGE_FIELDS)]


def next_pairs_lead(encoded: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """The same pairs in row form: each code's successor in (seq_num, code_id) order, without arrays.

    Code rows are range-partitioned and sorted by (hadm_id, seq_num, code_id); a scan-time row id breaks exact ties. One
    Arrow pass pairs each row with the one before it in its range partition and is checkpointed, so the rows are
    shuffled once. How each partition begins and ends (one row each) passes the driver and gives what crosses
    partitions: one pair at most per boundary, and the rows that a partition's first admission has before it. So an
    admission with a third of all rows lies in as many tasks as any other rows, and no exchange is on ``hadm_id``.
    """
    rows = _with_split(encoded.withColumn("_tie", F.monotonically_increasing_id()), cohort)
    order = ["hadm_id", "seq_num", "code_id", "_tie"]
    rows = rows.where(F.col("hadm_id").isNotNull()).select("split", *order)
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    steps = ranged.select("hadm_id", "split", "code_id").mapInArrow(_steps, f"{_PAIR}, _part int, {_EDGE}")
    staged = materialize(steps)
    names = [c.split(" ")[0] for c in _PAIR.split(", ")]
    edges = sorted(staged.where(F.col("_rows").isNotNull()).collect(), key=lambda r: r["_part"])
    carried, crossing, before = [], [], None
    for e in edges:  # rows of the first admission in earlier partitions
        same = before is not None and before[0] == e["_first_hadm"]
        carry = before[2] if same else 0
        if same:
            carried.append((e["_part"], carry))
            crossing.append((e["_first_hadm"], before[3], carry - 1, before[1], e["_first_code"]))
        whole = same and e["_first_run"] == e["_rows"]
        before = (e["_last_hadm"], e["_last_code"], e["_last_run"] + (carry if whole else 0), e["_last_split"])
    pairs = staged.where(F.col("_rows").isNull())
    if not crossing:
        return pairs.select(*names)
    spark = staged.sparkSession
    # At most one row per range partition each.
    shift = F.broadcast(spark.createDataFrame(carried, "_part int, _carry long"))
    pairs = pairs.join(shift, "_part", "left").withColumn("pos", F.col("pos") + F.coalesce("_carry", F.lit(0)))
    return pairs.select(*names).unionByName(spark.createDataFrame(crossing, _PAIR))


def pad_batches(
    sequences: DataFrame,
    batch_size: int = 16,
    seed: int | None = None,
    pad_id: int = PAD_ID,
    label_pad: int = LABEL_PAD,
) -> DataFrame:
    """Fixed-size batches per split, each padded to its longest sequence.

    Order inside a split is ``hadm_id`` or, with ``seed``, a deterministic hash shuffle. Positions are
    global (``row_index``) and re-based per split with a per-split offset (two rows, broadcast).
    The padding window is partitioned by (split, batch_id): at most ``batch_size`` rows per group.
    """
    order = shuffle_key("hadm_id", seed) if seed is not None else F.col("hadm_id")
    keyed = sequences.withColumn("_order", order)
    numbered = row_index(keyed, ["split", "_order", "hadm_id"], "_rn")
    starts = numbered.groupBy("split").agg(F.min("_rn").alias("_start"))
    numbered = numbered.join(F.broadcast(starts), "split").withColumn(
        "pos_in_split", F.col("_rn") - F.col("_start") + F.lit(1)
    )
    batched = numbered.withColumn("batch_id", batch_ids("pos_in_split", batch_size)).withColumn(
        "pos_in_batch", ((F.col("pos_in_split") - F.lit(1)) % F.lit(batch_size)).cast("long")
    )
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("split", "batch_id"))
    pad_n = longest - F.size("input_ids")
    return batched.select(
        "hadm_id",
        "split",
        "batch_id",
        "pos_in_batch",
        F.concat("input_ids", F.array_repeat(F.lit(pad_id).cast("long"), pad_n)).alias("input_ids"),
        F.concat("labels", F.array_repeat(F.lit(label_pad).cast("long"), pad_n)).alias("labels"),
    )


def unpad_batches(batches: DataFrame, label_pad: int = LABEL_PAD) -> DataFrame:
    """Padded batches back to prediction steps: positions whose label is the padding label are masked out
    -> (hadm_id, split, pos, prev, next), equal to ``next_pairs`` of the unpadded sequences."""
    z = F.arrays_zip(F.col("input_ids").alias("prev"), F.col("labels").alias("next"))
    steps = batches.select("hadm_id", "split", F.posexplode(z).alias("pos", "_p"))
    return steps.where(F.col("_p.next") != F.lit(label_pad)).select(
        "hadm_id", "split", F.col("pos").cast("long").alias("pos"), F.col("_p.prev").alias("prev"),
        F.col("_p.next").alias("next"),
    )


def top_codes(pairs: DataFrame, k: int = 10, split: str | None = "train") -> DataFrame:
    """The k most frequent input codes (``prev`` of the pairs: the last code of a sequence is no input)
    -> (code_id, n, rank). Counting is combined map-side; the ranking sees k rows."""
    src = pairs if split is None else pairs.where(F.col("split") == split)
    counts = src.groupBy(F.col("prev").alias("code_id")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    best = counts.orderBy(F.desc("n"), "code_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "code_id")).cast("long"))


def input_lengths(sequences: DataFrame, split: str | None = "train") -> DataFrame:
    """(hadm_id, length): number of input codes per sequence, the value the length profiles describe."""
    src = sequences if split is None else sequences.where(F.col("split") == split)
    return src.select("hadm_id", F.size("input_ids").cast("long").alias("length"))


def _per_value(lengths: DataFrame, value_col: str) -> tuple[DataFrame, Row]:
    """(v, c): counts of the distinct values, combined map-side; and the row (n, lo, hi, mean) of them all."""
    per_value = lengths.groupBy(F.col(value_col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c")
    mean = F.sum(F.col("c") * F.col("v")) / total
    stats = per_value.agg(total.alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), mean.alias("mean")).first()
    return per_value, stats


def length_histogram(lengths: DataFrame, value_col: str = "length", bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max], the last bin closed on the right -> (bin, lo, hi, n).

    Values are counted per distinct value first, so only distinct values meet the edges; the bin of a value is the
    number of inner edges at or below it. Equal values v use [v - 0.5, v + 0.5]; no value gives no bins. Only the
    range (two numbers) passes the driver.
    """
    per_value, stats = _per_value(lengths, value_col)
    if not stats.n:
        return per_value.select(F.lit(0).cast("long").alias("bin"), F.col("v").alias("lo"), F.col("v").alias("hi"), F.col("c").alias("n"))
    lo, hi = (stats.lo, stats.hi) if stats.hi > stats.lo else (stats.lo - 0.5, stats.lo + 0.5)
    step = (hi - lo) / float(bins)
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: i.cast("double") * F.lit(step) + F.lit(lo))
    bin_of = F.size(F.filter(edges, lambda e: e <= F.col("v"))).cast("long")
    counts = per_value.groupBy(bin_of.alias("bin")).agg(F.sum("c").cast("long").alias("n"))
    b = F.col("bin").cast("double")
    upper = F.when(F.col("bin") == F.lit(bins - 1), F.lit(hi)).otherwise(F.lit(lo) + (b + 1) * F.lit(step))
    return counts.select("bin", (F.lit(lo) + b * F.lit(step)).alias("lo"), upper.alias("hi"), "n")


def length_density(
    lengths: DataFrame, value_col: str = "length", grid_points: int = 200, bins: int = 50
) -> DataFrame:
    """Gaussian kernel density of the values on an evenly spaced grid over [min, max], scaled to counts.

    Bandwidth = n^(-1/5) * sample standard deviation (Scott's factor), from deviations from the mean (a second pass
    over the distinct values). The curve is scaled by n * bin width so it overlays a count histogram with ``bins``
    bins. Each distinct value emits one contribution per grid point, in the task that holds it, combined before the
    shuffle. Fewer than two values, or equal ones, have no density: no rows.
    """
    per_value, stats = _per_value(lengths, value_col)
    if not stats.n or stats.n < 2 or stats.hi == stats.lo:
        return per_value.where(F.lit(False)).select(
            F.col("c").alias("point"), F.col("v").alias("x"), F.col("v").alias("density_count")
        )
    squares = per_value.agg(F.sum(F.col("c") * F.pow(F.col("v") - F.lit(stats["mean"]), 2))).first()[0]
    width = float(stats.n) ** -0.2 * math.sqrt(squares / (stats.n - 1))
    step = (stats.hi - stats.lo) / float(grid_points - 1)
    cells = per_value.select("v", "c", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("point"))
    x = F.when(F.col("point") == F.lit(grid_points - 1), F.lit(stats.hi)).otherwise(
        F.lit(stats.lo) + F.col("point").cast("double") * F.lit(step)
    )
    z = (x - F.col("v")) / F.lit(width)
    kernel = F.exp(F.lit(-0.5) * z * z) / F.lit(width * math.sqrt(2.0 * math.pi))
    sums = cells.groupBy("point").agg(F.sum(F.col("c") * kernel).alias("k"))
    bin_width = (stats.hi - stats.lo) / float(bins)
    return sums.select(F.col("point").cast("long").alias("point"), x.alias("x"), (F.col("k") * F.lit(bin_width)).alias("density_count"))
