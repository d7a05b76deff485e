"""Dense-vector column expressions over ``ARRAY<FLOAT|DOUBLE>`` (higher-order built-ins, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.functions.scalar import ColumnOrName, _c, sigmoid


def lit_vector(values: Sequence[float]) -> Column:
    """A constant ``ARRAY<DOUBLE>`` (weights supplied by the caller)."""
    return F.array(*[F.lit(float(v)) for v in values])


def concat_vectors(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.concat(_c(a).cast("array<double>"), _c(b).cast("array<double>"))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Sum of element-wise products, accumulated in double."""
    products = F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def linear1(x: ColumnOrName, weights: Sequence[float], bias: float) -> Column:
    """One-output linear layer: x . w + b."""
    return dot(x, lit_vector(weights)) + F.lit(float(bias))


def _per_element(value: Column, like: Column) -> Column:
    """``value`` repeated once per element of ``like``. A per-row scalar enters a lambda as an argument this
    way, so it is evaluated once per row even after Catalyst inlines it, not once per element."""
    return F.array_repeat(value, F.size(like))


def weighted_sum(a: ColumnOrName, b: ColumnOrName, gate: ColumnOrName) -> Column:
    """gate * b + (1 - gate) * a, element-wise."""
    a, b = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    ab = F.arrays_zip(a.alias("a"), b.alias("b"), _per_element(_c(gate).cast("double"), a).alias("g"))
    return F.transform(ab, lambda s: s["g"] * s["b"] + (F.lit(1.0) - s["g"]) * s["a"])


def gate(code_vec: ColumnOrName, note_vec: ColumnOrName, weights: Sequence[float], bias: float) -> Column:
    """sigmoid(w . [code ; note] + b)."""
    return sigmoid(linear1(concat_vectors(code_vec, note_vec), weights, bias))


def vector_mean(x: ColumnOrName) -> Column:
    x = _c(x).cast("array<double>")
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def centered(x: ColumnOrName) -> Column:
    """x - mean(x), element-wise (the mean enters once per row)."""
    x = _c(x).cast("array<double>")
    return F.zip_with(x, _per_element(vector_mean(x), x), lambda v, m: v - m)


def normalize_centered(c: ColumnOrName, eps: float = 1e-5, gain: float = 1.0, shift: float = 0.0) -> Column:
    """c / sqrt(mean(c^2) + eps) * gain + shift for an already centered vector (biased variance)."""
    c = _c(c)
    var = F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(c)
    inv = F.lit(1.0) / F.sqrt(var + F.lit(eps))
    return F.zip_with(c, _per_element(inv, c), lambda v, s: v * s * F.lit(gain) + F.lit(shift))


def layer_norm(x: ColumnOrName, eps: float = 1e-5, gain: float = 1.0, shift: float = 0.0) -> Column:
    """(x - mean) / sqrt(biased variance + eps) * gain + shift, per vector."""
    return normalize_centered(centered(x), eps, gain, shift)


def l2_norm(x: ColumnOrName) -> Column:
    return F.sqrt(dot(x, x))


def is_ml_vector(df: DataFrame, col: str) -> bool:
    """Whether the column holds Spark ML vectors (dense or sparse) rather than arrays."""
    return isinstance(df.schema[col].dataType, VectorUDT)


def ml_vector(df: DataFrame, col: str) -> Column:
    """The column as Spark ML vectors; sparse ones stay sparse."""
    return F.col(col) if is_ml_vector(df, col) else array_to_vector(F.col(col).cast("array<double>"))


def vector_cells(df: DataFrame, *keep: str, col: str = "vec") -> DataFrame:
    """(kept columns, place, x): one row per stored value of each vector (all of a dense one, those of a sparse one)."""
    if is_ml_vector(df, col):
        u = F.unwrap_udt(F.col(col))
        dense = F.transform(u["values"], lambda v, i: F.struct(i.alias("place"), v.alias("x")))
        sparse = F.transform(u["values"], lambda v, i: F.struct(F.get(u["indices"], i).alias("place"), v.alias("x")))
        cells = df.select(*keep, F.explode(F.when(u["type"] == 1, dense).otherwise(sparse)).alias("_c"))
        return cells.select(*keep, "_c.place", "_c.x")
    return df.select(*keep, F.posexplode(F.col(col).cast("array<double>")).alias("place", "x"))
