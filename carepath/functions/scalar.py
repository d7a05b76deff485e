"""Scalar column expressions (JVM-side built-ins only; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(z: ColumnOrName) -> Column:
    """1 / (1 + e^-z)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def clamp(x: ColumnOrName, lo: float = -10.0, hi: float = 10.0) -> Column:
    """Clamp to [lo, hi]; NaN stays NaN (Spark's greatest/least would turn NaN into ``hi``)."""
    x = _c(x)
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def nan_to(x: ColumnOrName, value: float = 0.5) -> Column:
    """NaN -> value (the reference's fill for NaN probabilities)."""
    return F.nanvl(_c(x), F.lit(value))


def clamped_probability(logit: ColumnOrName, lo: float = -10.0, hi: float = 10.0, nan_fill: float = 0.5) -> Column:
    """margin -> clamp -> sigmoid -> NaN fill, in the reference's scoring order."""
    return nan_to(sigmoid(clamp(logit, lo, hi)), nan_fill)


def relu(x: ColumnOrName) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


def percent(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """100 * a / b, NULL on a zero denominator (ANSI-safe)."""
    return F.lit(100.0) * F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


# Fixed value: the whitespace set that separates word tokens (ASCII space, tab, LF, CR, FF, VT).
WHITESPACE_RUN = r"[ \t\n\r\f\x0B]+"


def word_tokens(text: ColumnOrName) -> Column:
    """Whitespace word tokens of a whole text (empty strings removed)."""
    return F.array_remove(F.split(_c(text), WHITESPACE_RUN), "")


def count_vectorizer_tokens(text: ColumnOrName) -> Column:
    """Lower-cased words of two or more word characters (the default token rule of a count vectorizer)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"\b\w\w+\b"), 0)


def array_to_string(arr: ColumnOrName, sep: str = ",") -> Column:
    """Render an array as a delimited string (for reports and oracle comparison)."""
    return F.array_join(_c(arr).cast("array<string>"), sep)


def rounded_array_string(arr: ColumnOrName, digits: int = 6, sep: str = ",") -> Column:
    """Render a numeric array with every element rounded (for reports and oracle comparison)."""
    rounded = F.transform(_c(arr), lambda v: F.round(v.cast("double"), digits))
    return F.array_join(rounded.cast("array<string>"), sep)
