"""Binary logistic regression over many features: Spark ML's estimator, whose optimizer then keeps its history on disk."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.session import arrow_rows, materialize

# Features up to which Spark ML's own optimizer runs: it holds some 35 numbers for each on the driver's heap.
HELD_FEATURES = 1 << 19
# Numbers of a slice of a sum; cells of a packed row; rows of an Arrow batch of vectors, and of packed rows.
SLICE = 1 << 16
PACKED_CELLS = 1 << 14
VECTOR_ROWS, PACKED_ROWS = 256, 64

_PACKED = "counts binary, places binary, values binary, labels binary, weights binary"
_KINDS = {"counts": np.int32, "places": np.int32, "values": np.float64, "labels": np.float64, "weights": np.float64}
_SLICES = "slice int, places binary, sums binary"


def _pack(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (size, places, values, label, weight) into rows of about PACKED_CELLS cells, each column as bytes."""
    most = PACKED_CELLS

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("places")
            counts = lists.value_lengths().to_numpy().astype(np.int32)
            places, values = (batch.column(c).flatten().to_numpy() for c in ("places", "values"))
            if (batch.column("size").to_numpy() != size).any():
                raise ValueError(f"the features have different sizes, the first {size}")
            if not np.isfinite(values).all():
                raise ValueError("a feature is not a number or not finite")
            ends = np.cumsum(counts, dtype=np.int64)
            labels, weights = (batch.column(c).to_numpy() for c in ("label", "weight"))
            cuts = np.flatnonzero(np.diff((ends - counts) // most)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(counts)]):
                cells = slice(ends[lo] - counts[lo], ends[hi - 1])
                own = (counts[lo:hi], places[cells], values[cells], labels[lo:hi], weights[lo:hi])
                columns = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(own, _KINDS.values())]
                yield pa.RecordBatch.from_arrays(columns, list(_KINDS))

    return pack


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, place, value) of the cells of the packed rows, and (label, weight) of the rows."""
    read = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), _KINDS[name])
    counts = read("counts")
    return np.repeat(np.arange(len(counts)), counts), read("places"), read("values"), read("labels"), read("weights")


def _slice(k: int, own: np.ndarray) -> pa.RecordBatch:
    """The numbers of slice ``k`` that are not 0."""
    at = np.flatnonzero(own).astype(np.int32)
    columns = [pa.array([k], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["slice", "places", "sums"])


def _add_slices(table: pa.Table, total: np.ndarray, width: int, first: int = 0) -> None:
    for k, at, sums in zip(*(table.column(c) for c in ("slice", "places", "sums"))):  # read where they lie, not copied
        total[(k.as_py() - first) * width + np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(sums.as_buffer(), np.float64)


def _summed(packed: DataFrame, length: int, add: Callable[..., None], held: np.ndarray | None = None) -> np.ndarray:
    """The sum over all packed rows of a vector of ``length``: ``add(total, held, *cells)`` adds those of a batch. Each
    task sends what is not 0 of its own sum in slices, which are merged by slice; the merged sum passes the driver."""
    sent, width = packed.sparkSession.sparkContext.broadcast(held), SLICE

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        with np.errstate(all="ignore"):
            for batch in batches:
                if batch.num_rows:
                    add(total, sent.value, *_cells(batch))
        for k in range(-(-length // width)):
            if (own := total[k * width : (k + 1) * width]).any():
                yield _slice(k, own)

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.zeros(width)
        _add_slices(parts, total, width, key[0].as_py())
        return pa.Table.from_batches([_slice(key[0].as_py(), total)])

    total = np.zeros(length)
    try:
        with arrow_rows(packed.sparkSession, PACKED_ROWS):
            slices = packed.mapInArrow(part, _SLICES).groupBy("slice").applyInArrow(merge, _SLICES)
            _add_slices(slices.toArrow(), total, width)
    finally:
        sent.destroy()
    return total


def _on_disk(*shape: int) -> np.ndarray:
    """Zeros in a file that goes with the array."""
    return np.memmap(tempfile.TemporaryFile(), np.float64, "w+", shape=shape)


class _Failed(Exception):
    """The direction or the line search gives no step."""


class _History:
    """The last steps and changes of the gradient, on disk, and the direction that they give (two-loop recursion)."""

    def __init__(self, length: int, m: int = 10):
        self.table, self.m, self.used = _on_disk(2 * m, length), m, []  # used: pairs of rows, the newest first

    def add(self, step: np.ndarray, change: np.ndarray) -> None:
        k = next(k for k in range(self.m) if k not in self.used[: self.m - 1])
        self.table[2 * k], self.table[2 * k + 1] = step, change
        self.used = [k, *self.used][: self.m]

    def direction(self, gradient: np.ndarray) -> np.ndarray:
        out, scratch, scale, found = gradient.copy(), np.empty_like(gradient), np.float64(1.0), []
        pairs = [(self.table[2 * k], self.table[2 * k + 1]) for k in self.used]
        for i, (step, change) in enumerate(pairs):
            rho = step.dot(change)
            if i == 0:
                if rho < 0 or np.isnan(rho):
                    raise _Failed("the last step does not descend")
                scale = rho / change.dot(change)
            a = step.dot(out) / rho
            if np.isnan(a):
                raise _Failed("the history is not a number")
            out -= np.multiply(change, a, out=scratch)
            found.append((a, rho))
        out *= scale
        for (step, change), (a, rho) in zip(reversed(pairs), reversed(found)):
            out += np.multiply(step, a - change.dot(out) / rho, out=scratch)
        return np.negative(out, out=out)


def _step_by_cubic(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through two points (t, value, slope), at least a tenth of the way from either."""
    (l, fl, dl), (r, fr, dr) = sorted((left, right), key=lambda p: p[0])
    d1 = dl + dr - 3 * (fl - fr) / (l - r)
    d2 = np.sqrt(d1 * d1 - dl * dr)
    t = r - (r - l) * (dr + d2 - d1) / (dr - dl + 2 * d2)
    low, high = l + 0.1 * (r - l), l + 0.9 * (r - l)
    return low if t < low else high if t > high else t


def _line_search(phi: Callable[[float], tuple], value: float, slope: float, t: float) -> float:
    """A step that meets the strong Wolfe conditions; the last one that ``phi`` (value, slope) was asked for."""
    if slope > 0:
        raise _Failed("the direction does not descend")
    point = lambda at: (at, *phi(at))
    too_high = lambda p: p[1] > value + 1e-4 * p[0] * slope
    flat = lambda p: abs(p[2]) <= 0.9 * abs(slope)

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(10):
            c = point(_step_by_cubic(low, high))
            if too_high(c) or c[1] >= low[1]:
                high = c
                continue
            if flat(c):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _Failed("line search: zoom failed")

    low = (np.float64(0.0), value, slope)
    for i in range(10):
        c = point(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if too_high(c) or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if flat(c):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Failed("line search failed")


def minimize(objective: Callable[[np.ndarray], tuple], x: np.ndarray, max_iter: int, tolerance: float) -> tuple[np.ndarray, list[float]]:
    """The steps of Spark ML's optimizer (Breeze's L-BFGS with ten corrections, strong Wolfe line search, its ends) for
    ``objective`` (value, gradient) -> (x, values of the iterations). Six vectors are in memory, the history is on disk."""
    value, gradient = objective(x)
    history, values, failed, done = _History(len(x)), [value], False, 0
    recent = [np.inf]
    while not (
        (max_iter >= 0 and done >= max_iter)
        or (len(recent) >= 2 and abs(value - max(recent)) <= tolerance * abs(values[0]))
        or np.sqrt(gradient.dot(gradient)) <= max(tolerance * abs(value), 1e-8)
    ):
        last: list = []

        def phi(t: float) -> tuple:
            last.clear()  # first, so that no more vectors than these are held
            last.append(x + direction * t)
            last.extend(objective(last[0]))
            return last[1], last[2].dot(direction)

        try:
            direction = history.direction(gradient)
            start = 1.0 / np.sqrt(direction.dot(direction)) if done == 0 else np.float64(1.0)
            t = _line_search(phi, value, gradient.dot(direction), start)
            if t * np.sqrt(gradient.dot(gradient)) < 1e-10:
                raise _Failed("the step is too small")
        except _Failed:
            if failed:
                break
            failed, history.used = True, []
            continue
        np.subtract(last[0], x, out=x)
        np.subtract(last[2], gradient, out=gradient)
        history.add(x, gradient)
        x, value, gradient = last
        failed, done = False, done + 1
        values.append(value)
        recent = [*recent, value][-20:]
    return x, values


def _first_sums(total: np.ndarray, held: None, row: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    """By feature: sum of w x, sum of w and number where x is not 0; then rows, w, w squared, w of label 1, other labels."""
    n = (len(total) - 5) // 3
    there = (x != 0).astype(np.float64)
    for k, values in enumerate((w[row] * x, w[row] * there, there)):
        total[k * n : (k + 1) * n] += np.bincount(place, values, n)
    total[3 * n :] += [len(y), w.sum(), (w * w).sum(), w[y == 1].sum(), ((y != 0) & (y != 1)).sum()]


def _squares(total: np.ndarray, mean: np.ndarray, row: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    total += np.bincount(place, w[row] * (x - mean[place]) ** 2 * (x != 0), len(total))


def _loss(total: np.ndarray, b: np.ndarray, row: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    """By feature the sum of w (p - y) x, then the sums of w (p - y) and of the log loss; the last of ``b`` is the intercept."""
    margin = b[-1] + np.bincount(row, x * b[place], len(y))
    off = w * (1.0 / (1.0 + np.exp(-margin)) - y)
    total[:-2] += np.bincount(place, x * off[row], len(total) - 2)
    total[-2:] += [off.sum(), (w * np.logaddexp(0.0, np.where(y > 0, -margin, margin))).sum()]


class WideLogisticRegression(LogisticRegression):
    """``LogisticRegression``; beyond HELD_FEATURES features, a binary L2 fit without standardization takes the same steps
    on the same objective, but its gradient is summed in slices and the optimizer's history is a file on the driver's
    disk, so the driver holds a few numbers for each feature. Such a model has no training summary."""

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        cells = F.unwrap_udt(F.col(self.getFeaturesCol()))
        size = F.coalesce(cells["size"], F.size(cells["values"]))
        first = dataset.select(size.alias("size")).first()
        plain = self.getElasticNetParam() == 0.0 and not self.getStandardization() and self.getFitIntercept() and self.isDefined(self.weightCol)
        if first is None or first["size"] <= HELD_FEATURES or not plain:
            return super()._fit(dataset)
        n = first["size"]
        places = F.coalesce(cells["indices"], F.sequence(F.lit(0), F.size(cells["values"]) - 1))
        label, weight = F.col(self.getLabelCol()).cast("double"), F.col(self.getWeightCol()).cast("double")
        rows = dataset.select(size.alias("size"), places.alias("places"), cells["values"].alias("values"), label.alias("label"), weight.alias("weight"))
        with arrow_rows(dataset.sparkSession, VECTOR_ROWS):
            packed = materialize(rows.mapInArrow(_pack(n), _PACKED))

        sums = _summed(packed, 3 * n + 5, _first_sums)
        count, total, squared, positive, other = sums[3 * n :]
        if other or not 0 < positive < total:  # labels that Spark ML refuses, or a single one: nothing to optimize
            return super()._fit(dataset)
        mean, inverse_std = _on_disk(n), _on_disk(n)
        np.divide(sums[:n], total, out=mean)
        spread = _summed(packed, n, _squares, np.asarray(mean))
        spread += np.where(sums[2 * n : 3 * n] < count, (total - sums[n : 2 * n]) * mean**2, 0.0)
        spread /= total - squared / total
        varies = spread > 1e-24 * mean**2  # else the same value in all rows, but for rounding
        inverse_std[varies] = 1.0 / np.sqrt(spread[varies])
        mean *= inverse_std
        reg = self.getRegParam()
        del sums, spread, varies

        def objective(c: np.ndarray) -> tuple:
            b = np.append(c[:-1] * inverse_std, c[-1] - c[:-1].dot(mean))
            found = _summed(packed, n + 2, _loss, b)
            found /= total
            gradient, loss = found[:-1], found[-1]
            gradient[:-1] *= inverse_std
            gradient[:-1] -= gradient[-1] * mean
            b = b[:-1]
            loss += 0.5 * reg * b.dot(b)
            b *= inverse_std
            b *= reg
            gradient[:-1] += b
            return loss, gradient

        start = np.zeros(n + 1)
        start[-1] = np.log(positive / (total - positive))
        with np.errstate(all="ignore"):
            c, _ = minimize(objective, start, self.getMaxIter(), self.getTol())
        intercept = float(c[-1] - c[:-1].dot(mean))
        coefficients = Vectors.dense(c[:-1] * inverse_std)
        name = "org.apache.spark.ml.classification.LogisticRegressionModel"
        return self._copyValues(LogisticRegressionModel._create_from_java_class(name, self.uid, coefficients, intercept))
