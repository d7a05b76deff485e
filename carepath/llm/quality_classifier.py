"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Each document becomes a short vector of statistics of its text. Standardised with the training rows' means and
deviations, the vector is mapped by ``sqrt(2/D) cos(x W + b)``, whose inner products approximate a Gaussian kernel.
Tasks add up the normal equations of their training rows, Spark adds the tasks' sums, and the driver solves systems of
FEATURES + 1 unknowns. Two folds are summed apart: each fold's rows are scored by the other fold's solution, and the
isotonic map from score to label rate is fitted to these out-of-fold scores, summed in BINS ranges of the score.

Defined results: a null text is empty and scored like any other; without training rows every score is 0.5, with one
class only it is close to that class; several labels of one document are averaged; labels without a document and
null labels teach nothing; null ids are scored and not learned from; repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import byte_slices, stage, text_or_empty, texts
from carepath.llm.statistics import COMMON_WORDS, SYMBOLS

FEATURES = 256
RIDGE = 1e-3
BINS = 1024
SEED = 11
CLIP = 6.0
RANGE = (-0.5, 1.5)

STATISTICS = (
    "log_words", "word_length", "long_words", "lower", "upper", "digit", "space", "symbol", "punctuation", "other",
    "distinct_words", "top_word", "same_as_before", "common_words", "short_lines", "duplicate_lines", "line_length",
    "compression", "exclaimed", "capitalised",
)
_COMMON = frozenset(w for group in COMMON_WORDS.values() for w in group)
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol, 6 ASCII punctuation."""
    global _CLASS
    if _CLASS is None:
        table = np.zeros(0x110000, np.int8)
        for i in range(0x110000):
            c = chr(i)
            if c.islower():
                table[i] = 1
            elif c.isupper():
                table[i] = 2
            elif c.isdigit():
                table[i] = 3
            elif c.isspace():
                table[i] = 4
            elif c in SYMBOLS:
                table[i] = 5
            elif i < 128:
                table[i] = 6
        _CLASS = table
    return _CLASS


def statistics(text: str) -> list[float]:
    """The STATISTICS of one whole text."""
    if not text:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    share = np.bincount(_classes()[codes], minlength=7) / len(codes)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 3 + share[[1, 2, 3, 4, 5, 6, 0]].tolist() + [0.0] * 10
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    raw = text.encode("utf-8", "surrogatepass")
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float((lengths > 12).mean()),
        *share[[1, 2, 3, 4, 5, 6, 0]].tolist(),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(k for w, k in counts.items() if w.lower() in _COMMON) / n,
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(text) / max(1, len(lines)))),
        len(zlib.compress(raw, 1)) / (len(raw) + 20),
        sum(k for w, k in counts.items() if w.endswith("!")) / n,
        sum(k for w, k in counts.items() if w[0].isupper()) / n,
    ]


def measure(docs: DataFrame, keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, x): the statistics of every text, staged; a few numbers a document."""
    rows = docs.select(*keep, text_or_empty().alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "_text"):
            x = np.array([statistics(t) for t in texts(batch, "_text")])
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)
            out = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), out], [*names, "x"])

    return stage(rows.mapInArrow(run, f"{schema}, x array<double>"))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # None: no training rows
    knots: np.ndarray
    rates: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        d = len(STATISTICS)
        w = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated score; a hundredth of it follows the raw score, so equal rates keep their order."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        rate = np.interp(raw, self.knots, self.rates) if len(self.knots) else np.clip(raw, 0, 1)
        return np.clip(0.99 * rate + 0.01 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(STATISTICS))


def isotonic(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of weighted values (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for r, w in zip(rate, weight):
        blocks.append([r, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            r2, w2, n2 = blocks.pop()
            r1, w1, n1 = blocks.pop()
            blocks.append([(r1 * w1 + r2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), r) for r, _, n in blocks]) if blocks else np.zeros(0)


def _normal_equations(rows: DataFrame, model: Model) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per fold (0, 1): Z'Z, Z'y and the row count, summed by task and then by Spark."""
    k = FEATURES + 1
    upper = np.triu_indices(k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y = model.features(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                zf, yf = z[fold == f], y[fold == f]
                part = np.concatenate([(zf.T @ zf)[upper], zf.T @ yf])
                sums[int(f)] = sums.get(int(f), 0) + part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
            ["fold", "part"],
        )

    parts = rows.select("x", "y", "fold").mapInArrow(run, "fold int, part array<double>")
    total = parts.select("fold", F.posexplode("part").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v"))
    flat = {f: np.zeros(len(upper[0]) + k) for f in (0, 1)}
    table = total.toPandas()
    for f in (0, 1):
        own = table[table["fold"] == f]
        flat[f][own["i"].to_numpy()] = own["v"].to_numpy()
    out = {}
    for f, v in flat.items():
        a = np.zeros((k, k))
        a[upper] = v[: len(upper[0])]
        out[f] = (a + np.triu(a, 1).T, v[len(upper[0]) :], a[-1, -1])
    return out


def _solve(a: np.ndarray, b: np.ndarray, n: float) -> np.ndarray:
    penalty = RIDGE * max(n, 1.0) * np.eye(len(b)) / 2
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, b)


def fit(training: DataFrame) -> Model:
    """Train from (x, y, fold): y in 0..1, fold 0 or 1. Only sums of a fixed size reach the driver."""
    rows = stage(training.select("x", F.col("y").cast("double").alias("y"), "fold"))
    d = range(len(STATISTICS))
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.avg(F.get("x", i)) for i in d)).alias("mean"),
        F.array(*(F.stddev_pop(F.get("x", i)) for i in d)).alias("sd"),
    ).first()
    if not stats.n:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), None, np.zeros(0), np.zeros(0))
    mean, scale = np.array(stats["mean"]), np.array(stats.sd)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), None, np.zeros(0), np.zeros(0))
    sums = _normal_equations(rows, model)
    other = {f: _solve(*sums[1 - f]) for f in (0, 1)}
    model.weights = _solve(*(x + y for x, y in zip(sums[0], sums[1])))
    base, low, high = Model(model.mean, model.scale, None, np.zeros(0), np.zeros(0)), *RANGE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = base.features(_matrix(batch))
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.where(fold == 0, z @ other[0], z @ other[1])
            cut = np.clip((raw - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cut), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    if min(sums[0][2], sums[1][2]) > 0:
        bins = rows.mapInArrow(run, "bin int, raw double, y double").groupBy("bin")
        table = bins.agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()
        table = table.sort_values("raw")
        fitted = isotonic(table["y"].to_numpy(), table["n"].to_numpy(float))
        # One knot per block, at its weighted middle, so the map rises between blocks.
        starts = np.flatnonzero(np.concatenate([[True], np.diff(fitted) > 0]))
        ends = np.concatenate([starts[1:], [len(fitted)]])
        raw, n = table["raw"].to_numpy(), table["n"].to_numpy(float)
        model.knots = np.array([np.average(raw[a:b], weights=n[a:b]) for a, b in zip(starts, ends)])
        model.rates = fitted[starts]
    return model


def apply(measured: DataFrame, model: Model) -> DataFrame:
    """Measured rows with ``score`` and ``predicted`` in place of ``x``."""
    fields = [f for f in measured.schema.fields if f.name != "x"]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                [*names, "score", "predicted"],
            )

    return measured.mapInArrow(run, f"{schema}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, learn: Column, fold: Column, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, score, predicted) of every document. ``learn`` says which ids may teach, ``fold`` (an
    integer expression on doc_id) deals them to the two folds; ``labels`` has (doc_id, quality)."""
    measured = measure(docs, ("doc_id", *keep))
    taught = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("y"))
    )
    rows = measured.select("doc_id", "x").join(taught, "doc_id").withColumn("fold", F.pmod(fold, F.lit(2)).cast("int"))
    return apply(measured, fit(rows))
