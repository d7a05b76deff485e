"""Periodic runs of words, found by block convolution.

A run of period q is a stretch of words in which words q apart are identical, whose smallest period is q, that no
neighbouring word extends, and that is at least ``max(MIN_LENGTH, MIN_PERIODS * q)`` words long.

At the dyadic scale B the words are cut into blocks of B. A run of period q holds, for the largest power of two
B <= 3q/2, one whole block together with its copy q words on, because 4q >= 2B + q. So each block is compared with all
places of the window that lies 2B/3 to 4B/3 words after it: the sum of squared differences at every place is
``sum p^2 + sum t^2 - 2 corr(p, t)``, and ``corr`` is a number-theoretic transform modulo 65537. The transform is exact:
its sums stay below 2^53, so they run as float64 matrix products (one product up to 256 points, two with twiddle factors
beyond). A zero sum is a seed; words whose residues clash only add seeds. Every seed is extended over the words
themselves in both directions, so nothing is reported that the words do not show, and no true zero can be missed.
Blocks grow to ``MAX_BLOCK`` words; longer periods use several windows of that block.

Scales ascend, so a seed inside a run that is known already and whose period is at most a block (it divides the distance,
by Fine and Wilf) is dropped before extension: a text of one word repeated a million times costs one extension.

Work is one Arrow map over documents: no shuffle, and memory follows a slice of texts, not a partition. Nulls: a null or
blank text has no words and no runs; a null id is kept as it is; repeated rows each get their result; extra columns of
the input are left out unless asked for with ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import byte_slices, text_or_empty, texts, words

MIN_LENGTH = 6
MIN_PERIODS = 4

# A Fermat prime, whose multiplicative group has order 2^16, and a generator of it.
PRIME = 65537
GENERATOR = 3

MAX_BLOCK = 1 << 15  # twice this many points is the longest transform modulo 65537
DIRECT_POINTS = 256  # transforms up to here are one matrix product
CELLS = 1 << 19  # cells of one batch of transforms

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _mod(x: np.ndarray) -> np.ndarray:
    """Residue in [0, PRIME] of whole numbers below 2^52; a multiple of PRIME may come out as PRIME itself."""
    return x - PRIME * np.floor(x * (1.0 / PRIME))


@lru_cache(maxsize=None)
def _powers(points: int, inverse: bool) -> np.ndarray:
    """The powers 0 to points - 1 of a root of unity of that order."""
    root = pow(GENERATOR, (PRIME - 1) // points, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    out = np.ones(points, np.int64)
    for i in range(1, points):
        out[i] = out[i - 1] * root % PRIME
    return out


@lru_cache(maxsize=None)
def _matrix(points: int, inverse: bool) -> np.ndarray:
    j = np.arange(points)
    return _powers(points, inverse)[np.outer(j, j) % points].astype(np.float64)


@lru_cache(maxsize=8)
def _twiddle(rows: int, cols: int, inverse: bool) -> np.ndarray:
    power = _powers(rows * cols, inverse)
    return power[np.outer(np.arange(rows), np.arange(cols))].astype(np.float64)


class Transform:
    """Number-theoretic transform of rows of ``points`` values. The spectrum keeps the order of the factored transform;
    only products of spectra and ``back`` read it."""

    def __init__(self, points: int):
        self.points = points
        self.cols = min(points, DIRECT_POINTS)
        self.rows = points // self.cols
        self.scale = pow(points, PRIME - 2, PRIME)

    def forward(self, x: np.ndarray, inverse: bool = False) -> np.ndarray:
        """Spectrum of the rows of ``x`` (missing values at the end are zero); by the inverse root if asked."""
        if self.rows == 1:
            return _mod(x @ _matrix(self.cols, inverse)[: x.shape[1]])
        if x.shape[1] < self.points:
            x = np.pad(x, ((0, 0), (0, self.points - x.shape[1])))
        y = _mod(_matrix(self.rows, inverse) @ x.reshape(len(x), self.rows, self.cols))
        y = _mod(y * _twiddle(self.rows, self.cols, inverse))
        return _mod(y @ _matrix(self.cols, inverse))

    def back(self, y: np.ndarray, wanted: int) -> np.ndarray:
        """The first ``wanted`` values of the rows with spectrum ``y``."""
        if self.rows == 1:
            x = _mod(y @ _matrix(self.cols, True)[:, :wanted])
        else:
            x = _mod(y @ _matrix(self.cols, True))
            x = _mod(x * _twiddle(self.rows, self.cols, True))
            used = -(-wanted // self.cols)
            x = _mod(_matrix(self.rows, True)[:used] @ x)
            x = x.reshape(len(y), -1)[:, :wanted]
        return _mod(x * self.scale)


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, least distance, greatest distance) of each scale, for texts of up to ``longest`` words. The distances
    ascend without a gap, and no scale holds a distance and its double."""
    block = 1
    while True:
        least = -(-2 * block // 3)
        if MIN_PERIODS * least > longest:
            return
        greatest = -(-4 * block // 3) - 1
        yield block, least, greatest
        if block == MAX_BLOCK:
            break
        block *= 2
    while MIN_PERIODS * (greatest + 1) <= longest:
        least, greatest = greatest + 1, 2 * greatest + 1
        yield block, least, min(greatest, longest // MIN_PERIODS)


def _zero_differences(x: np.ndarray, block: int, least: int, greatest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start of a block, distance) wherever the squared differences of a block of ``x`` and the words at that distance
    sum to zero modulo PRIME. ``x`` holds residues as float64."""
    blocks = len(x) // block
    net = Transform(2 * block)
    step = max(1, CELLS // net.points)
    for first in range(least, greatest + 1, block):
        places = min(block, greatest + 1 - first)
        width = block + places - 1
        for low in range(0, blocks, step):
            high = min(blocks, low + step)
            pattern = x[low * block : high * block].reshape(high - low, block)
            text = x[low * block + first : (high - 1) * block + first + width]
            text = np.pad(text, (0, (high - 1 - low) * block + width - len(text)))
            text = np.lib.stride_tricks.as_strided(text, (high - low, width), (8 * block, 8), writeable=False)
            corr = net.back(_mod(net.forward(text) * net.forward(pattern, inverse=True)), places)
            sums = np.zeros((high - low, width + 1))
            np.cumsum(text * text, axis=1, out=sums[:, 1:])
            squares = sums[:, block:] - sums[:, :places] + (pattern * pattern).sum(axis=1)[:, None]
            rest = _mod(squares + 2.0 * (PRIME - corr))
            row, place = np.nonzero((rest == 0) | (rest == PRIME))
            yield (low + row) * block, first + place


def _equal_steps(x: np.ndarray, start: np.ndarray, step: int, distance: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many places from ``start`` on, going by ``step``, hold the word that stands ``distance`` further on; at most
    ``limit``. All rows are compared together, in strides that double."""
    count = np.zeros(len(start), np.int64)
    active, stride = np.flatnonzero(limit > 0), 16
    while active.size:
        still = []
        for part in np.array_split(active, -(-active.size * stride // CELLS)):
            offset = count[part, None] + np.arange(stride)
            inside = offset < limit[part, None]
            at = start[part, None] + step * np.where(inside, offset, 0)
            same = inside & (x[at] == x[at + distance[part, None]])
            run = np.where(same.all(axis=1), stride, same.argmin(axis=1))
            count[part] += run
            still.append(part[run == stride])
        active, stride = np.concatenate(still), min(2 * stride, CELLS)
    return count


class _Known:
    """Runs found so far, for the question whether one of them covers a segment."""

    def __init__(self, runs: np.ndarray):
        order = np.argsort(runs[:, 0], kind="stable")
        self.starts = runs[order, 0]
        self.reach = np.maximum.accumulate(runs[order, 1]) if len(runs) else runs[:, 1]

    def covers(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.starts, start, "right") - 1
        return (at >= 0) & (self.reach[np.maximum(at, 0)] >= end)


def _extend(x: np.ndarray, seeds: np.ndarray, block: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(start, end, period) of the stretches around seeds (start, distance) sorted by distance and start. Consecutive
    blocks of one distance form a chain, which is extended from its first block, and again behind each mismatch."""
    start, distance = seeds[:, 0], seeds[:, 1]
    joined = (np.diff(start) == block) & (np.diff(distance) == 0) & (np.diff(low) == 0)
    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.append(heads[1:], len(start)) - 1
    at, found = heads.copy(), []
    while at.size:
        a, d, lo, hi = start[at], distance[at], low[at], high[at]
        right = _equal_steps(x, a, 1, d, hi - a - d)
        left = _equal_steps(x, a - 1, -1, d, a - lo)
        found.append(np.stack([a - left, a + right + d, d], axis=1))
        at = at + right // block + 1
        go = at <= last
        at, last = at[go], last[go]
    return np.concatenate(found)


def runs_of(sequences: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-sizes, kind="stable")  # long ones first: each scale reads a prefix
    sizes = sizes[order]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    x = np.concatenate([sequences[i] for i in order] or [np.zeros(0, np.int64)]).astype(np.int64)
    table = np.random.default_rng(13).integers(0, PRIME, int(x.max(initial=0)) + 1).astype(np.float64)
    residue = table[x]
    runs = np.zeros((0, 3), np.int64)
    for block, least, greatest in scales(int(sizes.max(initial=0))):
        long_enough = int(np.searchsorted(-sizes, -MIN_PERIODS * least, "right"))
        size = int(offsets[long_enough])
        known, seeds = _Known(runs), []
        within = _Known(runs[runs[:, 2] <= block])
        for start, distance in _zero_differences(residue[:size], block, least, greatest):
            doc = np.searchsorted(offsets, start, "right") - 1
            end = start + distance + block
            fits = (end <= offsets[doc + 1]) & (MIN_PERIODS * distance <= sizes[doc])
            fits &= ~within.covers(start, end)
            seeds.append(np.stack([start[fits], distance[fits], doc[fits]], axis=1))
        seeds = np.concatenate(seeds) if seeds else np.zeros((0, 3), np.int64)
        if not len(seeds):
            continue
        seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
        found = _extend(x, seeds[:, :2], block, offsets[seeds[:, 2]], offsets[seeds[:, 2] + 1])
        length = found[:, 1] - found[:, 0]
        found = found[(length >= MIN_LENGTH) & (length >= MIN_PERIODS * found[:, 2])]
        found = found[~known.covers(found[:, 0], found[:, 1])]  # a multiple of a smaller period
        runs = np.concatenate([runs, np.unique(found, axis=0)])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    bounds = np.searchsorted(runs[:, 0], offsets)
    out: list[np.ndarray] = [runs[:0]] * len(sequences)
    for k, i in enumerate(order):
        mine = runs[bounds[k] : bounds[k + 1]]
        out[i] = np.stack([mine[:, 0] - offsets[k], mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
    return out


def collapse(tokens: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return tokens
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [tokens[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _numbered(documents: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers, equal for equal words of a slice."""
    flat = pa.array([w for d in documents for w in d], pa.binary()).dictionary_encode()
    numbers = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(numbers, np.cumsum([len(d) for d in documents])[:-1]) if documents else []


def detect(docs: DataFrame, keep: Sequence[str | Column] = ("doc_id",), text: str | Column = "text") -> DataFrame:
    """The columns of ``keep`` plus n_words long, runs (an array of start, length, period in words, by start, then
    period) and collapsed (the words outside the repeated part of every run, joined by one space)."""
    rows = docs.select(*keep, text_or_empty(text).alias("_run_text"))
    kept = rows.columns[:-1]
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*types, "n_words bigint", f"runs array<{RUN}>", "collapsed string"])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in byte_slices(batches, "_run_text"):
            documents = [t.encode().split() for t in texts(batch, "_run_text")]
            runs = runs_of(_numbered(documents))
            flat = np.concatenate(runs)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run_type))
            columns = [batch.column(i) for i in range(len(kept))]
            columns.append(pa.array([len(d) for d in documents], pa.int64()))
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), structs))
            columns.append(pa.array([b" ".join(collapse(d, r)) for d, r in zip(documents, runs)], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(find, schema)


def planted(text: str | Column = "text", doc_id: str | Column = "doc_id") -> Column:
    """The text of a document with the contract's planted period: where the unsigned crc32 of the decimal id is a
    multiple of 10, the words from a on repeat the first p of them. Other texts, and those of null ids, stay."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    h = F.crc32(key.cast("string"))
    g = F.floor(h / F.lit(10)).cast("long")
    tokens = words(text_or_empty(text))

    def with_period(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % F.lit(8))).cast("long")
        tail = F.transform(
            F.sequence(a, n - F.lit(1)), lambda i: F.element_at(w, (a + (i - a) % p + F.lit(1)).cast("int"))
        )
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    chosen = F.coalesce(h % F.lit(10) == F.lit(0), F.lit(False)) & (F.size(tokens) > F.lit(0))
    # The words are bound once by a one-element array, not cut again at each mention.
    return F.when(chosen, F.transform(F.array(tokens), with_period)[0]).otherwise(text_or_empty(text))
