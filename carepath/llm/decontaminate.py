"""Benchmark decontamination: rare n-grams of test items seed Smith-Waterman alignments in the documents.

A pair (document, item) is reported when the best Smith-Waterman alignment of their words (runs of letters and digits,
lower case; match 1, mismatch and gap -0.5) scores at least THRESHOLD = 1/2 of the item's length L; exact copies score 1,
paraphrases with a fifth of the words replaced about 0.7. Seeds find every such pair:

- an alignment with m matches in r unbroken runs has at least r - 1 mismatches and gaps, so r <= 2m - L + 1, and it spans
  at most 2L words. Let c = ceil(2L / 3);
- with m >= c at most L - c words of the item are missing, so of its (L - c) + k rarest words k stand in the span;
- with m < c it holds m - r >= L - c of the item's L - 1 word pairs (2-grams), so of its (c - 1) + k rarest pairs k do.

Rarity is the number of places of the whole corpus that hold the word or pair, counted in a first pass; the common half
of an item's words and a quarter of its pairs never seed. A second pass looks the seeds up, keeps (document, item) where
k seeds lie within 2L words, drops regions that hold too few of the item's words, and aligns the rest there and then, in
the task that read the document: nothing but scores is shuffled, and a passage that a third of the documents share costs
each of them its own alignments.

The benchmark goes to the tasks in blocks of about MAX_WORDS words (and one item at least), two passes over the documents
per block, so a benchmark of any size fits.

Defined results: null texts have no words; an item of one or two words is reported for exact copies only, an item without
words never; a null doc_id or item_id is kept as it is in the pairs; repeated rows with one doc_id count as one document;
an empty table on either side gives no pairs. Only doc_id, text, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.bagminhash import mix
from carepath.llm.common import byte_slices, hashed, lists, stage, text_or_empty, without

MAX_WORDS = 1_000_000
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
SURE = 8  # an item of L words asks for L / SURE seeds (one at least) in a span
SIZES = (1, 2)  # words of a seed
# Seed places looked at together; cells of one block of alignments (pairs x widest region).
ENTRIES, BLOCK_CELLS = 2_000_000, 500_000

_U = np.uint64
_M = _U(0xD6E8FEB86659FD93)


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower case. An empty first or last piece is dropped by its hash."""
    return hashed(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"))


def _drop_empty(flat: np.ndarray, offsets: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
    keep = flat != empty
    kept = np.concatenate([[0], np.cumsum(keep)])
    return np.ascontiguousarray(flat[keep], np.int64), kept[offsets]


def gram_hashes(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the n-grams that lie in one document."""
    w = flat.view(_U)
    if len(w) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        out = out * _M + w[k : len(w) - n + 1 + k]
    whole = np.ones(len(out), bool)
    for k in range(1, n):
        at = offsets[1:-1] - k
        whole[at[(at >= 0) & (at < len(whole))]] = False
    place = np.flatnonzero(whole)
    return mix(out[place]), place


class Table:
    """A sorted set of hashes; ``find`` gives (place, number of the hash) of those n-grams that are in it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes >> _U(42)).astype(np.int64)] = True

    def find(self, grams: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return place[:0], place[:0]
        may = np.flatnonzero(self.bits[(grams >> _U(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, grams[may]), len(self.hashes) - 1)
        hit = self.hashes[at] == grams[may]
        return place[may[hit]], at[hit]


def required(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, of which) for words and for pairs, each 2 x items: how many of the rarest are seeds, and how many of
    those a reported span holds at least."""
    c = -(-2 * length // 3)
    k = np.maximum(1, length // SURE)
    seeds = np.stack([length - c + k, np.minimum(length - 1, c - 1 + k)])
    need = np.stack([k, seeds[1] - (c - 1)])
    seeds[:, length < 3] = need[:, length < 3] = 0
    seeds[0, length == 1] = need[0, length == 1] = seeds[1, length == 2] = need[1, length == 2] = 1
    return seeds, need


@dataclass
class Seeds:
    """The seeds of one size: a table, and for each of its hashes the items that it seeds."""

    table: Table
    first: np.ndarray
    items: np.ndarray
    need: np.ndarray  # per item, 0 where the item has no seeds of this size


def choose(flat: np.ndarray, offsets: np.ndarray, counted: list[tuple[Table, np.ndarray]]) -> list[Seeds]:
    """The rarest words and pairs of every item, by the places of the corpus that hold them (ties by hash)."""
    length = np.diff(offsets)
    seeds, need = required(length)
    out = []
    for n, (table, counts), wanted, least in zip(SIZES, counted, seeds, need):
        grams, place = gram_hashes(flat, offsets, n)
        item = np.searchsorted(offsets, place, "right") - 1
        order = np.lexsort((grams, counts[np.searchsorted(table.hashes, grams)], item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        kept = order[rank < wanted[item[order]]]
        own = Table(grams[kept])
        pairs = np.unique(np.stack([np.searchsorted(own.hashes, grams[kept]), item[kept]], axis=1), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(own.hashes) + 1))
        out.append(Seeds(own, first, pairs[:, 1], least))
    return out


def _count(tables: list[Table], empty: int):
    """One row per benchmark n-gram that a task saw: (size, number, places)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(t.hashes), np.int64) for t in tables]
        for batch in byte_slices(batches, "w"):
            flat, offsets = _drop_empty(*lists(batch, "w"), empty)
            for n, table, total in zip(SIZES, tables, totals):
                total += np.bincount(table.find(*gram_hashes(flat, offsets, n))[1], minlength=len(total))
        for n, total in zip(SIZES, totals):
            at = np.flatnonzero(total)
            columns = [pa.array(np.full(len(at), n, np.int32)), pa.array(at), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(columns, ["size", "number", "places"])

    return run


def spans(seeds: list[Seeds], length: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (document, item, low, high): stretches of words that hold every alignment worth reporting. Several blocks of
    documents, each with a bounded number of seed places unless one document has more."""
    docs = len(offsets) - 1
    found, load = [], np.zeros(docs, np.int64)
    for n, own in zip(SIZES, seeds):
        place, gram = own.table.find(*gram_hashes(flat, offsets, n))
        doc = np.searchsorted(offsets, place, "right") - 1
        count = own.first[gram + 1] - own.first[gram]
        load += np.bincount(doc, weights=count, minlength=docs).astype(np.int64)
        found.append((place, gram, doc, count))
    ends = np.cumsum(load)
    start = 0
    while start < docs:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + ENTRIES, "right")))
        windows = []
        for own, (place, gram, doc, count) in zip(seeds, found):
            a, b = np.searchsorted(doc, [start, stop])
            at = np.repeat(np.arange(a, b), count[a:b])
            inner = np.arange(len(at)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
            item = own.items[own.first[gram[at]] + inner]
            key = doc[at] * len(length) + item
            order = np.argsort(key, kind="stable")  # places ascend inside a key
            key, item, pos = key[order], item[order], place[at][order]
            last = np.arange(len(key)) + own.need[item] - 1
            fits = last < len(key)
            last = np.minimum(last, max(0, len(key) - 1))
            fits &= (key[last] == key) & (pos[last] - pos < 2 * length[item])
            reach = 2 * length[item[fits]]
            windows.append(np.stack([key[fits], pos[fits] - reach, pos[last[fits]] + reach + 1], axis=1))
        rows = np.concatenate(windows)
        if len(rows):
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            doc, item = rows[:, 0] // len(length), rows[:, 0] % len(length)
            low, high = np.maximum(rows[:, 1], offsets[doc]), np.minimum(rows[:, 2], offsets[doc + 1])
            shift = np.cumsum(np.concatenate([[0], np.diff(rows[:, 0]) != 0])) * (len(flat) + 1)  # keys apart
            reached = np.maximum.accumulate(high + shift)
            new = np.flatnonzero(np.concatenate([[True], (low + shift)[1:] > reached[:-1]]))
            yield np.stack([doc[new], item[new], low[new], np.maximum.reduceat(high, new)], axis=1)
        start = stop


def align(regions: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each (region, item) and the region place where it ends (exclusive).

    All pairs advance together, one item word at a time. Along a row, gaps are a running maximum:
    best[j] = max over i <= j of (cell[i] + GAP * (j - i)).
    """
    pairs, width = len(regions), max((len(r) for r in regions), default=0)
    depth = max((len(x) for x in items), default=0)
    best, end = np.zeros(pairs), np.zeros(pairs, np.int64)
    if not width or not depth:
        return best, end
    region = np.zeros((pairs, width), np.int64)
    there = np.zeros((pairs, width), bool)
    for i, r in enumerate(regions):
        region[i, : len(r)], there[i, : len(r)] = r, True
    slope = -GAP * np.arange(width)
    row = np.zeros((pairs, width))
    for k in range(depth):
        word = np.array([x[k] if k < len(x) else 0 for x in items], np.int64)[:, None]
        live = np.array([k < len(x) for x in items])[:, None] & there
        before = np.zeros_like(row)
        before[:, 1:] = row[:, :-1]
        cell = np.maximum(before + np.where(region == word, MATCH, MISMATCH), row + GAP)
        cell = np.where(live, np.maximum(cell, 0), 0)
        row = np.maximum(np.maximum.accumulate(cell + slope, axis=1) - slope, 0)
        row[~live] = 0
        top = row.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], row.argmax(axis=1)[better] + 1
    return best, end


def _common(flat: np.ndarray, off: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many words of each row's item occur in its region (a hash may count one too many, never too few)."""
    rows = len(off) - 1
    own = [mix(np.repeat(np.arange(1, rows + 1, dtype=_U), np.diff(o)) * _M) for o in (off, at)]
    there = np.isin(mix(words.view(_U) ^ own[1]), mix(flat.view(_U) ^ own[0]))
    return np.bincount(np.repeat(np.arange(rows), np.diff(at))[there], minlength=rows)


def _blocks(span: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of ``span`` to be aligned together: items and regions of like length, so padding stays within BLOCK_CELLS
    (or one pair)."""
    width = span[:, 3] - span[:, 2]
    depth = np.ceil(np.log2(np.maximum(1, length[span[:, 1]])))
    order = np.lexsort((width, depth))
    start = 0
    while start < len(order):
        stop = start + 1
        while (
            stop < len(order)
            and depth[order[stop]] == depth[order[start]]
            and (stop + 1 - start) * width[order[stop]] <= BLOCK_CELLS
        ):
            stop += 1
        yield order[start:stop]
        start = stop


def _pieces(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches low .. high of ``values``, flat and with offsets."""
    offsets = np.concatenate([[0], np.cumsum(high - low)])
    return values[np.repeat(low - offsets[:-1], high - low) + np.arange(offsets[-1])], offsets


def _search(seeds: list[Seeds], words: np.ndarray, at: np.ndarray, empty: int):
    """Scores of (document, number of the item) worth reporting, over slices of documents."""
    length = np.diff(at)
    threshold = np.where(length < 3, MATCH, THRESHOLD) * length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "w"):
            flat, offsets = _drop_empty(*lists(batch, "w"), empty)
            for all_spans in spans(seeds, length, flat, offsets):
                for part in np.array_split(all_spans, -(-int((all_spans[:, 3] - all_spans[:, 2]).sum()) // ENTRIES)):
                    region, off = _pieces(flat, part[:, 2], part[:, 3])
                    own, own_at = _pieces(words, at[part[:, 1]], at[part[:, 1] + 1])
                    span = part[MATCH * _common(region, off, own, own_at) >= threshold[part[:, 1]]]
                    for rows in _blocks(span, length):
                        doc, item, low, high = span[rows].T
                        score, end = align(
                            [flat[a:b] for a, b in zip(low, high)], [words[at[i] : at[i + 1]] for i in item]
                        )
                        hit = np.flatnonzero(score >= threshold[item])
                        doc, item = doc[hit], item[hit]
                        columns = [
                            batch.column("doc_id").take(pa.array(doc)),
                            pa.array(item),
                            pa.array(score[hit] / (MATCH * length[item])),
                            pa.array(low[hit] - offsets[doc] + end[hit]),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "number", "score", "last_word"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, last_word): documents that hold a copy, whole or edited, of a benchmark item.

    ``last_word`` is the place in the document's words just after the best alignment.
    """
    spark = docs.sparkSession
    empty = int(spark.range(1).select(F.xxhash64(F.lit(""))).first()[0])
    id_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    items = benchmark.select(F.col("item_id").alias("item"), tokens(text_or_empty("text")).alias("w")).distinct()
    items = stage(items.withColumn("size", F.size("w")))
    blocks = max(1, -(-(items.agg(F.sum("size")).first()[0] or 0) // MAX_WORDS))
    rows = docs.select("doc_id", tokens(text_or_empty("text")).alias("w"))
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b).select("item", "w").toArrow()
        words, at = _drop_empty(*lists(block.combine_chunks().to_batches()[0], "w"), empty) if block.num_rows else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        if not len(words):
            continue
        tables = [Table(gram_hashes(words, at, n)[0]) for n in SIZES]
        places = rows.select("w").mapInArrow(_count(tables, empty), "size int, number long, places long")
        counts = [np.zeros(len(t.hashes), np.int64) for t in tables]
        for size, number, total in places.groupBy("size", "number").agg(F.sum("places")).toPandas().itertuples(index=False):
            counts[size - 1][number] = total
        seeds = choose(words, at, list(zip(tables, counts)))
        part = rows.mapInArrow(_search(seeds, words, at, empty), f"doc_id {id_kind}, number long, score double, last_word long")
        best = part.groupBy("doc_id", "number").agg(F.max(F.struct("score", "last_word")).alias("best"))
        names = pa.table({"number": np.arange(block.num_rows), "item_id": block.column("item")})
        best = best.join(F.broadcast(spark.createDataFrame(names)), "number")
        best = best.select("doc_id", F.col("item_id").cast(item_kind), "best.score", "best.last_word")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"doc_id {id_kind}, item_id {item_kind}, score double, last_word long")
    # Rows that share an item's id with other texts (or have none) are one item in the result.
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "last_word")).alias("best")).select(
        "doc_id", "item_id", "best.score", "best.last_word"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item. Rows that share an id (or have none) share the verdict."""
    return without(docs, matches(docs, benchmark).select("doc_id"), {"doc_id": F.col("doc_id")})
