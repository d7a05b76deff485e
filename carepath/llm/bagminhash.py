"""Near duplicates by BagMinHash: weighted Jaccard of the multisets of five-word shingles.

A shingle that occurs w times has weight w. Its weights are discretised into the intervals [0,1), [1,2), [2,4),
[4,8), ...; each interval owns a Poisson process over (time, signature place, weight) with a rate equal to its width.
A point counts if its weight is below w, and each place of the signature keeps its earliest point, so two documents
agree in a place with probability sum(min) / sum(max): their weighted Jaccard. All processes of a document are followed
only up to the time by which the places are expected to be full, and further where they are not, so the work is about
``PLACES * log(PLACES)`` points whatever the document's length, and a repeated line of weight w costs log2(w) processes.

BANDS bands of ROWS places give candidates (a pair at 0.8 is missed with probability (1 - 0.8**4)**25 = 2e-6). Exact
copies (same words) are one class representative before banding. In a bucket of up to SMALL texts all pairs are
candidates. A larger bucket is a family of edited copies or shares a long passage; its HUBS members that share most
buckets with others (the least edited ones) are its hubs. Every member meets the best hub of all its large buckets, and
then those other hubs that are not in its component yet. Pairs are verified by the exact overlap of their shingle
multisets (32-bit shingle hashes), and linked texts form components. Pairs inside a component need no test. In a large
bucket that holds several components, all pairs of members in different components are compared, block
by block: histograms of the shingles bound the overlap from above, and pairs that the bound does not rule out are
verified, unless a link has joined their components by then. So the classes are those of all pairs of all buckets.

Defined results: documents are identified by doc_id, rows with the same id are one document; a null id gets no row;
null, empty and word-less texts are classes of their own; texts of one to four words have one shingle, the whole text;
words are compared in lower case; an empty table gives no rows. Other input columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import (
    byte_slices,
    gathered,
    hashed,
    lists,
    narrow,
    only,
    small_side,
    stage,
    stage_in_small_batches,
    text_or_empty,
    without,
    words,
)
from carepath.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 4
PLACES = BANDS * ROWS
SMALL = 8
HUBS = 4
# Members and shingles of a block of a large bucket, about; cells of a member's histogram, and where their counts stop.
BLOCK, BLOCK_ITEMS = 1024, 262_144
CELLS, FULL = 512, 255

_U = np.uint64
_GOLDEN, _MULT, _MULT2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs give unrelated outputs."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(flat: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle; a document shorter than ``size`` has one shingle, the whole document."""
    w = mix(flat.view(_U) if flat.dtype == np.int64 else flat.astype(np.int64).view(_U))
    length = np.diff(offsets)
    count = np.where(length >= size, length - size + 1, np.minimum(length, 1))
    doc = np.repeat(np.arange(len(length)), count)
    start = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(doc))
    take = np.minimum(length, size)[doc]
    out = np.zeros(len(doc), _U)
    for k in range(size):
        inside = take > k
        out[inside] = out[inside] * _MULT + w[start[inside] + k] + _U(1)
    return doc, mix(out)


def weighted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the distinct shingles; 44 bits of the hash tell shingles of a document apart."""
    keys = np.sort((doc.astype(_U) << _U(44)) | (hashes >> _U(20)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    weight = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    return (keys >> _U(44)).astype(np.int64), keys & _U((1 << 44) - 1), weight


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, places: int = PLACES) -> np.ndarray:
    """docs x places: time of the earliest counted point at each place (infinite for an empty document)."""
    sig = np.full(docs * places, np.inf)
    total = np.bincount(doc, weights=weight, minlength=docs)
    # One process per started interval: number 0 is [0,1), number k is [2**(k-1), 2**k).
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    p_doc, p_weight = doc[at], weight[at].astype(float)
    seed = mix(item[at] + _GOLDEN * (level.astype(_U) + _U(1)))
    time, step = np.zeros(len(at)), 0
    horizon = (np.log(places) + 3) / np.maximum(total, 1)
    live = np.arange(len(at))
    begun = np.zeros(len(at), np.int64)
    while len(live):
        waiting = []
        while len(live):
            step = begun[live].astype(_U)
            r = mix(seed[live] + _GOLDEN * (step + _U(1)))
            t = time[live] - np.log(((r >> _U(24)).astype(float) + 0.5) / 2.0**40) / (places * width[live])
            due = t < horizon[p_doc[live]]
            waiting.append(live[~due])  # its next point lies beyond the horizon: drawn again if that moves
            live, t, r = live[due], t[due], r[due]
            time[live] = t
            begun[live] += 1
            place = ((r & _U(0xFFFFFF)) * _U(places)) >> _U(24)
            counted = np.ones(len(live), bool)
            wide = np.flatnonzero(width[live] > 1)
            if len(wide):
                v = (mix(r[wide]) >> _U(11)).astype(float) / 2.0**53
                counted[wide] = np.floor(low[live[wide]] + v * width[live[wide]]) < p_weight[live[wide]]
            cell = p_doc[live] * places + place.astype(np.int64)
            np.minimum.at(sig, cell[counted], t[counted])
        open_docs = np.isinf(sig.reshape(docs, places)).any(axis=1) & (total > 0)
        horizon = np.where(open_docs, horizon * 2, horizon)
        left = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
        live = left[open_docs[p_doc[left]]]
    return sig.reshape(docs, places)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """docs x bands: one hash per band, of the band's number and places."""
    bits = sig.view(_U).reshape(len(sig), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U) * _GOLDEN), (len(sig), bands)).copy()
    for k in range(rows):
        out = mix(out * _MULT + bits[:, :, k])
    return out.view(np.int64)


def _text_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's word sequence."""
    length = np.diff(offsets)
    local = np.arange(len(flat)) - np.repeat(offsets[:-1], length)
    keys = []
    for m in (_MULT, _MULT2):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(length.max(initial=0)) + 1, m, _U))
            term = mix(flat.view(_U) ^ m) * power[local]
            total = np.concatenate([np.zeros(1, _U), np.cumsum(term)])
        keys.append(mix(total[offsets[1:]] - total[offsets[:-1]] + length.astype(_U)).view(np.int64))
    return keys[0], keys[1]


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(gathered(batches), "w"):
        flat, offsets = lists(batch, "w")
        flat = np.ascontiguousarray(flat, dtype=np.int64)
        sig = signatures(*weighted(*shingles(flat, offsets)), docs=batch.num_rows)
        bands = band_hashes(sig)
        a, b = _text_keys(flat, offsets)
        out = pa.ListArray.from_arrays(
            pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(a), pa.array(b), out],
            ["doc_id", "n_words", "k1", "k2", "bands"],
        )


def _multisets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(gathered(batches), "w"):
        flat, offsets = lists(batch, "w")
        doc, hashes = shingles(np.ascontiguousarray(flat, dtype=np.int64), offsets)
        keys = np.sort((doc.astype(_U) << _U(32)) | (hashes >> _U(32)))
        ends = np.searchsorted(keys, np.arange(batch.num_rows + 1, dtype=_U) << _U(32))
        items = (keys & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(items))],
            ["doc_id", "items"],
        )


def _multiset_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(_U)
    keys = (pair << _U(32)) | np.ascontiguousarray(flat, dtype=np.int32).view(np.uint32).astype(_U)
    return np.unique(keys, return_counts=True)


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard of each pair of multisets, given as flat values and offsets."""
    (ka, na), (kb, nb) = _multiset_keys(*a), _multiset_keys(*b)
    pairs = len(a[1]) - 1
    at = np.minimum(np.searchsorted(kb, ka), max(0, len(kb) - 1))
    same = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    low = np.bincount((ka[same] >> _U(32)).astype(np.int64), np.minimum(na[same], nb[at[same]]), minlength=pairs)
    high = np.diff(a[1]) + np.diff(b[1]) - low
    return np.divide(low, high, out=np.zeros(pairs), where=high > 0)


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(gathered(batches), "items_a"):
        sim = similarities(lists(batch, "items_a"), lists(batch, "items_b"))
        hit = pa.array(sim >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(hit), batch.column("b").filter(hit)], ["a", "b"])


def _word_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", hashed(words(F.lower(text_or_empty("text")))).alias("w")
    )


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, k1, k2, bands), one row per row with an id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, k1 long, k2 long, bands array<long>"
    return _word_rows(docs).mapInArrow(_sign, schema)


def multisets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, items): the sorted shingle hashes of the documents in ``ids``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = only(docs.select("doc_id", "text"), ids.select("doc_id"), {"doc_id": F.col("doc_id")})
    return stage_in_small_batches(_word_rows(rows).mapInArrow(_multisets, f"doc_id {kind}, items array<int>"))


def verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by SIMILARITY or more. Multisets whose sizes alone rule it out are not
    shipped; so the second one of a pair is at most 1 / SIMILARITY times the first."""
    kind = items.schema["doc_id"].dataType.simpleString()
    side = lambda n: items.select(F.col("doc_id").alias(n), F.col("items").alias(f"items_{n}"), F.size("items").alias(f"n_{n}"))
    near = F.least("n_a", "n_b") >= F.lit(SIMILARITY) * F.greatest("n_a", "n_b") - F.lit(1e-6)
    left, right = pairs.join(side("a"), "a"), side("b").withColumnRenamed("b", "_b")
    joined = left.join(right, (F.col("b") == F.col("_b")) & near).select("a", "b", "items_a", "items_b")
    return stage_in_small_batches(joined.mapInArrow(_verify, f"a {kind}, b {kind}").distinct())


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def bucket_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, rep, size, weight) -> candidate pairs (a, b) of small buckets, and (rep, hub, best) of large ones.

    Buckets of up to SMALL members give all their pairs; in a larger one each member is paired with its HUBS heaviest
    members, of which ``best`` marks the heaviest over all buckets of the member. A large bucket is cut to its hubs
    before the shuffle (a ranked limit per key), so its size costs nothing.
    """
    small = rows.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("rep")).alias("reps"))
    reps = F.col("reps")
    all_pairs = F.flatten(
        F.transform(
            reps,
            lambda x, i: F.transform(F.slice(reps, i + 2, F.size(reps)), lambda y: F.struct(x.alias("a"), y.alias("b"))),
        )
    )
    inner = small.select("reps").distinct().select(F.explode(all_pairs).alias("p")).select("p.a", "p.b")
    large = rows.where(F.col("size") > SMALL)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "rep"))
    hub = F.struct(F.col("weight"), F.col("rep").alias("hub"))
    top = large.withColumn("rank", rank).where(F.col("rank") <= HUBS).groupBy("key").agg(F.collect_list(hub).alias("hubs"))
    near_hubs = (
        large.select("key", "rep")
        .join(top, "key")
        .groupBy("rep")
        .agg(F.array_distinct(F.flatten(F.collect_set("hubs"))).alias("hubs"))
        .select("rep", F.filter("hubs", lambda h: h["hub"] != F.col("rep")).alias("hubs"))
    )
    outer = near_hubs.select("rep", F.explode("hubs").alias("h"), F.array_max("hubs").alias("top"))
    return inner.distinct(), outer.select("rep", "h.hub", (F.col("h.hub") == F.col("top.hub")).alias("best"))


def hub_links(inner: DataFrame, outer: DataFrame, items: DataFrame) -> DataFrame:
    """Verified links of the candidate pairs: first small buckets and best hubs, then the other hubs of members that are
    still in another component than the hub."""
    outer = stage(outer)
    best = outer.where("best").select(*_ordered(F.col("rep"), F.col("hub")))
    first = verified(stage(inner.union(best).distinct()), items)
    others = outer.where(~F.col("best")).select("rep", "hub")
    if not others.take(1):
        return first
    label = small_side(components(first))
    here = label.select(F.col("node").alias("rep"), F.col("label").alias("own"))
    there = label.select(F.col("node").alias("hub"), F.col("label").alias("its"))
    left = others.join(here, "rep", "left").join(there, "hub", "left")
    left = left.where(F.coalesce("own", "rep") != F.coalesce("its", "hub"))
    return first.union(verified(stage(left.select(*_ordered(F.col("rep"), F.col("hub"))).distinct()), items))


def mixed(large: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, rep, weight, comp, main) of the buckets that hold several components of ``found``, staged.

    ``main`` says that the member is in the component with most members in the bucket.
    """
    label = small_side(components(found)).withColumnRenamed("node", "rep")
    own = stage(large.join(label, "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label"))
    count = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    keys = count.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
    keys = keys.where(F.col("comps") > 1).select("key", "top")
    return stage(own.join(keys, "key").withColumn("main", F.col("comp") == F.col("top")).drop("top"))


def histograms(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x CELLS: how many shingles of each multiset fall into a cell, FULL at most."""
    rows = len(offsets) - 1
    cell = np.repeat(np.arange(rows), np.diff(offsets)) * CELLS + flat.view(np.uint32) % CELLS
    return np.minimum(np.bincount(cell, minlength=rows * CELLS), FULL).astype(np.uint8).reshape(rows, CELLS)


def possible(n_a: int, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False where histogram ``a`` and a row of ``b`` prove a similarity below SIMILARITY.

    The overlap of two multisets is at most the sum of their cells' minima; a cell that is FULL in both has no bound.
    """
    low = np.minimum(a, b)
    enough = (1 + SIMILARITY) * low.sum(axis=1, dtype=np.int64) >= SIMILARITY * (n_a + n_b) - 1e-6
    return enough | (low == FULL).any(axis=1)


def _compare(cell: pa.Table) -> pa.Table:
    """Verified links between a cell's two blocks (or inside its one block) that connect all that its pairs connect.

    Pairs of one component are skipped, and components that a link joins are one from then on.
    """
    batch = cell.combine_chunks().to_batches()[0]
    comp = batch.column("comp").dictionary_encode().indices.to_numpy().copy()
    flat, off = lists(batch, "items")
    flat, n = np.ascontiguousarray(flat, dtype=np.int32), np.diff(off)
    hist = histograms(flat, off)
    block = batch.column("block").to_numpy()
    left, right = (np.flatnonzero(block == cell.column(c)[0].as_py()) for c in "ij")
    at_a, at_b = [], []
    for x in left:
        near = right[comp[right] != comp[x]]
        near = near[possible(n[x], hist[x], n[near], hist[near])]
        own = flat[off[x] : off[x + 1]]
        while len(near):
            some, near = near[:16], near[16:]
            ends = np.concatenate([[0], np.cumsum(n[some])])
            theirs = np.concatenate([flat[off[y] : off[y + 1]] for y in some])
            sim = similarities((np.tile(own, len(some)), np.arange(len(some) + 1) * len(own)), (theirs, ends))
            for y in some[sim >= SIMILARITY]:
                if comp[y] != comp[x]:
                    comp[comp == comp[y]] = comp[x]
                    at_a.append(x)
                    at_b.append(y)
            near = near[comp[near] != comp[x]]
    a, b = (batch.column("rep").take(pa.array(at, pa.int64())) for at in (at_a, at_b))
    return pa.table([a, b], names=["a", "b"])


def block_links(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(key, rep, comp, main) -> verified links that connect all that the pairs of a key's members connect.

    Members outside the main component meet all members, block by block: blocks 0 .. rest - 1 hold them, the next ones
    the main component. A cell is a pair of blocks and a task's group, so a large bucket is spread over many groups.
    """
    kind = items.schema["doc_id"].dataType.simpleString()
    sizes = stage(items.groupBy(F.col("doc_id").alias("rep")).agg(F.max(F.size("items")).alias("n")))
    rows = stage(rows.join(small_side(sizes), "rep"))
    need = lambda own: F.ceil(
        F.greatest(F.count_if(own) / BLOCK, F.sum(F.when(own, F.col("n")).otherwise(0)) / BLOCK_ITEMS)
    ).cast("int")
    blocks = rows.groupBy("key").agg(need(~F.col("main")).alias("rest"), need(F.col("main")).alias("mains"))
    number = F.xxhash64("rep")
    block = F.when(F.col("main"), F.col("rest") + F.pmod(number, "mains")).otherwise(F.pmod(number, "rest")).cast("int")
    last = F.when(F.col("main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1
    placed = rows.join(blocks, "key").withColumn("block", block)
    placed = placed.select("key", "rep", "comp", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    placed = placed.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other")
    cells = placed.join(items.withColumnRenamed("doc_id", "rep"), "rep").groupBy("key", "i", "j")
    found = cells.applyInArrow(_compare, f"a {kind}, b {kind}")
    return stage(found.select(*_ordered(F.col("a"), F.col("b"))).distinct())


def links(docs: DataFrame, representatives: DataFrame) -> DataFrame:
    """Verified links (a, b) between representatives (rep, bands): they connect all that the buckets' pairs connect."""
    exploded = representatives.distinct().select("rep", F.posexplode("bands").alias("band", "key"))
    shared = (
        exploded.groupBy("key")
        .agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size"))
        .where(F.col("first") < F.col("last"))
    )
    rows = stage(exploded.join(shared.select("key", "size"), "key"))
    weights = stage(rows.groupBy("rep").agg(F.sum("size").alias("weight")))
    items = multisets(docs, weights.select(F.col("rep").alias("doc_id")))
    weighed = rows.join(small_side(weights), "rep").select("key", "rep", "size", "weight")
    found = hub_links(*bucket_pairs(weighed), items)
    large = stage(weighed.where(F.col("size") > SMALL).select("key", "rep", "weight").distinct())
    apart = mixed(large, found)
    if not apart.take(1):
        return found
    return found.union(block_links(apart, items)).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): the class id is the smallest doc_id of the class."""
    signed = stage_in_small_batches(sign(narrow(docs, "doc_id", "text")))
    worded = signed.where(F.col("n_words") > 0)
    texts = worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = stage(worded.join(texts, ["k1", "k2"]).select("doc_id", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    near = links(narrow(docs, "doc_id", "text"), members.where(F.col("bands").isNotNull()).select("rep", "bands"))
    first = members.groupBy("doc_id").agg(F.min("rep").alias("home"), F.max("rep").alias("last"))
    same_id = members.join(first.where(F.col("home") < F.col("last")), "doc_id").where(F.col("rep") != F.col("home"))
    label = small_side(components(near.union(same_id.select(F.col("home").alias("a"), F.col("rep").alias("b")))))
    out = signed.select("doc_id").distinct().join(first.select("doc_id", F.col("home").alias("node")), "doc_id", "left")
    return out.join(label, "node", "left").select("doc_id", F.coalesce("label", "node", "doc_id").alias("class_id"))



def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document per class, the one with the smallest id (one of its rows if it has several).

    Documents without an id are kept: nothing can be said about them.
    """
    dropped = classes(docs).where(F.col("doc_id") != F.col("class_id")).select("doc_id")
    left = without(docs, dropped, {"doc_id": F.col("doc_id")})
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    again = stage(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.take(1):
        return left
    one = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return without(left, again, {"doc_id": F.col("doc_id")}).unionByName(one)
