"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy inside Spark tasks.

A text is the ids of a public BPE vocabulary and one end id. Ids fall into CLASSES classes: the most frequent ids have
one each, the others are clustered by what comes before them and by whether they end a word. The model gives
P(id | before) = P(class | before) * P(id | class, class of the id before). The first factor is a single attention head
over the classes of the last positions, causal mask and learned distance bias, added to a table of class-to-class
logits; the second is a share of counts, smoothed by the id's share in its class.

Ids and their contexts are counted over all training documents, and so is the class table the training starts from.
The attention weights are trained on windows of every training document: one in STRIDE of a document's windows, one at
least, others in each round (a fixed rate, so the work grows with the input). In each of ROUNDS rounds every task runs
Adam over its windows from the same weights, and Spark averages the tasks' weights by window count. A text is scored in
windows of WINDOW positions, CONTEXT of them repeated from the window before; every id is scored exactly once, with
CONTEXT to WINDOW positions of context. Training and scoring look exp(query . key) up by pair of classes; weights too
steep for that take the plain way.

The base score is the add-one unigram over words. Words are told apart by a 64-bit hash of their bytes; tasks count
their words and Spark adds the counts up. Words frequent in the corpus (FREQUENT of them at most) are looked up in the
tasks; all other words go through a join.

Defined results: a null text is empty and has its end token only; without training documents the model is uniform and
the base score 0; null ids are scored and not learned from; repeated rows each get a row and count each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.bagminhash import mix
from carepath.llm.bpe_lexicon import Bpe, default_path, shared_encoder
from carepath.llm.common import HashLookup, byte_slices, stage, text_or_empty

CLASSES, SINGLE = 64, 24
BUCKETS = 32
DIM = 16
WINDOW, CONTEXT = 32, 8
STRIDE = ROUNDS = 3  # a round trains on every STRIDE-th window, the rounds together on all of them
BATCH = 128
# Rows of a window that attend together; the first CONTEXT rows are scored in the first window of a text only.
BLOCKS = ((0, CONTEXT), (CONTEXT, WINDOW))
LAG = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None]
SEEN, BACK = (LAG >= 0).astype(np.float32), np.maximum(LAG, 0)
TRAIN_WINDOWS = 40_000  # windows that a task trains on in one go
RATE, TABLE_RATE = 0.02, 0.004
FREQUENT = 300_000
BLOCK = 128  # windows scored together: their logits stay near the core
# Counts added: to each id, and in all to the ids (or classes) after one class.
ALPHA, PRIOR = 0.1, 10.0
# Bytes of text cut into ids together.
TOKEN_BYTES = 4_000_000
# Bytes of text whose words are hashed together, and words whose ids a worker remembers from batch to batch.
HASH_BYTES, REMEMBERED = 100_000, 400_000
# Pieces of a task's word counts are added up when they reach this many.
COUNT_ROWS = 2_000_000


# ------------------------------------------------------------------------------------------- base


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a random number per byte, A to Z as a to z and 0 for white space; powers of an odd number; of its inverse)."""
    if "bytes" not in _TABLES:
        table = np.random.Generator(np.random.Philox(key=71)).integers(1, 2**64, 256, np.uint64)
        table[65:91] = table[97:123]
        table[list(b" \t\n\x0b\x0c\r")] = 0
        odd = 0x9E3779B97F4A7C15
        _TABLES["bytes"] = table
        _TABLES["up"] = np.full(1, 1, np.uint64)
        _TABLES["down"] = np.full(1, 1, np.uint64)
        _TABLES["odd"] = np.array([odd, pow(odd, -1, 1 << 64)], np.uint64)
    return _TABLES["bytes"], _TABLES["up"], _TABLES["down"]


_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _tables()
    if len(_TABLES["up"]) < n:
        for name, factor in zip(("up", "down"), _TABLES["odd"]):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps)
    return _TABLES["up"], _TABLES["down"]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, where each text's words start and end) of a string array without nulls.

    The hash of a word is the sum of its bytes' numbers times powers of an odd number, mixed with its length: prefix
    sums over the whole array give all of them at once.
    """
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first : first + ends[-1]]
    table, _, _ = _tables()
    up, down = _powers(len(data) + 1)
    numbers = table[data]
    inside = numbers != 0
    border = np.zeros(len(data) + 1, bool)
    border[ends] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(after & (~before | border))
    stop = np.flatnonzero(before & (~after | border))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers * up[: len(data)])])
    hashes = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    return hashes.view(np.int64), np.searchsorted(start, ends)


def sliced_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of a batch's ``_text``, in slices whose prefix sums stay near the core: (hashes, offsets)."""
    hashed = [word_hashes(part.column("_text")) for part in byte_slices([batch], "_text", HASH_BYTES)]
    return np.concatenate([h for h, _ in hashed]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(ends) for _, ends in hashed]))])


@dataclass
class Unigram:
    counts: DataFrame  # (word, n), staged
    total: int
    distinct: int
    ends: int
    keys: np.ndarray  # hashes of frequent words
    values: np.ndarray

    def log10(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.total + self.distinct + 1))


def _add_up(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    word, n = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(word)
    word, n = word[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    return word[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in byte_slices(batches, "_text"):
        word, n = np.unique(sliced_hashes(batch)[0], return_counts=True)
        words.append(word)
        counts.append(n)
        held += len(word)
        if held > COUNT_ROWS:
            word, n = _add_up(words, counts)
            words, counts, held = [word], [n], 0
            if len(word) > COUNT_ROWS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])
                words, counts = [word[:0]], [n[:0]]
    word, n = _add_up(words, counts)
    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])


def count_words(train: DataFrame) -> Unigram:
    """Counts of all words of the training texts. A histogram over count ranges gives the cut for the frequent ones."""
    rows = train.select(text_or_empty("text").alias("_text")).mapInArrow(_count, "word long, n long")
    counts = stage(rows.groupBy("word").agg(F.sum("n").alias("n")))
    size = F.floor(F.log2("n") * 4).cast("int")
    ranges = counts.groupBy(size.alias("range")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    ends = train.count()
    held, cut = 0, None
    for r in sorted(ranges, key=lambda r: -r["range"]):
        held += r.words
        if held > FREQUENT:
            break
        cut = r["range"]
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if cut is not None:
        top = counts.where(size >= cut).toArrow()
        keys, values = top.column("word").to_numpy(), top.column("n").to_numpy()
    return Unigram(counts, sum(r.n for r in ranges) + ends, sum(r.words for r in ranges) + bool(ends), ends, keys, values)


# ------------------------------------------------------------------------------------------- ids


def tokenized(docs: DataFrame, unigram: Unigram, source: str, held_out: Column) -> DataFrame:
    """(uid, doc_id, held_out, n_tokens, n_known, base, rare, ids), staged: base sums over the frequent words and the
    end token, the hashes of all other words, and the subword ids as little-endian bytes."""
    rows = docs.select("doc_id", held_out.alias("held_out"), text_or_empty().alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys, log10 = unigram.keys, unigram.log10(unigram.values)
    end_log, end_known = float(unigram.log10(np.array([unigram.ends]))[0]), int(unigram.ends > 0)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(source, b"", REMEMBERED)
        kind = id_type(encoder.bpe)
        places = HashLookup(keys)
        for batch in byte_slices(batches, "_text", TOKEN_BYTES):
            flat, offsets = sliced_hashes(batch)
            place = places.find(flat)
            found = place >= 0
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            base = np.bincount(doc[found], log10[place[found]], batch.num_rows) + end_log
            known = np.bincount(doc[found], minlength=batch.num_rows) + end_known
            rare_ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~found], minlength=batch.num_rows))])
            ids, ends = encoder.encode_array(batch.column("_text"))
            ends = pa.py_buffer((ends * kind.itemsize).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.diff(offsets) + 1),
                    pa.array(known),
                    pa.array(base),
                    pa.ListArray.from_arrays(pa.array(rare_ends.astype(np.int32)), pa.array(flat[~found])),
                    ids,
                ],
                names,
            )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, rare array<long>, ids binary"
    return stage(rows.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()))


def id_type(bpe: Bpe) -> np.dtype:
    return np.dtype("<u2" if len(bpe.tokens) <= 1 << 16 else "<u4")


def sequences(batch: pa.RecordBatch, end: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, offsets) of the documents of a batch: targets are the ids and the end, inputs are the same
    one place later, with the end id first."""
    parts = [np.frombuffer(x, kind) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    targets = np.full(offsets[-1], end, np.int64)
    keep = np.ones(offsets[-1], bool)
    keep[offsets[1:] - 1] = False
    if parts:
        targets[keep] = np.concatenate(parts)
    inputs = np.empty_like(targets)
    inputs[1:], inputs[offsets[:-1]] = targets[:-1], end
    return inputs, targets, offsets


def windows(offsets: np.ndarray, turn: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, places, scored) of all windows: places are windows x WINDOW, scored marks each place once. With a
    ``turn``, of every STRIDE-th window of each document, one at least; which ones moves with the turn."""
    size = np.diff(offsets)
    step = WINDOW - CONTEXT
    count = np.where(size <= WINDOW, 1, 1 + -(-(size - WINDOW) // step))
    first, stride = np.zeros(len(size), np.int64), 1
    if turn is not None:
        first, stride = (np.arange(len(size)) + turn) % np.minimum(count, STRIDE), STRIDE
        count = 1 + (count - 1 - first) // STRIDE
    doc = np.repeat(np.arange(len(size)), count)
    nth = first[doc] + stride * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    places = (offsets[doc] + nth * step)[:, None] + np.arange(WINDOW)[None]
    scored = places < offsets[doc + 1][:, None]
    scored[nth > 0, :CONTEXT] = False
    return doc, np.minimum(places, offsets[doc + 1][:, None] - 1), scored


# ------------------------------------------------------------------------------------------- model


def _one_hot(classes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(classes), width), np.float32)
    out[np.arange(len(classes)), classes] = 1
    return out


def row_blocks(scored: np.ndarray) -> Iterator[tuple[slice, np.ndarray | slice]]:
    """(rows, windows) of the places to score: the rows of a block attend to places before the block's end only, and
    windows without a scored place in the block are left out of it."""
    for lo, hi in BLOCKS:
        some = scored[:, lo:hi].any(axis=1)
        if some.all():
            yield slice(lo, hi), slice(None)
        elif some.any():
            yield slice(lo, hi), np.flatnonzero(some)


def by_class(classes: np.ndarray) -> np.ndarray:
    """The order of ascending classes; sixteen bits are sorted by counting."""
    return np.argsort(classes.astype(np.uint16), kind="stable")


def sum_rows(rows: np.ndarray, classes: np.ndarray, width: int) -> np.ndarray:
    """Sums of the rows by class."""
    out, count = np.zeros((width, rows.shape[1]), rows.dtype), np.bincount(classes, minlength=width)
    some = np.flatnonzero(count)
    if len(some):
        out[some] = np.add.reduceat(rows.take(by_class(classes), axis=0), (np.cumsum(count) - count)[some], axis=0)
    return out


@dataclass
class Attention:
    """Weights over classes: a class-to-class table, query, key and value rows, the output and the distance bias."""

    table: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    distance: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.query, self.key, self.value, self.out, self.distance]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def from_flat(self, flat: np.ndarray) -> Attention:
        cut = np.cumsum([x.size for x in self.parts()])[:-1]
        return Attention(*(a.reshape(x.shape).astype(np.float32, copy=False) for a, x in zip(np.split(flat, cut), self.parts())))

    def mask(self) -> np.ndarray:
        return np.where(LAG >= 0, self.distance[BACK], np.float32(-1e9)).astype(np.float32)

    def attend(self, classes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, mixed values) of windows of classes."""
        s = np.matmul(self.query[classes], self.key[classes].transpose(0, 2, 1)) / np.float32(np.sqrt(DIM))
        s += mask
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        return s, np.matmul(s, self.value[classes])

    def log_prob(self, classes: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural log P(target class) of the scored places, in row order."""
        _, mixed = self.attend(classes, self.mask())
        logits = mixed[scored] @ self.out
        logits += self.table[classes[scored]]
        logits -= logits.max(axis=1, keepdims=True)
        pick = logits[np.arange(len(logits)), targets[scored]]
        np.exp(logits, out=logits)
        return pick - np.log(logits.sum(axis=1))

    def scorer(self) -> Scorer:
        """The same probabilities from tables over pairs of classes: keys, queries and values depend on the class only,
        so exp(query . key) is looked up, and bounds per class keep every exponential below 1."""
        pair = (self.query @ self.key.T) / np.float32(np.sqrt(DIM))
        pair = np.exp(pair - pair.max(axis=1, keepdims=True))
        near = np.exp(self.distance - self.distance.max()).take(BACK) * SEEN
        highest = (self.value @ self.out).max(axis=0)
        table = self.table - (self.table + highest).max(axis=1, keepdims=True)
        return Scorer(self, *(x.astype(np.float32, copy=False) for x in (pair, near, table)))

    def gradient(self, classes: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean log likelihood of the scored places, in the order of ``parts``.

        Query . key depends on a pair of classes only, so its gradient is added up by pair first; the softmaxes are
        taken from the scorer's tables and divided by their sums after the products."""
        tables, width, at = self.scorer(), len(self.table), np.flatnonzero(scored)
        own = classes.ravel().take(at)
        order = by_class(own)
        at, ends = at.take(order), np.cumsum(np.bincount(own, minlength=width)).tolist()
        values, mixed, held = tables.mix(classes, scored)
        mixed = mixed.reshape(-1, DIM + 1).take(at, axis=0)
        total = mixed[:, DIM:]
        d, mixed = tables.logits(mixed, own.take(order))
        sums = np.exp(d, out=d) @ np.ones(width, np.float32)
        if not tables.wide_enough(total, sums):
            return self.plain_gradient(classes, targets, scored)
        scale = np.float32(1 / max(1, len(at)))
        d *= (-scale / sums)[:, None]
        d.ravel()[np.arange(0, d.size, width) + targets.ravel().take(at)] += scale
        g_table, ones, first = np.zeros_like(self.table), np.ones(len(at), np.float32), 0
        for k, end in enumerate(ends):
            if end > first:
                np.dot(ones[first:end], d[first:end], out=g_table[k])
            first = end
        g_own = np.empty((len(at), DIM + 1), np.float32)
        g_own[:, :DIM] = d @ self.out.T
        g_own[:, DIM] = -np.einsum("ij,ij->i", g_own[:, :DIM], mixed)
        g_own /= total
        g_mixed = np.zeros((classes.size, DIM + 1), np.float32)
        g_mixed[at] = g_own
        g_mixed = g_mixed.reshape(*classes.shape, DIM + 1)
        g_pair, lags = np.zeros(width * width), np.zeros((WINDOW, WINDOW), np.float32)
        g_value = np.zeros((*classes.shape, DIM), np.float32)
        for rows, some, pairs, weights in held:
            end, g = rows.stop, g_mixed[some, rows]
            g_s = np.matmul(g, values[some, :end].transpose(0, 2, 1))
            g_s *= weights
            g_pair += np.bincount(pairs.ravel(), g_s.ravel(), width * width)
            lags[rows, :end] += g_s.sum(axis=0)
            g_value[some, :end] += np.matmul(weights.transpose(0, 2, 1), g[..., :DIM])
        g_pair = g_pair.reshape(width, width).astype(np.float32) / np.float32(np.sqrt(DIM))
        return [
            g_table,
            g_pair @ self.key,
            g_pair.T @ self.query,
            sum_rows(g_value.reshape(-1, DIM), classes.ravel(), width),
            mixed.T @ d,
            np.bincount(BACK.ravel(), lags.ravel(), WINDOW).astype(np.float32),
        ]

    def plain_gradient(self, classes: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> list[np.ndarray]:
        """The same gradient place by place, with every softmax bounded by its own maximum."""
        weights, mixed = self.attend(classes, self.mask())
        own = classes[scored]
        logits = mixed[scored] @ self.out
        logits += self.table[own]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        d = logits / -logits.sum(axis=1, keepdims=True)
        d[np.arange(len(d)), targets[scored]] += 1
        d /= np.float32(max(1, len(d)))
        hot = _one_hot(classes.ravel(), len(self.table))
        g_mixed = np.zeros_like(mixed)
        g_mixed[scored] = d @ self.out.T
        values = self.value[classes]
        g_weights = np.matmul(g_mixed, values.transpose(0, 2, 1))
        g_s = weights * (g_weights - np.einsum("bij,bij->bi", g_weights, weights)[..., None])
        scale = np.float32(1 / np.sqrt(DIM))
        g_query = np.matmul(g_s, self.key[classes]) * scale
        g_key = np.matmul(g_s.transpose(0, 2, 1), self.query[classes]) * scale
        g_value = np.matmul(weights.transpose(0, 2, 1), g_mixed)
        lags = g_s.sum(axis=0)
        return [
            _one_hot(own, len(self.table)).T @ d,
            hot.T @ g_query.reshape(-1, DIM),
            hot.T @ g_key.reshape(-1, DIM),
            hot.T @ g_value.reshape(-1, DIM),
            mixed[scored].T @ d,
            np.array([np.trace(lags, offset=-i) for i in range(WINDOW)], np.float32),
        ]


@dataclass
class Scorer:
    model: Attention
    pair: np.ndarray  # class x class: exp(query . key), at most 1
    near: np.ndarray  # place x place: exp(distance bias), at most 1, 0 for later places
    table: np.ndarray

    def mix(self, classes: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """(value of every place and a 1, their weighted sums for the scored places, blocks). The last column of the
        sums is that of the weights; a block is (rows, windows, pairs of classes, weights)."""
        width = len(self.pair)
        values = np.hstack([self.model.value, np.ones((width, 1), np.float32)]).take(classes, axis=0)
        mixed, held = np.zeros((*classes.shape, DIM + 1), np.float32), []
        for rows, some in row_blocks(scored):
            own = classes[some]
            pairs = (own[:, rows] * width)[:, :, None] + own[:, None, : rows.stop]
            weights = self.pair.ravel().take(pairs)
            weights *= self.near[rows, : rows.stop]
            mixed[some, rows] = np.matmul(weights, values[some, : rows.stop])
            held.append((rows, some, pairs, weights))
        return values, mixed, held

    def logits(self, mixed: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, all below 0; mixed values) of places with the given weighted sums and classes."""
        with np.errstate(invalid="ignore", divide="ignore"):  # wide_enough looks for empty sums
            mixed = mixed[:, :DIM] / mixed[:, DIM:]
            logits = mixed @ self.model.out
        logits += self.table.take(own, axis=0)
        return logits, mixed

    def wide_enough(self, total: np.ndarray, sums: np.ndarray) -> bool:
        """False if the bounds left next to nothing of a place's weights or classes."""
        return not total.size or bool(np.isfinite(sums).all() and min(total.min(), sums.min()) > 1e-30)

    def log_prob(self, classes: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(scored)
        mixed = self.mix(classes, scored)[1].reshape(-1, DIM + 1).take(at, axis=0)
        logits, _ = self.logits(mixed, classes.ravel().take(at))
        pick = logits[np.arange(len(at)), targets.ravel().take(at)]
        sums = np.exp(logits, out=logits) @ np.ones(len(self.table), np.float32)
        if not self.wide_enough(mixed[:, DIM], sums):
            return self.model.log_prob(classes, targets, scored)
        return pick - np.log(sums)


def train_windows(model: Attention, classes: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> Attention:
    """One pass of Adam over the windows, in a fixed shuffled order."""
    order = np.random.default_rng(len(classes)).permutation(len(classes))
    flat = model.flat()
    model = model.from_flat(flat)  # its parts are views of the flat weights
    rate = np.full(len(flat), RATE, np.float32)
    rate[: model.table.size] = TABLE_RATE
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step, lo in enumerate(range(0, len(order), BATCH), 1):
        pick = order[lo : lo + BATCH]
        g = np.concatenate([x.ravel() for x in model.gradient(classes[pick], targets[pick], scored[pick])])
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        flat += rate * ((first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8))
    return model


@dataclass
class LanguageModel:
    class_of: np.ndarray  # by id
    share: np.ndarray  # ids x classes: natural log P(id | its class, class before)
    attention: Attention
    end: int
    kind: np.dtype

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        """log10 probability of every document of a batch."""
        inputs, targets, offsets = sequences(batch, self.end, self.kind)
        doc, places, scored = windows(offsets)
        c_in, c_out = self.class_of.take(inputs), self.class_of.take(targets)
        total = np.add.reduceat(self.share.ravel().take(targets * self.share.shape[1] + c_in), offsets[:-1], dtype=float) if len(offsets) > 1 else np.zeros(0)
        scorer = self.attention.scorer()
        for lo in range(0, len(doc), BLOCK):
            at, own = places[lo : lo + BLOCK], scored[lo : lo + BLOCK]
            log_p = scorer.log_prob(c_in.take(at), c_out.take(at), own)
            owner = np.repeat(doc[lo : lo + BLOCK], own.sum(axis=1))
            total += np.bincount(owner, log_p, len(total))
        return total / np.log(10)


def cluster(profile: np.ndarray, ends_word: np.ndarray) -> np.ndarray:
    """Class of each id. ``profile`` has, for each id, its counts by the bucket of the id before it."""
    count = profile.sum(axis=1)
    order = np.lexsort((np.arange(len(count)), -count))
    out = np.zeros(len(count), np.int64)
    out[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    x = np.sqrt((profile[rest] + 1e-3) / (profile[rest] + 1e-3).sum(axis=1, keepdims=True))
    x = np.hstack([x, ends_word[rest, None].astype(float)])
    weight = count[rest] + 1e-3
    k = CLASSES - SINGLE
    spread = np.searchsorted(np.cumsum(weight), (np.arange(k) + 0.5) / k * weight.sum())
    centres = x[np.minimum(spread, len(rest) - 1)] + 1e-6 * np.arange(k)[:, None]
    for _ in range(12):
        near = ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
        mass = np.bincount(near, weight, k)
        sums = np.stack([np.bincount(near, weight * x[:, j], k) for j in range(x.shape[1])], axis=1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-12)[:, None], centres)
    out[rest] = SINGLE + near
    return out


def _sum_rows(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, sums) of (i, c0, c1, ...) rows added up by i."""
    table = parts.groupBy("i").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width))).toArrow()
    columns = [table.column(f"c{j}").to_numpy() for j in range(width)]
    return table.column("i").to_numpy(), np.stack(columns, axis=1) if len(table) else np.zeros((0, width))


def _counter(shape: tuple[int, int], pairs, names: Sequence[str]):
    """Tasks add up pairs (row, column) of their documents; they yield the rows that have any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in byte_slices(batches, "ids"):
            row, column = pairs(batch)
            total += np.bincount(row * shape[1] + column, minlength=len(total))
        table = total.reshape(shape)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *(pa.array(np.ascontiguousarray(table[some, j])) for j in range(shape[1]))], names
        )

    return run


def fit(tokens: DataFrame, bpe: Bpe) -> LanguageModel:
    """The model of the training rows of ``tokens`` (uid, held_out, ids)."""
    size, kind = len(bpe.tokens), id_type(bpe)
    end = max(bpe.special.values()) if bpe.special else size - 1
    train = tokens.where(~F.col("held_out")).select("ids")
    bucket = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(59)).astype(np.int64)

    def contexts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        inputs, targets, _ = sequences(batch, end, kind)
        return targets, bucket[inputs]

    names = ["i", *(f"c{j}" for j in range(BUCKETS))]
    schema = ", ".join(f"{n} long" for n in names)
    rows, sums = _sum_rows(train.mapInArrow(_counter((size, BUCKETS), contexts, names), schema), BUCKETS)
    profile = np.zeros((size, BUCKETS))
    profile[rows] = sums
    ends_word = np.array([bool(t) and t.endswith("</w>") for t in bpe.tokens])
    class_of = cluster(profile, ends_word)

    def follows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        inputs, targets, _ = sequences(batch, end, kind)
        return targets, class_of[inputs]

    names = ["i", *(f"c{j}" for j in range(CLASSES))]
    schema = ", ".join(f"{n} long" for n in names)
    rows, sums = _sum_rows(train.mapInArrow(_counter((size, CLASSES), follows, names), schema), CLASSES)
    after = np.zeros((size, CLASSES), np.float32)
    after[rows] = sums
    member = np.zeros((CLASSES, size), np.float32)
    member[class_of, np.arange(size)] = 1
    pairs = (member @ after).astype(float).T  # class before x class
    count = profile.sum(axis=1) + ALPHA
    alone = (count / np.bincount(class_of, count, CLASSES)[class_of]).astype(np.float32)
    share = np.log((after + PRIOR * alone[:, None]) / (pairs.T[class_of] + PRIOR).astype(np.float32))
    alone = (pairs.sum(axis=0) + ALPHA) / (pairs.sum() + ALPHA * CLASSES)
    table = np.log((pairs + PRIOR * alone[None]) / (pairs.sum(axis=1, keepdims=True) + PRIOR))
    rng = np.random.default_rng(5)
    some = lambda: rng.normal(0, 0.3, (CLASSES, DIM)).astype(np.float32)
    model = Attention(
        table.astype(np.float32), some(), some(), some(), np.zeros((DIM, CLASSES), np.float32), np.zeros(WINDOW, np.float32)
    )
    for turn in range(ROUNDS):
        model = _round(train, model, class_of, end, kind, turn)
    return LanguageModel(class_of, share, model, end, kind)


def _round(train: DataFrame, model: Attention, class_of: np.ndarray, end: int, kind: np.dtype, turn: int) -> Attention:
    """Tasks train from ``model`` on the turn's windows of all their documents; the result is their mean, weighted by windows."""

    small = class_of.astype(np.uint8)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []

        def trained() -> pa.RecordBatch:
            classes, targets, scored = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            weights = train_windows(model, classes.astype(np.int64), targets.astype(np.int64), scored).flat().astype(float)
            n = len(classes)
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(weights * n).tolist()], pa.list_(pa.float64()))], ["n", "w"])

        for batch in byte_slices(batches, "ids"):
            inputs, targets, offsets = sequences(batch, end, kind)
            _, places, scored = windows(offsets, turn)
            waiting.append((small.take(inputs).take(places), small.take(targets).take(places), scored))
            if sum(len(x[0]) for x in waiting) >= TRAIN_WINDOWS:
                yield trained()
        if sum(len(x[0]) for x in waiting):
            yield trained()

    parts = train.mapInArrow(run, "n long, w array<double>")
    sums = parts.select("n", F.posexplode("w").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    table = sums.toPandas().sort_values("i")
    return model.from_flat((table["v"] / table["n"]).to_numpy()) if len(table) else model


# ------------------------------------------------------------------------------------------- scores


def scores(docs: DataFrame, held_out: Column, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; ``held_out`` marks
    the documents that teach nothing."""
    with open(path or default_path(), encoding="utf-8") as f:
        source = f.read()
    unigram = count_words(docs.where(~held_out))
    tokens = tokenized(docs, unigram, source, held_out)
    model = fit(tokens, Bpe(source))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "ids"):
            score = pa.array(model.score(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), score], [*names, "score"])

    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    scored = tokens.select(*names, "ids").mapInArrow(run, schema)
    rare = tokens.select("uid", F.explode("rare").alias("word")).join(unigram.counts, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(unigram.total + unigram.distinct + 1)))
    rare = rare.groupBy("uid").agg(F.sum(log).alias("more"), F.count("n").alias("known"))
    return scored.join(rare, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(unigram.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
