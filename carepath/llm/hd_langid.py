"""Language identification by hyperdimensional profiles.

Each letter has a random ±1 vector drawn from its code point. A letter trigram binds the three vectors, the second
rotated by one place and the third by two, so order matters. A document bundles (adds) its trigram vectors; a
language prototype bundles the documents of the language, each with unit weight. A document gets the language whose
prototype has the largest cosine. Bundling is linear, so prototypes are built from trigram counts and only then
expanded to vectors.

Defined results: null and letter-less texts are ``und`` with score 0; so is every text when nothing was learned;
null languages and null ids are not learned from; repeated rows count as often as they occur; ties go to the
language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import byte_slices, text_or_empty, texts

DIM = 1024
SEED = 20260
UNDETERMINED = "und"
MAX_LANGUAGES = 4096
# Cells of one block's count matrix (documents x distinct trigrams): 32 MB of float32.
BLOCK_CELLS = 8_000_000

# Trigrams expanded to vectors together (with their letters' vectors), and letters whose vectors a process keeps (a byte
# a dimension).
VECTOR_ROWS = 4096
KEPT_LETTERS = 32_768

_LETTERS: dict[int, np.ndarray] = {}
_IS_LETTER: np.ndarray | None = None


def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    """The random ±1 vector of a code point (0: word boundary); the same in every process."""
    found = _LETTERS.get(code)
    if found is None or len(found) != dim:
        rng = np.random.Generator(np.random.Philox(key=[SEED, code]))
        found = (rng.integers(0, 2, dim) * 2 - 1).astype(np.int8)
        if len(_LETTERS) >= KEPT_LETTERS:
            _LETTERS.clear()
        _LETTERS[code] = found
    return found


def _letter_table() -> np.ndarray:
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _IS_LETTER


@dataclass
class TrigramCounts:
    """Counts of one block: documents x distinct trigrams, and the letters (code points) of each trigram."""

    counts: np.ndarray
    letters: np.ndarray

    def vectors(self, dim: int = DIM, rows: slice = slice(None)) -> np.ndarray:
        """The bound vectors of the trigrams (of a stretch of them)."""
        letters = self.letters[rows]
        if not len(letters):
            return np.zeros((0, dim), np.float32)
        codes, at = np.unique(letters, return_inverse=True)
        table = np.stack([letter_vector(int(c), dim) for c in codes])
        at = at.reshape(letters.shape)
        out = table[at[:, 0]].astype(np.float32)
        out *= np.roll(table, 1, axis=1)[at[:, 1]]
        out *= np.roll(table, 2, axis=1)[at[:, 2]]
        return out

    def bundle(self, weights: np.ndarray, dim: int = DIM) -> np.ndarray:
        """``weights`` (rows x distinct trigrams) times the trigrams' vectors, a stretch of trigrams at a time."""
        out = np.zeros((len(weights), dim), np.float32)
        for lo in range(0, len(self.letters), VECTOR_ROWS):
            rows = slice(lo, lo + VECTOR_ROWS)
            out += weights[:, rows] @ self.vectors(dim, rows)
        return out


def trigram_counts(docs: list[str]) -> Iterator[tuple[int, TrigramCounts]]:
    """(first document, counts) for blocks of the documents; a run of other characters is one boundary."""
    lowered = [t.lower() for t in docs]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    flat = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.concatenate([[0], np.repeat(np.arange(len(docs)), sizes)])
    codes = np.where(_letter_table()[flat], flat, 0).astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, owner = codes[keep], owner[keep]
    middle = np.flatnonzero(codes[1:-1]) + 1
    if not len(middle):
        yield 0, TrigramCounts(np.zeros((len(docs), 0), np.float32), np.zeros((0, 3), np.int64))
        return
    alphabet, index = np.unique(codes, return_inverse=True)
    k = len(alphabet)
    gram = (index[middle - 1] * k + index[middle]) * k + index[middle + 1]
    if k**3 <= 4_000_000:
        seen = np.zeros(k**3, bool)
        seen[gram] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(k**3, np.int64)
        place[distinct] = np.arange(len(distinct))
        column = place[gram]
    else:
        distinct, column = np.unique(gram, return_inverse=True)
    letters = alphabet[np.stack([distinct // (k * k), distinct // k % k, distinct % k], axis=1)]
    row, n = owner[middle], len(distinct)
    step = max(1, BLOCK_CELLS // n)
    for first in range(0, len(docs), step):
        last = min(first + step, len(docs))
        lo, hi = np.searchsorted(row, [first, last])
        block = np.bincount((row[lo:hi] - first) * n + column[lo:hi], minlength=(last - first) * n)
        yield first, TrigramCounts(block.reshape(last - first, n).astype(np.float32), letters)


def _bundle(dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in byte_slices(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, block in trigram_counts(texts(batch)):
                own = langs[first : first + len(block.counts)]
                weight = 1.0 / np.maximum(block.counts.sum(axis=1), 1)
                names = sorted(set(own))
                pick = np.stack([(own == x) * weight for x in names]).astype(np.float32)
                for name, vector in zip(names, block.bundle(pick @ block.counts, dim)):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            ["lang", "vector"],
        )

    return run


@dataclass
class Prototypes:
    langs: list[str]
    vectors: np.ndarray  # unit rows


def fit(docs: DataFrame, dim: int = DIM) -> Prototypes:
    """Prototypes from (text, lang). Each task adds up its own documents; tasks' sums are added by dimension.

    The result has one row per language (at most MAX_LANGUAGES, checked), whatever the number of documents.
    """
    rows = docs.where(F.col("lang").isNotNull()).select(text_or_empty().alias("text"), "lang")
    parts = rows.mapInArrow(_bundle(dim), "lang string, vector array<double>")
    total = (
        parts.select("lang", F.posexplode("vector").alias("dim", "value"))
        .groupBy("lang", "dim")
        .agg(F.sum("value").alias("value"))
        .limit(MAX_LANGUAGES * dim + 1)
        .collect()
    )
    if len(total) > MAX_LANGUAGES * dim:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted({r.lang for r in total})
    vectors = np.zeros((len(langs), dim))
    at = {x: i for i, x in enumerate(langs)}
    for r in total:
        vectors[at[r.lang], r.dim] = r.value
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    return Prototypes(langs, vectors.astype(np.float32))


def classify(docs: list[str], model: Prototypes) -> tuple[list[str], np.ndarray]:
    """Language and cosine (clipped to 0..1) of each text."""
    pred, score = [UNDETERMINED] * len(docs), np.zeros(len(docs))
    if not docs or not model.langs:
        return pred, score
    dim = model.vectors.shape[1]
    for first, block in trigram_counts(docs):
        if not block.letters.size:
            continue
        vec = block.bundle(block.counts, dim)
        norm = np.linalg.norm(vec, axis=1)
        cosine = (vec @ model.vectors.T) / np.maximum(norm, 1e-30)[:, None]
        best = np.argmax(cosine, axis=1)
        for i in np.flatnonzero(block.counts.sum(axis=1) > 0):
            pred[first + i] = model.langs[best[i]]
            score[first + i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
    return pred, score


def predict(docs: DataFrame, model: Prototypes, id_col: str = "doc_id", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(id, kept columns, lang_pred, score) per row. The prototypes travel with the tasks: languages x dim floats."""
    kept = docs.select(F.col(id_col).alias("doc_id"), *keep, text_or_empty().alias("_text"))
    fields = [f for f in kept.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "_text"):
            pred, score = classify(texts(batch, "_text"), model)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")
