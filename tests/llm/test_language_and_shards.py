"""Hyperdimensional language profiles and extendible-hash shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepath.llm import common, extendible
from carepath.llm import hd_langid as hd
from tests.llm.helpers import documents, rows_of, with_extra


def brute_vector(text, dim=hd.DIM):
    """One trigram at a time: bind rotated letter vectors, add."""
    letters, before = [0], 0
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or before:
            letters.append(code)
        before = code
    letters.append(0)
    out = np.zeros(dim)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b:
            v = [hd.letter_vector(x, dim) for x in (a, b, c)]
            out += v[0] * np.roll(v[1], 1) * np.roll(v[2], 2)
    return out


@pytest.mark.parametrize("block", [hd.BLOCK_CELLS, 50])
def test_document_vectors_equal_one_by_one_bundling(monkeypatch, block):
    monkeypatch.setattr(hd, "BLOCK_CELLS", block)
    texts = ["The cat, the dog!", "", "Ünïcödé  über—straße 12", "a", "日本語のテキスト", "x1y2z3"]
    got = {}
    for first, counts in hd.trigram_counts(texts):
        vectors = counts.vectors() if counts.letters.size else np.zeros((0, hd.DIM))
        for i, row in enumerate(counts.counts):
            got[first + i] = row @ vectors
    for i, t in enumerate(texts):
        assert np.allclose(got[i], brute_vector(t))


def test_languages_of_all_rows(spark):
    docs = with_extra(documents(spark))
    learn = docs.where(~common.held_out("doc_id", 4, 2))
    rows = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in hd.predict(docs, hd.fit(learn), keep=(F.col("text"),)).collect()}
    assert hd.predict(docs, hd.fit(learn)).count() == docs.count()
    truth = {r.doc_id: r.lang for r in docs.where("doc_id < 60").collect()}
    assert all(rows[k][0] == truth[k[0]] for k in rows if k[0] in truth)
    for key in ((1000, None), (1001, ""), (1002, " \n\t ")):
        text = "" if key[1] is None else key[1]
        found = [v for (i, t), v in rows.items() if i == key[0] and (t or "") == text]
        assert found == [("und", 0.0)]
    assert all(0 <= s <= 1 for _, s in rows.values())


def test_language_without_training_rows(spark):
    docs = documents(spark, 10)
    model = hd.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in hd.predict(docs, model).collect()} == {("und", 0.0)}
    assert hd.predict(docs.limit(0), hd.fit(docs)).count() == 0


def brute_shards(hashes, sizes, limit, start):
    """Split any bucket above the limit on one more bit."""
    out = {}

    def place(rows, bits):
        if sum(sizes[i] for i in rows) <= limit and len(bits) >= start or len(bits) == 64:
            for i in rows:
                out[i] = bits
            return
        for b in "01":
            own = [i for i in rows if hashes[i][len(bits)] == b]
            if own:
                place(own, bits + b)

    place(list(range(len(hashes))), "")
    return out


def test_shards_equal_splitting_by_hand(spark):
    rows = [(i, "x" * (10 + i * 37 % 300)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.doc_id: format(r.h & (1 << 64) - 1, "064b") for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for limit in (700, 5_000, 10**9):
        got = {r.doc_id: r for r in extendible.shard(docs, limit).collect()}
        total = sum(len(t) for _, t in rows)
        start = max(0, int(np.floor(np.log2(max(1, total / limit)))) - 1)
        want = brute_shards([hashes[i] for i, _ in rows], [len(t) for _, t in rows], limit, start)
        assert {i: got[i].shard for i, _ in rows} == want
        sums = {}
        for i, t in rows:
            sums[want[i]] = sums.get(want[i], 0) + len(t)
        assert all(got[i].shard_bytes == sums[want[i]] <= limit for i, _ in rows)


def test_one_key_with_most_rows_goes_to_pages_within_the_limit(spark):
    rows = [(7, "y" * 50)] * 300 + [(None, "z" * 20)] * 100 + [(i, "x" * 40) for i in range(100, 200)] + [(8, None), (9, "w" * 5000)]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = extendible.shard(docs, 1000).collect()
    assert len(got) == len(rows)
    size, count = {}, {}
    for r in got:
        n = len(r.text or "")
        size[r.shard], count[r.shard] = size.get(r.shard, 0) + n, count.get(r.shard, 0) + 1
    assert all(size[r.shard] == r.shard_bytes and count[r.shard] == r.shard_rows for r in got)
    assert [s for s in size if size[s] > 1000] == [r.shard for r in got if r.doc_id == 9]
    assert len({r.shard for r in got if r.doc_id == 7}) == 15
    assert rows_of(extendible.shard(docs.limit(0))) == []


def test_memory_of_texts_in_a_large_alphabet(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    text = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 650_000))  # about 2 MB, hardly a trigram twice
    model = hd.Prototypes(["zh"], np.ones((1, hd.DIM), np.float32) / 32)
    tracemalloc.start()
    pred, score = hd.classify([text, "short"], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pred == ["zh", "zh"] and peak < 500e6
    monkeypatch.setattr(hd, "VECTOR_ROWS", 7)
    monkeypatch.setattr(hd, "KEPT_LETTERS", 5)
    small, again = ["The cat, the dog!", "Ünïcödé über straße", "日本語のテキスト"], None
    (_, block), = hd.trigram_counts(small)
    again = block.bundle(block.counts)
    for t, row in zip(small, again):
        assert np.allclose(row, brute_vector(t))


def test_shards_of_a_table_with_clashing_columns(spark):
    names = ("cell", "over", "_h", "_bytes", "_row", "_uid", "_pos", "_first", "_largest", "_at", "n_bytes", "n_rows", "a.b", "shard")
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"),
        *[(F.col("id") * (k + 2)).alias(n) for k, n in enumerate(names)],
    )
    docs = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(200).select(F.lit(1).alias("_"))).drop("_"))
    out = extendible.shard(docs, limit=200)
    assert out.columns == [c for c in docs.columns if c != "shard"] + list(extendible.OUTPUT)
    rows = out.collect()
    assert len(rows) == 500
    for r in rows:
        assert [r[n] for n in names[:-1]] == [r.doc_id * (k + 2) for k in range(len(names) - 1)]
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(len(r.text))
    assert all(sum(v) <= 200 or len(v) == 1 for v in sizes.values())
    assert all(r.shard_bytes == sum(sizes[r.shard]) and r.shard_rows == len(sizes[r.shard]) for r in rows)
