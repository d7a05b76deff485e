"""Periodic runs by block convolution against the definition, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepath.llm import periodic_runs as pr
from carepath.llm.queries import op13_periodic_runs
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents, rows_of, with_extra


def brute_runs(x):
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            e = i + q
            if i > s and e - s >= max(6, 4 * q):
                smaller = any(all(x[j] == x[j + r] for j in range(s, e - r)) for r in range(1, q))
                if not smaller:
                    out.append((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_words(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    w = brute_words(doc_id, text)
    runs = brute_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def piecewise(rng):
    """Words of a few letters, made of stretches that repeat."""
    letters, x = rng.choice([1, 2, 2, 3, 10]), []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, rng.choice([3, 12, 40])))]
        x += (unit * rng.randint(1, 12))[: rng.randint(1, 300)]
    return np.array(x, np.int64)


@pytest.mark.parametrize("cells", [pr.CELLS, 64])
@pytest.mark.parametrize("block", [pr.MAX_BLOCK, 8])
def test_runs_equal_the_definition(monkeypatch, cells, block):
    monkeypatch.setattr(pr, "CELLS", cells)
    monkeypatch.setattr(pr, "MAX_BLOCK", block)
    rng = random.Random(cells + block)
    for _ in range(40):
        group = [piecewise(rng) for _ in range(rng.randint(1, 6))]
        for x, found in zip(group, pr.runs_of(group)):
            assert [tuple(r) for r in found.tolist()] == brute_runs(x.tolist())


def test_transform_equals_the_sum():
    rng = np.random.default_rng(2)
    for points in (2, 16, 256, 1024):
        net = pr.Transform(points)
        a, b = rng.integers(0, pr.PRIME, (2, 3, points)).astype(np.float64)
        a[:, points // 2 :] = 0
        got = pr._mod(net.back(pr._mod(net.forward(b) * net.forward(a, inverse=True)), points // 2))
        for row in range(3):
            for d in range(0, points // 2, max(1, points // 16)):
                want = sum(int(p) * int(t) for p, t in zip(a[row], b[row, d:])) % pr.PRIME
                assert int(got[row, d]) % pr.PRIME == want


def test_every_period_and_place_has_a_seed():
    rng = np.random.default_rng(5)
    for q in (1, 2, 3, 5, 6, 10, 11, 21, 22, 42, 43, 85, 86, 170, 171, 700):
        for before in (0, 1, 7, q):
            x = np.concatenate([10**6 + np.arange(before), np.resize(rng.permutation(q), max(6, 4 * q)), [5 * 10**6] * 3])
            assert [before, max(6, 4 * q), q] in pr.runs_of([x])[0].tolist()


def test_long_periods_and_long_runs():
    x = np.random.default_rng(0).integers(0, 5000, 300_000)
    x[10:] = x[10 + np.arange(len(x) - 10) % 70_000]
    assert [10, len(x) - 10, 70_000] in pr.runs_of([x])[0].tolist()
    assert pr.runs_of([np.zeros(200_000, np.int64)])[0].tolist() == [[0, 200_000, 1]]
    assert pr.runs_of([]) == [] and pr.runs_of([np.zeros(0, np.int64)])[0].shape == (0, 3)


def test_copies_do_not_run_into_each_other():
    x = np.arange(40)
    assert [len(r) for r in pr.runs_of([x] * 8)] == [0] * 8


def test_query_equals_the_definition(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(F.size(F.split("text", " ")) < 1500)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r[0]: tuple(r) for r in op13_periodic_runs(spark, SF_SMALL).collect()}
    assert len(text) > 100 and any(v[1] for v in got.values())
    for i, t in text.items():
        assert got[i] == brute_row(i, t)


def test_awkward_rows(spark):
    docs = with_extra(documents(spark, 30))
    found = pr.detect(docs, keep=("doc_id", "kept"))
    assert found.count() == docs.count() and found.columns == ["doc_id", "kept", "n_words", "runs", "collapsed"]
    for r in found.where("doc_id in (1000, 1001, 1002)").collect():
        assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
    assert rows_of(pr.detect(docs.limit(0))) == []
    again = spark.createDataFrame([(1, "a\x0bb " * 5 + " x  c"), (2, "Ä Ä Ä Ä Ä Ä")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pr.detect(again).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 10, 2)] and rows[1].collapsed == "a b  x  c"
    assert [tuple(x) for x in rows[2].runs] == [(0, 6, 1)] and rows[2].collapsed == "Ä"


def test_planted_texts(spark):
    docs = documents(spark, 60).where("doc_id is null or doc_id < 1003 or doc_id = 1005")
    for r in docs.select("doc_id", "text", pr.planted().alias("new")).collect():
        assert r.new.encode().split() == brute_words(r.doc_id, r.text)
        assert r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 or r.new == (r.text or "")
