"""Benchmark decontamination: alignment against a plain table, seeds, whole and edited copies."""

import random

import numpy as np

from carepath.llm import decontaminate as dc
from tests.llm.helpers import documents, with_extra


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return h.max()


def test_alignment_equals_the_plain_table():
    rng = random.Random(3)
    regions = [np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 30))], np.int64) for _ in range(60)]
    items = [np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 20))], np.int64) for _ in range(60)]
    score, end = dc.align(regions, items)
    for r, x, s, e in zip(regions, items, score, end):
        assert s == plain_alignment(r, x)
        assert plain_alignment(r[:e], x) == s


def passage(rng, n):
    return [f"q{rng.randint(0, 10**6)}" for _ in range(n)]


def test_copies_edits_and_clean_documents(spark):
    rng = random.Random(9)
    items = {i: passage(rng, rng.randint(12, 50)) for i in range(20)}
    items[20] = "the of and to in a is that it for on was".split() * 2  # only common words
    filler = lambda n: [rng.choice("the of and to in a is that it for on was be with as by at from".split()) for _ in range(n)]
    rows, want = [], set()
    for d in range(150):
        words = filler(rng.randint(20, 200))
        if d % 3 == 0:
            i = rng.randrange(20)
            copy = [w if rng.random() > 0.12 else f"r{rng.randint(0, 10**6)}" for w in items[i]] if d % 2 else list(items[i])
            if d % 5 == 0 and len(copy) > 20:
                del copy[7]
                copy.insert(12, "inserted")
            at = rng.randrange(len(words))
            words[at:at] = copy
            want.add((d, i))
        rows.append((d, " ".join(words).capitalize().replace(" the ", ", the ")))
    hot = " ".join(filler(20) + items[3] + filler(5))
    rows += [(1000 + k, hot) for k in range(150)]  # half of all rows hold one passage
    want |= {(1000 + k, 3) for k in range(150)}
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, " ".join(filler(30_000) + items[4] + filler(10))), (None, " ".join(items[5]))]
    want |= {(2003, 4), (None, 5)}
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    table = [(i, " ".join(w)) for i, w in items.items()] + [(30, None), (31, "too short"), (None, " ".join(passage(rng, 20))), (7, " ".join(items[7]))]
    bench = spark.createDataFrame(table, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in dc.matches(docs, bench).collect()}
    assert want <= set(got)
    assert {k for k in set(got) - want if k[1] != 20} == set()  # an item of common words may match common text
    assert all(0.5 <= s <= 1 for s in got.values()) and got[1000, 3] == 1
    clean = {r.doc_id for r in dc.decontaminate(docs, bench.where("item_id < 20")).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in want}


def test_edited_copies_next_to_an_exact_one(spark):
    """Most n-grams of the item are in the exact copy only; those of the edited copies are all in seven documents."""
    rng = random.Random(12)
    item = passage(rng, 30)
    copy = [f"r{k}" if k % 4 == 3 else w for k, w in enumerate(item)]
    rows = [(0, " ".join(item))] + [(i, f"start {' '.join(copy)} end{i}") for i in range(1, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in dc.matches(docs, bench).collect()} == set(range(8))


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    rng = random.Random(10)
    items = [passage(rng, 15) for _ in range(12)]
    docs = spark.createDataFrame([(i, "a b c " + " ".join(items[i % 12])) for i in range(24)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    whole = sorted(map(tuple, dc.matches(docs, bench).collect()))
    monkeypatch.setattr(dc, "MAX_WORDS", 40)
    monkeypatch.setattr(dc, "ENTRIES", 50)
    monkeypatch.setattr(dc, "BLOCK_CELLS", 60)
    assert sorted(map(tuple, dc.matches(docs, bench).collect())) == whole and len(whole) == 24


def all_pairs(docs, items):
    """Every document aligned with every item."""
    import re

    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, text in docs:
        for i, item in items:
            a, b = cut(text), cut(item)
            if b:
                share = plain_alignment(a, b) / len(b)
                if share >= (1 if len(b) < 3 else dc.THRESHOLD):
                    out[d, i] = share
    return out


def edited(rng, item, kind):
    """A copy of the item with edits of one kind."""
    if kind == "two of three":
        return [w if k % 3 else f"x{k}" for k, w in enumerate(item, 1)]
    if kind == "a word between all words":
        return [x for k, w in enumerate(item) for x in (w, f"y{k}")]
    if kind == "words left out":
        return [w for k, w in enumerate(item) if k % 4]
    return [w if rng.random() > 0.35 else f"z{rng.randint(0, 99)}" for w in item]


def test_pairs_equal_an_alignment_of_all_pairs(spark):
    """Edits down to the threshold, in texts of the same few words as the items, so common n-grams are everywhere."""
    rng = random.Random(21)
    vocabulary = "the of and to in a is that it for on was be with as by at from".split() + [f"w{i}" for i in range(40)]
    some = lambda n: [rng.choice(vocabulary[: rng.choice([18, 58])]) for _ in range(n)]
    items = {i: some(rng.choice([1, 2, 3, 4, 5, 7, 12, 20, 31])) for i in range(40)}
    kinds = ("two of three", "a word between all words", "words left out", "random")
    docs = {}
    for d in range(120):
        words = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, items[rng.randrange(40)], rng.choice(kinds))
        docs[d] = " ".join(words)
    items = {i: " ".join(w) for i, w in items.items()}
    got = dc.matches(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    )
    got = {(r.doc_id, r.item_id): r.score for r in got.collect()}
    want = all_pairs(docs.items(), items.items())
    assert len(want) > 150 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_long_items_and_long_texts(spark):
    rng = random.Random(22)
    long_item = [f"v{rng.randint(0, 3000)}" for _ in range(8_000)]
    common = "the of and to in a is that it for on was".split()
    short = [rng.choice(common) if k % 3 else f"s{k}" for k in range(30)]
    text = [rng.choice(common) for _ in range(100_000)]
    text[60_000:60_000] = edited(rng, short, "two of three")
    docs = [(1, " ".join(text)), (2, " ".join(edited(rng, long_item, "words left out"))), (3, " ".join(long_item[:3000]))]
    bench = [(1, " ".join(short)), (2, " ".join(long_item))]
    got = dc.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    )
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 2)}


def test_items_of_one_or_two_words(spark):
    docs = spark.createDataFrame([(1, "so Forty-two it is"), (2, "forty and two"), (3, "answer")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "forty two"), (2, "ANSWER!"), (3, "..."), (4, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in dc.matches(docs, bench).collect()} == {(1, 1, 1.0), (3, 2, 1.0)}


def test_empty_sides(spark):
    docs = with_extra(documents(spark, 10))
    bench = spark.createDataFrame([(1, "some words that are not there")], "item_id long, text string")
    assert dc.matches(docs, bench).count() == 0
    assert dc.matches(docs.limit(0), bench).count() == 0
    assert dc.matches(docs, bench.limit(0)).count() == 0
    assert dc.decontaminate(docs, bench).count() == docs.count()
    assert dc.decontaminate(docs, bench).columns == docs.columns
