"""BagMinHash: unbiased agreement, classes against all pairs, families of copies, components."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from carepath.llm import bagminhash as bm
from carepath.llm import common
from carepath.llm.common import gathered
from carepath.llm.components import components
from tests.llm.helpers import documents, with_extra


def weighted_jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_agreement_is_the_weighted_jaccard():
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(60):
        a = Counter({int(x): int(w) for x, w in zip(rng.integers(0, 60, 30), rng.integers(1, 40, 30))})
        b = Counter({x: max(1, w + int(rng.integers(-9, 9))) for x, w in a.items() if rng.random() < 0.9})
        docs += [a, b]
    doc = np.concatenate([np.full(len(d), i) for i, d in enumerate(docs)])
    item = bm.mix(np.array([x for d in docs for x in d], np.uint64)) >> np.uint64(20)
    weight = np.array([w for d in docs for w in d.values()])
    places = 400
    sig = bm.signatures(doc, item, weight, len(docs), places)
    error = [
        (sig[i] == sig[i + 1]).mean() - weighted_jaccard(docs[i], docs[i + 1]) for i in range(0, len(docs), 2)
    ]
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.035
    # a document's signature does not depend on its neighbours in the batch
    own = doc == 5
    assert (bm.signatures(np.zeros(own.sum(), int), item[own], weight[own], 1, places)[0] == sig[5]).all()


def shingled(text):
    w = text.lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_classes(rows):
    sets = {i: Counter(shingled(t or "")) for i, t in rows}
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = sum((sets[a] & sets[b]).values())
            if both and both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng, text, share):
    return " ".join(f"new{rng.randint(0, 10**6)}" if rng.random() < share else w for w in text.split())


def test_classes_equal_all_pairs(spark):
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(25):
        base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 90)))
        for _ in range(rng.randint(1, 4)):
            rows.append((n, edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))))
            n += 1
    base = " ".join(f"f{i}" for i in range(150))  # one family, from near to far copies, larger than SMALL
    for k in range(90):
        rows.append((n, edited(rng, base, 0.0006 * k)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "x " * 3000), (n + 6, "x " * 2900)]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r.doc_id: r["class_id"] for r in bm.classes(docs).collect()}
    assert got == brute_classes(rows)


def test_deduplicate_keeps_one_row_of_each_class(spark):
    docs = with_extra(documents(spark))
    out = bm.deduplicate(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    want = set(range(60)) | {1000, 1001, 1002, 1003, 1004}
    assert sorted(x for x in ids if x is not None) == sorted(want)  # 1005 copies 5; 7 is there three times
    assert ids.count(None) == 2
    assert bm.deduplicate(docs.limit(0)).count() == 0 and bm.classes(docs.limit(0)).count() == 0


def test_rows_with_one_id_are_one_document(spark):
    rng = random.Random(2)
    a, b = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(2))
    rows = [(1, a), (2, b), (3, a), (3, b), (4, "something else entirely")]
    got = {r.doc_id: r.class_id for r in bm.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 501), (501, 500)]
    links += [(1000 + rng.randint(0, 30), 1000 + rng.randint(0, 30)) for _ in range(60)]
    links = [(a, b) for a, b in links if a != b]
    low = {}

    def find(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        low[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(low)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_take_few_tasks(spark, monkeypatch):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    find = {x: x for link in links for x in link}
    for _ in find:
        for a, b in links:
            find[a] = find[b] = min(find[a], find[b])
    table = spark.createDataFrame(links, "a long, b long")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    own = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        few = components(table)
        assert few.rdd.getNumPartitions() <= 8  # not a file or more for each of the session's partitions and each round
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        many = components(table)
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    assert {r.node: r.label for r in few.collect()} == {r.node: r.label for r in many.collect()} == find


def test_pairs_that_share_large_buckets_only_and_no_hub(spark):
    """All texts share all buckets, as with one common passage: each is near one other, few are near a hub."""
    rng = random.Random(21)
    base = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(150)]
    texts = base + [t + " end" for t in base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bands = ", ".join(f"{k}L" for k in range(bm.BANDS))
    found = bm.links(docs, docs.selectExpr("doc_id AS rep", f"array({bands}) AS bands"))
    assert sorted(map(tuple, found.collect())) == [(i, i + 150) for i in range(150)]


def test_families_of_different_hubs_are_joined(spark, monkeypatch):
    """Drifting versions: each is near its neighbours only, and the ends of two hubs' reach are near each other."""
    monkeypatch.setattr(bm, "SMALL", 1)
    monkeypatch.setattr(bm, "HUBS", 1)
    rng = random.Random(8)
    rows = []
    for _ in range(6):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(30):
            words[rng.randrange(120)] = f"new{rng.randint(0, 10**6)}"
            words[rng.randrange(120)] = f"new{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string").repartition(4)  # some rows twice
    got = {r.doc_id: r["class_id"] for r in bm.classes(docs).collect()}
    assert got == brute_classes(rows)


def test_long_rows_reach_python_in_small_batches(spark, monkeypatch, tmp_path):
    """4 MB of words or items are never one batch; the session keeps its own limit."""
    folder, limit = str(tmp_path), "spark.sql.execution.arrow.maxRecordsPerBatch"

    def watched(name):
        function = getattr(bm, name)

        def run(batches):
            import uuid

            def seen():
                for batch in batches:
                    with open(f"{folder}/{name}-{uuid.uuid4().hex}", "w") as f:
                        f.write(f"{batch.nbytes} {batch.num_rows}")
                    yield batch

            yield from function(seen())

        monkeypatch.setattr(bm, name, run)

    for name in ("_sign", "_multisets", "_verify"):
        watched(name)
    before = spark.conf.get(limit)
    text = " ".join(f"w{k}" for k in range(1000))
    docs = spark.createDataFrame([(n, f"{text} end{n % 900}") for n in range(1200)], "doc_id long, text string").coalesce(1)
    assert {r.class_id for r in bm.classes(docs).collect()} == {0}
    assert spark.conf.get(limit) == before
    for name in ("_sign", "_multisets", "_verify"):
        found = [[int(x) for x in p.read_text().split()] for p in tmp_path.glob(f"{name}-*")]
        assert sum(n for _, n in found) >= 899 and max(b for b, _ in found) < 4_000_000, (name, found)


def test_gathered_batches_keep_all_rows_in_order():
    batches = [pa.record_batch([pa.array([[k] * (k % 7)] * 3, pa.list_(pa.int64()))], ["w"]) for k in range(50)]
    joined = list(gathered(batches, 2000))
    assert 1 < len(joined) < 25
    assert [x for b in joined for x in b.column("w").to_pylist()] == [x for b in batches for x in b.column("w").to_pylist()]
    assert list(gathered([])) == []
