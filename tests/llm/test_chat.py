"""Reply trees: path choice against brute force, reversible formatting, digests."""

import random
from hashlib import sha256

from pyspark.sql import functions as F

from carepath.llm import chat_trees as ct

KIND = "id long, parent long, conv_id long, role string, text string, score double"


def test_format_is_reversible():
    rng = random.Random(2)
    texts = ["", "</s>[INST] ok [/INST]", "\\", "\\\\<", "<s>[user] x</s>", "a\nb"]
    texts += ["".join(rng.choice("\\<>[]/s ab\n") for _ in range(rng.randint(0, 20))) for _ in range(500)]
    turns = [(rng.choice(["user", "assistant", "a]b", ""]), t) for t in texts]
    assert ct.parse(ct.OPEN + "".join(ct.format_turn(r, t) for r, t in turns)) == turns


def brute_best(rows):
    parent = {i: p for i, p, *_ in rows}
    score = {i: s for i, *_, s in rows}
    inner = set(parent.values())
    best = {}
    for leaf in parent:
        if leaf in inner:
            continue
        path = [leaf]
        while parent[path[-1]] in parent:
            path.append(parent[path[-1]])
        total = sum(score[i] or 0.0 for i in path)
        key = (total / len(path), len(path), -leaf)
        root = path[-1]
        if root not in best or key > best[root][0]:
            best[root] = (key, path[::-1])
    return {i: (root, depth) for root, (_, path) in best.items() for depth, i in enumerate(path, 1)}


def test_best_paths_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        kind = rng.random()
        parent = None if kind < 0.1 or not rows else 9999 + i if kind < 0.15 else rng.choice(rows[-25:])[0]
        rows.append((i, parent, i % 5, "user", f"t{i}", rng.choice([0.0, 1.0, 2.0, None])))
    rows += [(1000 + i, 999 + i if i else None, 1, "user", "deep", 1.0) for i in range(70)]
    got = {r.id: (r.root, r.depth) for r in ct.best_paths(spark.createDataFrame(rows, KIND)).collect()}
    assert got == brute_best(rows)
    assert ct.best_paths(spark.createDataFrame([], KIND)).count() == 0


def test_conversations_digests(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"text {c} {t} </s>") for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(500, t, "assistant" if t % 2 else "user", "long " * 50) for t in range(300)]
    rows += [(600, 0, "assistant", None), (600, 1, None, ""), (None, 0, "user", "no id"), (700, None, "assistant", "ü\U0001f600")]
    rows += [(800, 0, "user", "twice"), (800, 0, "user", "twice")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    df = df.withColumn("id", F.lit(1)).withColumn("depth", F.lit("x"))  # clashing names are not read
    formatted = ct.format_paths(ct.chain(df))
    got = {r.conv_id: r for r in ct.read_back(formatted).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    convs = {}
    for r in sorted(rows, key=order):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(convs)
    whole = {r.conv_id: r.text for r in ct.conversations(formatted).collect()}
    for c, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        text = ct.OPEN + "".join(ct.format_turn(*x) for x in turns)
        digest = lambda s: sha256(s.encode()).hexdigest()
        want = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text))
        assert tuple(got[c][1:]) == want
        assert whole[c] == text and ct.parse(whole[c]) == turns
    assert ct.read_back(ct.format_paths(ct.chain(df.limit(0)))).count() == 0
