"""Attention language model: base score, windows, gradients, a proper distribution."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from carepath.llm import attention_lm as lm
from carepath.llm import bpe_lexicon, common
from tests.llm.helpers import documents, with_extra


def test_hash_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 5000), np.arange(300)]))
    rng.shuffle(keys)
    wanted = np.concatenate([keys[::3], rng.integers(-(2**63), 2**63 - 1, 3000), np.arange(400)])
    at = {int(k): i for i, k in enumerate(keys)}
    assert common.HashLookup(keys).find(wanted).tolist() == [at.get(int(w), -1) for w in wanted]
    assert (common.HashLookup(keys[:0]).find(wanted) == -1).all()


def test_every_place_is_scored_once():
    for size in (1, 2, 31, 32, 33, 56, 57, 200):
        offsets = np.array([0, 3, 3 + size])
        doc, places, scored = lm.windows(offsets)
        seen = np.bincount(places[scored], minlength=offsets[-1])
        assert (seen == 1).all()
        own = places[doc == 1]
        assert own.min() >= 3
        for row, s in zip(own[1:], scored[doc == 1][1:]):
            assert not s[: lm.CONTEXT].any()  # later windows have CONTEXT places of context before the first score


def test_word_hashes_tell_words_apart():
    rng = random.Random(4)
    texts = ["", " ", "A b\ta\n", "a", "bA", " é\u00a0é é ", "x" * 300] + [
        "".join(rng.choice("abC \n\x0b") for _ in range(rng.randint(0, 30))) for _ in range(400)
    ]
    whole = pa.array(texts, pa.string())
    for part in (whole, whole.slice(3, 50)):
        hashes, ends = lm.word_hashes(part)
        own, found = part.to_pylist(), {}
        for t, a, b in zip(own, ends[:-1], ends[1:]):
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            assert len(words) == b - a
            for w, h in zip(words, hashes[a:b].tolist()):
                assert found.setdefault(w, h) == h
        assert len(set(found.values())) == len(found)


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.normal(0, 0.4, s).astype(np.float32)
    k, d = lm.CLASSES, lm.DIM
    return lm.Attention(f(k, k), f(k, d), f(k, d), f(k, d), f(d, k), f(lm.WINDOW))


def loss(model, c, t, s):
    return float(model.log_prob(c, t, s).sum() / s.sum())


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    model = small_model()
    c, t = rng.integers(0, 6, (3, lm.WINDOW)), rng.integers(0, 6, (3, lm.WINDOW))
    s = rng.random((3, lm.WINDOW)) < 0.7
    grads = model.gradient(c, t, s)
    wide = lm.Attention(*(x.astype(np.float64) for x in model.parts()))
    for part, grad in zip(range(6), grads):
        x = wide.parts()[part]
        for at in rng.permutation(np.argwhere(np.abs(grad) > 1e-4))[:4]:
            at = tuple(at)
            keep, step = x[at], 1e-4
            x[at] = keep + step
            up = loss(wide, c, t, s)
            x[at] = keep - step
            down = loss(wide, c, t, s)
            x[at] = keep
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3 * max(1, abs(grad[at]))


def test_attention_is_causal_and_sums_to_one():
    rng = np.random.default_rng(4)
    model = small_model()
    c = rng.integers(0, lm.CLASSES, (1, lm.WINDOW))
    changed = c.copy()
    changed[0, 20:] = (c[0, 20:] + 1) % lm.CLASSES
    s = np.zeros((1, lm.WINDOW), bool)
    s[0, :20] = True
    t = rng.integers(0, lm.CLASSES, (1, lm.WINDOW))
    for m in (model, model.scorer()):
        assert np.allclose(m.log_prob(c, t, s), m.log_prob(changed, t, s), atol=1e-5)
    every = np.ones((1, lm.WINDOW), bool)
    assert np.allclose(model.log_prob(c, t, every), model.scorer().log_prob(c, t, every), atol=1e-4)
    steep = lm.Attention(*(x * 60 for x in model.parts()))  # bounds too wide for the tables: the plain way takes over
    assert np.allclose(steep.log_prob(c, t, every), steep.scorer().log_prob(c, t, every), rtol=1e-3, atol=1e-2)
    one = np.zeros((1, lm.WINDOW), bool)
    one[0, 9] = True
    total = sum(math.exp(model.scorer().log_prob(c, np.full((1, lm.WINDOW), k), one)[0]) for k in range(lm.CLASSES))
    assert abs(total - 1) < 1e-4


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(5)
    c = rng.integers(0, 8, (600, lm.WINDOW))
    t = np.roll(c, 3, axis=1)  # the target is the class three places back
    s = np.ones(c.shape, bool)
    s[:, :3] = False
    model = small_model(1)
    model = lm.Attention(np.zeros_like(model.table), model.query, model.key, model.value, np.zeros_like(model.out), np.zeros_like(model.distance))
    before = loss(model, c, t, s)
    for _ in range(12):
        model = lm.train_windows(model, c, t, s)
    assert loss(model, c, t, s) > before + 1.0


def brute_base(rows, fold):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts, train = Counter(), 0
    for i, t in rows:
        if fold[i] is False:
            counts.update(words(t))
            counts["\n"] += 1  # the end token
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*words(t), "\n"]
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        out.append((i, fold[i], len(tokens), sum(counts[w] > 0 for w in tokens), total, round(score, 6)))
    del train
    return sorted(out, key=repr)


def check_base(spark, docs):
    held = common.held_out("doc_id", 7, 2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fold = {r.doc_id: r.h for r in docs.select("doc_id", held.alias("h")).collect()}
    got = lm.scores(docs, held).collect()
    mine = sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=repr)
    want = brute_base(rows, fold)
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert all(abs(m[5] - w[5]) < 1e-5 for m, w in zip(mine, want))
    assert all(r.score < 0 for r in got)
    return got


def test_base_score_equals_brute_force(spark, monkeypatch):
    docs = with_extra(documents(spark, 30))
    first = check_base(spark, docs)
    monkeypatch.setattr(lm, "FREQUENT", 3)  # nearly all words go through the join
    second = check_base(spark, docs)
    key = lambda r: (repr(r.doc_id), r.n_tokens, r.score)
    assert all(abs(a.score - b.score) < 1e-3 for a, b in zip(sorted(first, key=key), sorted(second, key=key)))


def test_scores_without_training_rows(spark):
    docs = documents(spark, 10)
    got = lm.scores(docs, F.lit(True)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert lm.scores(docs.limit(0), common.held_out("doc_id", 7, 2)).count() == 0


def test_ids_given_context_are_a_distribution(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("the house of river and stone".split()) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with open(lm.default_path(), encoding="utf-8") as f:
        source = f.read()
    bpe = lm.Bpe(source)
    held = F.lit(False)
    model = lm.fit(lm.tokenized(docs, lm.count_words(docs), source, held), bpe)
    own = np.exp(model.share.astype(float))
    for before in (0, 5, lm.CLASSES - 1):
        sums = np.bincount(model.class_of, own[:, before], lm.CLASSES)
        present = np.bincount(model.class_of, minlength=lm.CLASSES) > 0
        assert np.allclose(sums[present], 1, atol=1e-3)
    # order matters to the model: shuffled syllables are less likely than the corpus's own words
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array([np.array(lm.shared_encoder(source, b"").encode(t), model.kind).tobytes()], pa.binary())], ["ids"])
    assert model.score(batch("the house of river and stone"))[0] > model.score(batch("zq xv of jj the kk"))[0]


def test_training_windows_come_from_every_document_and_all_windows_in_turn():
    offsets = np.concatenate([[0], np.cumsum([1, 5, 32, 33, 300, 1, 4000])])
    everything = {(d, tuple(p)) for d, p in zip(*[x.tolist() for x in lm.windows(offsets)[:2]])}
    seen = set()
    for turn in range(lm.STRIDE):
        doc, places, scored = lm.windows(offsets, turn)
        assert set(doc.tolist()) == set(range(7)) and scored.any(axis=1).all()
        assert len(doc) <= 7 + len(everything) // lm.STRIDE + 1
        seen |= {(d, tuple(p)) for d, p in zip(doc.tolist(), places.tolist())}
    assert seen == everything


def test_score_equals_one_place_at_a_time():
    """Class and id probabilities from plain loops over each window, natural logs added up by hand."""
    rng = np.random.default_rng(8)
    attention = small_model(4)
    size, classes = 200, len(attention.table)
    class_of = rng.integers(0, classes, size)
    share = rng.normal(-3, 1, (size, classes)).astype(np.float32)
    model = lm.LanguageModel(class_of, share, attention, end=7, kind=np.dtype("<u2"))
    texts = [rng.integers(0, size, n).astype("<u2") for n in (0, 1, 5, 31, 32, 33, 100)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], ["ids"])
    got = model.score(batch)
    for ids, score in zip(texts, got):
        targets = [*ids.tolist(), 7]
        inputs = [7, *ids.tolist()]
        total, start, first = 0.0, 0, 0
        while first < len(targets):
            window = [class_of[i] for i in inputs[start : start + lm.WINDOW]]
            for at in range(first - start, len(window)):
                q = attention.query[window[at]]
                s = [q @ attention.key[window[j]] / math.sqrt(lm.DIM) + attention.distance[at - j] for j in range(at + 1)]
                e = [math.exp(v - max(s)) for v in s]
                mixed = sum(w / sum(e) * attention.value[window[j]] for j, w in enumerate(e))
                logits = attention.table[window[at]] + mixed @ attention.out
                top = logits.max()
                target = targets[start + at]
                total += logits[class_of[target]] - top - math.log(np.exp(logits - top).sum()) + share[target, window[at]]
            first = start + len(window)
            start += lm.WINDOW - lm.CONTEXT
        assert math.isclose(score, total / math.log(10), rel_tol=1e-4)


def scored_windows(count, seed):
    """Windows of random classes: the first of a text is scored whole, the others from CONTEXT on, the last in part."""
    rng = np.random.default_rng(seed)
    c, t = rng.integers(0, 9, (count, lm.WINDOW)), rng.integers(0, lm.CLASSES, (count, lm.WINDOW))
    s = np.ones(c.shape, bool)
    s[1:, : lm.CONTEXT] = False
    s[5::7, : lm.CONTEXT] = True
    s[4::7, 17:] = False
    return c, t, s


def test_gradient_by_pairs_of_classes_equals_the_plain_one():
    c, t, s = scored_windows(50, 2)
    empty = np.zeros_like(s)
    for model, mask in ((small_model(7), s), (small_model(7), empty), (small_model(7), ~s), (lm.Attention(*(x * 60 for x in small_model(7).parts())), s)):
        for fast, plain in zip(model.gradient(c, t, mask), model.plain_gradient(c, t, mask)):
            assert fast.shape == plain.shape and fast.dtype == np.float32
            assert np.allclose(fast, plain, rtol=1e-4, atol=1e-5 * max(1e-3, np.abs(plain).max()))


def test_gradient_by_pairs_of_classes_takes_less_time():
    c, t, s = scored_windows(lm.BATCH, 3)
    model = small_model(2)

    def seconds(f):
        best = math.inf
        for _ in range(7):
            start = time.process_time()
            for _ in range(5):
                f(c, t, s)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(model.gradient) < 0.85 * seconds(model.plain_gradient)


def test_hashes_of_slices_equal_those_of_the_whole(monkeypatch):
    texts = pa.array(["One two  three", "", " ", "four", "five six\nseven"] * 7)
    hashes, ends = lm.word_hashes(texts)
    monkeypatch.setattr(lm, "HASH_BYTES", 20)
    flat, offsets = lm.sliced_hashes(pa.RecordBatch.from_arrays([texts], ["_text"]))
    assert flat.tolist() == hashes.tolist() and offsets.tolist() == ends.tolist()


def test_training_leaves_its_starting_weights_alone():
    c, t, s = scored_windows(300, 4)
    model = small_model(3)
    before = model.flat().copy()
    assert not np.array_equal(lm.train_windows(model, c, t, s).flat(), before)
    assert np.array_equal(model.flat(), before)


def test_merged_words_are_remembered_within_the_bound(monkeypatch):
    with open(lm.default_path(), encoding="utf-8") as f:
        bpe = lm.Bpe(f.read())
    merged, merge_many = [], bpe.merge_many
    monkeypatch.setattr(bpe, "merge_many", lambda raw, start, size: merged.append(len(size)) or merge_many(raw, start, size))
    texts = ["the quick brown foxes", "the quick brown foxes", "brown hares, quickly", "", "a <s> b", "zebras zigzag zealously"]
    plain = bpe_lexicon.Encoder(bpe)
    want = [plain.encode(t) for t in texts]
    for bound, seen in ((100, [4, 0]), (4, [4, 0])):
        merged.clear()
        encoder = bpe_lexicon.Encoder(bpe, b"", bound)
        got = []
        for t in texts:
            got.append(encoder.encode(t))
            assert len(encoder.known[0]) <= bound
        assert got == want and merged[:2] == seen
