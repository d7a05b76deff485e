"""Quality rules (counts, distances, verdicts) and the quality classifier."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from carepath.llm import quality_classifier as qc
from carepath.llm import quality_rules as qr
from carepath.llm import statistics as st
from tests.llm.helpers import documents, prose, rows_of, with_extra


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
    )


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["", " ", "a b", "line\nline\nline", "x " * 40, " a\x0bb\x0cc\rd\te ", "ü <b> |é| 100% \U0001f600 # \xa0  x"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["\n".join(prose(rng, "en", 6) for _ in range(4)) * 2 for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: tuple(r[1:6]) for r in qr.verdicts(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_counts(t), repr(t)


def junk(rng, n):
    return " ".join(w.upper() + "!!" for w in prose(rng, "en", n).split())


def test_verdicts_and_distances(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "en", 120), "en") for i in range(200)]
    rows += [(1000 + i, junk(rng, 120), "en") for i in range(90)]
    rows += [(2000 + i, "*** ".join(prose(rng, "en", 100).split()), "en") for i in range(40)]
    rows += [(3000, "short text", "en"), (3001, None, "en"), (3002, prose(rng, "en", 40), None), (3003, "7 " * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in qr.verdicts(docs).collect()}
    assert all(got[i].kept for i in range(200))
    assert not any(got[i].kept for i in got if 1000 <= i < 3002)
    assert got[3002].kept and got[3002].char_distance == 0  # the only document without a language to learn from
    # the class distance of one document, from the definition
    counts = [np.array(_classes(t)) for i, t, _ in rows if i < 3000 and brute_counts(t)[4] * 100 <= 30 * brute_counts(t)[0]]
    shares = np.array([c / c.sum() for c in counts])
    median = np.sort(shares, axis=0)[(len(shares) - 1) // 2]
    q, p = median / median.sum(), shares[0]
    part = lambda x, y: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(x, y) if a > 0)
    assert abs(got[0].char_distance - math.sqrt(0.5 * (part(p, q) + part(q, p)))) < 0.01


def _classes(text):
    out = [0] * 6
    for c in text:
        if c.islower():
            out[0] += 1
        elif c.isupper():
            out[1] += 1
        elif c in " \t\n\x0b\x0c\r":
            out[2] += 1
        elif c in st.PUNCTUATION:
            out[3] += 1
        elif c in st.SYMBOLS:
            out[4] += 1
        elif not c.isdigit():
            out[5] += 1
    return out


def test_rules_keep_rows_and_columns_as_they_are(spark):
    docs = with_extra(documents(spark))
    kept = qr.keep(docs)
    assert kept.columns == docs.columns
    verdict = {}
    for r in qr.score(qr.measure(docs)).collect():
        verdict.setdefault(r.doc_id, set()).add(r.kept)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 3 and ids.count(None) == 1  # repeated rows stay; of two null ids the empty one goes
    assert not {1000, 1001, 1002, 1004} & set(ids) and set(range(60)) <= set(ids)
    assert qr.keep(docs.limit(0)).count() == 0 and qr.verdicts(docs).count() == docs.count()


def test_junk_is_rejected_among_few_documents_as_among_many(spark):
    for n in (6, 15, 30):
        rng = random.Random(4)
        rows = [(i, prose(rng, "en", 120), "en") for i in range(n)] + [(1000, junk(rng, 120), "en")]
        got = {r.doc_id: r.kept for r in qr.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        assert [i for i in got if not got[i]] == [1000]


def test_each_language_has_its_own_reference(spark):
    """Scripts that the word lists do not cover, in unequal shares, and documents without a language."""
    rng = random.Random(5)
    letters = {"ru": "абвгдежзиклмнопрст", "zh": "的一是不了人我在有他这中大来上国", None: "אבגדהוזחטיכלמנ"}

    def text(lang):
        word = lambda: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7)))
        return " ".join(word() for _ in range(90))

    rows = [(i, text(lang), lang) for i, lang in enumerate(["ru"] * 60 + ["zh"] * 30 + [None] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert qr.keep(docs).count() == 110
    mixed = docs.unionByName(spark.createDataFrame([(500, text("zh"), "ru")], "doc_id long, text string, lang string"))
    assert {r.doc_id for r in qr.verdicts(mixed).collect() if not r.kept} == {500}


def test_one_text_under_two_languages_is_judged_in_each(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, "en", 120), "en") for i in range(40)]
    text = " ".join("абвгд" if i % 2 else "жзик" for i in range(90))
    text = " ".join(f"{w}{'аеиоу'[i % 5]}{'бвгдж'[i // 5 % 5]}{'клмнп'[i // 25]}" for i, w in enumerate(text.split()))
    rows += [(100 + i, text.replace("а", "оуы"[i % 3]), "ru") for i in range(9)] + [(None, text, "ru"), (None, text, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = [(r.doc_id, r.lang) for r in qr.keep(docs).collect() if r.doc_id is None]
    assert left == [(None, "ru")]


def test_native_plan(spark):
    plan = qr.verdicts(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_isotonic_fit():
    rng = np.random.default_rng(0)
    y, w = rng.random(60), rng.random(60) + 0.1
    fit = qc.isotonic(y, w)
    assert (np.diff(fit) >= -1e-12).all() and abs((fit * w).sum() - (y * w).sum()) < 1e-9
    # least squares among monotone sequences: each block is the weighted mean of its values
    for level in np.unique(fit):
        own = fit == level
        assert abs(np.average(y[own], weights=w[own]) - level) < 1e-9
    assert list(qc.isotonic(np.array([1.0, 0.0]), np.ones(2))) == [0.5, 0.5]


def test_normal_equations_equal_one_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, len(qc.STATISTICS)))
    y = (x[:, 0] > 0).astype(float)
    rows = [(x[i].tolist(), float(y[i]), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "x array<double>, y double, fold int").repartition(5)
    model = qc.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), None, np.zeros(0), np.zeros(0))
    z = model.features(x)
    for fold, (a, b, n) in qc._normal_equations(df, model).items():
        own = np.arange(80) % 2 == fold
        assert np.allclose(a, z[own].T @ z[own]) and np.allclose(b, z[own].T @ y[own]) and n == own.sum()
    # the features approximate the Gaussian kernel
    near = z[:, :-1] @ z[:, :-1].T
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * x.shape[1]))
    assert np.abs(near - exact).mean() < 0.06


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "en", rng.randint(20, 150)) if i % 3 else junk(rng, rng.randint(20, 150))) for i in range(240)]
    docs = with_extra(spark.createDataFrame(rows + [(900, None), (901, ""), (None, "a b"), (3, rows[3][1])], "doc_id long, text string"))
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0)) for i in range(240)] + [(5, 1), (None, 1), (7, None), (5000, 0)], "doc_id long, quality int"
    )
    learn = F.pmod(F.col("doc_id"), F.lit(4)) != 1
    out = qc.classify(docs, labels, learn, F.shiftright("doc_id", 2)).collect()
    assert len(out) == 244 and all(0 <= r.score <= 1 for r in out)
    right = [r.predicted == int(r.doc_id % 3 > 0) for r in out if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 4 == 1]
    assert sum(right) / len(right) > 0.95


def test_classifier_without_or_with_one_class(spark):
    docs = documents(spark, 10)
    none = spark.createDataFrame([], "doc_id long, quality int")
    every = F.lit(True)
    assert {r.score for r in qc.classify(docs, none, every, F.col("doc_id")).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert min(r.score for r in qc.classify(docs.where("doc_id < 10"), ones, every, F.col("doc_id")).collect()) > 0.9
    assert rows_of(qc.classify(docs.limit(0), ones, every, F.col("doc_id"))) == []
