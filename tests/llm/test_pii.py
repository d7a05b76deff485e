"""Personal data: base patterns, the CRF, masking."""

import random
import re
from itertools import product

import numpy as np
import pytest

from carepath.llm import pii_crf as pii
from tests.llm.helpers import documents, with_extra

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            part, digits = m.group(), re.sub(r"\D", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in part.split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def model():
    return pii.train(sorted(pii.labelled_rows()))


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    texts = ["".join(rng.choice("a1.@+-( )2 b.0%\n") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["4111 1111-1111 1111", "1.2.3.4.5.6.7.8", "256.1.1.1 0.0.0.0", "a@b.c.d@e.f", "é x@y.z \U0001f600 +1 (743) 555-3824."]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), repr(t)


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "1 " * 100_000):
        pii.base_spans(t)
        pii.windows(t)


def test_viterbi_is_the_best_path(model):
    rng = np.random.default_rng(2)
    k, t = len(pii.LABELS), 3
    e = rng.normal(size=(t, k))
    score = lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(model.transitions[a, b] for a, b in zip(p, p[1:]))
    best = max(product(range(k), repeat=t), key=score)
    assert tuple(pii.viterbi([e, e[:1]], model.transitions)[0]) == best


def test_training_raises_the_likelihood_and_fits_the_table(model):
    rows = sorted(pii.labelled_rows())
    found = pii.crf_spans([t for t, _ in rows], model)
    hits = sum(sorted(a) == sorted(map(tuple, b)) for a, (_, b) in zip(found, rows))
    assert hits / len(rows) > 0.97


def test_unseen_values_are_found(model):
    rows = pii.labelled_rows(repeats=3, seed=99)
    found = [both for _, both in pii.all_spans([t for t, _ in rows], model)]
    wanted = [set(map(tuple, s)) for _, s in rows]
    assert sum(len(w & set(f)) for w, f in zip(wanted, found)) >= 0.9 * sum(map(len, wanted))
    assert sum(len(set(f) - w) for w, f in zip(wanted, found)) <= 0.05 * sum(map(len, wanted))


def test_windows_lose_nothing_against_whole_texts(model):
    import duckdb

    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where doc_id < 400").fetchall()]
    whole = pii.crf_spans(texts, model, [[(0, len(t))] for t in texts])
    assert whole == pii.crf_spans(texts, model)


def test_mask_and_overlaps():
    spans = [("ip", 3, 6), ("phone", 5, 9), ("card", 12, 13)]
    assert pii.mask("abc456789ab1cd", [*spans]) == "abc<IP>ab1<CARD>d"
    assert pii.mask("x", []) == "x"


def test_find_and_redact_every_row(spark, model):
    base = documents(spark, 10)
    more = spark.createDataFrame(
        [(50, "mail me.x@mail.example.com or 10.0.0.1", "en", "s", 38), (51, 'token = "' + "a1" * 20 + '"', None, "s", 50)], base.schema
    )
    docs = with_extra(base.union(more))
    got = {(r.doc_id, r.masked): r for r in pii.find(docs, model).collect()}
    assert pii.find(docs, model).count() == docs.count()
    assert got[50, "mail <EMAIL> or <IP>"].spans == "email:5:26,ip:30:38" and got[50, "mail <EMAIL> or <IP>"].n_email == 1
    assert [r.spans for k, r in got.items() if k[0] == 51] == ["secret:9:49"]
    red = pii.redact(docs, model)
    assert red.schema == docs.schema
    rows = {(r.doc_id, r.text): r for r in red.collect()}
    assert rows[50, "mail <EMAIL> or <IP>"].n_chars == 20
    assert rows[1000, None].n_chars is None and rows[1001, ""].n_chars == 0
    assert pii.redact(docs.limit(0), model).count() == 0
    table = pii.labelled_table(spark)
    assert pii.fit(table).index.keys() == model.index.keys()


def test_characters_that_only_look_like_digits():
    """Every Unicode digit, number, mark and letter class beside or inside each kind: no error, ASCII digits only."""
    import sys
    import unicodedata

    seen: dict[str, list[str]] = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if not 0xD800 <= code < 0xE000:
            kind = unicodedata.category(c) + str(c.isdigit()) + str(c.isdecimal()) + str(c.isnumeric())
            if len(seen.setdefault(kind, [])) < 3:
                seen[kind].append(c)
    odd = [c for group in seen.values() for c in group] + list("²¹⁴٣५④Ⅳ")
    texts = ["server at 10.20.30.4² is up"]
    for c in odd:
        texts += [
            f"server at 10.20.30.4{c} and 10.2{c}.30.4 and 1{c}.{c}.{c}.{c} is up",
            f"card 4111 1111 1111 111{c} or 4111{c}111111111111 or {c * 16} here",
            f"call +49 30 1234 567{c} or +{c} 30 123456 now",
            f"mail jo{c}@example.org or jo@ex{c}mple.org{c}",
            f"key = AKIA{c}IOSFODNN7EXAMPLE{c}abcdefghij0123456789",
        ]
    model = pii.train(sorted(pii.labelled_rows()))
    for text, (own, both) in zip(texts, pii.all_spans(texts, model)):
        assert set(own) <= set(both)
        for kind, a, b in both:
            if kind in ("ip", "card"):
                assert all(c in "0123456789 .-" for c in text[a:b])
    assert ("ip", 10, 20) in pii.all_spans(texts[:1], model)[0][0]
