"""BPE against the tokenizers library; the lexicon against a plain dictionary."""

import random

import numpy as np
import pyarrow as pa
import pytest

from carepath.llm import bpe_lexicon as bl
from tests.llm.helpers import documents, with_extra


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bl.default_path())


@pytest.fixture(scope="module")
def bpe():
    with open(bl.default_path(), encoding="utf-8") as f:
        return bl.Bpe(f.read())


def awkward_texts():
    rng = random.Random(3)
    letters = "abcXYZ éÉßΣσςİı'’ \n\t\x1c\x85\xa0\u0301԰一\U0001f600\u200d0123½Ⅷ²<|endoftext|>#$.,s't"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FFF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(1500)]
    return texts + ["", "<|endoftext|>a<|startoftext|><|endoftext|>", "a" * 5000, "ab" * 3000 + " x", "É" * 300, "don't I'LL we've '"]


def test_ids_and_text_equal_the_library(library, bpe):
    lexicon = bl.build_lexicon(["the", "and", "don", "straße", "a" * 30], bpe)
    encoder, decoder = bl.Encoder(bpe, lexicon), bl.Decoder(bpe)
    texts = [*awkward_texts(), None]
    for first in range(0, len(texts), 700):
        part = texts[first : first + 700]
        ids, ends = encoder.encode_array(pa.array(part, pa.string()))
        back = decoder.decode(ids.astype(np.int64), ends).to_pylist()
        for t, a, b, text in zip(part, ends[:-1], ends[1:], back):
            want = library.encode(t or "", add_special_tokens=False).ids
            assert ids[a:b].tolist() == want, repr(t)
            assert text == library.decode(want, skip_special_tokens=False)


def test_every_settled_character(library, bpe):
    encoder = bl.Encoder(bpe)
    texts = [x for c in map(chr, range(0x600)) for x in ("a" + c + "a" + c + "1", c + "'s", c + c, "A" + c.upper() + "Σ" + c)]
    ids, ends = encoder.encode_array(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_slices_of_a_batch_and_document_borders(library, bpe):
    texts = ["it'", "s' ", "'ll", " ", "a'", "re", "é", "ét", "'", "'d'dd''s", "1", "2 '", "tx"] * 3
    whole = pa.array(texts, pa.string())
    for part in (whole, whole.slice(5), whole.slice(3, 9), whole.slice(0, 0)):
        ids, ends = bl.Encoder(bpe).encode_array(part)
        got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in part.to_pylist()]


def test_lexicon_is_a_minimal_dictionary():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode() for _ in range(800)}
    entries = {w: [rng.randint(0, 9) for _ in range(rng.randint(1, 4))] for w in words} | {"ü".encode(): [7]}
    lexicon = bl.Lexicon(bl.compile_lexicon(entries))
    asked = [*entries, b"", b"d", b"abcabcabca", *(w + b"a" for w in words)]
    size = np.array([len(w) for w in asked])
    place = lexicon.places(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(size) - size, size)
    got = [lexicon.ids[lexicon.ends[p] : lexicon.ends[p + 1]].tolist() if p >= 0 else None for p in place]
    assert got == [entries.get(w) for w in asked]
    # minimal: as many states as there are distinct sets of completions
    prefixes = {w[:k] for w in entries for k in range(len(w) + 1)}
    rests = {frozenset(w[len(p) :] for w in entries if w.startswith(p)) for p in prefixes}
    assert len(lexicon.first) - 1 == len(rests)


def test_words_merged_together_equal_one_by_one(bpe):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 40))).encode() for _ in range(3000)] + [b"a", b"zz" * 16]
    size = np.array([len(w) for w in words])
    ids, count = bpe.merge_many(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    ends = np.cumsum(count)
    for w, a, b in zip(words, ends - count, ends):
        assert ids[a:b].tolist() == bpe.merge(w) == bpe._merge_long([*(bpe.inner[x] for x in w[:-1]), bpe.last[w[-1]]])


def test_frequent_words_cut(spark):
    docs = spark.createDataFrame([(1, "a1bb bb CC cc cc dd, dd dd dd"), (2, None), (3, "ee ee")], "doc_id long, text string")
    assert set(bl.frequent_words(docs, 10)) == {"bb", "cc", "dd", "ee"}
    assert bl.frequent_words(docs, 1) == ["dd"]
    assert bl.frequent_words(docs.limit(0)) == []


def test_encode_decode_every_row(spark, library):
    docs = with_extra(documents(spark, 20))
    both = bl.encode(docs, keep=("doc_id", docs["text"].alias("own")), decoded=True)
    rows = both.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode(r.own or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    again = bl.decode(both.drop("decoded", "own"))
    assert sorted((r.doc_id or -1, r.decoded) for r in again.collect()) == sorted((r.doc_id or -1, r.decoded) for r in rows)
    assert bl.encode(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [-1, 518, 10**6])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bl.decode(odd).orderBy("doc_id").collect()] == ["", "the</w>"]
