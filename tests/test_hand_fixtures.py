"""The hand-made clinical fixture: every operator against hand-computed results."""

import pytest
from pyspark.sql import functions as F

from carepath.operators import cohort as co
from carepath.operators import forecast as fc
from carepath.operators import risk as rk
from carepath.operators import sequences as sq
from carepath.operators.examples import assemble_examples, modality_drop_counts
from carepath.operators.vocab import build_vocab, decode_codes, encode_codes

ADM = [(1, 101, 0), (1, 102, 1), (2, 103, 0), (2, 104, 0), (4, 105, 1), (5, 107, 0)]
NOTES = [101, 102, 103, 104, 105, 106]
DIAG = [
    (101, 1, "4019"), (101, 2, "0389"), (101, 3, "25000"),
    (102, 2, "25000"), (102, 1, "4019"),
    (103, 1, "I10"),
    (104, 1, "4019"), (104, 2, "Z99"), (104, 3, "0389"),
    (105, 1, "25000"), (105, 2, "4019"),
    (107, 1, "E119"),
]


@pytest.fixture(scope="module")
def world(spark):
    adm = spark.createDataFrame(ADM, "subject_id long, hadm_id long, hospital_expire_flag int")
    notes = spark.createDataFrame([(h,) for h in NOTES], "hadm_id long")
    diag = spark.createDataFrame(DIAG, "hadm_id long, seq_num int, icd_code string")
    labels = adm.select("hadm_id", F.col("hospital_expire_flag").alias("label"))
    ids = co.intersect_ids(adm.select("hadm_id"), notes)
    cohort = co.split_by_position(ids, train_size=3, test_size=2)
    vocab = build_vocab(diag, cohort)
    enc = encode_codes(diag, vocab)
    seqs = sq.build_sequences(enc, cohort)
    return dict(adm=adm, notes=notes, diag=diag, labels=labels, ids=ids, cohort=cohort, vocab=vocab, enc=enc,
                seqs=seqs, pairs=sq.next_pairs(seqs))


def test_intersection(world):
    assert sorted(r.hadm_id for r in world["ids"].collect()) == [101, 102, 103, 104, 105]


def test_split(world):
    rows = {r.hadm_id: (r.split, r.rn) for r in world["cohort"].collect()}
    assert rows == {101: ("train", 1), 102: ("train", 2), 103: ("train", 3), 104: ("test", 4), 105: ("test", 5)}


def test_fraction_split(spark, world):
    c = co.split_by_position(world["ids"], train_frac=0.6)
    assert sorted((r.hadm_id, r.split) for r in c.collect()) == [
        (101, "train"), (102, "train"), (103, "train"), (104, "test"), (105, "test")]


def test_split_check(world):
    got = {r.check_name: r.n for r in co.split_check(world["cohort"], world["adm"]).collect()}
    assert got == {"shared_admissions": 0, "shared_subjects": 1}


def test_cohort_stats(world):
    got = {r.split: (r.n, r.n_pos, r.rate_pct) for r in co.cohort_stats(world["cohort"], world["labels"]).collect()}
    assert got["train"][:2] == (3, 1) and abs(got["train"][2] - 33.333333) < 1e-6
    assert got["test"] == (2, 1, 50.0)


def test_vocab(world):
    v = world["vocab"]
    assert {r.code: r.code_id for r in v.table.collect()} == {"0389": 1, "25000": 2, "4019": 3, "I10": 4}
    assert (v.unk_id, v.size_with_unknown, v.model_size) == (5, 5, 6)


def test_sequences(world):
    got = {r.hadm_id: (r.input_ids, r.labels) for r in world["seqs"].collect()}
    assert got == {101: ([3, 1], [1, 2]), 102: ([3], [2]), 104: ([3, 5], [5, 1]), 105: ([2], [3])}


def test_lead_pairs_equal_array_pairs(world):
    a = sorted(tuple(r) for r in world["pairs"].select("hadm_id", "pos", "prev", "next").collect())
    b = sorted(tuple(r) for r in sq.next_pairs_lead(world["enc"], world["cohort"]).select(
        "hadm_id", "pos", "prev", "next").collect())
    assert a == b


def test_pad_one_batch(world):
    b = sq.pad_batches(world["seqs"].where("split = 'train'"), batch_size=16)
    got = sorted((r.pos_in_batch, r.input_ids, r.labels) for r in b.collect())
    assert got == [(0, [3, 1], [1, 2]), (1, [3, 0], [2, -100])]


def test_top_codes(world):
    top = decode_codes(sq.top_codes(sq.next_pairs(world["seqs"]), k=2), world["vocab"])
    assert [(r.code, r.n) for r in top.orderBy("rank").collect()] == [("4019", 2), ("0389", 1)]


def test_next_code_candidates_and_accuracy(world):
    train = world["pairs"].where("split = 'train'")
    test = world["pairs"].where("split = 'test'")
    model = fc.fit_next_code(train, k=10)
    ctx = world["pairs"].sparkSession.createDataFrame([(3,), (1,), (2,), (5,)], "prev long")
    cands = fc.rank_candidates(model, ctx)
    lists = {}
    for r in cands.orderBy("prev", "rank").collect():
        lists.setdefault(r.prev, []).append(r.cand)
    assert lists == {3: [1, 2], 1: [2, 1], 2: [2, 1], 5: [2, 1]}
    acc = fc.topk_accuracy(fc.score_pairs(model, test)).first()
    assert acc.n_tokens == 3
    assert (acc.top1_pct, round(acc.top5_pct, 4), round(acc.top10_pct, 4)) == (0.0, 33.3333, 33.3333)


def test_bag_of_codes(world):
    bags = rk.bag_of_codes(world["diag"], world["cohort"], world["labels"])
    counts = {r.split: r["count"] for r in bags.groupBy("split").count().collect()}
    assert counts == {"train": 3, "test": 2}
    top2 = [r.term for r in rk.doc_freq_vocab(bags, 2).orderBy("rank").collect()]
    assert top2 == ["25000", "4019"]


def test_class_weights(world):
    w = {r.label: r.weight for r in co.class_weights(world["cohort"], world["labels"]).collect()}
    assert w == {0: 0.75, 1: 1.5}


def test_modality_drop_and_missing_label(spark, world):
    vecs = spark.createDataFrame([(101, [1.0, 2.0]), (104, [3.0, 4.0])], "hadm_id long, vec array<float>")
    got = {r.split: (r.kept, r.dropped) for r in modality_drop_counts(world["seqs"], vecs, world["labels"]).collect()}
    assert got == {"train": (1, 1), "test": (1, 1)}
    labels = world["labels"].where("hadm_id != 104")
    ex = assemble_examples(world["seqs"], vecs, labels)
    rows = {r.hadm_id: (r.label, r.label_missing) for r in ex.collect()}
    assert rows == {101: (0, False), 104: (0, True)}


def test_doc_frequency_not_term_frequency(spark):
    docs = spark.createDataFrame(
        [(1, "train", ["x", "x", "x", "x"]), (2, "train", ["y"]), (3, "train", ["y"]), (4, "train", ["z", "y"]),
         (5, "train", ["z"])], "hadm_id long, split string, codes array<string>")
    assert [r.term for r in rk.doc_freq_vocab(docs, 2).orderBy("rank").collect()] == ["y", "z"]


def test_input_length_histogram(world):
    lens = sq.input_lengths(world["seqs"])
    assert sorted(r.length for r in lens.collect()) == [1, 2]
    h = {r.bin: r.n for r in sq.length_histogram(lens, bins=50).collect()}
    assert h == {0: 1, 49: 1}
