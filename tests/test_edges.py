"""Edge rows: empty split, unknown-only test codes, NaN logits in scoring, a score saturated at one value."""

import math

from pyspark.sql import functions as F

from carepath.functions import clamped_probability
from carepath.operators import forecast as fc
from carepath.operators import metrics as me


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "hadm_id long, split string, pos long, prev long, next long")


def test_empty_test_split(spark):
    train = _pairs(spark, [(1, "train", 0, 1, 2), (1, "train", 1, 2, 3)])
    test = train.where("split = 'test'")
    model = fc.fit_next_code(train, 10)
    r = fc.evaluate_topk(model, test).first()
    assert r.n_tokens == 0 and r.top1_pct is None
    ce = fc.cross_entropy(train, test, vocab_size=3).first()
    assert ce.n_tokens == 0 and ce.cross_entropy is None


def test_unseen_previous_code_uses_global_list(spark):
    train = _pairs(spark, [(1, "train", 0, 1, 2), (2, "train", 0, 1, 2), (3, "train", 0, 2, 3)])
    test = _pairs(spark, [(9, "test", 0, 7, 2), (9, "test", 1, 7, 3)])
    model = fc.fit_next_code(train, 1)
    r = fc.evaluate_topk(model, test, ks=(1,)).first()
    assert r.n_tokens == 2 and r.top1_pct == 50.0  # global best is 2
    ce = fc.cross_entropy(train, test, vocab_size=3, lam=0.7).first()
    # prev 7 unseen: unigram (c(next)+1)/(N+n+1) with N=3, n=3 -> 3/7 and 2/7
    assert abs(ce.cross_entropy - (-(math.log(3 / 7) + math.log(2 / 7)) / 2)) < 1e-9


def test_nan_logit_scores_half(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, 0.0, -3.0), (3, 1.0, 4.0)], "hadm_id long, y double, z double")
    scored = df.select("hadm_id", "y", clamped_probability("z").alias("p"))
    ps = {r.hadm_id: r.p for r in scored.collect()}
    assert ps[1] == 0.5
    assert me.roc_auc(scored).first().roc_auc == 1.0


def test_saturated_scores_many_ties(spark):
    rows = [(i, float(i % 3 == 0), 1.0 if i % 2 else 0.25) for i in range(300)]
    df = spark.createDataFrame(rows, "hadm_id long, y double, p double")
    # brute force: pairs (pos, neg) with half credit for ties
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(me.roc_auc(df).first().roc_auc - want) < 1e-9


def test_many_distinct_scores_match_brute_force(spark):
    import random

    rnd = random.Random(7)
    rows = [(i, float(rnd.random() < 0.3), round(rnd.random() ** 8, 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "hadm_id long, y double, p double")
    pos = sorted(p for _, y, p in rows if y == 1)
    neg = [p for _, y, p in rows if y == 0]
    import bisect

    want = sum(bisect.bisect_left(pos, b) * 0 + (len(pos) - bisect.bisect_right(pos, b))
               + 0.5 * (bisect.bisect_right(pos, b) - bisect.bisect_left(pos, b)) for b in neg) / (len(pos) * len(neg))
    got = me.roc_auc(df).first().roc_auc
    assert abs(got - want) < 1e-9
    # average precision by direct definition over distinct thresholds
    thr = sorted({p for _, _, p in rows}, reverse=True)
    ap, tp_prev = 0.0, 0
    for t in thr:
        tp = sum(1 for _, y, p in rows if p >= t and y == 1)
        fp = sum(1 for _, y, p in rows if p >= t and y == 0)
        ap += (tp - tp_prev) / len(pos) * (tp / (tp + fp))
        tp_prev = tp
    assert abs(me.average_precision(df).first().average_precision - ap) < 1e-9


def test_hot_admission_row_form_equals_array_form(spark):
    """One admission with a third of all code rows (and exact ties in seq_num): the row form of next pairs,
    which spreads that admission over range partitions, equals the array form."""
    from carepath.operators import cohort as co
    from carepath.operators import sequences as sq
    from carepath.operators.vocab import build_vocab, encode_codes

    rows = [(1, i // 2, f"c{i % 17}") for i in range(3000)]  # hot admission, every seq_num used twice
    rows += [(h, j, f"c{(h * 7 + j) % 23}") for h in range(2, 1002) for j in range(6)]
    diag = spark.createDataFrame(rows, "hadm_id long, seq_num int, icd_code string").repartition(7)
    ids = diag.select("hadm_id").distinct()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        cohort = co.split_by_position(ids, train_frac=0.7)
        enc = encode_codes(diag, build_vocab(diag, cohort))
        a = sorted(map(tuple, sq.next_pairs(sq.build_sequences(enc, cohort)).collect()))
        b = sorted(map(tuple, sq.next_pairs_lead(enc, cohort).select("hadm_id", "split", "pos", "prev", "next").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(a) == 2999 + 1000 * 5
    assert a == b


def test_missing_cluster_is_its_own_context(spark):
    rows = [(1, "train", 0, 1, 2, None), (2, "train", 0, 1, 2, None), (3, "train", 0, 1, 3, 7),
            (4, "test", 0, 1, 2, None), (5, "test", 0, 1, 3, 7)]
    pairs = spark.createDataFrame(rows, "hadm_id long, split string, pos long, prev long, next long, cluster long")
    model = fc.fit_next_code(pairs.where("split = 'train'"), 1, ("cluster",))
    r = fc.evaluate_topk(model, pairs.where("split = 'test'"), ks=(1,)).first()
    assert r.n_tokens == 2 and r.top1_pct == 100.0


def test_topk_block_chunked_with_ties(monkeypatch):
    import numpy as np

    from carepath.operators import vectors as vx

    monkeypatch.setattr(vx, "QUERY_CHUNK", 3)
    rng = np.random.default_rng(1)
    q = rng.integers(-2, 3, size=(10, 4)).astype(float)  # small integers: many exact ties
    items = rng.integers(-2, 3, size=(30, 4)).astype(float)
    q_ids, i_ids = np.arange(100, 110), np.arange(30)[::-1].copy()
    query, item, score = vx._topk_block(q_ids, q, i_ids, items, 5)
    for r, qid in enumerate(q_ids):
        s = items @ q[r]
        want = sorted(range(30), key=lambda j: (-s[j], i_ids[j]))[:5]
        assert list(item[query == qid]) == [i_ids[j] for j in want]
        assert list(score[query == qid]) == [s[j] for j in want]


def test_topk_by_dot_keeps_k_rows_where_scores_are_no_numbers(spark):
    from carepath.operators.vectors import topk_by_dot

    nan = float("nan")
    items = spark.createDataFrame([(i, [float(i), nan if i % 3 == 0 else 1.0]) for i in range(1, 8)], "item_id long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [nan, 0.0]), (3, [-1.0, 0.0])], "query_id long, vec array<double>")
    for blocks in (1, 3):
        got = {}
        for r in topk_by_dot(queries, items, 6, item_blocks=blocks).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.item_id))
        assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {
            1: [7, 5, 4, 2, 1, 3],
            2: [1, 2, 3, 4, 5, 6],
            3: [1, 2, 4, 5, 7, 3],
        }


def test_empty_inputs(spark):
    from carepath.operators import cohort as co
    from carepath.operators import sequences as sq
    from carepath.operators.vocab import build_vocab, encode_codes

    ids = spark.createDataFrame([], "hadm_id long")
    cohort = co.split_by_position(ids, train_frac=0.8)
    assert cohort.count() == 0
    diag = spark.createDataFrame([], "hadm_id long, seq_num int, icd_code string")
    vocab = build_vocab(diag, cohort)
    assert vocab.size == 0 and vocab.unk_id == 1
    seqs = sq.build_sequences(encode_codes(diag, vocab), cohort)
    assert seqs.count() == 0
    assert sq.pad_batches(seqs).count() == 0


def test_empty_scores(spark):
    df = spark.createDataFrame([], "hadm_id long, y double, p double")
    r = me.ranking_summary(df).first()
    assert (r.n_pos, r.n_neg, r.roc_auc, r.average_precision) == (0, 0, None, None)
    assert me.calibration(df).count() == 0
    assert [tuple(x) for x in me.roc_points(df).collect()] == [(None, 0.0, 0.0)]


def test_two_vectors_or_labels_of_an_admission_give_one_example(spark):
    from carepath.operators.examples import assemble_examples

    seqs = spark.createDataFrame([(1, "train", [1], [2])], "hadm_id long, split string, input_ids array<long>, labels array<long>")
    vecs = spark.createDataFrame([(1, 2, [1.0]), (1, 9, [0.0]), (1, 5, [3.0])], "hadm_id long, seq int, vec array<double>")
    labels = spark.createDataFrame([(1, 0), (1, 1)], "hadm_id long, label int")
    rows = assemble_examples(seqs, vecs, labels, vector_order="seq").collect()
    assert [(r.vec, r.label) for r in rows] == [([0.0], 1)]


def test_constant_and_empty_lengths(spark):
    from carepath.operators import sequences as sq

    same = spark.createDataFrame([(i, 7) for i in range(5)], "hadm_id long, length long")
    rows = sq.length_histogram(same, bins=50).collect()
    assert [(r.bin, r.n) for r in rows] == [(25, 5)] and abs(rows[0].lo - 7.0) < 1e-12
    assert sq.length_density(same).count() == 0
    assert sq.length_histogram(same.limit(0)).count() == 0 and sq.length_density(same.limit(0)).count() == 0


def test_ks_beyond_the_model_raise(spark):
    import pytest

    train = _pairs(spark, [(1, "train", 0, 1, 2)])
    with pytest.raises(ValueError, match="keeps 3"):
        fc.evaluate_topk(fc.fit_next_code(train, 3), train, ks=(1, 5))


def test_fixed_split_keeps_every_id(spark):
    from carepath.operators import cohort as co

    ids = spark.createDataFrame([(i,) for i in range(10)], "hadm_id long")
    rows = {r.hadm_id: r.split for r in co.split_by_position(ids, train_size=4, test_size=3).collect()}
    assert rows == {i: "train" if i < 4 else "test" if i < 7 else "unused" for i in range(10)}


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    import pytest

    from carepath.session import checkpoint_dir, is_local

    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[3,2,1000]") and not is_local("yarn")

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_stream_rejects_a_reordered_header(spark):
    import os
    import tempfile

    import pytest

    from carepath.schemas import DIAGNOSES
    from carepath.streaming.landing import land_csv_stream

    root = tempfile.mkdtemp(prefix="carepath-stream-header-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("hadm_id,subject_id,seq_num,icd_code\n5,1,1,0389\n")
    with pytest.raises(Exception, match="(?i)header|column"):
        cols = ["subject_id", "hadm_id", "seq_num", "icd_code"]
        land_csv_stream(spark, src, cols, DIAGNOSES, f"{root}/out", f"{root}/ck").awaitTermination()


def test_row_form_pairs_have_no_exchange_on_the_admission(spark):
    """The code rows of a hot admission are never sent to one task: after the cohort join, no exchange is on
    hadm_id alone."""
    import contextlib
    import io

    from carepath.operators import sequences as sq

    rows = [(1, "train", i, i % 9) for i in range(3000)] + [(h, "train", j, j) for h in range(2, 600) for j in range(5)]
    enc = spark.createDataFrame(rows, "hadm_id long, split string, seq_num int, code_id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = sq.next_pairs_lead(enc)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            pairs.explain("formatted")
        assert pairs.count() == 2999 + 598 * 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = [x for x in buf.getvalue().split("\n") if x.startswith("Arguments: hashpartitioning(hadm_id")]
    assert exchanges == []
