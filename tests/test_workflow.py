"""End-to-end study, vector operators' alternative plans, the encoder hook and the streaming landing."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepath.plans.queries import QUERIES
from tests.conftest import SF_SMALL


def test_final_report(spark):
    rows = {(r.task, r.model): r for r in QUERIES["final_report"](spark, SF_SMALL).collect()}
    assert set(rows) == {("Forecasting", "Unimodal"), ("Forecasting", "Multimodal"),
                         ("Mortality", "Unimodal"), ("Mortality", "Multimodal"), ("Mortality", "Baseline")}
    for (task, _), r in rows.items():
        if task == "Forecasting":
            assert 0 <= r.metric_1 <= r.metric_2 <= r.metric_3 <= 100
        else:
            assert 0 <= r.metric_1 <= 1 and 0 <= r.metric_2 <= 1 and r.metric_3 == 0.0


def test_topk_by_dot_does_not_depend_on_blocks(spark):
    from carepath.operators.vectors import topk_by_dot

    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    a = topk_by_dot(e, e, 4, q_id="id", i_id="id")
    b = topk_by_dot(e, e, 4, q_id="id", i_id="id", item_blocks=3, query_block_rows=64)
    norm = lambda df: sorted((r.query_id, r.item_id, r.rank, round(r.score, 9)) for r in df.collect())
    assert norm(a) == norm(b)


def test_project_vectors_matches_numpy(spark):
    from carepath.operators.vectors import project_vectors

    w = np.arange(6, dtype=float).reshape(3, 2) / 7
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.5, -1.0, 0.0])], "id long, vec array<double>")
    got = {r.id: r.proj for r in project_vectors(df, "vec", w, np.array([0.1, 0.2])).collect()}
    assert got[1] == pytest.approx(list(np.array([1.0, 2.0, 3.0]) @ w + [0.1, 0.2]))
    assert got[2] == pytest.approx(list(np.array([0.5, -1.0, 0.0]) @ w + [0.1, 0.2]))


def test_max_pool_per_group(spark):
    from carepath.operators.vectors import max_pool

    df = spark.createDataFrame([(1, [1.0, 5.0]), (1, [3.0, 2.0]), (2, [0.0, -1.0])], "g long, vec array<double>")
    assert {r.g: r.pooled for r in max_pool(df, ["g"]).collect()} == {1: [3.0, 5.0], 2: [0.0, -1.0]}


def test_encoder_hook(spark):
    from carepath.operators.vectors import vectorize_notes_with

    def make_fn():
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)
        return predict

    notes = spark.createDataFrame([(1, "a b c"), (2, "hello")], "hadm_id long, text string")
    got = {r.hadm_id: r.vec for r in vectorize_notes_with(notes, make_fn, dim=2, batch_size=1).collect()}
    assert got == {1: [5.0, 2.0], 2: [5.0, 0.0]}


def test_streaming_landing_is_exactly_once(spark):
    from carepath.schemas import DIAGNOSES
    from carepath.streaming.landing import land_csv_stream

    root = tempfile.mkdtemp(prefix="carepath-stream-")
    src, out, ck = (os.path.join(root, d) for d in ("in", "out", "ck"))
    os.makedirs(src)
    cols = ["subject_id", "hadm_id", "seq_num", "icd_code", "icd_version"]
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(",".join(cols) + "\n1,5,1,0389,9\n1,5,2,4019,9\n")
    land_csv_stream(spark, src, cols, DIAGNOSES, out, ck).awaitTermination()
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write(",".join(cols) + "\n2,6,1,V1582,9\n")
    land_csv_stream(spark, src, cols, DIAGNOSES, out, ck).awaitTermination()
    land_csv_stream(spark, src, cols, DIAGNOSES, out, ck).awaitTermination()  # nothing new: no duplicates
    rows = sorted((r.hadm_id, r.seq_num, r.icd_code) for r in spark.read.parquet(out).collect())
    assert rows == [(5, 1, "0389"), (5, 2, "4019"), (6, 1, "V1582")]


def test_risk_matches_newton_solution(spark):
    """Weighted L2 logistic regression (1/2|b|^2 + sum w_i l_i) solved by Newton's method in numpy equals the
    Spark fit used by the risk model (coefficients and intercept)."""
    from pyspark.ml.functions import array_to_vector

    from carepath.operators import risk as rk

    rng = np.random.default_rng(0)
    n, d = 60, 4
    x = (rng.random((n, d)) < 0.4).astype(float)
    y = (rng.random(n) < 0.3).astype(float)
    bags = spark.createDataFrame(
        [(i, "train", [f"c{j}" for j in range(d) if x[i, j]], int(y[i])) for i in range(n)],
        "hadm_id long, split string, codes array<string>, label int")
    model = rk.fit_risk(bags, k=d)
    lr = model.pipeline.stages[-1]
    vocab = list(model.vocabulary)
    xs = np.stack([[1.0 if f"c{j}" == v else 0.0 for v in vocab] for j in range(d)])  # permutation
    xv = x @ xs
    wpos = n / (2 * y.sum())
    wneg = n / (2 * (n - y.sum()))
    w = np.where(y == 1, wpos, wneg)
    beta = np.zeros(d + 1)  # coefs..., intercept (unpenalised)
    a = np.hstack([xv, np.ones((n, 1))])
    reg = np.eye(d + 1)
    reg[d, d] = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (w * (p - y)) + reg @ beta
        hess = a.T @ (a * (w * p * (1 - p))[:, None]) + reg
        beta -= np.linalg.solve(hess, grad)
    assert list(lr.coefficients) == pytest.approx(list(beta[:d]), abs=2e-4)
    assert lr.intercept == pytest.approx(beta[d], abs=2e-4)


def test_next_code_model_round_trip(spark):
    from carepath.operators import forecast as fc

    pairs = spark.createDataFrame(
        [(1, "train", 0, 1, 2), (2, "train", 0, 1, 3), (3, "train", 0, 1, 2), (4, "test", 0, 1, 3)],
        "hadm_id long, split string, pos long, prev long, next long")
    model = fc.fit_next_code(pairs.where("split = 'train'"), 10)
    path = tempfile.mkdtemp(prefix="carepath-model-") + "/m"
    fc.save_next_code(model, path)
    back = fc.load_next_code(spark, path)
    a = fc.evaluate_topk(model, pairs.where("split = 'test'")).first()
    b = fc.evaluate_topk(back, pairs.where("split = 'test'")).first()
    assert a == b and back.global_top == model.global_top and back.k == model.k


def test_unpad_batches_gives_back_pairs(spark):
    from carepath.operators.sequences import next_pairs, pad_batches, unpad_batches
    from carepath.plans.fixtures import prepare

    s = prepare(spark, SF_SMALL, "F2").sequences
    a = sorted(map(tuple, next_pairs(s).collect()))
    b = sorted(map(tuple, unpad_batches(pad_batches(s, batch_size=8, seed=3)).collect()))
    assert a == b


def test_fuse_sequence_positions_repeats_note(spark):
    from carepath.operators.vectors import fuse_sequence_positions

    seqs = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "hadm_id long, pos long, code_id long")
    codes = spark.createDataFrame([(5, [1.0, 2.0]), (6, [0.0, 1.0])], "code_id long, vec array<double>")
    notes = spark.createDataFrame([(1, [3.0, 5.0])], "hadm_id long, vec array<double>")
    got = {r.pos: r for r in fuse_sequence_positions(seqs, codes, notes, [.1, .2, .3, .4], .05).collect()}
    assert got[0].gate == pytest.approx(0.969231140642852, abs=1e-12)
    assert got[0].fused == pytest.approx([2.9384622812857044, 4.907693421928556], abs=1e-12)
    assert got[1].code_id == 6 and len(got) == 2


def test_risk_model_round_trip_keeps_scores(spark):
    from carepath.operators import risk as rk

    rows = [(i, "train" if i % 4 else "test", ["a", "b", "c"][: 1 + i % 3], int(i % 5 == 0)) for i in range(40)]
    bags = spark.createDataFrame(rows, "hadm_id long, split string, codes array<string>, label int")
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "hadm_id long, vec array<double>")
    for v in (None, vectors):
        model = rk.fit_risk(bags, v)
        path = tempfile.mkdtemp(prefix="carepath-risk-") + "/m"
        rk.save_risk(model, path)
        back = rk.load_risk(spark, path)
        assert back.vocabulary == model.vocabulary and back.with_notes == (v is not None)
        assert sorted(rk.score_risk(back, bags, v).collect()) == sorted(rk.score_risk(model, bags, v).collect())
    assert rk.fit_check(rk.fit_risk(bags), bags).first().stationary


def test_report_filters(spark):
    from carepath.plans.report import filter_report

    rep = spark.createDataFrame(
        [("Forecasting", "Unimodal", 1.0, 2.0, 3.0), ("Mortality", "Multimodal", .9, .5, 0.0)],
        "task string, model string, metric_1 double, metric_2 double, metric_3 double")
    assert [r.model for r in filter_report(rep, task="Mortality").collect()] == ["Multimodal"]
    assert [r.task for r in filter_report(rep, model_contains="Unimodal").collect()] == ["Forecasting"]


def test_study_from_clinical_csv(spark):
    """The hand fixture as raw CSV extracts (quoted multi-line notes, codes with leading zeros) -> whole study."""
    from carepath.operators.risk import load_risk
    from carepath.plans.fixtures import clinical_inputs
    from carepath.plans.workflow import StudyConfig, run_study

    d = tempfile.mkdtemp(prefix="carepath-csv-")
    with open(f"{d}/admissions.csv", "w") as f:
        f.write("subject_id,hadm_id,admittime,hospital_expire_flag\n")
        for s_, h, fl in [(1, 101, 0), (1, 102, 1), (2, 103, 0), (2, 104, 0), (4, 105, 1), (5, 107, 0)]:
            f.write(f"{s_},{h},2150-01-01,{fl}\n")
    with open(f"{d}/discharge.csv", "w") as f:
        f.write("note_id,subject_id,hadm_id,text\n")
        for h in [101, 102, 103, 104, 105, 106]:
            f.write(f'n{h},1,{h},"Patient {h}\nsaid ""fine"", discharged home with code {h % 7}"\n')
    with open(f"{d}/diagnoses_icd.csv", "w") as f:
        f.write("subject_id,hadm_id,seq_num,icd_code,icd_version\n")
        for h, sq_, c in [(101, 1, "4019"), (101, 2, "0389"), (101, 3, "25000"), (102, 2, "25000"), (102, 1, "4019"),
                          (103, 1, "I10"), (104, 1, "4019"), (104, 2, "Z99"), (104, 3, "0389"), (105, 1, "25000"),
                          (105, 2, "4019"), (107, 1, "E119")]:
            f.write(f"1,{h},{sq_},{c},9\n")
    inp = clinical_inputs(spark, f"{d}/admissions.csv", f"{d}/discharge.csv", f"{d}/diagnoses_icd.csv",
                          landed_dir=f"{d}/landed")
    assert spark.read.parquet(f"{d}/landed/notes").count() == 6  # parsed once; ids are a column of it
    res = run_study(spark, inp, f"{d}/out", notes=inp.notes,
                    config=StudyConfig(train_frac=None, train_size=3, test_size=2, note_clusters=2, max_features=10))
    assert {r.split: r["count"] for r in res.cohort.groupBy("split").count().collect()} == {"train": 3, "test": 2}
    vocab = {r.code: r.code_id for r in spark.read.parquet(f"{d}/out/vocab").collect()}
    assert vocab == {"0389": 1, "25000": 2, "4019": 3, "I10": 4, "<UNK>": 5}
    seqs = {r.hadm_id: (r.input_ids, r.labels) for r in spark.read.parquet(f"{d}/out/sequences").collect()}
    assert seqs == {101: ([3, 1], [1, 2]), 102: ([3], [2]), 104: ([3, 5], [5, 1]), 105: ([2], [3])}
    rows = {(r.task, r.model) for r in res.report.collect()}
    assert len(rows) == 5 and ("Mortality", "Baseline") in rows
    third = {(r.task, r.metric): r for r in res.comparison.collect()}
    assert third["Mortality", "metric_1"].baseline is not None and third["Forecasting", "metric_1"].baseline is None
    model = load_risk(spark, f"{d}/out/models/risk_baseline")
    assert set(model.vocabulary) == {"0389", "25000", "4019", "I10"} and not model.with_notes
    header = spark.read.option("header", True).csv(f"{d}/out/final_metrics").columns
    assert header == ["Task", "Model", "Top-1 / AUC", "Top-5 / AUPRC", "Top-10"]


def test_format_report(spark):
    from carepath.plans.report import format_cohort_stats, format_report

    rep = spark.createDataFrame(
        [("Forecasting", "Unimodal", 6.5723444, 17.26, 24.9), ("Mortality", "Multimodal", .96305, .5131, 0.0)],
        "task string, model string, metric_1 double, metric_2 double, metric_3 double")
    got = {r.model: (r.metric_1, r.metric_3) for r in format_report(rep).collect()}
    assert got == {"Unimodal": ("6.5723%", "24.9000%"), "Multimodal": ("0.9631", "0.0000")}
    stats = spark.createDataFrame([("train", 50000, 1234, 2.468)], "split string, n long, n_pos long, rate_pct double")
    r = format_cohort_stats(stats, 12345).first()
    assert (r.n, r.positives, r.rate, r.vocab_size) == ("50,000", "1,234", "2.47%", "12,345")


def test_vectorize_notes_tfidf_values(spark):
    """Whole-text TF-IDF: a word in 1 of 3 notes gets count * ln(4/2); a word in every note gets 0."""
    import math

    from carepath.operators.vectors import vectorize_notes

    notes = spark.createDataFrame(
        [(1, "alpha alpha common"), (2, "beta common\ncommon"), (3, "Common gamma\tdelta")], "hadm_id long, text string"
    )
    vecs = {r.hadm_id: r.vec for r in vectorize_notes(notes).collect()}
    assert all(v.size == 5 for v in vecs.values())  # a place for each word
    values = {i: sorted(v.toArray().tolist()) for i, v in vecs.items()}
    one = math.log(4 / 2)
    assert values[1] == pytest.approx([0, 0, 0, 0, 2 * one])
    assert values[2] == pytest.approx([0, 0, 0, 0, one])
    assert values[3] == pytest.approx([0, 0, 0, one, one])
    cut = vectorize_notes(notes, max_terms=1).first().vec
    assert cut.size == 1 and cut.toArray().tolist() == [0.0]  # the most frequent word, in every note


def test_pca_projection_fit_on_train(spark):
    from carepath.operators.vectors import apply_projection, fit_projection

    rows = [(i, [float(i), 2.0 * i, 0.5]) for i in range(1, 9)]
    vecs = spark.createDataFrame(rows, "hadm_id long, vec array<double>")
    train = spark.createDataFrame([(i,) for i in range(1, 6)], "hadm_id long")
    model = fit_projection(vecs, train, 1)
    out = {r.hadm_id: r.proj for r in apply_projection(model, vecs).collect()}
    assert all(len(v) == 1 for v in out.values())
    # points on one line: the first component is linear in i
    diffs = [out[i + 1][0] - out[i][0] for i in range(1, 8)]
    assert max(diffs) - min(diffs) < 1e-9 and abs(abs(diffs[0]) - 5 ** 0.5) < 1e-9


def test_vectorize_notes_idf_fitted_on_train_only(spark):
    import math

    from carepath.operators.vectors import vectorize_notes

    notes = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "alpha alpha")], "hadm_id long, text string")
    train = spark.createDataFrame([(1,), (2,)], "hadm_id long")
    notes = notes.unionByName(spark.createDataFrame([(3, "unseen"), (4, None)], "hadm_id long, text string"))
    vecs = {r.hadm_id: r.vec for r in vectorize_notes(notes, fit_ids=train).collect()}
    # df(alpha) over the 2 train notes is 1: idf = ln(3/2), applied to the test note too; a word of no train note has no place
    assert vecs[3].size == 2 and max(vecs[3].toArray()) == pytest.approx(2 * math.log(3 / 2), rel=1e-6)
    assert vecs[4].toArray().tolist() == [0.0, 0.0]


def test_streaming_landing_multiline_notes(spark):
    from carepath.schemas import NOTES
    from carepath.streaming.landing import land_csv_stream

    root = tempfile.mkdtemp(prefix="carepath-stream-notes-")
    src, out, ck = (os.path.join(root, d) for d in ("in", "out", "ck"))
    os.makedirs(src)
    cols = ["note_id", "subject_id", "hadm_id", "text"]
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(",".join(cols) + '\nn1,1,11,"first line\nsecond ""quoted"" line"\nn2,2,12,"plain"\n')
    land_csv_stream(spark, src, cols, NOTES, out, ck, multiline=True).awaitTermination()
    rows = sorted((r.hadm_id, r.text) for r in spark.read.parquet(out).collect())
    assert rows == [(11, 'first line\nsecond "quoted" line'), (12, "plain")]
