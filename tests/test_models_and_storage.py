"""Fitted clusters, projection, two-layer head, encoder hook, stored models, bucketed tables, CSV round trip, counters."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from carepath.functions.vector import vector_cells
from carepath.operators import encoders as en
from carepath.operators import heads as hd
from carepath.operators import risk as rk
from carepath.operators import vectors as vx
from carepath.plans.queries import stored_examples
from carepath.schemas import DIAGNOSES, NOTES
from carepath.session import remove_folder, shuffle_partitions
from carepath.sources import clinical
from tests.conftest import SF_SMALL


def vectors(spark, n=200, d=5, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)) * np.arange(1, d + 1)
    x[n // 2 :, 0] += 12
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "hadm_id long, vec array<double>"), x


def test_cluster_evidence_is_zero_only_for_settled_clusters(spark):
    df, x = vectors(spark)
    settled = vx.cluster_evidence(vx.fit_note_clusters(df, df, k=4, max_iter=200, tol=1e-9), df).collect()
    assert len(settled) == len(x)
    assert max(r.off_nearest for r in settled) < 1e-9 and max(r.off_mean for r in settled) < 1e-6
    early = vx.cluster_evidence(vx.fit_note_clusters(df, df, k=4, max_iter=1), df).collect()
    assert max(r.off_mean for r in early) > 1e-3
    rows = {r.hadm_id: r.cluster for r in settled}
    for c in set(rows.values()):
        own = x[[i for i in rows if rows[i] == c]]
        others = [x[[i for i in rows if rows[i] == o]].mean(axis=0) for o in set(rows.values()) - {c}]
        for row in own:
            assert all(np.linalg.norm(row - own.mean(axis=0)) <= np.linalg.norm(row - o) + 1e-6 for o in others)


def test_fitted_projection_against_numpy(spark):
    df, x = vectors(spark)
    model = vx.fit_projection(df, df, 5)
    got = vx.projection_moments(vx.apply_projection(model, df)).first()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert (got.n, got.dims, got.descending) == (200, 5, True)
    assert [got.trace, got.trace_of_square, got.trace_of_cube] == pytest.approx([(values**p).sum() for p in (1, 2, 3)])
    assert got.largest_covariance < 1e-9
    raw = vx.projection_moments(df, "vec").first()
    assert raw.largest_covariance > 0.01 and not raw.descending
    assert vx.projection_moments(df.limit(0), "vec").first().n == 0


def test_head_learns_what_one_layer_cannot(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(400)], "hadm_id long, vec array<double>, label int")
    model = hd.fit_head(df, hidden=8, max_iter=300)
    assert model.layers == (2, 8, 2) and model.n_params == 3 * 8 + 9 * 2 == len(model.model.weights)
    check = hd.head_check(model, df).first()
    assert (check.n, check.n_pos, check.n_params, check.max_gap, check.learned) == (400, int(y.sum()), 42, 0.0, True)
    p = {r.hadm_id: r.p for r in hd.score_head(model, df).collect()}
    assert np.mean([(p[i] > 0.5) == y[i] for i in range(400)]) > 0.9
    (w1, b1), (w2, b2) = hd.layers_of(model)
    out = 1 / (1 + np.exp(-(x @ w1.T + b1))) @ w2.T + b2
    assert [p[i] for i in range(400)] == pytest.approx(list(1 / (1 + np.exp(out[:, 0] - out[:, 1]))))


def test_head_wants_vectors_of_one_length(spark):
    df = spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 1)], "hadm_id long, vec array<double>, label int")
    with pytest.raises(ValueError):
        hd.fit_head(df)
    with pytest.raises(ValueError):
        hd.fit_head(df.limit(0))


def test_encoder_does_not_see_padding_or_batches(spark):
    rng = random.Random(2)
    texts = [" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", " \n", "ä" * 70_000, "a b\x0bc " * 20_000]
    run = en.make_length_encoder()
    whole = run(np.array(texts, dtype=object))
    for i, t in enumerate(texts):
        n = [len(w) for w in re.findall("[^ \t\n\x0b\x0c\r]+", t or "")]
        want = [n[0], sum(n) / len(n), max(n), len(n)] if n else [0, 0, 0, 0]
        assert whole[i].tolist() == pytest.approx(want)
        assert run(np.array([t], dtype=object))[0].tolist() == whole[i].tolist()
    notes = spark.createDataFrame(list(enumerate(texts)), "hadm_id long, text string")
    for size in (1, 7, 500):
        got = {r.hadm_id: r.vec for r in vx.vectorize_notes_with(notes, en.make_length_encoder, 4, size).collect()}
        assert all(got[i] == whole[i].tolist() for i in range(len(texts)))


def test_padded_blocks_hold_every_text_once_and_stay_small():
    lengths = [5, 0, 900, 3, 3, 1, 70, 2]
    blocks = en.padded_blocks(lengths, cells=20)
    assert sorted(np.concatenate(blocks).tolist()) == list(range(8))
    for b in blocks:
        assert len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 20


def test_stored_coefficients_give_the_models_margins(spark, tmp_path):
    rng = random.Random(5)
    bags = [(i, "train" if i % 4 else "test", rng.sample("abcdefg", rng.randint(0, 4)), int(rng.random() < 0.4)) for i in range(120)]
    bags = spark.createDataFrame(bags, "hadm_id long, split string, codes array<string>, label int")
    notes = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(0, 120, 2)], "hadm_id long, vec array<float>")
    for v in (None, notes):
        path = str(tmp_path / f"model{v is None}")
        rk.save_risk(rk.fit_risk(bags, v), path)
        loaded = rk.load_risk(spark, path)
        want = {r.hadm_id: r.margin for r in rk.score_risk(loaded, bags, v, split=None).collect()}
        got = {r.hadm_id: r.margin for r in rk.stored_margins(spark, path, bags, v).collect()}
        assert set(got) == set(want) and all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want)
        assert rk.fit_check(loaded, bags, v).first().stationary
    cut = rk.fit_risk(bags, notes, max_iter=0)
    assert not rk.fit_check(cut, bags, notes).first().stationary


def test_bucketed_artifacts_join_without_an_exchange_and_prune(spark, tmp_path):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined, names = stored_examples(spark, SF_SMALL, str(tmp_path / "a"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
        one = joined.where("split = 'test'")
        scan = one._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*split#\d+ = test", scan)
        stored = spark.table(names[0]).where("split = 'test'").inputFiles()
        assert stored and len(stored) <= shuffle_partitions(spark) and all("split=test" in f for f in stored)
        assert one.count() == joined.where("split = 'test'").count() < joined.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove_folder(spark, str(tmp_path / "a"))


def test_csv_round_trip_is_exact(spark, tmp_path):
    odd = ["a", "", None, " lead", "trail ", 'say ""hi"', '"', '""', "a,b\nc\r\nd\re", "back\\slash\\", '\\"', "ü\t x", "null", "'", "#c"]
    rows = [(i, 2 * i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, text string")
    for compression in ("gzip", None):
        path = str(tmp_path / f"csv-{compression}")
        clinical.write_csv(df, path, compression)
        back = clinical.read_csv(spark, path, NOTES, multiline=True, keep_empty=True)
        assert back.schema == NOTES and sorted(map(tuple, back.collect())) == rows
        assert sorted(map(tuple, clinical.read_notes(spark, path).collect())) == [(a, b, t or None) for a, b, t in rows]


def test_counts_ride_on_the_landing_and_the_session_stays_usable(spark, tmp_path):
    raw = [("1", "1", "0389"), ("x", "2", "V1"), (None, "two", ""), ("4", "", None)]
    clinical.write_csv(spark.createDataFrame(raw, "hadm_id string, seq_num string, icd_code string"), str(tmp_path / "raw"))
    got = clinical.land_counted(spark, str(tmp_path / "raw"), DIAGNOSES, str(tmp_path / "landed"))
    assert got == {"rows": 4, "rejected_hadm_id": 1, "rejected_seq_num": 1}
    landed = spark.read.parquet(str(tmp_path / "landed"))
    assert landed.schema.names == DIAGNOSES.names and landed.count() == 4
    assert landed.where(F.col("hadm_id").isNull()).count() == 2
    bags = spark.createDataFrame([(i, "train", ["a"] if i % 2 else ["b"], i % 2) for i in range(8)], "hadm_id long, split string, codes array<string>, label int")
    assert rk.fit_risk(bags).vocabulary == ("a", "b")


def test_models_take_sparse_note_vectors(spark, tmp_path):
    """Clusters, risk models and stored coefficients on exact TF-IDF vectors; several notes of one admission are one."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    notes = [(i, " ".join(rng.choice(words[30 * (i % 2) : 30 * (i % 2) + 30]) for _ in range(20))) for i in range(80)]
    notes = spark.createDataFrame(notes + [(0, "w1 w2")], "hadm_id long, text string")
    sparse = vx.vectorize_notes(notes).cache()
    assert sparse.count() == 80 and sparse.first().vec.size == 60
    dense = sparse.select("hadm_id", vector_to_array("vec").alias("vec"))
    cells = lambda df: sorted((r.hadm_id, r.place, r.x) for r in vector_cells(df, "hadm_id").collect() if r.x)
    assert cells(sparse) == cells(dense)
    bags = [(i, "train" if i % 4 else "test", ["a", "b"][: 1 + i % 2], int(i % 2 == 0 or i % 7 == 0)) for i in range(80)]
    bags = spark.createDataFrame(bags, "hadm_id long, split string, codes array<string>, label int")
    clusters = [vx.assign_clusters(vx.fit_note_clusters(v, v, k=2), v).collect() for v in (sparse, dense)]
    for found in clusters:
        groups = {r.cluster: {x.hadm_id % 2 for x in found if x.cluster == r.cluster} for r in found}
        assert sorted(map(sorted, groups.values())) == [[0], [1]]
    margins = []
    for name, v in (("sparse", sparse), ("dense", dense)):
        model = rk.fit_risk(bags, v)
        rk.save_risk(model, str(tmp_path / name))
        want = {r.hadm_id: r.margin for r in rk.score_risk(model, bags, v, split=None).collect()}
        got = {r.hadm_id: r.margin for r in rk.stored_margins(spark, str(tmp_path / name), bags, v).collect()}
        assert all(math.isclose(got[i], want[i], abs_tol=1e-6) for i in want)
        assert rk.fit_check(model, bags, v).first().stationary
        margins.append(want)
    assert all(math.isclose(margins[0][i], margins[1][i], abs_tol=1e-3) for i in margins[0])
