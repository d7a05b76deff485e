"""Ranking metrics, calibration, clamping and fusion against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from carepath.functions import clamped_probability, gate, weighted_sum
from carepath.functions.vector import layer_norm
from carepath.operators import metrics as me

SCORES = [(0, .1), (0, .4), (1, .35), (1, .8), (1, .4), (0, .8), (0, .2)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(i, float(y), p) for i, (y, p) in enumerate(SCORES)], "hadm_id long, y double, p double")


def test_auc_ap(scores):
    assert abs(me.roc_auc(scores).first().roc_auc - 2 / 3) < 1e-9
    assert abs(me.average_precision(scores).first().average_precision - 0.5333333333) < 1e-9
    s = me.ranking_summary(scores).first()
    assert (s.n_pos, s.n_neg) == (3, 4)


def test_roc_area_equals_auc(scores):
    assert abs(me.roc_area(scores).first().roc_area - 2 / 3) < 1e-9


def test_auc_of_complement(scores):
    flipped = scores.withColumn("p", 1 - F.col("p"))
    assert abs(me.roc_auc(scores).first().roc_auc + me.roc_auc(flipped).first().roc_auc - 1) < 1e-9


def test_prefix_sums_do_not_depend_on_partitioning(scores):
    # One range partition and many give the same prefix sums.
    a, _ = me.prefix_sum_by_score(scores, num_partitions=1)
    b, _ = me.prefix_sum_by_score(scores, num_partitions=13)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, .2), (2, 1.0, .7)], "hadm_id long, y double, p double")
    assert me.roc_auc(df).first().roc_auc is None


def test_roc_points(scores):
    pts = sorted((r.fpr, r.tpr) for r in me.roc_points(scores).collect())
    # Distinct scores .8 .4 .35 .2 .1 -> cumulative (fp, tp) (1,1) (2,2) (2,3) (3,3) (4,3); (3,3) lies on the
    # segment between its neighbours and is dropped; the (0, 0) start is added.
    want = [(0.0, 0.0), (0.25, 1 / 3), (0.5, 2 / 3), (0.5, 1.0), (1.0, 1.0)]
    assert len(pts) == len(want)
    for a, b in zip(pts, sorted(want)):
        assert a == pytest.approx(b, abs=1e-9)


def test_calibration_bins(spark):
    ps = [0, .1, .2, .3, 0.30000000000000004, .6, .7, .95, 1]
    df = spark.createDataFrame([(float(p), 0.0) for p in ps], "p double, y double")
    bins = me.calibration(df)
    got = {r.bin: r.n for r in bins.collect()}
    assert got == {0: 2, 1: 1, 2: 2, 5: 1, 6: 1, 9: 2}


def test_clamp_sigmoid_nan(spark):
    df = spark.createDataFrame([(-20.0,), (0.0,), (20.0,), (float("nan"),)], "z double")
    got = [r.p for r in df.select(clamped_probability("z").alias("p")).collect()]
    assert got[0] == pytest.approx(4.5397868702434395e-05, rel=1e-12)
    assert got[1] == 0.5 and got[3] == 0.5
    assert got[2] == pytest.approx(0.9999546021312976, rel=1e-12)


def test_gated_fusion(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "c array<double>, n array<double>")
    g = gate("c", "n", [.1, .2, .3, .4], .05)
    r = df.select(g.alias("g"), weighted_sum("c", "n", g).alias("f")).first()
    assert r.g == pytest.approx(0.969231140642852, abs=1e-12)
    assert r.f == pytest.approx([2.9384622812857044, 4.907693421928556], abs=1e-12)


def test_layer_norm(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    out = df.select(layer_norm("v").alias("o")).first().o
    mean, var = 2.5, 1.25
    assert out == pytest.approx([(x - mean) / math.sqrt(var + 1e-5) for x in [1, 2, 3, 4]], abs=1e-12)


def test_log_loss(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, -1.0), (1.0, -3.0)], "y double, z double")
    expected = sum(math.log1p(math.exp(-z)) if y == 1 else math.log1p(math.exp(z)) for y, z in
                   [(1, 2.0), (0, -1.0), (1, -3.0)]) / 3
    assert me.log_loss(df).first().log_loss == pytest.approx(expected, abs=1e-9)
