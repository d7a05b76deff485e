"""The risk fit with more features than Spark ML's optimizer should hold on the driver."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from carepath.operators import logistic
from carepath.operators import risk as rk


def _rows(spark, n=400, size=4):
    rng = random.Random(7)
    codes = [f"c{i}" for i in range(80)]
    rows = []
    for i in range(n):
        own = sorted({"all", *rng.choices(codes, [1 / (j + 1) for j in range(80)], k=rng.randint(0, 5))})
        vec = [rng.gauss(0, 1), rng.gauss(3, 0.1), 2.0, rng.gauss(0, 1) * (rng.random() < 0.5)][:size]
        rows.append((i, "train" if i % 5 else "test", own, int(rng.random() < 0.3 + 0.3 * ("c1" in own)), vec))
    df = spark.createDataFrame(rows, "hadm_id long, split string, codes array<string>, label int, vec array<float>")
    return df.drop("vec"), df.select("hadm_id", "vec").where("hadm_id % 9 != 0")


def test_fit_and_scores_hold_no_terms_on_the_driver(spark, monkeypatch):
    bags, notes = _rows(spark)
    for kind in (CountVectorizerModel, VectorAssembler):  # both describe every single feature in the column's metadata
        monkeypatch.setattr(kind, "_transform", None)
    monkeypatch.setattr(CountVectorizerModel, "_create_from_java_class", None)
    for v in (None, notes):
        model = rk.fit_risk(bags, v)
        scores = rk.score_risk(model, bags, v)
        assert scores.count() == bags.where("split = 'test'").join(notes if v is not None else bags, "hadm_id").count()
        assert rk.fit_check(model, bags, v).first().stationary
        assert "ml_attr" not in scores._jdf.queryExecution().analyzed().schema().json()


def test_wide_fit_takes_the_steps_of_spark_ml(spark, monkeypatch):
    bags, notes = _rows(spark)
    plain, steps, minimize, inner = [], [], logistic.minimize, LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: plain.append(inner(self, df)) or plain[-1])
    monkeypatch.setattr(logistic, "minimize", lambda *a: steps.append(minimize(*a)) or steps[-1])
    monkeypatch.setattr(logistic, "SLICE", 16)
    monkeypatch.setattr(logistic, "PACKED_CELLS", 50)
    for v in (None, notes):
        found = []
        for held in (1 << 19, 0):
            monkeypatch.setattr(logistic, "HELD_FEATURES", held)
            model = rk.fit_risk(bags, v)
            lr = model.regression
            scores = {r.hadm_id: r.p for r in rk.score_risk(model, bags, v, split=None).collect()}
            found.append((np.append(lr.coefficients.toArray(), lr.intercept), scores))
        assert found[1][0] == pytest.approx(found[0][0], abs=1e-8)
        assert found[1][1] == pytest.approx(found[0][1], abs=1e-8)
        assert steps[-1][1] == pytest.approx(plain[-1].summary.objectiveHistory, abs=1e-9)
        assert found[1][0][model.vocabulary.index("all")] == 0  # the same in every row
    assert len(plain) == len(steps) == 2


def test_wide_fit_refuses_and_yields_as_spark_ml_does(spark, monkeypatch):
    bags, notes = _rows(spark, 60)
    monkeypatch.setattr(logistic, "HELD_FEATURES", 0)
    one = rk.fit_risk(bags.withColumn("label", bags.label * 0 + 1))
    assert one.regression.intercept == float("inf") and not one.regression.coefficients.toArray().any()
    assert {r.y for r in rk.score_risk(one, bags.withColumn("label", bags.label * 0 + 1)).collect()} == {1.0}
    longer = notes.selectExpr("hadm_id", "if(hadm_id = 8, concat(vec, vec), vec) as vec")
    for bad in (longer, notes.selectExpr("hadm_id", "if(hadm_id = 8, array(float('nan'), 0, 0, 0), vec) as vec")):
        with pytest.raises(Exception, match="different sizes|not a number"):
            rk.fit_risk(bags, bad)
    with pytest.raises(Exception, match="null note vector"):
        rk.fit_risk(bags, notes.select("hadm_id", F.when(F.col("hadm_id") != 8, array_to_vector(F.col("vec").cast("array<double>"))).alias("vec")))


def test_history_keeps_the_newest_pairs_and_gives_the_two_loop_direction():
    rng, kept = np.random.default_rng(0), []
    history = logistic._History(5, m=3)
    for _ in range(8):
        step = rng.normal(size=5)
        kept = [(step, 2 * step), *kept][:3]
        history.add(*kept[0])
        gradient = rng.normal(size=5)
        assert history.direction(gradient) == pytest.approx(-gradient / 2)  # the inverse of a Hessian that doubles
    assert isinstance(history.table, np.memmap) and [tuple(history.table[2 * k]) for k in history.used] == [tuple(s) for s, _ in kept]
