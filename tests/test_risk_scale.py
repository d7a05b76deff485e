"""What the risk fit sends to its tasks, and how bags are aggregated."""

import re

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel

from carepath.operators import risk as rk


def test_fit_rows_carry_no_vocabulary(spark, monkeypatch):
    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, params=None: seen.append(df) or fit(self, df))
    monkeypatch.setattr(CountVectorizerModel, "_new_java_array", None)  # a call to the JVM for each term
    codes = [["b", "a"], ["b"], ["é", "\n"], [], ["a", None]]
    rows = [(i, "train", codes[i % 5], i % 2) for i in range(40)]
    bags = spark.createDataFrame(rows, "hadm_id long, split string, codes array<string>, label int")
    notes = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)], "hadm_id long, vec array<float>")
    for v in (None, notes):
        model = rk.fit_risk(bags, v)
        assert model.vocabulary == ("a", "b", "\n", "é")
        assert rk.fit_check(model, bags, v).first().stationary
        assert "ml_attr" not in seen[-1].schema["features"].metadata
        assert "UDF" not in seen[-1]._jdf.queryExecution().toString()
        places = sorted((r.kind, r.place, r.term) for r in rk.coefficients(model).collect() if r.kind != "intercept")
        terms = [("code", None, t) for t in ("\n", "a", "b", "é")]
        assert places == terms + ([("note", i, None) for i in (0, 1)] if v is not None else [])
    assert rk.fit_risk(bags, k=2).vocabulary == ("a", "b")
    with pytest.raises(ValueError):
        rk.fit_risk(bags.where("size(codes) = 0"))


def test_bags_hold_no_distinct_rows_in_hash_tables(spark):
    rows = [(1, 1, "b"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (2, 1, None), (3, 1, "c"), (None, 1, "d")]
    diagnoses = spark.createDataFrame(rows, "hadm_id long, seq_num int, icd_code string")
    cohort = spark.createDataFrame([(1, "train"), (2, "test"), (4, "test")], "hadm_id long, split string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "hadm_id long, label int")
    bags = rk.bag_of_codes(diagnoses, cohort, labels)
    got = sorted((r.hadm_id, r.split, r.codes, r.label) for r in bags.collect())
    assert got == [(1, "train", ["a", "b"], 1), (2, "test", [], 0)]
    plan = bags._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*code#", plan)
