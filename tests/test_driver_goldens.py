"""Golden numbers on the driver tables (computed independently with DuckDB) and plan invariants."""

import pytest
from pyspark.sql import functions as F

from carepath.plans.queries import QUERIES
from tests.conftest import SF_MID, SF_SMALL


def test_flagship_sf0001(spark):
    r = QUERIES["forecast_topk_accuracy"](spark, SF_SMALL).first()
    assert r.n_tokens == 888
    assert (r.top1_pct, r.top5_pct, r.top10_pct) == (5.968468, 23.423423, 47.072072)


def test_cross_entropy_sf0001(spark):
    assert QUERIES["forecast_cross_entropy"](spark, SF_SMALL).first().cross_entropy == pytest.approx(3.215223944, abs=1e-9)


def test_with_notes_sf0001(spark):
    r = QUERIES["forecast_topk_accuracy_notes"](spark, SF_SMALL).first()
    assert r.n_tokens == 296
    assert (r.top1_pct, r.top5_pct, r.top10_pct) == (3.716216, 25.337838, 46.959459)


def test_score_metrics_sf0001(spark):
    assert QUERIES["roc_auc"](spark, SF_SMALL).first().roc_auc == pytest.approx(0.489832536, abs=1e-9)
    assert QUERIES["average_precision"](spark, SF_SMALL).first().average_precision == pytest.approx(0.14010821, abs=1e-9)
    assert QUERIES["log_loss"](spark, SF_SMALL).first().log_loss == pytest.approx(2.941069907, abs=1e-9)


def test_calibration_sf001(spark):
    got = {r.bin: (r.n, r.mean_p, r.frac_pos) for r in QUERIES["calibration"](spark, SF_MID).collect()}
    assert got == {0: (132, 0.009739, 0.106061), 1: (9, 0.163289, 0.111111), 2: (10, 0.253939, 0.0),
                   3: (10, 0.340407, 0.2), 4: (15, 0.471217, 0.133333), 5: (8, 0.544921, 0.25), 6: (10, 0.652691, 0.2),
                   7: (11, 0.754064, 0.090909), 8: (14, 0.836802, 0.142857), 9: (180, 0.992763, 0.138889)}


def test_counts_sf0001(spark):
    stats = {r.split: (r.n, r.n_pos) for r in QUERIES["cohort_stats"](spark, SF_SMALL).collect()}
    assert stats["train"][0] == 1178 and stats["test"][0] == 295
    checks = {r.check_name: r.n for r in QUERIES["split_check"](spark, SF_SMALL).collect()}
    assert checks == {"shared_admissions": 0, "shared_subjects": 124}
    w = {r.label: r.weight for r in QUERIES["class_weights"](spark, SF_SMALL).collect()}
    assert w[0] == pytest.approx(0.742749, abs=1e-6) and w[1] == pytest.approx(1.529870, abs=1e-6)
    top = [(r.code, r.n) for r in QUERIES["top_codes"](spark, SF_SMALL).orderBy("rank").limit(3).collect()]
    assert top == [("Brand#13", 241), ("Brand#22", 210), ("Brand#11", 200)]


def test_f2_counts_sf0001(spark):
    v = QUERIES["vocab_train_only"](spark, SF_SMALL)
    assert v.count() == 191 + 1
    drop = {r.split: (r.kept, r.dropped) for r in QUERIES["modality_drop_counts"](spark, SF_SMALL).collect()}
    assert drop == {"train": (146, 0), "test": (39, 0)}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partition_invariance(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        r = QUERIES["forecast_topk_accuracy"](spark, SF_SMALL).first()
        assert (r.n_tokens, r.top1_pct, r.top5_pct, r.top10_pct) == (888, 5.968468, 23.423423, 47.072072)
        auc = QUERIES["roc_auc"](spark, SF_SMALL).first().roc_auc
        assert auc == pytest.approx(0.489832536, abs=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sequence_invariants(spark):
    from carepath.plans.fixtures import prepare

    p = prepare(spark, SF_SMALL, "F2")
    s = p.sequences
    assert s.where(F.size("input_ids") != F.size("labels")).count() == 0
    # labels are inputs shifted by one
    bad = s.where(F.slice("input_ids", 2, 1_000_000) != F.slice("labels", 1, F.size("labels") - 1))
    assert bad.count() == 0
    ids = s.select(F.explode("input_ids").alias("i"))
    assert ids.where((F.col("i") < 1) | (F.col("i") > p.vocab.unk_id)).count() == 0
    # the train split never sees the unknown id
    train_ids = s.where("split = 'train'").select(F.explode("labels").alias("i"))
    assert train_ids.where(F.col("i") == p.vocab.unk_id).count() == 0
    acc = QUERIES["forecast_topk_accuracy"](spark, SF_SMALL).first()
    assert acc.top1_pct <= acc.top5_pct <= acc.top10_pct
