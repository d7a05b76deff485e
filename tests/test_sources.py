"""CSV landing (string codes, multi-line quoted notes) and training-log parsing."""

import os
import tempfile

from carepath.plans.report import parse_training_logs
from carepath.sources.clinical import read_diagnoses, read_notes


def _tmp():
    return tempfile.mkdtemp(prefix="carepath-test-")


def test_notes_multiline_and_string_codes(spark):
    d = _tmp()
    path = os.path.join(d, "notes.csv")
    with open(path, "w") as f:
        f.write('subject_id,hadm_id,text,code\n1,11,"line1\nsaid ""hi"", ok",0389\n2,12,"b",25000\n')
    notes = read_notes(spark, path)
    rows = sorted(notes.collect(), key=lambda r: r.hadm_id)
    assert len(rows) == 2
    assert rows[0].text == 'line1\nsaid "hi", ok'
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert sorted(r.code for r in raw.collect()) == ["0389", "25000"]


def test_diagnoses_keep_leading_zeros(spark):
    d = _tmp()
    path = os.path.join(d, "diag.csv")
    with open(path, "w") as f:
        f.write("subject_id,hadm_id,seq_num,icd_code,icd_version\n1,5,1,0389,9\n1,5,2,V1582,9\n")
    rows = read_diagnoses(spark, path).orderBy("seq_num").collect()
    assert [r.icd_code for r in rows] == ["0389", "V1582"]
    assert rows[0].hadm_id == 5 and rows[0].seq_num == 1


def test_training_log_curves(spark):
    """Lines of the fixed form with invented runs; a line without epoch and loss is skipped."""
    d = _tmp()
    first, second = os.path.join(d, "codes.txt"), os.path.join(d, "risk.txt")
    with open(first, "w") as f:
        f.write("loading 12 shards\nEpoch 1 Average Loss: 3.5\nEpoch 2 Average Loss: 2.25\n")
    with open(second, "w") as f:
        f.write("Epoch 1 | Avg Loss: 0.5 | Train AUC: 0.75\n")
    got = {(r.run, r.epoch): (r.loss, r.auc, r.loss_change) for r in parse_training_logs(spark, [first, second]).collect()}
    assert got == {("codes", 1): (3.5, None, None), ("codes", 2): (2.25, None, -1.25), ("risk", 1): (0.5, 0.75, None)}


def test_unreadable_values_are_counted_per_file(spark):
    from carepath.schemas import DIAGNOSES
    from carepath.sources.clinical import count_rejects

    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("subject_id,hadm_id,seq_num,icd_code\n1,x5,1,0389\n1,6,,V1\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("subject_id,hadm_id,seq_num,icd_code\n1,7,one,0389\n")
    got = {(os.path.basename(r.file), r.column): (r.rows, r.rejected) for r in count_rejects(spark, d, DIAGNOSES).collect()}
    assert got == {
        ("a.csv", "hadm_id"): (2, 1), ("a.csv", "seq_num"): (2, 0), ("b.csv", "hadm_id"): (1, 0), ("b.csv", "seq_num"): (1, 1),
    }


def test_results_file_round_trip(spark):
    from carepath.plans.report import read_report_csv, write_report_csv

    kind = "task string, model string, metric_1 double, metric_2 double, metric_3 double"
    rows = [("Forecasting", "Unimodal", 1.5, 2.0, 3.0), ("Mortality", "Baseline", 0.5, 0.25, 0.0)]
    path = os.path.join(_tmp(), "metrics")
    write_report_csv(spark.createDataFrame(rows, kind), path)
    assert sorted(map(tuple, read_report_csv(spark, path).collect())) == rows
