"""The whole study as one Spark application: the reference's stage scripts re-expressed as one lazy plan with
Parquet artifacts where a result is reused.

cohort -> (note vectors | vocabulary) -> sequences -> next-code models (codes only / keyed by note cluster)
-> risk models (codes only / with the note vector) -> scores -> metrics -> report (+ comparison).
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.operators import cohort as co
from carepath.operators import forecast as fc
from carepath.operators import metrics as me
from carepath.operators import risk as rk
from carepath.operators.cohort import TEST, TRAIN, UNUSED
from carepath.operators.examples import modality_drop_counts, unique_vectors
from carepath.operators.sequences import build_sequences, next_pairs_lead
from carepath.operators.vectors import assign_clusters, fit_note_clusters, vectorize_notes
from carepath.operators.vocab import build_vocab, encode_codes, with_split
from carepath.plans.fixtures import Inputs
from carepath.plans.report import (
    BASELINE,
    MORTALITY,
    MULTIMODAL,
    UNIMODAL,
    compare_models,
    forecasting_rows,
    report_row,
    write_report_csv,
)
from carepath.session import materialize
from carepath.sources.clinical import write_artifact


@dataclass(frozen=True)
class StudyConfig:
    train_frac: float | None = 0.8
    train_size: int | None = None  # the reference uses 50,000 / 5,000
    test_size: int | None = None
    k: int = 10
    note_clusters: int = 10
    seed: int = 42
    max_features: int | None = None  # None: the whole train vocabulary


@dataclass(frozen=True)
class StudyResult:
    cohort: DataFrame
    report: DataFrame
    comparison: DataFrame
    drop_counts: DataFrame


def run_study(
    spark: SparkSession,
    inp: Inputs,
    out_dir: str,
    note_vectors: DataFrame | None = None,
    notes: DataFrame | None = None,
    clusters: DataFrame | None = None,
    config: StudyConfig = StudyConfig(),
) -> StudyResult:
    """Run every stage; artifacts go to ``out_dir`` (a shared folder on a cluster).

    Note vectors come from ``note_vectors`` (hadm_id, vec) or are computed from ``notes`` (hadm_id, text); note
    clusters are fitted on train vectors unless ``clusters`` (hadm_id, cluster) is given. The report has a row per
    task and model, and the baseline: bag of codes over all cohort admissions, with or without a note vector.
    """
    ids = co.intersect_ids(inp.admissions.select("hadm_id"), inp.note_ids)
    cohort = co.split_by_position(ids, config.train_frac, config.train_size, config.test_size)
    write_artifact(cohort, os.path.join(out_dir, "cohort"), ["split"])
    used = cohort.where(F.col("split") != UNUSED)

    if note_vectors is None:
        if notes is None:
            raise ValueError("give note_vectors or notes")
        note_vectors = vectorize_notes(
            notes.join(used.select("hadm_id"), "hadm_id", "left_semi"), fit_ids=used.where(F.col("split") == TRAIN)
        )
    vecs = unique_vectors(note_vectors).join(used.select("hadm_id", "split"), "hadm_id")
    write_artifact(vecs, os.path.join(out_dir, "note_vectors"), ["split"])
    vecs = spark.read.parquet(os.path.join(out_dir, "note_vectors")).select("hadm_id", "vec")

    joined = with_split(inp.diagnoses, used)
    vocab = build_vocab(joined)
    write_artifact(vocab.with_unknown(), os.path.join(out_dir, "vocab"))
    encoded = encode_codes(joined, vocab)
    write_artifact(build_sequences(encoded), os.path.join(out_dir, "sequences"), ["split"])
    sequences = spark.read.parquet(os.path.join(out_dir, "sequences"))
    # All codes, one-code admissions included. Both mortality models see the admissions with a vector, as in the
    # reference's report; the baseline sees all.
    all_bags = materialize(rk.bag_of_codes(joined, None, inp.labels))
    bags = materialize(all_bags.join(vecs.select("hadm_id"), "hadm_id", "left_semi"))
    drops = modality_drop_counts(sequences, vecs, inp.labels)

    # Forecasting: codes only, and keyed by the note cluster. As in the reference's data loader, both models see only
    # sequences that have a note vector (inner join).
    if clusters is None:
        km = fit_note_clusters(vecs, used.where(F.col("split") == TRAIN), config.note_clusters, config.seed)
        clusters = assign_clusters(km, vecs)
    counts = fc.pair_counts(next_pairs_lead(encoded).join(clusters, "hadm_id"), ("cluster",))

    def store(name: str, model: fc.NextCodeModel) -> None:
        fc.save_next_code(model, os.path.join(out_dir, "models", f"next_code_{name.lower()}"))

    rows = [forecasting_rows(counts, config.k, store)]

    # Mortality: class-weighted logistic regression with and without the note vector, and the baseline.
    for name, own, v in ((MULTIMODAL, bags, vecs), (UNIMODAL, bags, None), (BASELINE, all_bags, None)):
        model = rk.fit_risk(own, v, k=config.max_features)
        rk.save_risk(model, os.path.join(out_dir, "models", f"risk_{name.lower()}"))
        scores = materialize(rk.score_risk(model, own, v, split=TEST))
        write_artifact(scores, os.path.join(out_dir, f"scores_{name.lower()}"))
        rows.append(report_row(me.ranking_summary(scores), MORTALITY, name, "roc_auc", "average_precision", None))

    report = materialize(reduce(DataFrame.unionByName, rows))
    write_report_csv(report, os.path.join(out_dir, "final_metrics"))
    return StudyResult(cohort, report, compare_models(report, third=BASELINE), drops)


def main(argv: list[str] | None = None) -> None:
    """Command line: the whole study from the raw extracts.

    python -m carepath.plans.workflow --admissions A.csv.gz --notes N.csv.gz --diagnoses D.csv.gz --out DIR
        [--train-size 50000 --test-size 5000 | --train-frac 0.8] [--vectors VEC.parquet]
    """
    import argparse

    from carepath.plans.fixtures import clinical_inputs

    ap = argparse.ArgumentParser(prog="carepath.plans.workflow")
    ap.add_argument("--admissions", required=True)
    ap.add_argument("--notes", required=True)
    ap.add_argument("--diagnoses", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--vectors", help="Parquet (hadm_id, vec); default: TF-IDF of the note text")
    ap.add_argument("--train-size", type=int)
    ap.add_argument("--test-size", type=int)
    ap.add_argument("--train-frac", type=float, default=0.8)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("carepath-study").getOrCreate()
    inp = clinical_inputs(spark, args.admissions, args.notes, args.diagnoses, landed_dir=f"{args.out}/landed")
    cfg = StudyConfig(
        train_frac=None if args.train_size else args.train_frac, train_size=args.train_size, test_size=args.test_size
    )
    vectors = spark.read.parquet(args.vectors) if args.vectors else None
    notes = None if vectors is not None else inp.notes
    result = run_study(spark, inp, args.out, note_vectors=vectors, notes=notes, config=cfg)
    result.report.show(truncate=False)
    result.comparison.orderBy("task", "metric").show(truncate=False)


if __name__ == "__main__":
    main()
