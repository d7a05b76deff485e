"""Named stand-in inputs over the driver tables (F1, F1b, F2, F3, F4, SCORE) and the shared preparation plan.

| Fixture | note-side ids       | code                  |
| F1      | embeddings.vec_id   | part key as text      |
| F1b     | embeddings.vec_id   | part brand            |
| F2      | documents.doc_id    | part key as text      |
| F3      | lineitem.l_orderkey | part brand            |
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.operators.cohort import intersect_ids, split_by_position
from carepath.operators.sequences import build_sequences, next_pairs_lead
from carepath.operators.vocab import Vocabulary, build_vocab, encode_codes, with_split
from carepath.session import materialize
from carepath.sources import tables

FIXTURES = {
    "F1": ("embeddings", "partkey"),
    "F1b": ("embeddings", "brand"),
    "F2": ("documents", "partkey"),
    "F3": ("lineitem", "brand"),
}


@dataclass(frozen=True)
class Inputs:
    admissions: DataFrame  # subject_id, hadm_id, hospital_expire_flag
    labels: DataFrame  # hadm_id, label
    note_ids: DataFrame  # hadm_id
    diagnoses: DataFrame  # hadm_id, seq_num, icd_code
    notes: DataFrame | None = None  # hadm_id, text


def inputs(spark: SparkSession, sf_dir: str, fixture: str) -> Inputs:
    note_source, code = FIXTURES[fixture]
    return Inputs(
        admissions=tables.admissions(spark, sf_dir),
        labels=tables.mortality_labels(spark, sf_dir),
        note_ids=tables.note_ids(spark, sf_dir, note_source),
        diagnoses=tables.diagnoses(spark, sf_dir, code),
    )


def clinical_inputs(
    spark: SparkSession, admissions_path: str, notes_path: str, diagnoses_path: str, landed_dir: str | None = None
) -> Inputs:
    """Inputs from the raw clinical extracts (CSV, possibly gzip). With ``landed_dir`` each table is parsed once and
    landed as Parquet (gzip CSV is unsplittable); the notes land with their text, and the note ids are a column of
    that table (the scan reads no text for them)."""
    from carepath.sources import clinical

    adm = clinical.read_admissions(spark, admissions_path)
    notes = clinical.read_notes(spark, notes_path).select("hadm_id", "text")
    diag = clinical.read_diagnoses(spark, diagnoses_path)
    if landed_dir:
        for name, df in (("admissions", adm), ("notes", notes), ("diagnoses", diag)):
            clinical.land_parquet(df, f"{landed_dir}/{name}")
        adm = spark.read.parquet(f"{landed_dir}/admissions")
        notes = spark.read.parquet(f"{landed_dir}/notes")
        diag = spark.read.parquet(f"{landed_dir}/diagnoses")
    labels = adm.select("hadm_id", F.col("hospital_expire_flag").alias("label"))
    return Inputs(adm, labels, notes.select("hadm_id"), diag, notes)


def build_cohort(inp: Inputs, train_frac: float = 0.8) -> DataFrame:
    """Ids in both admissions and notes, split by position. The positions are checkpointed inside
    ``split_by_position``; what remains on top is a cheap projection."""
    ids = intersect_ids(inp.admissions.select("hadm_id"), inp.note_ids)
    return split_by_position(ids, train_frac=train_frac)


class Prepared:
    """The shared preparation plan. The cohort and vocabulary are built on creation; the pairs and the sequences are
    built on first use, so a query that needs only the cohort or the vocabulary runs neither."""

    def __init__(self, inputs: Inputs, cohort: DataFrame, vocab: Vocabulary, encoded: DataFrame):
        self.inputs = inputs
        self.cohort = cohort
        self.vocab = vocab
        self.encoded = encoded  # hadm_id, seq_num, icd_code, split, code_id (cohort admissions)

    @cached_property
    def sequences(self) -> DataFrame:
        """hadm_id, split, input_ids, labels: arrays, for the outputs that are arrays."""
        return materialize(build_sequences(self.encoded, self.cohort))

    @cached_property
    def pairs(self) -> DataFrame:
        """hadm_id, split, pos, prev, next in row form: no task holds an admission."""
        return next_pairs_lead(self.encoded, self.cohort)

    @cached_property
    def sequence_ids(self) -> DataFrame:
        """(hadm_id, split) of the admissions that have a sequence: those with a pair."""
        return self.pairs.select("hadm_id", "split").distinct()


def prepare(spark: SparkSession, sf_dir: str, fixture: str, train_frac: float = 0.8) -> Prepared:
    """cohort -> train vocabulary -> encoded codes -> (on use) ordered sequences (>= 2 codes) -> next-step pairs."""
    inp = inputs(spark, sf_dir, fixture)
    cohort = build_cohort(inp, train_frac)
    joined = with_split(inp.diagnoses, cohort)
    vocab = build_vocab(joined)
    return Prepared(inp, cohort, vocab, encode_codes(joined, vocab))
