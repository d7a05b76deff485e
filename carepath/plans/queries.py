"""Registered queries: one per operator group of the blueprint, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables whole (no id subsets, no row caps); limits appear only where the
operator is a top-k. Output columns are named exactly as in the matching oracle SQL (``plans/oracle.py``).
Vectors are reported in long form (id, dim, value) so values compare as numbers, not formatted text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.functions.scalar import array_to_string, clamp, clamped_probability, relu, word_tokens
from carepath.functions.vector import vector_cells
from carepath.operators import cohort as co
from carepath.operators import encoders as en
from carepath.operators import forecast as fc
from carepath.operators import heads as hd
from carepath.operators import metrics as me
from carepath.operators import risk as rk
from carepath.operators import sequences as sq
from carepath.operators import vectors as vx
from carepath.operators.examples import assemble_counted, assemble_examples, modality_drop_counts, unique_vectors
from carepath.operators.vocab import decode_codes
from carepath.plans.fixtures import build_cohort, inputs, prepare
from carepath.plans.report import (
    BASELINE,
    MORTALITY,
    MULTIMODAL,
    UNIMODAL,
    compare_models,
    filter_report,
    forecast_report,
    format_cohort_stats,
    parse_training_logs,
    read_report_csv,
    report_row,
    write_report_csv,
    write_training_logs,
)
from carepath.schemas import DIAGNOSES
from carepath.session import checkpoint_dir, counting_session, materialize, remove_folder, shuffle_partitions
from carepath.sources import clinical, tables

# Parameters of the registered queries (fixed here so Spark and the oracle SQL use the same ones).
TOPK = 10
BATCH_SIZE = 16
SHUFFLE_SEED = 7
LAMBDA = 0.7
DF_TOPK = 200
NOTE_MAX_TOKENS = 512
GATE_BIAS = 0.05
DOT_TOPK = 5
PROJ_OUT = 8


def gate_weights(dim: int) -> list[float]:
    """Deterministic gate weights for the fusion query: w_i = ((i mod 7) - 3) / 10, i = 0..dim-1."""
    return [((i % 7) - 3) / 10.0 for i in range(dim)]


def projection_matrix(d_in: int, d_out: int = PROJ_OUT) -> tuple[np.ndarray, np.ndarray]:
    """Deterministic projection for the projection query: W[i, j] = (((7i + 3j) mod 11) - 5) / 10, b_j = j / 10."""
    i = np.arange(d_in)[:, None]
    j = np.arange(d_out)[None, :]
    return (((7 * i + 3 * j) % 11) - 5) / 10.0, np.arange(d_out) / 10.0


# ---------------------------------------------------------------------------------------------- cohort


def q_cohort_intersection(spark: SparkSession, sf: str) -> DataFrame:
    inp = inputs(spark, sf, "F3")
    return co.intersect_ids(inp.admissions.select("hadm_id"), inp.note_ids)


def q_cohort_split(spark: SparkSession, sf: str) -> DataFrame:
    return build_cohort(inputs(spark, sf, "F3"))


# Sizes of the fixed split in the query: small enough that every scale has train, test and unused ids.
FIXED_TRAIN_SIZE, FIXED_TEST_SIZE = 1_000, 100


def q_cohort_split_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed-size split: the first N sorted ids train, the next M test, all others unused."""
    inp = inputs(spark, sf, "F3")
    ids = co.intersect_ids(inp.admissions.select("hadm_id"), inp.note_ids)
    return co.split_by_position(ids, train_size=FIXED_TRAIN_SIZE, test_size=FIXED_TEST_SIZE)


def q_split_check(spark: SparkSession, sf: str) -> DataFrame:
    inp = inputs(spark, sf, "F3")
    return co.split_check(build_cohort(inp), inp.admissions)


def q_cohort_stats(spark: SparkSession, sf: str) -> DataFrame:
    inp = inputs(spark, sf, "F3")
    return co.cohort_stats(build_cohort(inp), inp.labels)


def q_note_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """F3 cohort against its note rows (one per line item): missing notes and rows that would multiply."""
    inp = inputs(spark, sf, "F3")
    return co.note_coverage(build_cohort(inp), inp.note_ids)


def q_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    inp = inputs(spark, sf, "F3")
    return co.class_weights(build_cohort(inp), inp.labels).withColumn("weight", F.round("weight", 9))


# ------------------------------------------------------------------------------------ vocab, sequences


def q_vocab_train_only(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark, sf, "F2").vocab.with_unknown()


def q_encode_with_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark, sf, "F2").encoded.select("hadm_id", "split", "seq_num", "icd_code", "code_id")


def q_ordered_sequences(spark: SparkSession, sf: str) -> DataFrame:
    s = prepare(spark, sf, "F2").sequences
    return s.select(
        "hadm_id",
        "split",
        array_to_string("input_ids").alias("input_ids"),
        array_to_string("labels").alias("labels"),
        F.size("input_ids").cast("long").alias("n_inputs"),
    )


def q_next_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The array form: sequences, then positions of the arrays."""
    return sq.next_pairs(prepare(spark, sf, "F3").sequences)


def q_next_pairs_lead(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark, sf, "F3").pairs


def q_last_value_per_key(spark: SparkSession, sf: str) -> DataFrame:
    ev = tables.read_table(spark, sf, "events")
    latest = ev.groupBy("user_id").agg(
        F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("_last")
    )
    return latest.select("user_id", "_last.event_id", "_last.event_type", "_last.value")


def q_pad_batches(spark: SparkSession, sf: str) -> DataFrame:
    b = sq.pad_batches(prepare(spark, sf, "F2").sequences, batch_size=BATCH_SIZE)
    return b.select(
        "hadm_id",
        "split",
        "batch_id",
        "pos_in_batch",
        array_to_string("input_ids").alias("input_ids"),
        array_to_string("labels").alias("labels"),
    )


def q_shuffled_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The seeded order itself: every sequence's batch and place in it."""
    b = sq.pad_batches(prepare(spark, sf, "F2").sequences, batch_size=BATCH_SIZE, seed=SHUFFLE_SEED)
    return b.select("hadm_id", "split", "batch_id", "pos_in_batch")


def q_unpad_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Padded batches (hash-shuffled order) masked back to prediction steps: equal to the unpadded pairs."""
    b = sq.pad_batches(prepare(spark, sf, "F2").sequences, batch_size=BATCH_SIZE, seed=SHUFFLE_SEED)
    return sq.unpad_batches(b)


def q_top_codes(spark: SparkSession, sf: str) -> DataFrame:
    p = prepare(spark, sf, "F3")
    top = sq.top_codes(p.pairs, k=TOPK)
    return decode_codes(top, p.vocab).select("rank", "code", "code_id", "n")


def _event_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """per user, the input length of the ordered event sequence (events - 1), users with >= 2 events."""
    ev = tables.event_codes(spark, sf)
    per_user = ev.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.where(F.col("n") >= 2).select((F.col("n") - 1).cast("long").alias("length"))


def q_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = sq.length_histogram(_event_lengths(spark, sf), "length", bins=50)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


def q_length_density(spark: SparkSession, sf: str) -> DataFrame:
    d = sq.length_density(_event_lengths(spark, sf), "length", grid_points=200, bins=50)
    return d.select("point", F.round("x", 6).alias("x"), F.round("density_count", 6).alias("density_count"))


# ------------------------------------------------------------------------------------------- examples


def q_examples_joined(spark: SparkSession, sf: str) -> DataFrame:
    p = prepare(spark, sf, "F2")
    ex = assemble_examples(p.sequences, tables.note_vectors(spark, sf), p.inputs.labels)
    return ex.select(
        "hadm_id",
        "split",
        F.size("input_ids").cast("long").alias("n_inputs"),
        "label",
        F.size("vec").cast("long").alias("vec_dim"),
        F.round(F.col("vec")[0].cast("double"), 6).alias("vec_first"),
    )


def q_one_vector_per_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item is a note of its order, its numbers the note's vector: one vector per order, the last line's."""
    notes = tables.read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("hadm_id"),
        F.col("l_linenumber").cast("long").alias("seq"),
        F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("vec"),
    )
    one = unique_vectors(notes, "seq")
    return one.select("hadm_id", *(F.round(F.col("vec")[i].cast("double"), 4).alias(f"v{i}") for i in (0, 1)))


def q_modality_drop_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = prepare(spark, sf, "F2")
    return modality_drop_counts(p.sequence_ids, tables.note_vectors(spark, sf), p.inputs.labels)


# ------------------------------------------------------------------------------------------- forecast


def _fitted(spark: SparkSession, sf: str, fixture: str, with_notes: bool):
    """(model, train counts, test counts)."""
    p = prepare(spark, sf, fixture)
    ctx = ("cluster",) if with_notes else ()
    pairs = p.pairs.join(tables.note_clusters(spark, sf), "hadm_id") if with_notes else p.pairs
    counts = fc.pair_counts(pairs, ctx)
    train, test = (counts.where(F.col("split") == s) for s in (co.TRAIN, co.TEST))
    return fc.fit_next_code(train, TOPK, ctx), train, test


def q_next_code_model(spark: SparkSession, sf: str) -> DataFrame:
    model, train, test = _fitted(spark, sf, "F3", False)
    return fc.rank_candidates(model, train.select("prev").unionByName(test.select("prev")))


def q_forecast_topk_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    model, _, test = _fitted(spark, sf, "F3", False)
    return fc.evaluate_topk(model, test)


def q_forecast_topk_accuracy_notes(spark: SparkSession, sf: str) -> DataFrame:
    model, _, test = _fitted(spark, sf, "F1b", True)
    return fc.evaluate_topk(model, test)


def q_forecast_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    p = prepare(spark, sf, "F3")
    counts = fc.pair_counts(p.pairs)
    train, test = (counts.where(F.col("split") == s) for s in (co.TRAIN, co.TEST))
    return fc.cross_entropy(train, test, p.vocab.size, LAMBDA)


def q_report_forecasting(spark: SparkSession, sf: str) -> DataFrame:
    """The forecasting rows of the final report, by the study's own function on the study's fixture."""
    return forecast_report(spark, sf, "F1", TOPK, how="inner")


def q_final_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole study on F1 (vectors for every admission): the four-row task/model report."""
    from carepath.plans.workflow import run_study

    out = _study_folder(spark, "study")
    try:
        result = run_study(
            spark,
            inputs(spark, sf, "F1"),
            out,
            note_vectors=tables.note_vectors(spark, sf),
            clusters=tables.note_clusters(spark, sf),
        )
        return result.report  # a checkpoint: it outlives the study's folder
    finally:
        remove_folder(spark, out)


def q_compare_models(spark: SparkSession, sf: str) -> DataFrame:
    return compare_models(forecast_report(spark, sf, "F1b", TOPK))


# ----------------------------------------------------------------------------------------------- risk


def q_bag_of_codes_topk_vocab(spark: SparkSession, sf: str) -> DataFrame:
    inp = inputs(spark, sf, "F2")
    return rk.doc_freq_vocab(rk.code_rows(inp.diagnoses, build_cohort(inp)), DF_TOPK)


def q_risk_features(spark: SparkSession, sf: str) -> DataFrame:
    """The training matrix of the codes-only risk model in long form, with class weights."""
    inp = inputs(spark, sf, "F1")
    f = rk.risk_features(rk.code_rows(inp.diagnoses, build_cohort(inp)), inp.labels)
    return f.select("hadm_id", "term", F.col("y").cast("long").alias("y"), F.round("weight", 9).alias("weight"))


def q_risk_fit_check(spark: SparkSession, sf: str) -> DataFrame:
    """Size and weights of the risk fit, and whether its coefficients are stationary."""
    inp = inputs(spark, sf, "F1")
    bags = materialize(rk.bag_of_codes(inp.diagnoses, build_cohort(inp), inp.labels))
    return rk.fit_check(rk.fit_risk(bags), bags)


def _risk(spark: SparkSession, sf: str, with_notes: bool) -> DataFrame:
    inp = inputs(spark, sf, "F1")
    # The bags feed the vocabulary, weight, fit and scoring jobs: checkpoint them once.
    bags = materialize(rk.bag_of_codes(inp.diagnoses, build_cohort(inp), inp.labels))
    vecs = tables.note_vectors(spark, sf) if with_notes else None
    model = rk.fit_risk(bags, vecs)
    return rk.score_risk(model, bags, vecs).select("hadm_id", "y", F.round("p", 9).alias("p"))


def q_risk_codes_only(spark: SparkSession, sf: str) -> DataFrame:
    return _risk(spark, sf, False)


def q_risk_with_notes(spark: SparkSession, sf: str) -> DataFrame:
    return _risk(spark, sf, True)


# -------------------------------------------------------------------------------------------- metrics


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """SCORE fixture: z clamped to [-10, 10], p = sigmoid(z) with the NaN guard."""
    s = tables.score_fixture(spark, sf)
    return s.select("hadm_id", "y", clamp("z").alias("z"), clamped_probability("z").alias("p"))


def q_clamped_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.score_fixture(spark, sf)
    number = lambda c: F.when(~F.isnan(c), c)  # noqa: E731  NaN is reported as null
    return s.select(
        "hadm_id",
        "y",
        number(F.col("z")).alias("z_raw"),
        number(clamp("z")).alias("z"),
        F.round(clamped_probability("z"), 9).alias("p"),
    )


def q_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return me.roc_auc(_scores(spark, sf))


def q_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return me.average_precision(_scores(spark, sf))


def q_roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return me.roc_points(_scores(spark, sf)).withColumn("threshold", F.round("threshold", 9))


def q_roc_area(spark: SparkSession, sf: str) -> DataFrame:
    return me.roc_area(_scores(spark, sf))


def q_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return me.calibration(_scores(spark, sf))


def q_ranking_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Per-group ROC-AUC / average precision (the per-epoch train AUC pattern), grouped by document language."""
    lang = tables.read_table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("hadm_id"), "lang")
    return me.ranking_by_group(_scores(spark, sf).join(lang, "hadm_id"), ("lang",))


def q_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Loss on the clamped logits; a NaN logit counts as 0 (probability 0.5)."""
    return me.log_loss(_scores(spark, sf).withColumn("z", F.nanvl("z", F.lit(0.0))), "y", "z")


# ------------------------------------------------------------------------------------- notes, vectors


def q_note_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-text token counts and where a 512-token encoder window would cut (no text is dropped here)."""
    n = tables.notes(spark, sf).select("hadm_id", F.size(word_tokens("text")).cast("long").alias("n_tokens"))
    return n.select(
        "hadm_id",
        "n_tokens",
        F.least(F.col("n_tokens"), F.lit(NOTE_MAX_TOKENS)).cast("long").alias("n_kept"),
        (F.col("n_tokens") > F.lit(NOTE_MAX_TOKENS)).alias("truncated"),
    )


def q_vectorize_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Exact-term TF-IDF of the notes: terms, tokens and squared norm per note (idf over all notes)."""
    notes = tables.notes(spark, sf)
    weights = vx.term_weights(materialize(vx.note_terms(notes)), notes)
    return weights.groupBy("hadm_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_terms"),
        F.round(F.sum(F.col("weight") * F.col("weight")), 4).alias("sq_norm"),
    )


def q_note_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse note vectors that the models take: terms and squared norm per note, over the whole vocabulary."""
    vectors = vx.vectorize_notes(tables.notes(spark, sf))
    cells = vector_cells(vectors, "hadm_id").groupBy("hadm_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_terms"), F.round(F.sum(F.col("x") * F.col("x")), 4).alias("sq_norm")
    )
    return cells


def _long_form(df: DataFrame, id_col: str, vec_col: str, out: str = "value") -> DataFrame:
    return df.select(id_col, F.posexplode(vec_col).alias("dim", "_v")).select(
        id_col, F.col("dim").cast("long").alias("dim"), F.round(F.col("_v").cast("double"), 6).alias(out)
    )


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("long").alias("label"),
    )


def q_gated_fusion(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf)
    half = 32
    e = e.select("vec_id", F.slice("vec", 1, half).alias("code"), F.slice("vec", half + 1, half).alias("note"))
    fused = vx.gated_fusion(e, "code", "note", gate_weights(2 * half), GATE_BIAS)
    return fused.select("vec_id", F.round("gate", 9).alias("gate"), F.posexplode("fused").alias("dim", "_v")).select(
        "vec_id", "gate", F.col("dim").cast("long").alias("dim"), F.round("_v", 6).alias("value")
    )


def q_fused_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Per input position of F1b: the code's vector (``embeddings`` row keyed by code id, a stand-in for a
    code-vector table) gated against the admission's note vector repeated over its positions."""
    p = prepare(spark, sf, "F1b")
    emb = _embeddings(spark, sf)
    codes = emb.select(F.col("vec_id").alias("code_id"), "vec")
    notes = emb.select(F.col("vec_id").alias("hadm_id"), "vec")
    positions = p.pairs.select("hadm_id", "pos", F.col("prev").alias("code_id"))
    fused = vx.fuse_sequence_positions(positions, codes, notes, gate_weights(128), GATE_BIAS)
    return fused.select(
        "hadm_id", "pos", "code_id", F.round("gate", 9).alias("gate"), F.posexplode("fused").alias("dim", "_v")
    ).select("hadm_id", "pos", "code_id", "gate", F.col("dim").cast("long").alias("dim"), F.round("_v", 6).alias("value"))


def q_layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    return _long_form(vx.layer_normalize(_embeddings(spark, sf), "vec"), "vec_id", "vec")


def q_max_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _long_form(vx.max_pool(_embeddings(spark, sf), ["label"], "vec"), "label", "pooled")


def q_project_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf)
    w, b = projection_matrix(64)
    return _long_form(vx.project_vectors(e, "vec", w, b), "vec_id", "proj")


def q_topk_by_dot(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector against the code-vector table of F1b's vocabulary (``embeddings`` rows keyed by code id)."""
    e = _embeddings(spark, sf)
    codes = prepare(spark, sf, "F1b").vocab.table.select(F.col("code_id").alias("vec_id"))
    items = e.join(codes, "vec_id", "left_semi")
    r = vx.topk_by_dot(e, items, DOT_TOPK, q_id="vec_id", i_id="vec_id")
    return r.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


def q_note_clusters_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """KMeans over all vectors until its centres rest: every row at its nearest centre, every centre its rows' mean."""
    vectors = tables.note_vectors(spark, sf)
    model = vx.fit_note_clusters(vectors, vectors, k=TOPK, max_iter=300, tol=1e-6)
    found = vx.cluster_evidence(model, vectors)
    return found.select("hadm_id", F.round("off_nearest", 6).alias("off_nearest"), F.round("off_mean", 4).alias("off_mean"))


def _fitted_projection(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors on all principal axes of their covariance."""
    vectors = tables.note_vectors(spark, sf)
    dims = vectors.agg(F.max(F.size("vec"))).first()[0]
    return vx.apply_projection(vx.fit_projection(vectors, vectors, int(dims)), vectors)


def q_projection_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted projection turns vectors without stretching them: squared length and dimensions of each."""
    square = F.aggregate("proj", F.lit(0.0), lambda s, v: s + v * v)
    rows = _fitted_projection(spark, sf)
    return rows.select("hadm_id", F.size("proj").cast("long").alias("dims"), F.round(square, 6).alias("square"))


def q_projection_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Variances of the projected columns: their power sums, no covariance left, in falling order."""
    m = vx.projection_moments(_fitted_projection(spark, sf))
    sums = [F.round(c, 6).alias(c) for c in ("trace", "trace_of_square", "trace_of_cube", "largest_covariance")]
    return m.select("n", "dims", *sums, "descending")


ENCODER_BATCHES = (7, 64)


def q_encode_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Every note through the encoder hook, once for each of two batch sizes: padding never shows in a vector."""
    notes = tables.notes(spark, sf)
    parts = []
    for size in ENCODER_BATCHES:
        v = vx.vectorize_notes_with(notes, en.make_length_encoder, len(en.ENCODING), batch_size=size)
        cells = [F.round(F.col("vec")[i].cast("double"), 4).alias(c) for i, c in enumerate(en.ENCODING)]
        parts.append(v.select("hadm_id", F.lit(size).cast("long").alias("batch_size"), *cells))
    return parts[0].unionByName(parts[1])


def q_two_layer_head(spark: SparkSession, sf: str) -> DataFrame:
    """The two-layer head over fused, normalised and max-pooled admissions of F1b, trained on all of them."""
    p = prepare(spark, sf, "F1b")
    emb = _embeddings(spark, sf)
    positions = p.pairs.select("hadm_id", "pos", F.col("prev").alias("code_id"))
    fused = vx.fuse_sequence_positions(
        positions,
        emb.select(F.col("vec_id").alias("code_id"), "vec"),
        emb.select(F.col("vec_id").alias("hadm_id"), "vec"),
        gate_weights(128),
        GATE_BIAS,
    )
    pooled = vx.max_pool(vx.layer_normalize(fused, "fused"), ["hadm_id"], "fused", "vec")
    rows = materialize(co.attach_labels(pooled, p.inputs.labels).select("hadm_id", "vec", "label"))
    return hd.head_check(hd.fit_head(rows), rows)


def _study_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError(f"{name} writes files under spark.checkpoint.dir; set it to a shared folder")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_stored_risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The with-notes risk model stored, loaded, and all admissions scored: how far each margin is from the one that the
    stored coefficients give by joins, and the probability from the clamped margin's sigmoid."""
    inp = inputs(spark, sf, "F1")
    bags = materialize(rk.bag_of_codes(inp.diagnoses, build_cohort(inp), inp.labels))
    vecs = tables.note_vectors(spark, sf)
    out = _study_folder(spark, "risk")
    try:
        rk.save_risk(rk.fit_risk(bags, vecs), out)
        loaded = rk.load_risk(spark, out)
        scores = rk.score_risk(loaded, bags, vecs, split=None)
        again = rk.stored_margins(spark, out, bags, vecs).withColumnRenamed("margin", "again")
        joined = scores.join(again, "hadm_id")
        expected = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("again")))))
        return materialize(
            joined.select(
                "hadm_id",
                F.col("y").cast("long").alias("y"),
                F.round(F.abs(F.col("margin") - F.col("again")), 6).alias("margin_gap"),
                F.round(F.abs(F.col("p") - expected), 6).alias("p_gap"),
            )
        )
    finally:
        remove_folder(spark, out)


def q_risk_notes_fit_check(spark: SparkSession, sf: str) -> DataFrame:
    """Size and weights of the with-notes risk fit, and whether its coefficients are stationary."""
    inp = inputs(spark, sf, "F1")
    bags = materialize(rk.bag_of_codes(inp.diagnoses, build_cohort(inp), inp.labels))
    vecs = tables.note_vectors(spark, sf)
    return rk.fit_check(rk.fit_risk(bags, vecs), bags, vecs)


def stored_examples(spark: SparkSession, sf: str, out: str) -> tuple[DataFrame, tuple[str, str]]:
    """Examples of F2 from sequences and vectors stored bucketed by admission (the tables' names come back too)."""
    p = prepare(spark, sf, "F2")
    run = uuid.uuid4().hex
    names = (f"sequences_{run}", f"vectors_{run}")
    buckets = shuffle_partitions(spark)
    sequences = clinical.write_bucketed(p.sequences, names[0], f"{out}/sequences", buckets=buckets, partition_by=["split"])
    vectors = clinical.write_bucketed(tables.note_vectors(spark, sf), names[1], f"{out}/vectors", buckets=buckets)
    return sequences.join(unique_vectors(vectors), "hadm_id"), names


def q_stored_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Stored sequences joined with stored vectors, bucket by bucket."""
    out, names = _study_folder(spark, "buckets"), ()
    try:
        joined, names = stored_examples(spark, sf, out)
        return materialize(
            joined.select(
                "hadm_id",
                "split",
                F.size("input_ids").cast("long").alias("n_inputs"),
                F.element_at("labels", -1).alias("last_label"),
                F.round(F.col("vec")[0].cast("double"), 6).alias("vec_first"),
            )
        )
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(spark, out)


def q_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document written as gzip CSV (quoted, over several lines) and read back with the explicit schema."""
    docs = tables.read_table(spark, sf, "documents").select("doc_id", "source", "text")
    out = _study_folder(spark, "csv")
    try:
        clinical.write_csv(docs, out)
        back = clinical.read_csv(spark, out, docs.schema, multiline=True, keep_empty=True)
        return materialize(
            back.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))
        )
    finally:
        remove_folder(spark, out)


# The order lines as a raw extract: the line number of a returned line is no number.
UNREADABLE = "n/a"


def q_observed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that ride on the jobs: rows and unreadable values of a landing, kept and dropped examples."""
    lines = tables.read_table(spark, sf, "lineitem")
    number = F.when(F.col("l_returnflag") == "R", F.lit(UNREADABLE)).otherwise(F.col("l_linenumber").cast("string"))
    raw = lines.select(
        F.col("l_orderkey").alias("hadm_id"), number.alias("seq_num"), F.col("l_partkey").cast("string").alias("icd_code")
    )
    out = _study_folder(spark, "landing")
    try:
        clinical.write_csv(raw, f"{out}/raw")
        landed = clinical.land_counted(spark, f"{out}/raw", DIAGNOSES, f"{out}/diagnoses")
        own = counting_session(spark)
        p = prepare(own, sf, "F2")
        examples, counts = assemble_counted(p.sequences, tables.note_vectors(own, sf), p.inputs.labels)
        clinical.land_parquet(examples, f"{out}/examples")
        row = {**landed, **counts.get}
    finally:
        remove_folder(spark, out)
    names = ("rows", "rejected_hadm_id", "rejected_seq_num", "kept", "dropped", "missing_label")
    return spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} long" for n in names))


def q_tokenized_bags(spark: SparkSession, sf: str) -> DataFrame:
    """Bags as a text vectorizer sees them: lower-case words of two or more word characters of the joined codes."""
    inp = inputs(spark, sf, "F3")
    bags = rk.bag_of_codes(inp.diagnoses, build_cohort(inp), inp.labels, tokenize=True)
    return bags.select("hadm_id", "split", F.array_join("codes", " ").alias("terms"), F.col("label").cast("long").alias("label"))


def q_relu_vectors(spark: SparkSession, sf: str) -> DataFrame:
    cells = _embeddings(spark, sf).select("vec_id", F.posexplode("vec").alias("dim", "x"))
    return cells.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round(relu("x"), 6).alias("value"))


def q_formatted_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The cohort table as it is printed, with the vocabulary size."""
    p = prepare(spark, sf, "F3")
    return format_cohort_stats(co.cohort_stats(p.cohort, p.inputs.labels), p.vocab.size_with_unknown)


# Languages whose ranking metrics stand in for the three models' rows.
REPORT_LANGUAGES = (("en", UNIMODAL), ("de", MULTIMODAL), ("fr", BASELINE))


def q_results_file(spark: SparkSession, sf: str) -> DataFrame:
    """The results file: a report assembled row by row, written with its header, read back, filtered by task and model."""
    lang = tables.read_table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("hadm_id"), "lang")
    by_lang = materialize(me.ranking_by_group(_scores(spark, sf).join(lang, "hadm_id"), ("lang",)))
    rows = [
        report_row(by_lang.where(F.col("lang") == code), MORTALITY, model, "roc_auc", "average_precision", None)
        for code, model in REPORT_LANGUAGES
    ]
    report = rows[0].unionByName(rows[1]).unionByName(rows[2])
    out = _study_folder(spark, "results")
    try:
        write_report_csv(report, out)
        return materialize(filter_report(read_report_csv(spark, out), MORTALITY, "modal"))
    finally:
        remove_folder(spark, out)


def q_training_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Loss curves parsed from log lines of both forms: a run per event type, an epoch per day of the month, and as its loss the
    day's events in thousands."""
    ev = tables.read_table(spark, sf, "events")
    days = ev.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch")).agg(F.count(F.lit(1)).alias("n"))
    loss = F.format_string("%.4f", F.col("n") / F.lit(1000.0))
    short = F.format_string("Epoch %d | Avg Loss: %s | Train AUC: 0.5", F.col("epoch"), loss)
    long = F.format_string("Epoch %d Average Loss: %s", F.col("epoch"), loss)
    lines = days.select("run", F.when(F.col("epoch") % 2 == 0, short).otherwise(long).alias("value"))
    other = days.select("run", F.lit("reading the next shard").alias("value"))
    out = _study_folder(spark, "logs")
    try:
        write_training_logs(lines.unionByName(other), out)
        curves = parse_training_logs(spark, [out])
        return materialize(
            curves.select("run", F.col("epoch").cast("long").alias("epoch"), "loss", "auc", F.round("loss_change", 6).alias("loss_change"))
        )
    finally:
        remove_folder(spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cohort_intersection": q_cohort_intersection,
    "cohort_split": q_cohort_split,
    "cohort_split_fixed": q_cohort_split_fixed,
    "split_check": q_split_check,
    "cohort_stats": q_cohort_stats,
    "class_weights": q_class_weights,
    "note_coverage": q_note_coverage,
    "vocab_train_only": q_vocab_train_only,
    "encode_with_unknown": q_encode_with_unknown,
    "ordered_sequences": q_ordered_sequences,
    "next_pairs": q_next_pairs,
    "next_pairs_lead": q_next_pairs_lead,
    "last_value_per_key": q_last_value_per_key,
    "pad_batches": q_pad_batches,
    "unpad_batches": q_unpad_batches,
    "top_codes": q_top_codes,
    "length_histogram": q_length_histogram,
    "length_density": q_length_density,
    "examples_joined": q_examples_joined,
    "one_vector_per_admission": q_one_vector_per_admission,
    "modality_drop_counts": q_modality_drop_counts,
    "next_code_model": q_next_code_model,
    "forecast_topk_accuracy": q_forecast_topk_accuracy,
    "forecast_topk_accuracy_notes": q_forecast_topk_accuracy_notes,
    "forecast_cross_entropy": q_forecast_cross_entropy,
    "compare_models": q_compare_models,
    "final_report": q_final_report,
    "bag_of_codes_topk_vocab": q_bag_of_codes_topk_vocab,
    "risk_features": q_risk_features,
    "risk_fit_check": q_risk_fit_check,
    "risk_codes_only": q_risk_codes_only,
    "risk_with_notes": q_risk_with_notes,
    "clamped_scores": q_clamped_scores,
    "roc_auc": q_roc_auc,
    "average_precision": q_average_precision,
    "roc_points": q_roc_points,
    "roc_area": q_roc_area,
    "calibration": q_calibration,
    "ranking_by_group": q_ranking_by_group,
    "log_loss": q_log_loss,
    "note_token_counts": q_note_token_counts,
    "vectorize_notes": q_vectorize_notes,
    "gated_fusion": q_gated_fusion,
    "fused_positions": q_fused_positions,
    "layer_norm": q_layer_norm,
    "max_pool": q_max_pool,
    "project_vectors": q_project_vectors,
    "topk_by_dot": q_topk_by_dot,
    "note_clusters_fitted": q_note_clusters_fitted,
    "projection_fitted": q_projection_fitted,
    "projection_moments": q_projection_moments,
    "encode_notes": q_encode_notes,
    "two_layer_head": q_two_layer_head,
    "stored_risk_scores": q_stored_risk_scores,
    "risk_notes_fit_check": q_risk_notes_fit_check,
    "stored_examples": q_stored_examples,
    "csv_round_trip": q_csv_round_trip,
    "observed_counts": q_observed_counts,
    "report_forecasting": q_report_forecasting,
    "shuffled_batches": q_shuffled_batches,
    "note_vectors": q_note_vectors,
    "tokenized_bags": q_tokenized_bags,
    "relu_vectors": q_relu_vectors,
    "formatted_stats": q_formatted_stats,
    "results_file": q_results_file,
    "training_curves": q_training_curves,
}
