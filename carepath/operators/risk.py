"""Risk (mortality) models on Spark ML: bag of codes, document frequencies, weighted logistic regression with or
without the note vector, and scoring with the reference's clamp / NaN guard."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carepath.functions.scalar import clamped_probability, count_vectorizer_tokens, sigmoid
from carepath.functions.vector import ml_vector, vector_cells
from carepath.operators.cohort import TRAIN, attach_labels, class_weights
from carepath.operators.examples import unique_vectors
from carepath.operators.logistic import SLICE, VECTOR_ROWS, WideLogisticRegression
from carepath.operators.ordering import row_index
from carepath.session import arrow_rows, materialize

# Fixed value of the reference's baseline: iteration cap.
MAX_ITER = 1000


def code_rows(diagnoses: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """(hadm_id, split, code): the distinct codes of cohort admissions, one row each. Repeats are dropped map-side and
    the shuffle is on all three columns, so an admission with a third of the rows spreads over all tasks."""
    if "split" not in diagnoses.columns:
        diagnoses = diagnoses.join(cohort.select("hadm_id", "split"), "hadm_id")
    return diagnoses.select("hadm_id", "split", F.col("icd_code").alias("code")).distinct()


def bag_of_codes(
    diagnoses: DataFrame, cohort: DataFrame | None, labels: DataFrame, tokenize: bool = False
) -> DataFrame:
    """(hadm_id, split, codes ARRAY<STRING> distinct and sorted, label): every cohort admission with a diagnosis row.

    ``tokenize=True`` applies the count vectorizer's own token rule to the space-joined codes (lower case, runs
    of two or more word characters), reproducing what a text vectorizer sees; the default keeps codes whole.
    An array holds distinct codes, so the vocabulary bounds it, not the admission's rows. The sets are built in one
    aggregation, which sorts and spills; distinct rows before it would hold a task's rows in hash tables as well.
    """
    if "split" not in diagnoses.columns:
        diagnoses = diagnoses.join(cohort.select("hadm_id", "split"), "hadm_id")
    bags = diagnoses.groupBy("hadm_id", "split").agg(F.sort_array(F.collect_set("icd_code")).alias("codes"))
    if tokenize:
        tokens = count_vectorizer_tokens(F.array_join("codes", " "))
        bags = bags.withColumn("codes", F.array_sort(F.array_distinct(tokens)))
    return attach_labels(bags, labels).drop("label_missing")


def doc_freq_vocab(rows: DataFrame, k: int | None = None, split: str | None = TRAIN) -> DataFrame:
    """Terms by document frequency -> (term, df, rank); ties by term ascending. All terms, or the k most frequent.

    ``rows`` has distinct (hadm_id, code) rows (``code_rows``) or bags with a ``codes`` array. Distinct terms per
    document make term frequency equal document frequency, so the cut is the one a binary vectorizer makes. Ranks are
    distributed positions, whatever k.
    """
    src = rows if split is None else rows.where(F.col("split") == split)
    code = F.explode(F.array_distinct("codes")) if "codes" in rows.columns else F.col("code")
    terms = src.select(code.alias("term")).where(F.col("term").isNotNull())
    dfreq = terms.groupBy("term").agg(F.count(F.lit(1)).cast("long").alias("df"))
    ordered = row_index(dfreq.withColumn("_order", -F.col("df")), ["_order", "term"], "rank").select("term", "df", "rank")
    return ordered if k is None else ordered.where(F.col("rank") <= F.lit(k))


def risk_features(rows: DataFrame, labels: DataFrame, split: str = TRAIN) -> DataFrame:
    """The risk model's training matrix in long form: (hadm_id, term, y, weight), one row per feature that is 1, with
    the balanced class weight of the admission."""
    own = rows.where((F.col("split") == split) & F.col("code").isNotNull())
    admissions = attach_labels(own.select("hadm_id", "split").distinct(), labels)
    weights = class_weights(admissions.select("hadm_id", "split"), labels, split).select("label", "weight")
    rowwise = admissions.join(F.broadcast(weights), "label").select("hadm_id", F.col("label").alias("y"), "weight")
    return own.join(rowwise, "hadm_id").select("hadm_id", F.col("code").alias("term"), "y", "weight")


@dataclass(frozen=True)
class RiskModel:
    """A fitted model. The terms stay a table; ``vocabulary`` and ``pipeline`` bring them to the driver when asked for."""

    terms: DataFrame  # term, rank (1..n_terms): a term's place among the coefficients is its rank - 1
    n_terms: int
    regression: LogisticRegressionModel
    with_notes: bool

    @property
    def vocabulary(self) -> tuple[str, ...]:
        return tuple(self.terms.select("term", "rank").toArrow().sort_by("rank").column("term").to_pylist())

    @property
    def pipeline(self) -> PipelineModel:
        """Counter, assembler and regression as one Spark ML model."""
        inputs = ["bag", "note_vec"] if self.with_notes else ["bag"]
        assembler = VectorAssembler(inputCols=inputs, outputCol="features")
        return PipelineModel(stages=[_code_counter(self.terms.orderBy("rank")), assembler, self.regression])


def _features(bags: DataFrame, note_vectors: DataFrame | None) -> DataFrame:
    if note_vectors is None:
        return bags
    # Inner join: examples without a note vector are dropped (the reference's modality filter).
    # Several vectors of one admission count as one, so no admission trains twice.
    vectors = unique_vectors(note_vectors)
    return bags.join(vectors.select("hadm_id", ml_vector(vectors, "vec").alias("note_vec")), "hadm_id")


def _code_counter(terms: DataFrame) -> CountVectorizerModel:
    """The binary counter of the terms, in their order. ``from_vocabulary`` sends the terms to the JVM in a call each;
    here the JVM collects them itself."""
    jvm = terms.sparkSession._jvm
    words = getattr(terms.select("term")._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING()).collect()
    if not len(words):
        raise ValueError("no codes to learn from")
    cv = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", words)
    return cv.setInputCol("codes").setOutputCol("bag").setBinary(True)


def _vectors(rows: DataFrame, terms: DataFrame, n_terms: int, *keep: str) -> DataFrame:
    """(kept columns, features) of staged rows: binary bag of codes and, if there is one, the note vector after it, as
    sparse Spark ML vectors. The codes find their places by a join, and the column describes no single feature, so
    neither the driver nor a task holds something for each term."""
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    found = keyed.select("_row", F.explode(F.array_distinct("codes")).alias("term")).join(terms.select("term", "rank"), "term")
    found = found.groupBy("_row").agg(F.sort_array(F.collect_list((F.col("rank") - 1).cast("int"))).alias("_places"))
    indices = F.coalesce("_places", F.array().cast("array<int>"))
    values = F.transform(indices, lambda _: F.lit(1.0))
    size = F.lit(n_terms)
    if "note_vec" in rows.columns:
        own = F.coalesce(F.unwrap_udt("note_vec"), F.raise_error(F.lit("an admission has a null note vector")))
        keyed = keyed.withColumn("_note", own)
        u = F.col("_note")
        cell = lambda v, i: F.struct((F.coalesce(F.get(u["indices"], i), i) + n_terms).alias("i"), v.alias("v"))
        cells = F.filter(F.transform(u["values"], cell), lambda c: c["v"] != 0.0)
        indices, values = F.concat(indices, cells["i"]), F.concat(values, cells["v"])
        size = size + F.coalesce(u["size"], F.size(u["values"]))
    vector = F.struct(F.lit(0).cast("byte").alias("type"), size.alias("size"), indices.alias("indices"), values.alias("values"))
    out = keyed.join(found, "_row", "left").select(*keep, vector.alias("features"))
    schema = T.StructType([*(out.schema[c] for c in keep), T.StructField("features", VectorUDT())])
    with arrow_rows(rows.sparkSession, VECTOR_ROWS):
        return materialize(out.mapInArrow(lambda batches: batches, schema))  # no cast makes a vector of its cells


def fit_risk(
    bags: DataFrame,
    note_vectors: DataFrame | None = None,
    k: int | None = None,
    max_iter: int = MAX_ITER,
) -> RiskModel:
    """Binary bag-of-codes (+ note vector when given) -> class-weighted L2 logistic regression on train.

    With note vectors the training rows are the train admissions that have one; the feature vocabulary and
    the balanced class weights are computed on exactly those rows. Objective matches 1/2 |b|^2 + sum_i w_i l_i
    (C = 1, balanced weights): regParam = 1 / sum(w), no standardization, no elastic net. Every term of the train
    vocabulary is a sparse feature unless ``k`` cuts to the most frequent; the driver holds a coefficient for each, not
    the terms. The training rows are materialised once for vocabulary, weights and fit.
    """
    train = materialize(_features(bags.where(F.col("split") == TRAIN), note_vectors))
    terms = doc_freq_vocab(train, k, None).select("term", "rank")
    n_terms = terms.count()
    if not n_terms:
        raise ValueError("no codes to learn from")
    # Balanced weights over the training rows the model sees (one row per class comes back).
    per_class = {int(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total_w = float(sum(per_class.values()))  # balanced weights add up to the number of rows
    weights = {label: total_w / (len(per_class) * n) for label, n in per_class.items()}
    wmap = F.create_map(*[x for label, w in weights.items() for x in (F.lit(label), F.lit(w))])
    train = train.withColumn("w", F.coalesce(wmap[F.col("label")], F.lit(1.0))).withColumn("label_d", F.col("label").cast("double"))
    lr = WideLogisticRegression(
        featuresCol="features",
        labelCol="label_d",
        weightCol="w",
        regParam=1.0 / total_w if total_w > 0 else 0.0,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-6,
    )
    # The fit runs jobs on these rows for each iteration: they are staged.
    return RiskModel(terms, n_terms, lr.fit(_vectors(train, terms, n_terms, "label_d", "w")), note_vectors is not None)


def score_risk(model: RiskModel, bags: DataFrame, note_vectors: DataFrame | None = None, split: str = "test") -> DataFrame:
    """(hadm_id, y, margin, p): margin -> clamp to [-10, 10] -> sigmoid -> NaN to 0.5."""
    rows = bags.where(F.col("split") == split) if split else bags
    if model.with_notes:
        rows = _features(rows, note_vectors)
    out = model.regression.transform(_vectors(materialize(rows), model.terms, model.n_terms, "hadm_id", "label"))
    margin = vector_to_array("rawPrediction")[1]
    return out.select(
        "hadm_id",
        F.col("label").cast("double").alias("y"),
        margin.alias("margin"),
        clamped_probability(margin).alias("p"),
    )


def coefficients(model: RiskModel) -> DataFrame:
    """(kind, term, place, b): the model's coefficients, one row each: ``code`` by term, ``note`` by place in the note
    vector, and the ``intercept``. They leave the driver as numbers in slices and meet their terms in a join."""
    spark, b = SparkSession.active(), model.regression.coefficients.toArray()
    starts = np.arange(0, len(b), SLICE)
    parts = pa.table({"start": pa.array(starts, pa.int64()), "b": pa.array([b[i : i + SLICE] for i in starts], pa.list_(pa.float64()))})
    rows = spark.createDataFrame(parts).select("start", F.posexplode("b").alias("i", "b"))
    rows = materialize(rows.select((F.col("start") + F.col("i")).alias("at"), "b"))  # else the planner takes them for few
    terms = model.terms.select("term", (F.col("rank") - 1).alias("at"))
    none, at = F.lit(None), (F.col("at") - model.n_terms).cast("int")
    codes = rows.join(terms, "at").select(F.lit("code").alias("kind"), "term", none.cast("int").alias("place"), "b")
    notes = rows.where(at >= 0).select(F.lit("note").alias("kind"), none.cast("string").alias("term"), at.alias("place"), "b")
    start = spark.createDataFrame([("intercept", None, None, model.regression.intercept)], "kind string, term string, place int, b double")
    return start.unionByName(codes).unionByName(notes)


def save_risk(model: RiskModel, path: str) -> None:
    """Store under ``path`` the fitted pipeline, the vocabulary (rank, term), the coefficients as a table, and whether
    notes are used."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    model.terms.select("rank", "term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    coefficients(model).write.mode("overwrite").parquet(f"{path}/coefficients")
    spark = SparkSession.active()
    spark.createDataFrame([(model.with_notes,)], "with_notes boolean").write.mode("overwrite").parquet(f"{path}/meta")


def stored_margins(
    spark: SparkSession, path: str, bags: DataFrame, note_vectors: DataFrame | None = None
) -> DataFrame:
    """(hadm_id, margin) from the stored coefficients alone, by joins and sums: intercept, plus the coefficients of the
    admission's distinct codes, plus note vector times note coefficients. Admissions as ``score_risk`` sees them."""
    stored = spark.read.parquet(f"{path}/coefficients")
    start = stored.where(F.col("kind") == "intercept").first()["b"]
    codes = stored.where(F.col("kind") == "code").select("term", "b")
    places = stored.where(F.col("kind") == "note").select("place", "b")
    rows = bags if note_vectors is None else bags.join(note_vectors.select("hadm_id").distinct(), "hadm_id", "left_semi")
    parts = rows.select("hadm_id", F.explode(F.array_distinct("codes")).alias("term")).join(codes, "term").select("hadm_id", "b")
    if note_vectors is not None:
        cells = vector_cells(unique_vectors(note_vectors), "hadm_id")
        parts = parts.unionByName(cells.join(places, "place").select("hadm_id", (F.col("x") * F.col("b")).alias("b")))
    sums = parts.groupBy("hadm_id").agg(F.sum("b").alias("_sum"))
    out = rows.select("hadm_id").join(sums, "hadm_id", "left")
    return out.select("hadm_id", (F.lit(start) + F.coalesce("_sum", F.lit(0.0))).alias("margin"))


def load_risk(spark: SparkSession, path: str) -> RiskModel:
    terms = materialize(spark.read.parquet(f"{path}/vocabulary").select("term", "rank"))
    with_notes = spark.read.parquet(f"{path}/meta").first()["with_notes"]
    return RiskModel(terms, terms.count(), PipelineModel.load(f"{path}/pipeline").stages[-1], with_notes)


def fit_check(model: RiskModel, bags: DataFrame, note_vectors: DataFrame | None = None, tolerance: float = 1e-3) -> DataFrame:
    """(n, n_pos, n_features, weight_sum, stationary) of a model on its training rows, with the note vectors that it was
    fitted with, if any.

    ``stationary``: at the fitted coefficients b, every part of the objective's gradient,
    b_j + sum over admissions of w (p - y) x_j, is below ``tolerance`` times the weight sum; x_j is 1 for the codes of
    the admission, else the note vector's value; p is the unclamped probability.
    """
    spark = bags.sparkSession
    train = _features(bags.where(F.col("split") == TRAIN), note_vectors)
    weights = class_weights(train.select("hadm_id", "split"), train.select("hadm_id", "label"))
    rows = score_risk(model, bags, note_vectors, split=TRAIN).select("hadm_id", "y", sigmoid("margin").alias("p"))
    rows = materialize(rows.join(F.broadcast(weights.select(F.col("label").cast("double").alias("y"), "weight")), "y"))
    residual = F.col("weight") * (F.col("p") - F.col("y"))
    # Sums of a fixed size pass the driver.
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").cast("long").alias("n_pos"),
        F.sum("weight").alias("weight_sum"),
        F.sum(residual).alias("intercept"),
    ).first()
    b = coefficients(model)
    slopes = (
        train.select("hadm_id", F.explode("codes").alias("term"))
        .join(rows, "hadm_id")
        .groupBy("term")
        .agg(F.sum(residual).alias("g"))
        .join(b.where(F.col("kind") == "code").select("term", "b"), "term")
        .select("g", "b")
    )
    if note_vectors is not None:
        cells = vector_cells(train, "hadm_id", col="note_vec").join(rows, "hadm_id")
        notes = cells.groupBy("place").agg(F.sum(residual * F.col("x")).alias("g"))
        places = b.where(F.col("kind") == "note").select("place", "b").join(notes, "place", "left")
        slopes = slopes.unionByName(places.select(F.coalesce("g", F.lit(0.0)).alias("g"), "b"))
    steep = slopes.agg(F.max(F.abs(F.col("g") + F.col("b"))).alias("steepest"), F.count(F.lit(1)).alias("n_features")).first()
    weight_sum = totals.weight_sum or 0.0
    steepest = max(abs(totals.intercept or 0.0), steep.steepest or 0.0)
    row = (totals.n, totals.n_pos or 0, steep.n_features, round(weight_sum, 6), steepest <= tolerance * weight_sum)
    return spark.createDataFrame([row], "n long, n_pos long, n_features long, weight_sum double, stationary boolean")
