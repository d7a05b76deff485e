"""Two-layer binary head over pooled admission vectors, trained by back-propagation on gradients that Spark sums over
partitions (Spark ML's multilayer perceptron, L-BFGS)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value of the reference's head: hidden units.
HIDDEN = 32


@dataclass(frozen=True)
class HeadModel:
    model: MultilayerPerceptronClassificationModel
    layers: tuple[int, int, int]

    @property
    def n_params(self) -> int:
        d, h, out = self.layers
        return (d + 1) * h + (h + 1) * out


def _points(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_x", array_to_vector(F.col("vec").cast("array<double>")))


def fit_head(rows: DataFrame, hidden: int = HIDDEN, max_iter: int = 100, seed: int = 42) -> HeadModel:
    """Fit on rows (vec, label 0/1). The vectors' length comes from the table; all must have it. The classifier has no
    row weights: scores follow the class shares of the rows it sees."""
    size = rows.agg(F.max(F.size("vec")).alias("d"), F.min(F.size("vec")).alias("low")).first()
    if size.d is None or size.d != size.low:
        raise ValueError(f"vectors of one length wanted, found {size.low} to {size.d}")
    layers = (int(size.d), hidden, 2)
    data = _points(rows).select("_x", F.col("label").cast("double").alias("_y"))
    fit = MultilayerPerceptronClassifier(layers=list(layers), maxIter=max_iter, seed=seed, featuresCol="_x", labelCol="_y")
    return HeadModel(fit.fit(data), layers)


def score_head(model: HeadModel, rows: DataFrame) -> DataFrame:
    """``rows`` plus p, the probability of label 1."""
    net = model.model.copy({model.model.featuresCol: "_x", model.model.probabilityCol: "_p", model.model.rawPredictionCol: "_r"})
    out = net.transform(_points(rows)).withColumn("p", vector_to_array("_p")[1])
    return out.drop("_x", "_p", "_r", "prediction")


def layers_of(model: HeadModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights as outputs x inputs, bias) of both layers, from the model's flat stored weights."""
    stored, out, at = np.array(model.model.weights), [], 0
    for inputs, outputs in zip(model.layers, model.layers[1:]):
        weights = stored[at : at + inputs * outputs].reshape(outputs, inputs, order="F")
        at += inputs * outputs
        out.append((weights, stored[at : at + outputs]))
        at += outputs
    return out


def forward(model: HeadModel, vec: Column) -> Column:
    """The probability of label 1 written out from the stored weights: a sigmoid per hidden unit, a softmax over both
    outputs. Arrow batches of matrix products."""
    (first, bias), (second, last) = layers_of(model)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        rows = np.stack([np.asarray(v, np.float64) for v in x]) if len(x) else np.zeros((0, first.shape[1]))
        hidden = 1 / (1 + np.exp(-(rows @ first.T + bias)))
        out = hidden @ second.T + last
        return pd.Series(1 / (1 + np.exp(out[:, 0] - out[:, 1])))

    return run(vec)


def head_check(model: HeadModel, rows: DataFrame) -> DataFrame:
    """(n, n_pos, n_params, max_gap, learned): rows and positives; weights of the model; the largest difference between
    the model's probability and one recomputed from the stored weights; whether the log loss is below ln 2, where a
    one-layer model with zero weights starts."""
    scored = score_head(model, rows).withColumn("_again", forward(model, F.col("vec")))
    y, p = F.col("label").cast("double"), F.col("p")
    loss = -(y * F.log(F.greatest(p, F.lit(1e-15))) + (F.lit(1.0) - y) * F.log(F.greatest(F.lit(1.0) - p, F.lit(1e-15))))
    return scored.agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum(F.col("label").cast("long")).alias("n_pos"),
        F.lit(model.n_params).cast("long").alias("n_params"),
        F.round(F.max(F.abs(p - F.col("_again"))), 6).alias("max_gap"),
        (F.avg(loss) < F.lit(math.log(2.0))).alias("learned"),
    )
