"""Exact distributed ranking metrics: ROC-AUC, average precision, ROC points, trapezoid area, calibration, log loss.

All threshold metrics share one prefix-sum table over *distinct* scores, built without a global single-task
window: scores are aggregated to (score, positives, negatives) with map-side combining, range-partitioned on
score (descending), cumulated inside each partition in parallel, and shifted by the totals of all earlier
partitions (one row per partition: a bounded broadcast). Ties share one row, so they get the half credit / step behaviour
of the usual definitions. Scores must not be NaN (apply ``nan_to`` first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carepath.session import materialize, shuffle_partitions

def prefix_sum_by_score(
    scores: DataFrame,
    y: str = "y",
    p: str = "p",
    group_cols: tuple[str, ...] = (),
    num_partitions: int | None = None,
) -> tuple[DataFrame, dict]:
    """Per group and distinct score, descending: (group..., p, tp, fp, ctp, cfp, idx, n_pos, n_neg, n_points).

    ``ctp``/``cfp`` count positives/negatives of the group with score >= p; ``idx`` is the 1-based position of
    the score inside its group. The second value holds overall totals.

    Distributed prefix sum: rows (one per distinct (group, score), combined map-side) are range-partitioned
    on (group, score descending), so Spark's sampler gives every partition about the same number of rows even
    when one group holds a third of them or its scores pile up in a narrow range. Each (partition, group)
    slice is cumulated in parallel, and slice totals (at most partitions + groups rows) shift the slices.
    """
    g = list(group_cols)
    spark = scores.sparkSession
    parts = num_partitions or shuffle_partitions(spark)
    by_score = scores.groupBy(*g, F.col(p).cast("double").alias("p")).agg(
        F.sum(F.col(y).cast("long")).alias("tp"),
        F.sum(F.lit(1) - F.col(y).cast("long")).alias("fp"),
    )
    staged = materialize(
        by_score.repartitionByRange(parts, *[F.col(c).asc() for c in g], F.col("p").desc()).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    inside = Window.partitionBy("_part", *g).orderBy(F.desc("p"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    b = (
        staged.withColumn("_rtp", F.sum("tp").over(running))
        .withColumn("_rfp", F.sum("fp").over(running))
        .withColumn("_ridx", F.row_number().over(inside))
    )
    per_slice = staged.groupBy("_part", *g).agg(
        F.sum("tp").alias("_btp"), F.sum("fp").alias("_bfp"), F.count(F.lit(1)).alias("_bn")
    )
    before = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = materialize(
        per_slice.select(
            "_part",
            *g,
            F.coalesce(F.sum("_btp").over(before), F.lit(0)).alias("_otp"),
            F.coalesce(F.sum("_bfp").over(before), F.lit(0)).alias("_ofp"),
            F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_on"),
            F.sum("_btp").over(whole).alias("n_pos"),
            F.sum("_bfp").over(whole).alias("n_neg"),
            F.sum("_bn").over(whole).alias("n_points"),
        )
    )
    tot = offsets.groupBy(*g).agg(
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"), F.first("n_points").alias("n_points")
    ).agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.sum("n_points").alias("n_points")).first()
    totals = {k: int(tot[k] or 0) for k in ("n_pos", "n_neg", "n_points")}
    # Ungrouped, the offsets are one row per partition: a bounded broadcast. Grouped, the planner decides.
    off = F.broadcast(offsets) if not g else offsets
    out = b.join(off, ["_part", *g]).select(
        *g,
        "p",
        F.col("tp").cast("long").alias("tp"),
        F.col("fp").cast("long").alias("fp"),
        (F.col("_otp") + F.col("_rtp")).cast("long").alias("ctp"),
        (F.col("_ofp") + F.col("_rfp")).cast("long").alias("cfp"),
        (F.col("_on") + F.col("_ridx")).cast("long").alias("idx"),
        F.col("n_pos").cast("long").alias("n_pos"),
        F.col("n_neg").cast("long").alias("n_neg"),
        F.col("n_points").cast("long").alias("n_points"),
    )
    return out, totals


def ranking_by_group(scores: DataFrame, group_cols: tuple[str, ...], y: str = "y", p: str = "p") -> DataFrame:
    """ROC-AUC and average precision per group (e.g. per epoch or per split) from one grouped prefix-sum pass
    -> (group..., n_pos, n_neg, roc_auc, average_precision); NULL metrics for a group missing a class."""
    t, _ = prefix_sum_by_score(scores, y, p, group_cols=group_cols)
    auc = F.sum(F.col("fp").cast("double") * (F.col("ctp").cast("double") - F.col("tp").cast("double") / 2.0))
    ap = F.sum(
        F.col("tp").cast("double") * F.col("ctp").cast("double") / (F.col("ctp") + F.col("cfp")).cast("double")
    )
    g = t.groupBy(*group_cols).agg(
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"), auc.alias("_auc"), ap.alias("_ap")
    )
    return g.select(
        *group_cols,
        "n_pos",
        "n_neg",
        F.round(F.try_divide(F.col("_auc"), (F.col("n_pos") * F.col("n_neg")).cast("double")), 9).alias("roc_auc"),
        F.round(F.try_divide(F.col("_ap"), F.col("n_pos").cast("double")), 9).alias("average_precision"),
    )


def roc_auc(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """ROC-AUC with half credit for ties -> (n_pos, n_neg, roc_auc); NULL when a class is absent."""
    t, tot = prefix_sum_by_score(scores, y, p)
    denom = float(tot["n_pos"]) * float(tot["n_neg"])
    s = F.sum(F.col("fp").cast("double") * (F.col("ctp").cast("double") - F.col("tp").cast("double") / 2.0))
    return t.agg(
        F.lit(tot["n_pos"]).cast("long").alias("n_pos"),
        F.lit(tot["n_neg"]).cast("long").alias("n_neg"),
        F.round(F.try_divide(s, F.lit(denom)), 9).alias("roc_auc"),
    )


def average_precision(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Step-sum average precision: sum over thresholds of recall increase * precision."""
    t, tot = prefix_sum_by_score(scores, y, p)
    s = F.sum(
        F.col("tp").cast("double") * F.col("ctp").cast("double") / (F.col("ctp") + F.col("cfp")).cast("double")
    )
    return t.agg(
        F.lit(tot["n_pos"]).cast("long").alias("n_pos"),
        F.lit(tot["n_neg"]).cast("long").alias("n_neg"),
        F.round(F.try_divide(s, F.lit(float(tot["n_pos"]))), 9).alias("average_precision"),
    )


def ranking_summary(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """ROC-AUC and average precision from one prefix-sum pass -> (n_pos, n_neg, roc_auc, average_precision)."""
    t, tot = prefix_sum_by_score(scores, y, p)
    auc = F.sum(F.col("fp").cast("double") * (F.col("ctp").cast("double") - F.col("tp").cast("double") / 2.0))
    ap = F.sum(
        F.col("tp").cast("double") * F.col("ctp").cast("double") / (F.col("ctp") + F.col("cfp")).cast("double")
    )
    return t.agg(
        F.lit(tot["n_pos"]).cast("long").alias("n_pos"),
        F.lit(tot["n_neg"]).cast("long").alias("n_neg"),
        F.round(F.try_divide(auc, F.lit(float(tot["n_pos"]) * float(tot["n_neg"]))), 9).alias("roc_auc"),
        F.round(F.try_divide(ap, F.lit(float(tot["n_pos"]))), 9).alias("average_precision"),
    )


def roc_area(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Trapezoid area under the ROC points; each point's predecessor is (cfp - fp, ctp - tp)."""
    t, tot = prefix_sum_by_score(scores, y, p)
    area = F.sum(
        F.col("fp").cast("double") * ((F.col("ctp") - F.col("tp")) + F.col("ctp")).cast("double") / 2.0
    )
    return t.agg(F.round(F.try_divide(area, F.lit(float(tot["n_pos"]) * float(tot["n_neg"]))), 9).alias("roc_area"))


def roc_points(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """ROC points (threshold, fpr, tpr): one per distinct score, collinear interior points dropped, plus a
    (NULL, 0, 0) start. Neighbours are found by equi-joins on the score position, not a global window."""
    t, tot = prefix_sum_by_score(scores, y, p)
    m = tot["n_points"]
    cur = t.select("idx", "p", "ctp", "cfp")
    prv = t.select((F.col("idx") + 1).alias("idx"), F.col("ctp").alias("ptp"), F.col("cfp").alias("pfp"))
    nxt = t.select((F.col("idx") - 1).alias("idx"), F.col("ctp").alias("ntp"), F.col("cfp").alias("nfp"))
    j = cur.join(prv, "idx", "left").join(nxt, "idx", "left")
    bend = (
        (F.col("nfp") - 2 * F.col("cfp") + F.col("pfp") != 0) | (F.col("ntp") - 2 * F.col("ctp") + F.col("ptp") != 0)
    )
    keep = (F.col("idx") == 1) | (F.col("idx") == F.lit(m)) | bend if m > 2 else F.lit(True)
    pts = j.where(keep).select(
        F.col("p").alias("threshold"),
        F.round(F.try_divide(F.col("cfp").cast("double"), F.lit(float(tot["n_neg"]))), 9).alias("fpr"),
        F.round(F.try_divide(F.col("ctp").cast("double"), F.lit(float(tot["n_pos"]))), 9).alias("tpr"),
    )
    start = scores.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def calibration(scores: DataFrame, y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    """Equal-width reliability bins on [0, 1] -> (bin, n, mean_p, frac_pos); empty bins are absent.

    A score's bin is the number of inner edges strictly below it, the edges being i * (1 / n_bins) in double
    arithmetic, as an evenly spaced grid computes them (so 0.3 falls in bin 2: the third edge is
    0.30000000000000004).
    """
    step = 1.0 / n_bins
    edges = F.transform(F.sequence(F.lit(1), F.lit(n_bins - 1)), lambda i: i.cast("double") * F.lit(step))
    binned = scores.select(F.col(p).cast("double").alias("_p"), F.col(y).cast("double").alias("_y")).withColumn(
        "bin", F.size(F.filter(edges, lambda e: e < F.col("_p"))).cast("long")
    )
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.round(F.avg("_p"), 6).alias("mean_p"),
        F.round(F.avg("_y"), 6).alias("frac_pos"),
    )


def log_loss(df: DataFrame, y: str = "y", z: str = "z") -> DataFrame:
    """Binary cross-entropy on logits, numerically stable -> (n, log_loss)."""
    zc = F.col(z).cast("double")
    yc = F.col(y).cast("double")
    per_row = F.greatest(zc, F.lit(0.0)) - zc * yc + F.log1p(F.exp(-F.abs(zc)))
    return df.agg(F.count(F.lit(1)).cast("long").alias("n"), F.round(F.avg(per_row), 9).alias("log_loss"))
