"""Reports: the task/model metric table, model comparison with relative gain, and training-log curves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carepath.functions.scalar import percent
from carepath.operators import forecast as fc
from carepath.operators.cohort import TEST, TRAIN
from carepath.operators.forecast import NextCodeModel
from carepath.plans.fixtures import prepare
from carepath.schemas import REPORT_CSV_HEADER
from carepath.sources import tables

# The reference's task and model names.
FORECASTING, MORTALITY = "Forecasting", "Mortality"
UNIMODAL, MULTIMODAL, BASELINE = "Unimodal", "Multimodal", "Baseline"


def report_row(df: DataFrame, task: str, model: str, m1: str, m2: str, m3: str | None) -> DataFrame:
    return df.select(
        F.lit(task).alias("task"),
        F.lit(model).alias("model"),
        F.col(m1).cast("double").alias("metric_1"),
        F.col(m2).cast("double").alias("metric_2"),
        (F.col(m3).cast("double") if m3 else F.lit(0.0)).alias("metric_3"),
    )


def forecasting_rows(counts: DataFrame, k: int = 10, store: Callable[[str, NextCodeModel], None] | None = None) -> DataFrame:
    """Two rows: top-1/5/10 % of the codes-only model and of the model keyed by note cluster, from ``forecast.pair_counts``
    with the cluster. ``store`` gets each fitted model by name."""
    train, test = (counts.where(F.col("split") == s) for s in (TRAIN, TEST))
    rows = []
    for name, ctx in ((UNIMODAL, ()), (MULTIMODAL, ("cluster",))):
        model = fc.fit_next_code(train, k, ctx)
        if store:
            store(name, model)
        rows.append(report_row(fc.evaluate_topk(model, test), FORECASTING, name, "top1_pct", "top5_pct", "top10_pct"))
    return rows[0].unionByName(rows[1])


def forecast_report(spark: SparkSession, sf_dir: str, fixture: str = "F1b", k: int = 10, how: str = "left") -> DataFrame:
    """``forecasting_rows`` of a fixture. ``how`` = "inner" keeps admissions with a note cluster only, as the study does."""
    p = prepare(spark, sf_dir, fixture)
    pairs = p.pairs.join(tables.note_clusters(spark, sf_dir), "hadm_id", how)
    return forecasting_rows(fc.pair_counts(pairs, ("cluster",)), k)


def filter_report(report: DataFrame, task: str | None = None, model_contains: str | None = None) -> DataFrame:
    """Rows of one task and/or whose model name contains a substring."""
    out = report
    if task is not None:
        out = out.where(F.col("task") == F.lit(task))
    if model_contains is not None:
        out = out.where(F.col("model").contains(model_contains))
    return out


def compare_models(report: DataFrame, base: str = UNIMODAL, other: str = MULTIMODAL, third: str | None = None) -> DataFrame:
    """Per task and metric, the models side by side (chosen by name, not row position) and the relative gain % of
    ``other`` over ``base`` -> (task, metric, unimodal, multimodal, gain_pct).

    With ``third`` (the baseline) also its value and the gain of ``other`` over it: (baseline, gain_over_baseline_pct).
    A model without a row for a task gives nulls.
    """
    metrics = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("metric_1", "metric_2", "metric_3")]
    long = report.select("task", "model", F.explode(F.array(*metrics)).alias("_m")).select("task", "model", "_m.*")
    names = [base, other, *([third] if third else [])]
    wide = long.groupBy("task", "metric").pivot("model", names).agg(F.first("value"))
    gain = lambda x, y: F.round(percent(F.col(x) - F.col(y), F.col(y)), 6)
    out = [F.round(n, 6).alias(n.lower()) for n in names] + [gain(other, base).alias("gain_pct")]
    if third:
        out.append(gain(other, third).alias(f"gain_over_{third.lower()}_pct"))
    return wide.select("task", "metric", *out)


def format_report(report: DataFrame, digits: int = 4) -> DataFrame:
    """Display strings for the report (task, model, then each metric with ``digits`` decimals); forecasting
    metrics are percentages and get a % sign."""
    pct = F.col("task") == F.lit(FORECASTING)
    out = [F.col("task"), F.col("model")]
    for m in ("metric_1", "metric_2", "metric_3"):
        text = F.format_string(f"%.{digits}f", F.col(m))
        out.append(F.when(pct, F.concat(text, F.lit("%"))).otherwise(text).alias(m))
    return report.select(*out)


def format_cohort_stats(stats: DataFrame, vocab_size_with_unknown: int | None = None) -> DataFrame:
    """Cohort table for display: n with thousands separators, positives, rate with two decimals and a % sign,
    and the vocabulary size when given."""
    cols = [
        F.col("split"),
        F.format_number(F.col("n"), 0).alias("n"),
        F.format_number(F.col("n_pos"), 0).alias("positives"),
        F.concat(F.format_string("%.2f", F.col("rate_pct")), F.lit("%")).alias("rate"),
    ]
    if vocab_size_with_unknown is not None:
        cols.append(F.format_number(F.lit(vocab_size_with_unknown), 0).alias("vocab_size"))
    return stats.select(*cols)


def write_report_csv(report: DataFrame, path: str) -> None:
    """The results file with the reference's header (a handful of rows: one output file is fine)."""
    report.select(
        *[F.col(c).alias(h) for c, h in zip(["task", "model", "metric_1", "metric_2", "metric_3"], REPORT_CSV_HEADER)]
    ).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """The results file read back as (task, model, metric_1, metric_2, metric_3); columns are found by header."""
    raw = spark.read.option("header", True).csv(path)
    missing = [h for h in REPORT_CSV_HEADER if h not in raw.columns]
    if missing:
        raise ValueError(f"{path}: columns {missing} missing (found {raw.columns})")
    task, model, *metrics = REPORT_CSV_HEADER
    values = [F.col(f"`{h}`").try_cast("double").alias(f"metric_{i}") for i, h in enumerate(metrics, 1)]
    return raw.select(F.col(f"`{task}`").alias("task"), F.col(f"`{model}`").alias("model"), *values)


# The log-line patterns of the reference's training output.
EPOCH_PATTERN = r"Epoch (\d+)"
LOSS_PATTERN = r"Av(?:erage|g) Loss: ([0-9.]+)"
AUC_PATTERN = r"Train AUC: ([0-9.]+)"


def write_training_logs(lines: DataFrame, path: str) -> None:
    """Log lines (run, value) as text files in one folder per run."""
    lines.select("run", "value").write.mode("overwrite").partitionBy("run").text(path)


def parse_training_logs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Training-log lines -> (run, epoch, loss, auc, loss_change); lines without an epoch and loss are skipped. A run is a
    file, or all files of a folder ``run=...``."""
    read = spark.read.text(list(paths))
    run = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    lines = read.select((F.col("run").cast("string") if "run" in read.columns else run).alias("run"), "value")
    parsed = lines.select(
        "run",
        F.regexp_extract("value", EPOCH_PATTERN, 1).alias("_e"),
        F.regexp_extract("value", LOSS_PATTERN, 1).alias("_l"),
        F.regexp_extract("value", AUC_PATTERN, 1).alias("_a"),
    ).where((F.col("_e") != "") & (F.col("_l") != ""))
    out = parsed.select(
        "run",
        F.col("_e").try_cast("int").alias("epoch"),
        F.col("_l").try_cast("double").alias("loss"),
        F.when(F.col("_a") != "", F.col("_a").try_cast("double")).alias("auc"),
    )
    w = Window.partitionBy("run").orderBy("epoch")
    return out.withColumn("loss_change", F.col("loss") - F.lag("loss").over(w))
