"""Next-code forecasting as Spark jobs: a back-off table of ranked candidates, top-k accuracy, cross-entropy.

The fitted model is a set of ranked candidate tables, one per context level, most specific first:
``(context..., prev)`` -> ``(prev)`` -> global. Each level keeps its k best next codes by (count desc, code id
asc). A context's list is the union of its levels with every code kept at its best level, ordered by
(level, rank within level) and cut at k. Without context columns this is "the previous code's k best,
filled from the global k best".
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.functions.scalar import percent
from carepath.session import materialize


@dataclass(frozen=True)
class NextCodeModel:
    context_cols: tuple[str, ...]
    levels: tuple[tuple[tuple[str, ...], DataFrame], ...]  # (key columns, table(keys..., cand, rank))
    global_top: tuple[int, ...]  # the global k best code ids, best first
    k: int


def pair_counts(pairs: DataFrame, context_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct (split, context..., prev, next) with their multiplicity ``m``, staged: combined map-side, so a hot code
    adds one row per partition. The fitting and scoring functions take these rows in place of the pairs."""
    keys = ["split", *context_cols, "prev", "next"]
    return materialize(pairs.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("m")))


def _number(pairs: DataFrame) -> Column:
    """How many pairs the rows of a group stand for."""
    return F.sum("m") if "m" in pairs.columns else F.count(F.lit(1))


def _top_per_key(counts: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """k best ``next`` per key by (count desc, id asc). Plans as a per-partition group limit before the final one."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("next"))
    return (
        counts.withColumn("rank", F.row_number().over(w).cast("long"))
        .where(F.col("rank") <= F.lit(k))
        .select(*keys, F.col("next").alias("cand"), "rank")
    )


def fit_next_code(train_pairs: DataFrame, k: int = 10, context_cols: Sequence[str] = ()) -> NextCodeModel:
    """Count (context, prev, next) on train pairs or their counts (map-side combined) and keep k candidates per level."""
    ctx = tuple(context_cols)
    finest = materialize(train_pairs.groupBy(*ctx, "prev", "next").agg(_number(train_pairs).alias("n")))
    level_keys: list[tuple[str, ...]] = []
    if ctx:
        level_keys.append(ctx + ("prev",))
    level_keys.append(("prev",))
    levels = []
    for keys in level_keys:
        counts = finest if keys == ctx + ("prev",) else finest.groupBy(*keys, "next").agg(F.sum("n").alias("n"))
        levels.append((keys, _top_per_key(counts, keys, k)))
    overall = finest.groupBy("next").agg(F.sum("n").alias("n"))
    # k rows: the global fallback list is small by construction and travels as a literal.
    top = overall.orderBy(F.desc("n"), F.asc("next")).limit(k).collect()
    return NextCodeModel(ctx, tuple(levels), tuple(int(r["next"]) for r in top), k)


def save_next_code(model: NextCodeModel, path: str) -> None:
    """Store the model as Parquet: one folder per level table plus a small metadata table."""
    spark = model.levels[0][1].sparkSession
    for i, (keys, table) in enumerate(model.levels):
        table.write.mode("overwrite").parquet(f"{path}/level={i}")
    meta = spark.createDataFrame(
        [(i, ",".join(keys)) for i, (keys, _) in enumerate(model.levels)], "level int, keys string"
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/levels")
    spark.createDataFrame(
        [(r, c) for r, c in enumerate(model.global_top, start=1)] or [(0, None)], "rank long, cand long"
    ).where(F.col("cand").isNotNull()).coalesce(1).write.mode("overwrite").parquet(f"{path}/global")
    spark.createDataFrame([(",".join(model.context_cols), model.k)], "context string, k int").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/meta")


def load_next_code(spark, path: str) -> NextCodeModel:
    meta = spark.read.parquet(f"{path}/meta").first()
    lv = sorted(spark.read.parquet(f"{path}/levels").collect(), key=lambda r: r["level"])
    levels = tuple((tuple(r["keys"].split(",")), spark.read.parquet(f"{path}/level={r['level']}")) for r in lv)
    top = tuple(int(r["cand"]) for r in spark.read.parquet(f"{path}/global").orderBy("rank").collect())
    ctx = tuple(c for c in meta["context"].split(",") if c)
    return NextCodeModel(ctx, levels, top, int(meta["k"]))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (a missing note cluster is a context of its own, as it
    is a group of its own when counting). Still planned as a hash/sort-merge equi-join."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def rank_candidates(model: NextCodeModel, contexts: DataFrame) -> DataFrame:
    """Ranked candidate list for each distinct context in ``contexts`` -> (context..., prev, cand, rank)."""
    keys = model.context_cols + ("prev",)
    ctx = contexts.select(*keys).distinct()
    parts = []
    for level, (lkeys, table) in enumerate(model.levels):
        parts.append(
            _join_null_safe(ctx, table, list(lkeys), "inner").select(
                *keys, "cand", F.lit(level).alias("level"), "rank"
            )
        )
    fallback = F.array(*[F.lit(c).cast("long") for c in model.global_top]) if model.global_top else F.array().cast(
        "array<long>"
    )
    parts.append(
        ctx.select(*keys, F.posexplode(fallback).alias("_r", "cand")).select(
            *keys, "cand", F.lit(len(model.levels)).alias("level"), (F.col("_r") + 1).cast("long").alias("rank")
        )
    )
    allc = parts[0]
    for p in parts[1:]:
        allc = allc.unionByName(p)
    # One sortable long per candidate, (level, rank) -> level * 2^20 + rank: a hash aggregate, not a sort one.
    key = F.col("level").cast("long") * F.lit(1 << 20) + F.col("rank")
    best = allc.groupBy(*keys, "cand").agg(F.min(key).alias("_b"))
    w = Window.partitionBy(*keys).orderBy("_b")
    return (
        best.withColumn("rank", F.row_number().over(w).cast("long"))
        .where(F.col("rank") <= F.lit(model.k))
        .select(*keys, "cand", "rank")
    )


def score_pairs(model: NextCodeModel, pairs: DataFrame) -> DataFrame:
    """Rank of each pair's true next code in its context's list (NULL when outside the k best), per row."""
    keys = list(model.context_cols + ("prev",))
    cands = rank_candidates(model, pairs)
    hit = cands.select(*keys, F.col("cand").alias("next"), F.col("rank").alias("hit_rank"))
    return _join_null_safe(pairs, hit, keys + ["next"], "left")


def score_pair_counts(model: NextCodeModel, pairs: DataFrame) -> DataFrame:
    """Like ``score_pairs`` but on distinct (context, next) with a multiplicity ``m``.

    Pairs are combined map-side before any shuffle, so a hot code holding a third of all steps adds one row
    per partition, not a third of the data, to the exchange; the candidate table (at most k rows per
    context) is joined to the combined rows.
    """
    keys = list(model.context_cols + ("prev",))
    combined = materialize(pairs.groupBy(*keys, "next").agg(_number(pairs).alias("m")))
    cands = rank_candidates(model, combined)
    hit = cands.select(*keys, F.col("cand").alias("next"), F.col("rank").alias("hit_rank"))
    return _join_null_safe(combined, hit, keys + ["next"], "left")


def topk_accuracy(scored: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Micro-averaged top-k accuracy % over prediction steps -> (n_tokens, top1_pct, top5_pct, top10_pct).

    Accepts per-row scores (``score_pairs``) or combined ones with a multiplicity ``m`` (``score_pair_counts``).
    """
    m = F.col("m") if "m" in scored.columns else F.lit(1)
    total = F.coalesce(F.sum(m), F.lit(0))
    aggs = [total.cast("long").alias("n_tokens")]
    for k in ks:
        hits = F.sum(F.when(F.col("hit_rank") <= F.lit(k), m).otherwise(F.lit(0)))
        aggs.append(F.round(percent(hits, total), 6).alias(f"top{k}_pct"))
    return scored.agg(*aggs)


def evaluate_topk(model: NextCodeModel, pairs: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Top-k accuracy of ``model`` on ``pairs`` via the combined (pre-aggregated) scoring. No k may exceed the model's:
    its lists end there."""
    if max(ks, default=0) > model.k:
        raise ValueError(f"the model keeps {model.k} candidates, asked for top-{max(ks)}")
    return topk_accuracy(score_pair_counts(model, pairs), ks)


def cross_entropy(train_pairs: DataFrame, eval_pairs: DataFrame, vocab_size: int, lam: float = 0.7) -> DataFrame:
    """Mean -ln p(next | prev) over ``eval_pairs`` -> (n_tokens, cross_entropy).

    p = lam * c(prev, next) / c(prev) + (1 - lam) * (c(next) + 1) / (N + n + 1), with N train pairs and n known
    codes (add-one smoothing over n codes plus the unknown id). A ``prev`` never seen in train has no
    conditional estimate and takes the smoothed unigram alone. Only observed pairs are joined: no
    vocabulary-by-vocabulary table is built.
    """
    c_pair = materialize(train_pairs.groupBy("prev", "next").agg(_number(train_pairs).alias("c_pair")))
    n_train = c_pair.agg(F.sum("c_pair")).first()[0] or 0  # one scalar from the small pair-count table
    c_prev = c_pair.groupBy("prev").agg(F.sum("c_pair").alias("c_prev"))
    c_next = c_pair.groupBy("next").agg(F.sum("c_pair").alias("c_next"))
    # Evaluation steps are combined map-side to distinct (prev, next) with a multiplicity before the joins.
    ev = eval_pairs.groupBy("prev", "next").agg(_number(eval_pairs).alias("m"))
    joined = (
        ev.join(c_pair, ["prev", "next"], "left")
        .join(c_prev, "prev", "left")
        .join(c_next, "next", "left")
    )
    uni = (F.coalesce(F.col("c_next"), F.lit(0)) + F.lit(1)).cast("double") / F.lit(
        float(n_train + vocab_size + 1)
    )
    cond = F.coalesce(F.col("c_pair"), F.lit(0)).cast("double") / F.col("c_prev").cast("double")
    p = F.when(F.col("c_prev").isNull(), uni).otherwise(F.lit(lam) * cond + F.lit(1.0 - lam) * uni)
    return joined.agg(
        F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("n_tokens"),
        F.round(F.try_divide(F.sum(F.col("m") * -F.log(p)), F.sum("m").cast("double")), 9).alias("cross_entropy"),
    )
