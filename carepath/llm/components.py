"""Connected components of a link table: every node gets the smallest id it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import few, stage

# Tasks that hold a table of few links.
FEW_TASKS = 8


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label), for nodes that have a link.

    Rounds of: take the smallest label among the neighbours (a minimum per node, combined before the shuffle), then
    the label of the label. A hub's links never meet in one list. Each round is staged; the driver gets the number of
    links once, and one row as long as labels change. With few links the labels are broadcast and FEW_TASKS tasks hold
    a table: a round then shuffles once and leaves few files, however many partitions the session has.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct())
    small = few(both)
    packed = (lambda df: df.coalesce(FEW_TASKS)) if small else (lambda df: df)
    both = packed(both)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = stage(packed(labels))
    while True:
        known = F.broadcast(labels) if small else labels
        near = (
            both.join(known.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = near.join(known, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("mid")
        )
        up = known.select(F.col("node").alias("mid"), F.col("label").alias("up"))
        new = step.join(up, "mid", "left").select("node", "old", F.least("mid", F.coalesce("up", "mid")).alias("label"))
        new = stage(packed(new))
        changed = new.where(F.col("old") != F.col("label")).take(1)
        labels = new.drop("old")
        if not changed:
            return labels
