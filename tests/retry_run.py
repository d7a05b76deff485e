"""Run the flagship pipeline in a fresh session that allows task retries; with --fail, an input column fails
the first attempt of partition 0 in every stage that reads it. Prints one JSON line of results."""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pandas as pd  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    fail = "--fail" in sys.argv
    sf = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[4,3]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "6")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel(os.environ.get("RETRY_LOG_LEVEL", "OFF"))

    from carepath.operators import forecast as fc
    from carepath.operators.sequences import build_sequences, next_pairs
    from carepath.operators.vocab import build_vocab, encode_codes, with_split
    from carepath.plans.fixtures import Inputs, build_cohort, inputs
    from carepath.session import materialize

    @F.pandas_udf("long")
    def flaky(x: pd.Series) -> pd.Series:
        ctx = TaskContext.get()
        if fail and ctx.partitionId() == 0 and ctx.attemptNumber() == 0:
            raise RuntimeError("injected task failure")
        return x

    inp = inputs(spark, sf, "F3")
    inp = Inputs(inp.admissions, inp.labels, inp.note_ids, inp.diagnoses.withColumn("hadm_id", flaky("hadm_id")))
    cohort = build_cohort(inp)
    joined = with_split(inp.diagnoses, cohort)
    vocab = build_vocab(joined)
    seqs = materialize(build_sequences(encode_codes(joined, vocab)))
    pairs = next_pairs(seqs)
    model = fc.fit_next_code(pairs.where("split = 'train'"), 10)
    acc = fc.evaluate_topk(model, pairs.where("split = 'test'")).first()
    digest = seqs.select(F.sum(F.pmod(F.xxhash64("hadm_id", "split", "input_ids", "labels"), F.lit(1_000_000_007))).alias("h")).first()["h"]
    from carepath.functions.scalar import clamped_probability
    from carepath.operators import metrics as me
    from carepath.operators.sequences import pad_batches
    from carepath.sources import tables

    raw = tables.score_fixture(spark, sf).withColumn("hadm_id", flaky("hadm_id"))
    scores = raw.select("hadm_id", "y", clamped_probability("z").alias("p"))
    summary = list(me.ranking_summary(scores).first())
    batches = pad_batches(seqs, batch_size=8, seed=3)
    bdigest = batches.select(
        F.sum(F.pmod(F.xxhash64("hadm_id", "batch_id", "pos_in_batch", "input_ids"), F.lit(1_000_000_007))).alias("h")
    ).first()["h"]
    print(json.dumps({"acc": list(acc), "vocab": vocab.size, "sequences": seqs.count(), "digest": digest,
                      "ranking": summary, "batches": bdigest}))
    spark.stop()


if __name__ == "__main__":
    main()
