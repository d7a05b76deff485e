"""Registered queries of the training-data operators, ``opN_<name>(spark, sf_dir)``: the whole table, production
parameters, the whole result. They only choose inputs and digest columns; the work is in the operators' modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm import (
    attention_lm,
    bagminhash,
    bpe_lexicon,
    chat_trees,
    common,
    decontaminate,
    extendible,
    hd_langid,
    html_mincut,
    merkle,
    periodic_runs,
    pii_crf,
    quality_classifier,
    quality_rules,
)
from carepath.llm.oracle import ORACLE_SQL as ORACLE_SQL
from carepath.sources.tables import read_table


def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    held = common.held_out("doc_id", 3, 1)
    return quality_classifier.classify(
        read_table(spark, sf, "documents"),
        read_table(spark, sf, "labels"),
        learn=~held,
        fold=F.shiftright(common.fold("doc_id", 3), 1),
        keep=(held.alias("held_out"),),
    )


def op2_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    model = pii_crf.fit(pii_crf.labelled_table(spark))
    found = pii_crf.find(read_table(spark, sf, "documents"), model)
    counts = [f"n_{k}" for k in pii_crf.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


# The conversation that the contract adds, whose texts look like control strings.
EXTRA_CONVERSATION = tuple((-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant")))


def op3_chat_trees(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(list(EXTRA_CONVERSATION), "conv_id long, turn long, role string, text string"))
    return chat_trees.read_back(chat_trees.format_paths(chat_trees.chain(rows)))


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    out = bpe_lexicon.encode(read_table(spark, sf, "documents"), decoded=True)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return bagminhash.classes(read_table(spark, sf, "documents"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.verdicts(read_table(spark, sf, "documents"))


def op7_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return attention_lm.scores(read_table(spark, sf, "documents"), common.held_out("doc_id", 7, 2))


def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    out = common.held_out("doc_id", 4, 2).alias("held_out")
    model = hd_langid.fit(docs.where(~common.held_out("doc_id", 4, 2)))
    return hd_langid.predict(docs, model, keep=(out,))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return extendible.shard(docs, n_bytes=F.col("n_bytes"))


# The letters that the contract's tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = merkle.leaf_hash(*fields, F.translate("text", UPPER, LOWER))
    manifest = merkle.build(
        docs,
        leaf=merkle.leaf_hash(*fields, F.col("text")),
        group="source",
        order="doc_id",
        keep=("doc_id",),
        claimed=F.when(common.fold("doc_id", 5) == F.lit(0), tampered),
    )
    return merkle.verify(manifest)


def op12_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_mincut.extract(read_table(spark, sf, "pages"), html_mincut.default_weights(spark))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", periodic_runs.planted().alias("text"))
    found = periodic_runs.detect(docs)
    row = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    found = found.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.col3")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(row, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_personal_data": op2_personal_data,
    "op3_chat_trees": op3_chat_trees,
    "op4_bpe": op4_bpe,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_model": op7_language_model,
    "op8_language": op8_language,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_html_text": op12_html_text,
    "op13_periodic_runs": op13_periodic_runs,
}
