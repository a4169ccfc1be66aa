"""One query per numbered operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.llm import (
    bpe,
    centroids,
    fm_index,
    languages,
    mixing,
    pieces,
    quality,
    runs,
    sharding,
    simhash,
    substrings,
    templates,
    training_order,
)
from agoraflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_simhash_anchors")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(docs, ranks, public_tokenizers.PATTERN).drop("text")


@query("op6_piece_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query("op9_fm_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op5_external_shuffle")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, 8).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_divergence_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, quality.learn_references(docs)).drop("text", "lang")


@query("op10_language_mixture")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = languages.learn(docs.filter(~languages.held_out()))
    found = languages.identify(docs.select("doc_id", "text"), models)
    return found.select("doc_id", languages.held_out().alias("held_out"), "lang_pred", "score")


@query("op1_training_order")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    shards = training_order.training_order(docs, ranks, public_tokenizers.PATTERN)
    return training_order.records(shards).withColumn("tokens_sha256", F.sha2("tokens", 256)).drop("tokens")


@query("op7_compact_windows")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


@query("op8_template_deduction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


@query("op11_threshold_mix", mixing.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, keep=["doc_id"]).drop("times")


@query("op13_lookup_centroids", centroids.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster(vectors, keep=["vec_id"])[0]


@query("op12_word_runs", runs.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_repeated_tail(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs, keep=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # greatest length first, then smallest start, then smallest period
    rank = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    longest = F.array_min(rank)
    first = found.withColumn("first", longest).withColumn("lines", F.array_join(lines, "\n"))
    return first.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("first.s").alias("start"),
        (-F.col("first.l")).alias("length"),
        F.col("first.p").alias("period"),
        F.floor(-F.col("first.l") * 1000 / F.col("first.p")).alias("exponent_milli"),
        F.sha2(F.when(F.col("lines") != "", F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
