"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import decontam, lines, neardup, secrets, topk, toxicity, urls
from lamella.llm.chat import repair_chats
from lamella.llm.packing import pack_documents
from lamella.llm.sharding import histogram_shards
from lamella.session import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """Where the public tokenizer's file is; the package that holds it is installed on all nodes."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return secrets.digest(found)


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_report(table(spark, sf_dir, "documents"))
    return found.withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = histogram_shards(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_topk": op1_topk,
    "op2_secrets": op2_secrets,
    "op3_linededup": op3_linededup,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_urls": op6_urls,
    "op7_neardup": op7_neardup,
    "op8_decontam": op8_decontam,
    "op9_packing": op9_packing,
    "op10_chat": op10_chat,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": topk.ORACLE,
    "op2_secrets": secrets.ORACLE,
    "op3_linededup": lines.ORACLE,
    "op6_urls": urls.oracle(),
    "op7_neardup": neardup.ORACLE,
    "op8_decontam": decontam.ORACLE,
}
