"""Queries of the training-data operators, each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tools, decontaminate, html_main, jaccard_join, mixing, quality, sharding, simhash, token_files, url_filter
from .common import materialise

N_SHARDS = 24
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.interleave_shards(docs, N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat_tools.link_calls(*chat_tools.parse_messages(_table(spark, sf_dir, "conversations")))
    return linked.withColumn("problems", F.array_join("problems", "; "))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: a row for each document and test item that it holds."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With, for documents whose id is divisible by 50 (null for the rest), `near_fingerprints`:
    the other documents' fingerprints within 3 bits, itself where others share it; a document's own
    fingerprint tells which of these it belongs to. `near_found` (long) counts their documents."""
    made = materialise(simhash.with_edits(_table(spark, sf_dir, "documents")), "simhash")
    bits = lambda c: F.conv(c, 16, -10).cast("long")
    asked = made.where("doc_id % 50 = 0")
    near = simhash.within_radius(made.select(bits("fingerprint").alias("fingerprint")), asked.select(bits("fingerprint").alias("fingerprint")))
    held = made.groupBy(bits("fingerprint").alias("fingerprint")).agg(F.count("*").alias("docs"))
    # At most C(64, 0) + ... + C(64, 3) = 43,745 fingerprints are that near to one.
    others = near.join(held, "fingerprint").withColumn("docs", F.col("docs") - (F.col("fingerprint") == F.col("query")).cast("long")).where("docs > 0")
    found = others.groupBy("query").agg(F.sum("docs").alias("near_found"), F.array_sort(F.collect_list(F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))).alias("near_fingerprints"))
    asked = asked.withColumn("query", bits("fingerprint")).join(found, "query", "left").drop("query")
    asked = asked.withColumns({"near_found": F.coalesce("near_found", F.lit(0)), "near_fingerprints": F.coalesce("near_fingerprints", F.array().cast("array<string>"))})
    return asked.unionByName(made.where("doc_id is null or doc_id % 50 <> 0"), allowMissingColumns=True)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_tool_calls, op3_quality, op4_decontamination, op5_html_extraction, op6_token_files, op7_url_filter, op8_fingerprints, op9_jaccard_join, op10_mixing, pipeline)}
