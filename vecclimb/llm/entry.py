"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecclimb.llm import bpe, conversations, decontaminate, manifest, quality, secret_scan, sharding, suffix_dedup, token_files, toxicity, url_filter
from vecclimb.llm.near_dedup import near_duplicates
from vecclimb.llm.vector_dedup import near_vectors
from vecclimb.session import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), ngram=3, percent=85, bands=32, rows=6).drop("chosen")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in ("assign", "access", "hex")),
        F.sha2(F.expr(secret_scan.joined_spans("spans", "'assign', 'access', 'hex'")), 256).alias("base_sha256"),
        F.expr(secret_scan.joined_spans("spans")).alias("spans"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(manifest)


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), least=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    claimed = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest.manifest(table(spark, sf_dir, "documents"), claimed).withColumn("proof_sha256", F.sha2("siblings", 256)).drop("siblings")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with the faults of the contract: a row's id and turn decide which; nulls are one space."""
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.pmod(F.crc32(F.concat(texts["conv_id"], F.lit(":"), texts["turn"])), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(texts["text"], ".!?", "")).otherwise(texts["text"])
    role = F.when(kind == 4, "user").otherwise(texts["role"])
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.repair(damaged(rows))
    parts = rows.select("conv_id").distinct().unionByName(found.conversations, allowMissingColumns=True).unionByName(found.digests(), allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_near_dedup,
        op2_quality,
        op3_toxicity,
        op4_byte_bpe,
        op5_secret_scan,
        op6_token_files,
        op7_vector_near_dedup,
        op8_decontaminate,
        op9_url_filter,
        op10_sharding,
        op11_suffix_dedup,
        op12_merkle_manifest,
        op13_conversation_repair,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
