"""A training-data pipeline: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecclimb.llm import bpe, decontaminate, near_dedup, secret_scan, toxicity
from vecclimb.session import Workspace, table

#: Columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels of sf_dir."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Rows are told apart by their texts, also where they share a doc_id or have none.
    """
    return near_dedup.near_duplicates(docs, keep=COLUMNS[1:]).filter("chosen").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[2:])
    return decontaminate.without_overlaps(found).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; n_chars follows the text."""
    clean = secret_scan.redacted(secret_scan.scan(docs, keep=COLUMNS[2:4]))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, exact): token ids, and whether decoding them gives the text again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("text",), decoded=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", tokenise),
]

#: Trained models, minima and merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
