"""Libraries: scan, load, inspect, copy, and sinks of failures and results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecclimb.functions.vectors import norm, normalise


def scan_library(spark: SparkSession, path: str | None = None, records: list[tuple[str, str]] | None = None) -> DataFrame:
    """(item, external_id) from CSV with a header, or from a list: exactly one of the two (A1)."""
    if (path is None) == (records is None):
        raise ValueError("give either a path or records")
    if records is not None:
        return spark.createDataFrame(records, "item string, external_id string")
    return spark.read.schema("external_id string, item string").option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path).select("item", "external_id")


def records_to_items(records: DataFrame) -> DataFrame:
    """Records as valid items with temporary ids (A3)."""
    return records.select(F.monotonically_increasing_id().alias("item_id"), "item", F.col("external_id").cast("string"), F.lit(True).alias("valid"))


def embed_items(items: DataFrame, embeddings: dict[int, Column]) -> DataFrame:
    """A row for an item and embedding: embedding_id, vec as unit vector, norm, valid (A4, K1)."""
    rows = F.array(*(F.struct(F.lit(i).alias("embedding_id"), v.alias("raw")) for i, v in sorted(embeddings.items())))
    out = items.select("*", F.inline(rows))
    good = F.coalesce(F.col("raw").isNotNull() & ~F.exists("raw", lambda x: F.isnan(x) | x.isNull()), F.lit(False))
    return out.withColumn("valid", F.col("valid") & good).withColumns({"vec": F.when(F.col("valid"), normalise(F.col("raw"))), "norm": F.when(F.col("valid"), norm(F.col("raw")))}).drop("raw")


def load_library(embedded: DataFrame, path: str, job_id: int) -> None:
    """Points partitioned by embedding, and failed records, appended under path (A4, A5).

    The embeddings, which may be costly, are computed in one write, to a folder of the load; points and failures
    are copied from there.
    """
    folder = f"{path}/loads/{uuid.uuid4().hex[:12]}"
    embedded.write.parquet(folder)
    done = embedded.sparkSession.read.schema(embedded.schema).parquet(folder)
    done.filter("valid").drop("valid").write.mode("append").partitionBy("embedding_id").parquet(f"{path}/points")
    done.filter("not valid").select(F.lit(job_id).cast("long").alias("job_id"), "item", "external_id").distinct().write.mode("append").parquet(f"{path}/failures")


def load_summary(embedded: DataFrame) -> DataFrame:
    """(uploaded, failed): records with all embeddings, and the others."""
    records = embedded.groupBy("item_id").agg(F.bool_and("valid").alias("ok"))
    return records.agg(F.count_if("ok").alias("uploaded"), F.count_if(~F.col("ok")).alias("failed"))


def library_info(library: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Points, vector length and metric of each named vector; embeddings: embedding_id, metric."""
    sizes = library.groupBy("embedding_id").agg(F.count("*").alias("points"), F.max(F.size("vec")).cast("long").alias("vector_length"))
    return sizes.join(embeddings.select("embedding_id", "metric"), "embedding_id", "left")


def snapshot(library: DataFrame, path: str, version: str) -> DataFrame:
    """A copy under a version's name, read back."""
    library.write.mode("errorifexists").parquet(f"{path}/{version}")
    return library.sparkSession.read.schema(library.schema).parquet(f"{path}/{version}")


def export_json(results: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    results.write.mode("overwrite").json(path)


def append_failures(failures: DataFrame, path: str) -> None:
    """Failure rows added to the log (A10)."""
    failures.write.mode("append").parquet(path)
