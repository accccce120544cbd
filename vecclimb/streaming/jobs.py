"""Incremental work: pending jobs, caches with a time to live, and growing libraries (M1-M6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(jobs: DataFrame, cursor: int) -> DataFrame:
    """New auto-run jobs beyond the cursor, marked queued (M1, as a batch)."""
    return jobs.filter((F.col("job_id") > cursor) & (F.col("status") == "created") & F.col("auto_run")).withColumn("status", F.lit("queued"))


def stream_pending(spark: SparkSession, path: str, schema: str, delay: str = "1 day") -> DataFrame:
    """Pending jobs of Parquet files as they come, each id once (M1, M2).

    created_at is the event time: ids are remembered for `delay`, so that state stays bounded.
    """
    jobs = spark.readStream.schema(schema).parquet(path)
    return jobs.filter("status = 'created' and auto_run").withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["job_id"]).withColumn("status", F.lit("queued"))


def alive(cache: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Good results that are not older than the cache's life (M3)."""
    return cache.filter(F.col("valid") & (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("created_at") <= seconds))


def cleared(cache: DataFrame, plugin_id: int) -> DataFrame:
    """The cache without a plugin's rows (M4)."""
    return cache.filter(~F.col("key").startswith(f"plugin:{plugin_id}:"))


def failed_jobs(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, status) of jobs whose run failed or was cancelled, the last event deciding (M5)."""
    last = events.filter("run_status in ('FAILURE', 'CANCELED')").groupBy("job_id").agg(F.max_by("run_status", F.struct("ts", "event_id")).alias("run_status"))
    return jobs.join(last, "job_id").select("job_id", F.when(F.col("run_status") == "FAILURE", "failed").otherwise("cancelled").alias("status"))


def stream_library(spark: SparkSession, source: str, target: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame]):
    """A query that embeds records of CSV files as they come, and adds them to a library (M6)."""
    rows = spark.readStream.schema("external_id string, item string").option("header", True).csv(source)
    return embed(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
