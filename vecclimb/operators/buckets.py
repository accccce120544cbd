"""Upserts into bucketed tables: a batch is shuffled to the table's buckets, the table itself never."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecclimb.operators.windows import last_seen


def write_bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """Rows as an external table bucketed by keys, with one sorted file a bucket."""
    _writer(rows.repartition(buckets, *keys), keys, buckets, path).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def _writer(rows: DataFrame, keys: list[str], buckets: int, path: str):
    return rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet")


def upserted(target: DataFrame, updates: DataFrame, keys: list[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(the rows of target, updated where the batch has their key; the rows of new keys): by the last update of a key.

    Nulls in keys equal nothing, so their rows are always new. Both plans keep the buckets of target: the first is a left join that
    brings at most one row a key, the second an anti-join of the batch.
    """
    rest = [c for c in target.columns if c not in keys]
    last = last_seen(updates, keys, seq)
    given = last.select(*keys, F.struct(*rest).alias("_new"))
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    kept = target.join(given, keys, "left").select(*(F.col(c) if c in keys else value(c) for c in target.columns))
    return kept, last.select(*target.columns).join(target.select(*keys), keys, "left_anti")


def upsert_bucketed(name: str, updates: DataFrame, keys: list[str], buckets: int, following: str, path: str, seq: str = "seq") -> DataFrame:
    """The next version of the bucketed table name, as the table following at path; the old one stays as it is.

    A version is whole once this returns; one that a broken run left is written anew.
    """
    kept, fresh = upserted(updates.sparkSession.table(name), updates, keys, seq)
    _writer(kept, keys, buckets, path).mode("overwrite").saveAsTable(following)
    _writer(fresh, keys, buckets, path).mode("append").saveAsTable(following)
    return updates.sparkSession.table(following)
