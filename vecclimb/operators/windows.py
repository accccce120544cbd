"""First and last rows, and pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes last in the order, given descending."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def last_seen(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key, by an aggregate that combines before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def first_seen(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def top_result(rows: DataFrame, keys: list[str], score: str = "score", seq: str = "seq") -> DataFrame:
    """The best row of each iteration, the last of equals; null scores lose."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score).isNotNull(), score, seq)).alias("_r")).select(*keys, "_r.*")


def page(rows: DataFrame, *order: Column, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Sorted rows from offset on; without limit all of them."""
    out = rows.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def valid_page(rows: DataFrame, *order: Column, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of the valid rows alone, each with the number of all valid rows."""
    valid = rows.filter("valid")
    total = valid.agg(F.count("*").alias("total"))
    return page(valid, *order, offset=offset, limit=limit).join(F.broadcast(total))
