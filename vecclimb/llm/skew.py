"""Joins of rows that may share one key by the thousand with a table of one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast as hot at most, and the rows that no key needs salts for.
MOST_HOT, LEAST_ROWS = 10_000, 1_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """(keys, _salts) of the keys with more than a MOST_HOT-th of all rows, and more than LEAST_ROWS.

    counts: keys and n, the rows of a key. There are never more than MOST_HOT such keys.
    """
    most = max(LEAST_ROWS, total // MOST_HOT)
    return counts.filter(F.col(n) > most).select(*keys, F.ceil(F.col(n) / most).alias("_salts"))


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """rows joined to few, which has one row a key; the rows of hot keys are dealt to several partitions.

    few grows with the rows, so the plan is the same at every size: it is not broadcast where it happens to be small.
    """
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts)).drop("_salts")
    right = few.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))).drop("_salts")
    return left.join(right.hint("merge"), [*keys, "_salt"]).drop("_salt")
