"""Deep pages of an ordered table: counted ranges of its order, so that a page sorts the ranges it lies in and no others."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ranges of a table at most: their counts are held by the driver.
MOST_RANGES = 20_000


@dataclass(frozen=True)
class By:
    """A column of an order. Nulls come first where it ascends and last where it descends, unless said otherwise."""

    name: str
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def _last(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    @property
    def column(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_last() if self._last else c.desc_nulls_first()
        return c.asc_nulls_last() if self._last else c.asc_nulls_first()

    def after(self, value) -> Column:
        """Whether the column's value comes after the given one in the order."""
        c = F.col(self.name)
        if value is None:
            return F.lit(False) if self._last else c.isNotNull()
        beyond = F.coalesce(c < F.lit(value) if self.descending else c > F.lit(value), F.lit(False))
        return beyond | c.isNull() if self._last else beyond


def after_key(order: list[By], key: dict) -> Column:
    """Whether a row comes after the key's values of all columns of the order."""
    levels = []
    for i, by in enumerate(order):
        same = [F.col(b.name).eqNullSafe(F.lit(key[b.name])) for b in order[:i]]
        levels.append(reduce(Column.__and__, same, by.after(key[by.name])))
    return reduce(Column.__or__, levels)


class PagedTable:
    """A table stored by ranges of an order, with the number of rows of each.

    The order must end in a column that tells all rows apart (rows equal in all its columns stand in no defined order). So ranges
    are even however many rows share a score or have none. Columns _range and place are the table's own.
    """

    def __init__(self, spark: SparkSession, path: str):
        """Open a table that build() has written."""
        self.spark, self.path = spark, path
        known = json.loads(spark.read.text(f"{path}/known").first()[0])
        self.order = [By(**by) for by in known["order"]]
        self._histogram = spark.read.parquet(f"{path}/ranges")
        self.counts = [(r["_range"], r["n"]) for r in self._histogram.select("_range", "n").orderBy("_range").collect()]
        self.total = sum(n for _, n in self.counts)
        self._stored = spark.read.schema(StructType.fromJson(known["schema"])).parquet(f"{path}/rows")

    @classmethod
    def build(cls, rows: DataFrame, order: list[By], path: str, rows_a_range: int = 500_000) -> "PagedTable":
        """Sort rows into ranges of some rows_a_range rows below path, and count them; ValueError for clashing names.

        Tables of more than MOST_RANGES such ranges get larger ones. Rows is read twice: to be counted and to be written.
        """
        if taken := {"_range", "place"} & set(rows.columns):
            raise ValueError(f"columns of the table's own: {sorted(taken)}")
        spark = rows.sparkSession
        parts = min(MOST_RANGES, max(1, -(-rows.count() // rows_a_range)))
        by = [b.column for b in order]
        ranged = rows.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *by)
        ranged.write.mode("overwrite").partitionBy("_range").option("compression", "zstd").parquet(f"{path}/rows")
        stored = spark.read.schema(ranged.schema).parquet(f"{path}/rows")
        last = Window.partitionBy("_range").orderBy(*[b.column for b in _reversed(order)])
        ends = stored.select("_range", *(b.name for b in order)).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
        counted = ends.join(stored.groupBy("_range").agg(F.count("*").alias("n")), "_range")
        counted.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        known = json.dumps({"order": [asdict(b) for b in order], "schema": ranged.schema.jsonValue()})
        spark.createDataFrame([(known,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/known")
        return cls(spark, path)

    def _placed(self, ranges: list[tuple[int, int]], start: int) -> DataFrame:
        """The rows of neighbouring ranges with their place in the table, from 0; start: the rows before them."""
        names = [c for c in self._stored.columns if c != "_range"]
        if not ranges:
            return self._stored.filter("false").select(*names, F.lit(0).cast("long").alias("place"))
        first, last = ranges[0][0], ranges[-1][0]
        starts, before = [], start
        for number, n in ranges:
            starts.append((number, before))
            before += n
        known = F.broadcast(self.spark.createDataFrame(starts, "_range int, _start long"))
        within = Window.partitionBy("_range").orderBy(*[b.column for b in self.order])
        held = self._stored.filter(F.col("_range").between(first, last))
        numbered = held.withColumn("_n", F.row_number().over(within)).join(known, "_range")
        return numbered.select(*names, (F.col("_start") + F.col("_n") - 1).alias("place"))

    def rows(self) -> DataFrame:
        """All rows with their place; each range is numbered in a task of its own."""
        return self._placed(self.counts, 0)

    def covering(self, offset: int, limit: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """(the ranges, each with its rows, that hold a page; the number of rows before the first)."""
        end = self.total if limit is None else min(self.total, offset + limit)
        chosen, start, seen = [], 0, 0
        for number, n in self.counts:
            if seen < end and seen + n > offset:
                start = start if chosen else seen
                chosen.append((number, n))
            seen += n
        return chosen, start

    def page(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """The rows from offset on with their place, in order; without limit all of them.

        Only the ranges that hold them are read and sorted, whatever the offset.
        """
        if offset < 0 or (limit is not None and limit < 0):
            raise ValueError("offset and limit are 0 or more")
        ranges, start = self.covering(offset, limit)
        out = self._placed(ranges, start).filter(F.col("place") >= offset)
        out = out if limit is None else out.filter(F.col("place") < offset + limit)
        return out.orderBy("place")

    def after(self, key: dict, limit: int | None = None) -> DataFrame:
        """The rows after a key (the order's columns of a page's last row, which need not be stored any more) with their place, in order."""
        if limit is not None and limit < 0:
            raise ValueError("limit is 0 or more")
        reached = {r["_range"] for r in self._histogram.filter(after_key(self.order, key)).select("_range").collect()}
        chosen, start, more = [], 0, 0
        for number, n in self.counts:
            if number not in reached:
                start += n
            elif limit is None or more < limit or not chosen:
                more += n if chosen else 0  # of the first range one row is certain at least
                chosen.append((number, n))
        out = self._placed(chosen, start).filter(after_key(self.order, key)).orderBy("place")
        return out if limit is None else out.limit(limit)


def _reversed(order: list[By]) -> list[By]:
    return [By(b.name, not b.descending, not b._last) for b in order]
