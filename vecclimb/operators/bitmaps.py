"""Partners by compatible marks, from bitmaps of the fragments that bear a mark, counted and read page by page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecclimb.operators.pages import By, PagedTable
from vecclimb.session import ship

#: Bits of one bitmap, as Spark's bitmap functions have them.
BITS = 32_768
#: Parts that the fragments of one kind are dealt to when they meet their page.
SALTS = 32


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, bits, before, low, high) -> (kind, number, rank): set bits whose rank is from low to high."""
    for batch in batches:
        for row in batch.to_pylist():
            numbers = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little"))
            ranks = np.arange(len(numbers)) + row["before"] + 1
            kept = (ranks >= row["low"]) & (ranks <= row["high"])
            n = int(kept.sum())
            columns = [pa.array([row["kind"]] * n, pa.binary()), pa.array(numbers[kept] + row["bucket"] * BITS, pa.int64()), pa.array(ranks[kept], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "number", "rank"])


class PartnerIndex:
    """For every mark the fragments that bear it, as bitmaps of 32,768 numbered fragments each, stored compressed.

    fragments: id (distinct, not null), marks; rules: left_mark, right_mark. Fragments are numbered by id. Those that may stand beside the same
    marks are one kind: the union of these marks' bitmaps is the set of partners of all of them, a fragment itself aside.
    """

    def __init__(self, fragments: DataFrame, rules: DataFrame, path: str, rows_a_range: int = 500_000):
        ship(fragments.sparkSession)
        none = F.array().cast("array<string>")
        held = fragments.select("id", F.array_distinct(F.coalesce("marks", none)).alias("marks"))
        self._numbered = PagedTable.build(held, [By("id")], f"{path}/fragments", rows_a_range).rows().withColumnRenamed("place", "number")
        spark, borne = fragments.sparkSession, self._numbered.select("number", F.explode("marks").alias("mark")).filter("mark is not null")
        bucket, bit = F.floor(F.col("number") / BITS).cast("long"), F.col("number") % BITS
        bitmaps = borne.groupBy("mark", bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
        bitmaps.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/bitmaps")
        self._bitmaps = spark.read.schema(bitmaps.schema).parquet(f"{path}/bitmaps")
        # the marks that a fragment's own let stand beside it; a fragment without any has no partner and no row
        allowed = rules.select("left_mark", "right_mark").dropna().distinct()
        meets = self._numbered.select("id", F.explode("marks").alias("left_mark")).join(allowed, "left_mark")
        wanted = meets.groupBy("id").agg(F.array_sort(F.collect_set("right_mark")).alias("wanted"))
        kind = F.unhex(F.sha2(F.to_json(F.struct("wanted")), 256))
        itself = F.arrays_overlap(F.array_compact("marks"), "wanted")
        judged = wanted.join(self._numbered.select("id", "marks"), "id").select("id", kind.alias("kind"), "wanted", itself.alias("itself"))
        judged.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/kinds")
        self._kinds = spark.read.schema(judged.schema).parquet(f"{path}/kinds")

    def _partners(self, kinds: DataFrame) -> DataFrame:
        """(kind, bucket, bits, n): the union of the bitmaps of each kind's marks, and its bits."""
        each = kinds.groupBy("kind").agg(F.first("wanted").alias("wanted")).select("kind", F.explode("wanted").alias("mark"))
        return each.join(self._bitmaps, "mark").groupBy("kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("n", F.bitmap_count("bits"))

    def _met(self, left: DataFrame, of_kind: DataFrame) -> DataFrame:
        """left joined to one row a kind; the fragments of a kind are dealt to SALTS parts."""
        dealt = left.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        copied = of_kind.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return dealt.join(copied, ["kind", "_salt"]).drop("_salt")

    def counts(self) -> DataFrame:
        """(id, partners) of every fragment, without a pair."""
        sizes = self._partners(self._kinds).groupBy("kind").agg(F.sum("n").alias("n"))
        found = self._met(self._kinds.select("id", "kind", "itself"), sizes).select("id", (F.col("n") - F.col("itself").cast("long")).alias("partners"))
        return self._numbered.select("id").join(found, "id", "left").select("id", F.coalesce("partners", F.lit(0)).cast("long").alias("partners"))

    def page(self, offset: int, limit: int, left: DataFrame | None = None) -> DataFrame:
        """(left_id, place, right_id): the partners of each fragment, or of those of left (id), from place offset + 1 on, limit at most, by id.

        Only the bitmaps in which a kind's page lies are taken apart. A fragment that fits itself shifts those after it by one.
        """
        if offset < 0 or limit < 1:
            raise ValueError("offset is 0 or more, limit 1 or more")
        asked = self._kinds if left is None else self._kinds.join(left.select("id").distinct(), "id", "left_semi")
        so_far = F.sum("n").over(Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        low, high = offset + 1, offset + limit + 1
        sizes = self._partners(asked).withColumn("before", so_far - F.col("n"))
        reached = sizes.filter((F.col("before") < high) & (F.col("before") + F.col("n") >= low))
        ranked = reached.select("kind", "bucket", "bits", "before", F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high")).mapInArrow(_ranked, "kind binary, number long, rank long")
        named = ranked.join(self._numbered.select("number", F.col("id").alias("right_id")), "number")
        pages = named.groupBy("kind").agg(F.collect_list(F.struct("rank", "right_id")).alias("page"))  # limit + 1 entries at most
        met = self._met(asked.select("id", "kind", "itself"), pages).select(F.col("id").alias("left_id"), "itself", F.inline("page"))
        place = F.col("rank") - (F.col("itself") & (F.col("right_id") > F.col("left_id"))).cast("long")
        return met.filter("left_id <> right_id").select("left_id", place.alias("place"), "right_id").filter(F.col("place").between(offset + 1, offset + limit))
