"""Balanced label propagation: linked documents move into one shard, shards stay even.

DataFrame functions only. Documents of equal text are linked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecclimb.llm.skew import hot_keys, spread_join
from vecclimb.session import Workspace

#: Rows that one bucket of a ranking holds on average.
BUCKET_ROWS = 20_000


def _summed(rows: DataFrame, keys: list[str], order: list[Column], spread: Column, weight: Column, n: int, name: str) -> DataFrame:
    """rows with `name`: the sum of the weights of all rows before it within keys, in the order of spread and then order.

    spread is a number from 0 up to 1. It cuts the rows of a key into buckets by range; buckets are
    summed, and the sums of a bucket follow those of the ones before it. So no task sorts a whole
    key, and the window over the sums sees n / BUCKET_ROWS rows of a key.
    """
    buckets = max(64, n // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.floor(spread * buckets).cast("int")).withColumn("_w", weight)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_row", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return rows.join(offsets, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_row")).drop("_bucket", "_before", "_row", "_w")


def _unit(*columns: str | Column) -> Column:
    """A hash from 0 up to 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def _by_shard(rows: DataFrame, key: str, value: str, shards: int) -> list[int]:
    """The sums of value for every shard, from as many rows as shards."""
    sums = {r[0]: r[1] for r in rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value)).collect()}
    return [sums.get(k, 0) for k in range(shards)]


def _granted(asking: DataFrame, first: Column, room: list[int], whole_from: int, n: int) -> DataFrame:
    """asking (grp, to, c) with take, what the shard `to` takes of the c rows: as many as its room allows, the first in the order of `first`.

    first is a number above 1, the greater the earlier: what comes first by its whole logarithm, then by a hash. A request is
    granted whole or not at all, but for those of more than whole_from rows, which no shard could take whole.
    """
    spread = 1 - (F.floor(F.log2(first.cast("double"))) + _unit("grp", "to")) / 64
    classes = 64 * (n // BUCKET_ROWS + 1) * BUCKET_ROWS  # a class is a 64-th of the buckets
    asking = _summed(asking.withColumn("_spread", spread), ["to"], [F.col("_spread"), F.col("grp"), F.col("c")], F.col("_spread"), F.col("c"), classes, "_ahead")
    free = F.greatest(F.element_at(F.array(*map(F.lit, room)), F.col("to") + 1) - F.col("_ahead"), F.lit(0))
    return asking.withColumn("take", F.when(F.col("c") <= free, F.col("c")).when(F.col("c") > whole_from, free).otherwise(0)).drop("_spread", "_ahead")


def propagate(labels: DataFrame, quota: list[int], work: Workspace) -> DataFrame:
    """(grp, shard, c): how many documents of every group end in which shard, no shard taking more than its quota.

    labels: (grp, shard, c), the documents of a group by the shard that they start in; a group's documents are each other's
    neighbours. In every round the documents of a group that have no place ask for the shard that most of its neighbours are in,
    among those with room for all of them; where none of these has, a shard that has, by a hash. Larger groups come first. Groups
    that fit nowhere as a whole are cut where the room ends, before any others have a place. Then groups in several shards pull their smaller parts after their
    largest, by the pairs that this saves, until no move is left that cuts fewer edges. A round is a few joins and one table; groups
    of any size are at most a row a shard.
    """
    shards = len(quota)
    sizes = labels.groupBy("grp").agg(F.sum("c").alias("linked")).filter("linked > 1")
    labels = work.save(labels.join(sizes.drop("linked"), "grp", "left_semi"), "labels")
    waiting = work.save(sizes.select("grp", "linked", F.col("linked").alias("c")), "waiting")
    room, tables, i = list(quota), [], 0
    while True:
        most = max(room)
        n, large = waiting.agg(F.count("*"), F.count_if(F.col("c") > most)).first()
        if not n:
            break
        later = waiting.filter(F.col("c") <= most) if large else waiting.limit(0)  # what fits waits for what must be cut
        waiting = waiting.filter(F.col("c") > most) if large else waiting
        of = lambda s, rooms=tuple(room): F.element_at(F.array(*map(F.lit, rooms)), s + 1)
        need = F.least("c", F.lit(most))
        near = waiting.select("grp", "c").join(labels.select("grp", "shard", F.col("c").alias("_near")), "grp").filter(of(F.col("shard")) >= need)
        near = near.groupBy("grp").agg(F.max_by("shard", F.struct("_near", F.xxhash64("grp", "shard"))).alias("to"))
        open_ = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: of(s) >= need)
        drawn = F.element_at(open_, (F.pmod(F.xxhash64("grp", F.lit(i)), F.size(open_)) + 1).cast("int"))
        asking = waiting.join(near, "grp", "left").withColumn("to", F.coalesce("to", drawn))
        asking = work.save(_granted(asking, F.col("linked"), room, most, n), f"asked{i}")
        tables.append(asking.filter("take > 0").select("grp", F.col("to").alias("shard"), F.col("take").alias("c")))
        room = [r - t for r, t in zip(room, _by_shard(asking, "to", "take", shards))]
        refused = asking.filter("take < c").select("grp", "linked", (F.col("c") - F.col("take")).alias("c"))
        waiting = work.save(refused.unionByName(later), f"waiting{i}")
        i += 1
    if not tables:
        return labels
    parts = work.save(reduce(DataFrame.unionByName, tables).groupBy("grp", "shard").agg(F.sum("c").alias("c")), "parts0")
    i = 0
    while True:
        best = parts.groupBy("grp").agg(F.count("*").alias("_n"), F.max(F.struct("c", F.xxhash64("grp", "shard").alias("tie"), "shard")).alias("_b")).filter("_n > 1")
        asking = parts.join(best.select("grp", F.col("_b.shard").alias("to"), F.col("_b.c").alias("_near")), "grp").filter(F.col("shard") != F.col("to"))
        asking = work.save(_granted(asking, F.col("_near") + 1, room, 1 << 62, 1), f"pulled{i}")  # whole parts alone
        moved = asking.filter("take > 0")
        gone, come = _by_shard(moved, "shard", "c", shards), _by_shard(moved, "to", "c", shards)
        if not any(gone):
            return parts
        room = [r + a - b for r, a, b in zip(room, gone, come)]
        moves = moved.select("grp", "shard", "to")
        parts = parts.join(moves, ["grp", "shard"], "left").select("grp", F.coalesce("to", "shard").alias("shard"), "c")
        i += 1
        parts = work.save(parts.groupBy("grp", "shard").agg(F.sum("c").alias("c")), f"parts{i}")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for a row; the law is `rows`.

    Shards differ by one document at most. size is the text's UTF-8 bytes and 16, slot is gapless from 0
    within a shard, grown_shard is null under this law.

    Documents start in the shard of a hash of the id. Groups of equal texts propagate (see propagate()): their documents move to the
    shards of their neighbours while these have room. Then shards above their quota give up unlinked documents, which no edge holds,
    and the places of the others are filled with them.

    A null text is empty but linked with nothing. Rows that share a doc_id are documents of their own. A
    null id is allowed; further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    text = F.col("_t")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
    rows = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("hash"),
    )
    # two hashes and the size stand for the text; rows without an id are told apart by their places
    rows = rows.withColumn("place", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    base = work.save(rows.withColumn("grp", F.when(F.col("hash").isNotNull(), F.xxhash64("hash", "text_crc32", "size"))).drop("hash"), "base")
    n = base.count()
    if not n:
        return base.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    quota = [n // shards + (k < n % shards) for k in range(shards)]
    start = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int")
    parts = propagate(base.filter("grp is not null").groupBy("grp", start.alias("shard")).agg(F.count("*").alias("c")), quota, work)

    # a row a group: its parts as ranges of its documents' numbers
    ahead = F.coalesce(F.sum("c").over(Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a shard at most
    ranges = parts.withColumn("low", ahead).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("low", "shard"))).alias("ranges"))
    counts = base.filter("grp is not null").groupBy("grp").agg(F.count("*").alias("linked"))
    groups = work.save(counts.join(ranges, "grp", "left"), "groups")
    linked = spread_join(base.filter("grp is not null"), groups, ["grp"], hot_keys(groups, ["grp"], "linked", n))
    linked = work.save(linked.unionByName(base.filter("grp is null"), allowMissingColumns=True).withColumn("linked", F.coalesce("linked", F.lit(1))), "linked")
    own = _unit("doc_id", "text_crc32", "place")
    columns = ["doc_id", "size", "text_crc32", "place", "linked"]
    cut = _summed(linked.filter("size(ranges) > 1"), ["grp"], [own, F.col("doc_id")], own, F.lit(1), n, "nth")
    cut = cut.select(*columns, F.element_at(F.filter("ranges", lambda r: r["low"] <= F.col("nth")), -1)["shard"].alias("shard"))
    whole = linked.filter("ranges is null or size(ranges) = 1").select(*columns, F.coalesce(F.get("ranges", F.lit(0))["shard"], start).alias("shard"))
    state = cut.unionByName(whole)

    # linked documents first: they are within the quota
    spread = F.when(F.col("linked") > 1, own / 2).otherwise(0.5 + own / 2)
    order = [spread, F.col("doc_id"), F.col("text_crc32")]
    homed = work.save(_summed(state, ["shard"], order, spread, F.lit(1), n // shards, "slot"), "homed")
    held = _by_shard(homed.withColumn("one", F.lit(1)), "shard", "one", shards)
    lack = [max(0, q - h) for q, h in zip(quota, held)]
    ends = [sum(lack[: k + 1]) for k in range(shards)]
    stays = F.col("slot") < F.element_at(F.array(*map(F.lit, quota)), F.col("shard") + 1)
    stay = homed.filter(stays).select("doc_id", "size", "text_crc32", "shard", "slot")
    spare = _summed(homed.filter(~stays).drop("slot").withColumn("all", F.lit(0)), ["all"], order, spread, F.lit(1), n, "nth")
    to = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("nth")))
    begins = F.array(*(F.lit(e - x) for e, x in zip(ends, lack)))
    first_free = F.array(*(F.lit(q - x) for q, x in zip(quota, lack)))
    filled = spare.withColumn("to", to).select("doc_id", "size", "text_crc32", F.col("to").alias("shard"), (F.element_at(first_free, F.col("to") + 1) + F.col("nth") - F.element_at(begins, F.col("to") + 1)).alias("slot"))
    return stay.unionByName(filled).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
