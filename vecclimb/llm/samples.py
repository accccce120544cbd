"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int, most_chars: int) -> DataFrame:
    """(doc_id, text, y) of up to `most` documents of either label, none of the held-out fold.

    The ids are the first in the order of a hash of the id, of either label while their texts have most_chars
    characters together at most; a longer text on the way makes room for shorter ones after it. Ids
    with several rows count once (the least text); ids with differing labels, and null labels, are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") > 0)
    chosen = known.filter("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).unionByName(known.filter("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # at most 2 * most ids and lengths go to the driver and are broadcast
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max(F.length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    room, taken = {0: most_chars, 1: most_chars}, []
    for doc_id, y, n in sizes:
        if n <= room[y]:
            room[y] -= n
            taken.append((doc_id, y))
    few = docs.sparkSession.createDataFrame(taken, "doc_id long, y int")
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
