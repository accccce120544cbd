"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecclimb.llm.skew import hot_keys, spread_join
from vecclimb.session import Workspace


def _to_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows with m of their u; a u with more than its share of the rows, a hub, is dealt to several tasks.

    least: u, m and n, the rows of u.
    """
    return spread_join(rows, least.select("u", "m"), ["u"], hot_keys(least, ["u"], "n", total))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _to_least(both.filter("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    rest = _to_least(edges, least, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, work: Workspace, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges: columns u and v. Loops, repeated and reversed edges and null ends are allowed and add
    nothing. Each round ends in a table in the shared folder, so lost executors cost one round.
    The rounds stop when the edges stay as they were; RuntimeError if they never do.
    """
    current = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = work.save(current, "cc0")
    mark = (current.count(), None)
    for i in range(1, most_rounds + 1):
        starred = _large_star(current, mark[0]).distinct()
        following = work.save(_small_star(starred, mark[0]).distinct(), f"cc{i}")
        found = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"cc{i - 1}")
        current = following
        if tuple(found) == mark:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark = tuple(found)
    raise RuntimeError("components did not settle")
