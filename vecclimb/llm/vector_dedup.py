"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecclimb.llm.components import connected_components
from vecclimb.llm.skew import hot_keys, spread_join
from vecclimb.session import Workspace, ship

#: Vectors of one block of a bucket; a larger bucket is compared block by block.
BLOCK = 512


def _projections(size: int, tables: int, width: float, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1234 + size))
    return rng.standard_normal((size, tables * hashes)), rng.random(tables * hashes) * width


def _hash(tables: int, hashes: int, width: float):
    """Rows with unit vectors and, for each table, a hash of the quantised projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 2048):
                part = batch.slice(low, 2048)
                column = part.column(2)
                ends = column.offsets.to_numpy()
                flat, ends = column.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]
                values, null = flat.fill_null(np.nan).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
                vectors = [np.zeros(0) if null[i] else values[ends[i] : ends[i + 1]] for i in range(len(part))]
                unit, keys = [None] * len(part), [None] * len(part)
                for size in {len(v) for v in vectors} - {0}:
                    at = [i for i, v in enumerate(vectors) if len(v) == size]
                    x = np.stack([vectors[i] for i in at])
                    peak = np.abs(x).max(axis=1, keepdims=True)
                    good = np.isfinite(x).all(axis=1) & (peak[:, 0] > 0)
                    x, at = x[good] / peak[good], np.array(at)[good]
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    a, b = _projections(size, tables, width, hashes)
                    cells = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64)
                    key = np.full((len(at), tables), size, np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(hashes):
                            key = (key ^ cells[:, j::hashes]) * np.uint64(0x9E3779B97F4A7C15)
                            key ^= key >> np.uint64(29)
                    for i, u, k in zip(at, x, key.view(np.int64)):
                        unit[i], keys[i] = u.tobytes(), k
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(unit, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["vec_id", "label", "unit", "keys"])

    return run


def _links(table: int, nodes: np.ndarray, copies: np.ndarray, units: list[bytes], keys: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(node, links, other) of one pair of blocks, given by the rows left and right (the same for one block).

    Rows with node = other count links; the others are a forest of them. A pair counts in the first
    table that it shares, so that no pair counts twice.
    """
    x = np.stack([np.frombuffer(units[i], np.float64) for i in left])
    y = x if left is right else np.stack([np.frombuffer(units[i], np.float64) for i in right])
    i, j = np.nonzero(x @ y.T >= least - 1e-9)
    if left is right:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return []
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], y[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
    first = exact >= least
    p, q = keys[left], keys[right]
    for t in range(table):
        first &= p[i, t] != q[j, t]
    i, j = i[first], j[first]
    u, v = nodes[left], nodes[right]
    counts = np.bincount(i, copies[right][j], len(u)), np.bincount(j, copies[left][i], len(v))
    out = [(z, int(c), z) for ids, cs in zip((u, v), counts) for z, c in zip(ids.tolist(), cs.tolist()) if c]
    root: dict[int, int] = {}

    def top(z: int) -> int:
        while root.get(z, z) != z:
            root[z] = root.get(root[z], root[z])
            z = root[z]
        return z

    for s, t in zip(u[i].tolist(), v[j].tolist()):
        s0, t0 = top(s), top(t)
        if s0 != t0:
            root[max(s0, t0)] = min(s0, t0)
            out.append((s, 0, t))
    return out


def _compare(least: float):
    """Links within the runs of rows of one table, bucket and pair of blocks; rows come sorted by these."""

    def groups(rows: pa.Table, whole: bool) -> tuple[list, pa.Table]:
        by = np.stack([rows.column(c).to_numpy() for c in ("t", "bucket", "lo", "hi")])
        cuts = np.flatnonzero(np.append(True, (by[:, 1:] != by[:, :-1]).any(axis=0)))
        ends = np.append(cuts[1:], rows.num_rows)
        if not whole:
            cuts, ends = cuts[:-1], ends[:-1]
        stop = int(ends[-1]) if len(ends) else 0
        done = rows.slice(0, stop).combine_chunks()
        out: list[tuple[int, int, int]] = []
        if stop:
            nodes, copies, block = (done.column(c).to_numpy() for c in ("node", "copies", "block"))
            units = done.column("unit").to_pylist()
            keys = done.column("keys").chunk(0).flatten().to_numpy().reshape(stop, -1)
            for a, b in zip(cuts.tolist(), ends.tolist()):
                if b - a > 1:
                    at = np.arange(a, b)
                    left = at[block[a:b] == by[2, a]]
                    right = left if by[2, a] == by[3, a] else at[block[a:b] == by[3, a]]
                    if len(left) and len(right):
                        out += _links(int(by[0, a]), nodes, copies, units, keys, left, right, least)
        return out, rows.slice(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [()] * 3)], schema=schema)
        for batch in batches:
            for low in range(0, len(batch), 4096):
                part = pa.Table.from_batches([batch.slice(low, 4096)])
                out, rest = groups(pa.concat_tables([rest, part]) if rest is not None else part, False)
                if out:
                    yield pack(out)
        if rest is not None and rest.num_rows:
            yield pack(groups(rest, True)[0])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = 24, hashes: int = 14, width: float = 1.8, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): the links and the near-duplicate group of every vector.

    Two vectors of one label are linked if they share a bucket and their cosine, in double precision, is
    at least `least`. Each of `tables` tables puts a unit vector in the bucket of `hashes` quantised
    Gaussian projections; with a cosine of 0.98 two vectors miss all 24 tables with a probability
    of about 0.05 %. n_links counts the other vectors linked directly, component_id is the
    smallest vec_id reachable.

    Vectors of equal label and direction bit for bit are one node, named by one of their rows, with a count of
    copies. Buckets are salted into blocks of BLOCK nodes, compared by pairs of blocks; only counts and a forest
    of the links leave a task, so that a hot bucket is neither collected nor written as pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those of a null
    label, link with nothing. Vectors of different lengths are not compared. Rows that share a vec_id
    are told apart by label and direction, and count as copies of each other where both are equal; a null
    vec_id is returned and counts as a vector, and stands for a group only if all its ids are null. An empty
    table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    work = Workspace(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    hashed = rows.mapInArrow(_hash(tables, hashes, width), "vec_id long, label long, unit binary, keys array<long>")
    hashed = hashed.withColumns({"class": F.when(F.col("unit").isNotNull() & F.col("label").isNotNull(), F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), "unit"))), "row": F.monotonically_increasing_id()})
    hashed = work.save(hashed, "hashed")  # the written number of a row is its name from here on
    total = hashed.count()
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"), "row"))
    classes = hashed.filter("class is not null").groupBy("class").agg(first.alias("best"), F.count("*").alias("copies"))
    classes = work.save(classes.select("class", F.col("best.row").alias("node"), F.col("best.id").alias("id"), "copies"), "classes")
    nodes = hashed.select(F.col("row").alias("node"), "label", "unit", "keys").join(classes.select("node", "copies"), "node")
    nodes = work.save(nodes, "nodes")

    placed = nodes.select("node", "label", F.posexplode("keys").alias("t", "bucket"))
    full = work.save(placed.groupBy("t", "label", "bucket").agg(F.count("*").alias("m")).filter("m > 1"), "full")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    by_bucket = ["t", "label", "bucket"]
    dealt = spread_join(placed, full, by_bucket, hot_keys(full, by_bucket, "m", total * tables)).select("t", "label", "bucket", "node", blocks.alias("n"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    dealt = dealt.select("t", F.xxhash64("label", "bucket").alias("bucket"), "node", "block", F.explode(F.expr("transform(sequence(0, n - 1), o -> struct(least(o, block) as lo, greatest(o, block) as hi))")).alias("at"))
    dealt = dealt.select("t", "bucket", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), "block", "node").join(nodes.drop("label"), "node")
    by = ["t", "bucket", "lo", "hi"]
    sorted_ = dealt.select(*by, "block", "node", "unit", "keys", "copies").repartition(*by).sortWithinPartitions(*by, "node")
    found = work.save(sorted_.mapInArrow(_compare(least), "node long, links long, other long"), "found")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v")), work)
    linked = work.save(classes.select("node", "id").join(groups, "node"), "linked")
    # the least id of a component; null only if all its ids are
    tops = work.save(linked.groupBy("component").agg(F.min("id").alias("top"), F.count("*").alias("n")), "tops")
    least_id = spread_join(linked.select("node", "component"), tops.select("component", "top"), ["component"], hot_keys(tops, ["component"], "n", total)).select("node", "top", F.lit(True).alias("grouped"))
    known = classes.join(counts, "node", "left").join(least_id, "node", "left").select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("grouped"), F.col("top")).otherwise(F.col("id")).alias("component_id"))
    out = spread_join(hashed.filter("class is not null").select("vec_id", "class"), known, ["class"], hot_keys(classes, ["class"], "copies", total)).select("vec_id", "n_links", "component_id")
    out = out.unionByName(hashed.filter("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
