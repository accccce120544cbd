"""Near-duplicate documents by MinHash, banding, verification and connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecclimb.llm import words as W
from vecclimb.llm.bitmap import bitmap_of, passes
from vecclimb.llm.components import connected_components
from vecclimb.llm.skew import hot_keys, spread_join
from vecclimb.session import Workspace, ship

#: Buckets of up to so many different texts give their pairs directly; larger ones give a star and,
#: where the star leaves anything open, blocks of about so many texts or shingles.
SMALL, BLOCK_TEXTS, BLOCK_SHINGLES = 8, 1024, 1_000_000
#: Bits of the bitmap of the texts whose full sets are needed: 8 MB, whatever their number.
WANTED_BITS = 26


def shingles(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, sorted hashes of its distinct n-word shingles) for all texts."""
    for first, w in W.each(texts, W.NOT_SPACE):
        runs = W.windows(w.hashes, n)
        for k in range(len(w.bounds) - 1):
            low, high = w.bounds[k], w.bounds[k + 1]
            if high - low >= n:
                yield first + k, np.unique(runs[low : high - n + 1])
            elif high > low:
                yield first + k, W.windows(w.hashes[low:high], int(high - low))
            else:
                yield first + k, np.zeros(0, np.uint64)


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(97))
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash x -> a x + b mod 2 ** 64 over the values."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(out, (values[None, i : i + 1024] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(bands * rows)
        salt = W.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sizes, digests, signatures, keys = [], [], [], []
            for _, found in shingles(batch.column(0), n):
                sizes.append(len(found))
                if not len(found):
                    digests.append(None), signatures.append(None), keys.append(None)
                    continue
                low = minima(found, a, b)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signatures.append((W.mix(low) >> np.uint64(48)).astype("<u2").tobytes())
                key = salt.copy()
                for j in range(rows):
                    key = W.mix(key * np.uint64(0xD6E8FEB86659FD93) + low[j::rows])
                keys.append(key.view(np.int64))
            found = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "n_shingles", "digest", "signature", "keys"])

    return run


def _sets(n: int, wanted):
    """Full sets of the texts (row, hash, text) whose hash is in the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted.value, batch.column(1).to_numpy())))
            ids, low = batch.column(0), 0
            out: list[bytes] = []
            size = 0
            for k, found in shingles(batch.column(2), n):
                out.append(found.tobytes())
                size += 8 * len(found)
                if size > 1 << 24 or k == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(low, len(out)), pa.array(out, pa.binary())], names=["node", "items"])
                    low, out, size = k + 1, [], 0

    return run


def linked(both: int, x: int, y: int, percent: int) -> bool:
    return 100 * both >= percent * (x + y - both)


def _alike(least: int):
    """Keep pairs whose signatures agree in at least `least` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sx").to_pylist(), batch.column("sy").to_pylist()
            keep = [int((np.frombuffer(p, "<u2") == np.frombuffer(q, "<u2")).sum()) >= least for p, q in zip(x, y)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(percent: int):
    """Keep pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("ix"), batch.column("iy")):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                keep.append(linked(int((q[at] == p).sum()), len(p), len(q), percent))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the values that both sides hold."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        value = np.concatenate(sets)
        column = np.searchsorted(common, value)
        column[column == len(common)] = 0
        hit = common[column] == value
        row, column = row[hit], column[hit]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    (lr, lc), (rr, rc) = places(left), places(right)
    for low in range(0, len(common), 4096):
        width = min(4096, len(common) - low)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for m, r, c in ((x, lr, lc), (y, rr, rc)):
            i, j = np.searchsorted(c, low), np.searchsorted(c, low + width)
            m[r[i:j], c[i:j] - low] = 1
        out += x @ y.T
    return out


def _compare_block(percent: int):
    """Edges between labels that occur among the links of one pair of blocks, at most a forest of them."""
    def run(key, group):
        left, right = group[group["block"] == key[1]], group[group["block"] == key[2]]
        p = [np.frombuffer(x, np.uint64) for x in left["items"]]
        q = [np.frombuffer(x, np.uint64) for x in right["items"]]
        if not p or not q:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        both = intersections(p, q).astype(np.int64)
        union = np.array([len(x) for x in p])[:, None] + np.array([len(x) for x in q])[None, :] - both
        u, v = left["label"].to_numpy(), right["label"].to_numpy()
        i, j = np.nonzero((100 * both >= percent * union) & (u[:, None] != v[None, :]))
        found = np.unique(np.stack([np.maximum(u[i], v[j]), np.minimum(u[i], v[j])], axis=1), axis=0)
        root: dict[int, int] = {}

        def top(z: int) -> int:
            while root.get(z, z) != z:
                root[z] = root.get(root[z], root[z])
                z = root[z]
            return z

        kept = []
        for s, t in found.tolist():
            s0, t0 = top(s), top(t)
            if s0 != t0:
                root[max(s0, t0)] = min(s0, t0)
                kept.append((s, t))
        return pd.DataFrame(kept, columns=["u", "v"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., n_shingles, component_id, kept, chosen): the near-duplicate group of every document.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Two documents are linked if
    their sets of ngram-word shingles have a Jaccard similarity of at least percent / 100; a text of
    fewer words is one shingle. component_id is the smallest doc_id reachable by links, kept marks the rows
    that have it, chosen exactly one row of each group: of the rows with the least doc_id, the one with the
    least hash of its text.

    Method: bands * rows universal hash minima; documents that share a band are candidates. Rows of equal
    sets are one node, named by one of them, so that rows which share an id are apart where their texts are.
    Small buckets give their pairs; a large one gives a star from its smallest node, and if some members are
    not linked to that, they are compared block by block with each other and the rest, over their full
    sets. So every candidate pair is confirmed on full sets or already joined. A pair at the threshold
    shares no band with probability (1 - s ** rows) ** bands: 3e-6 at 0.8 with 5 rows, 3e-7 at 0.85 with 6.

    Null and empty texts and texts of white space have no shingles, link with nothing and are all chosen. Rows
    that share a doc_id, with equal or different texts, are each returned with the group of their own
    text. A null doc_id is returned with its group's component, and stands for a group only if all its
    ids are null. An empty table gives an empty result; columns that are not kept are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "near")
    base = docs.select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id"), F.struct(F.lit(0).alias("_0"), *keep).alias("_kept"), F.xxhash64(text_col).alias("_hash"))
    signing = StructType([*base.schema.fields, *StructType.fromDDL("n_shingles long, digest binary, signature binary, keys array<long>").fields])
    # the written number of a row is its name from here on
    signed = work.save(base.mapInArrow(_sign(ngram, bands, rows), signing).withColumn("row", F.monotonically_increasing_id()), "signed")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_hash", "row"))
    # rows of one digest have equal sets, signatures and keys
    classes = signed.filter("digest is not null").groupBy("digest").agg(first.alias("best"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", "keys")))
    nodes = work.save(classes.withColumn("node", F.col("best.row")), "nodes")
    classes = nodes.select("digest", "node", "best", "copies")
    total = signed.count()

    members = nodes.select("node", F.explode("keys").alias("bucket"), "n_shingles")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("leader"), F.min_by("n_shingles", "node").alias("nx"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"), F.sum("n_shingles").alias("weight")).filter("m > 1")
    buckets = work.save(buckets.groupBy("m", "leader", "nx", "mark", "weight").agg(F.min("bucket").alias("bucket")), "buckets")
    hot = hot_keys(buckets, ["bucket"], "m", total * bands)
    members = work.save(spread_join(members, buckets.select("bucket", "m", "leader", "nx"), ["bucket"], hot), "members")

    lists = members.filter(f"m <= {SMALL}").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "n_shingles"))).alias("all"))
    small = lists.select(F.explode(F.expr("flatten(transform(all, (p, i) -> transform(slice(all, i + 2, size(all)), q -> struct(p.node as x, q.node as y, p.n_shingles as nx, q.n_shingles as ny))))")).alias("e")).select("e.*")
    star = members.filter(f"m > {SMALL} and node <> leader").select(F.col("leader").alias("x"), F.col("node").alias("y"), "nx", F.col("n_shingles").alias("ny"))
    pairs = small.unionByName(star).filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)").select("x", "y").distinct()

    signature = nodes.select("node", "signature")
    pairs = pairs.join(signature.select(F.col("node").alias("x"), F.col("signature").alias("sx")), "x").join(signature.select(F.col("node").alias("y"), F.col("signature").alias("sy")), "y")
    s, k = percent / 100, bands * rows
    least = int(k * s - 6 * (k * s * (1 - s)) ** 0.5)  # six standard deviations below the threshold
    pairs = work.save(pairs.select("x", "y", "sx", "sy").mapInArrow(_alike(least), "x long, y long"), "pairs")

    # sets of rows that only pass the bitmap by chance meet no pair
    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).union(members.filter(f"m > {SMALL}").select("node"))
    sent = spark.sparkContext.broadcast(bitmap_of(wanted, F.xxhash64("node"), WANTED_BITS))
    sets = work.save(signed.filter("digest is not null").select("row", F.xxhash64("row").alias("hash"), "_text").mapInArrow(_sets(ngram, sent), "node long, items binary"), "sets")
    # one plan for any number of pairs: sets are shuffled once, pairs with a set once
    ends = pairs.join(sets.hint("merge").select(F.col("node").alias("x"), F.col("items").alias("ix")), "x").join(sets.hint("merge").select(F.col("node").alias("y"), F.col("items").alias("iy")), "y")
    links = work.save(ends.select("x", "y", "ix", "iy").mapInArrow(_confirm(percent), "x long, y long"), "links")

    large = members.filter(f"m > {SMALL}").join(links.select(F.col("x").alias("leader"), F.col("y").alias("node"), F.lit(True).alias("joined")), ["leader", "node"], "left")
    large = large.withColumn("joined", F.coalesce("joined", F.col("node") == F.col("leader")))
    large = work.save(large.withColumn("label", F.when(F.col("joined"), F.col("leader")).otherwise(F.col("node"))), "large")
    count = lambda flag: F.greatest(F.ceil(F.count_if(flag) / BLOCK_TEXTS), F.ceil(F.sum(F.when(flag, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    blocks = large.groupBy("bucket").agg(count(F.col("joined")).alias("nj"), count(~F.col("joined")).alias("no"), count(F.lit(True)).alias("all")).filter("no > 0")
    dealt = spread_join(large, blocks, ["bucket"], hot).withColumn("joined", F.col("joined") & (F.col("all") > 1)).withColumn("nj", F.when(F.col("all") > 1, F.col("nj")).otherwise(0))
    # what fits into one block is one; else those joined to the leader come first, and only pairs of blocks
    # with open members are compared
    number = F.pmod(F.xxhash64("node"), F.when(F.col("joined"), F.col("nj")).otherwise(F.col("no"))).cast("int")
    dealt = dealt.select("bucket", "node", "joined", "label", "nj", "no", F.when(F.col("joined"), number).otherwise(F.col("nj") + number).alias("block"))
    dealt = dealt.select("bucket", "node", "label", "block", F.explode(F.expr("transform(sequence(if(joined, nj, 0), nj + no - 1), o -> struct(least(o, block) as lo, greatest(o, block) as hi))")).alias("at"))
    dealt = dealt.select("bucket", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), "block", "node", "label").join(sets, "node")
    more = dealt.groupBy("bucket", "lo", "hi").applyInPandas(_compare_block(percent), "u long, v long")

    found = connected_components(links.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(more), work)
    linked_ = work.save(classes.join(found, "node").select("digest", "component", "best"), "linked")
    tops = work.save(linked_.groupBy("component").agg(F.min("best").alias("top"), F.count("*").alias("n")), "tops")
    groups = spread_join(linked_, tops.select("component", "top"), ["component"], hot_keys(tops, ["component"], "n", total)).select("digest", "top")
    groups = groups.unionByName(classes.join(linked_.select("digest"), "digest", "left_anti").select("digest", F.col("best").alias("top")))
    in_group = spread_join(signed.filter("digest is not null").select("row", "_id", "n_shingles", "digest"), groups, ["digest"], hot_keys(classes, ["digest"], "copies", total))
    in_group = in_group.select("row", "_id", "n_shingles", F.col("top.id").alias("component_id"), (F.col("row") == F.col("top.row")).alias("chosen"))
    alone = signed.filter("digest is null").select("row", "_id", "n_shingles", F.col("_id").alias("component_id"), F.lit(True).alias("chosen"))
    out = in_group.unionByName(alone).withColumn("kept", F.col("_id").eqNullSafe(F.col("component_id")))
    if keep:
        out = out.join(signed.select("row", "_kept"), "row")
    return out.select(F.col("_id").alias("doc_id"), *(F.col(f"_kept.{c}") for c in keep), "n_shingles", "component_id", "kept", "chosen")
