"""Nearest neighbours of a set of query vectors among all library vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecclimb.functions.vectors import rescale_by_norm
from vecclimb.session import Workspace, ship

#: Query vectors that one broadcast may hold; more are dealt to blocks, each with a pass of its own.
MOST_QUERIES = 16_384
#: Queries and rows that are scored at a time: 256 x 4,096 scores are 8 MB.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 256, 4096
METRICS = ("cosine", "euclid", "dot")


def scores_of(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Similarities, larger being nearer; the Euclidean one is the negative distance."""
    if metric == "euclid":
        return -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T))
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return (q @ x.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :])
    return q @ x.T


def scorer(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda q, x: scores_of(q, x, metric)


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat values, first value, length) of a list column; -1 for vectors that are null or hold nulls."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(ends[0], ends[-1] - ends[0])
    starts, size = ends[:-1] - ends[0], np.diff(ends)
    size[column.is_null().to_numpy(zero_copy_only=False)] = -1
    if values.null_count:
        nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        size[nulls[starts + np.maximum(size, 0)] > nulls[starts]] = -1
        values = values.fill_null(0.0)
    return values.to_numpy(zero_copy_only=False), starts, size


class Best:
    """The k best of each query among all that a task has seen, ties by the lesser id.

    Of a block of scores only each query's k best are kept, and what is held is cut back to them after any block that makes it
    more than four times as much; equal scores at the edge are all held until then.
    """

    def __init__(self, k: np.ndarray):
        self.k = k
        self.least = np.full(len(k), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held, self.most = 0, 4 * int(k.sum()) + 65_536

    def offer(self, queries: np.ndarray, items: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        """scores: a row a query, a column an item; places: where the items stand in what the task has read."""
        with np.errstate(invalid="ignore"):
            good = (scores >= self.least[queries][:, None]) & np.isfinite(scores)
        k = int(self.k[queries].max(initial=0))
        if 0 < k < scores.shape[1] and good.sum() > 2 * k * len(queries):
            shown = np.where(good, scores, -np.inf)
            good &= shown >= np.partition(shown, -k, axis=1)[:, -k][:, None]
        query, item = np.nonzero(good)
        self.found.append((queries[query], items[item], scores[query, item], places[item]))
        self.held += len(query)
        if self.held > self.most:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        """(query, item, score, place) of the best, by query and rank."""
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        query, item, score, place = (np.concatenate(c) for c in zip(*self.found, empty))
        order = np.lexsort((item, -score, query))
        query, item, score, place = query[order], item[order], score[order], place[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k[query] - 1
        self.least[query[last]] = score[last]
        keep = rank < self.k[query]
        self.found = [(query[keep], item[keep], score[keep], place[keep])]
        self.held = int(keep.sum())
        return self.found[0]


class Carried:
    """The columns that go with candidates: the rows of a task that some candidate still stands for."""

    def __init__(self, most: int):
        self.rows: list[tuple[np.ndarray, pa.RecordBatch]] = []
        self.held, self.most = 0, most

    def keep(self, batch: pa.RecordBatch, first: int, bests: Sequence[Best]) -> None:
        """Hold the rows of a batch, which begin at place first, that are candidates; drop rows that are no more."""
        new = [p[p >= first] for b in bests for *_, p in b.found]
        places = np.unique(np.concatenate([np.zeros(0, np.int64), *new]))
        if len(places):
            self.rows.append((places, batch.take(pa.array(places - first))))
            self.held += len(places)
        if self.held > self.most:
            alive = np.unique(np.concatenate([np.zeros(0, np.int64), *(b.shrink()[3] for b in bests)]))
            self.rows = [(p[m], rows.filter(pa.array(m))) for p, rows in self.rows for m in [np.isin(p, alive)] if m.any()]
            self.held = sum(len(p) for p, _ in self.rows)

    def take(self, places: np.ndarray) -> pa.Table:
        held = np.concatenate([p for p, _ in self.rows])
        return pa.Table.from_batches([rows for _, rows in self.rows]).take(pa.array(np.searchsorted(held, places))).combine_chunks()


#: (query numbers that a batch's rows concern, numbers of these rows), for queries of one kind.
Meets = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def _all_meet(n: int) -> Meets:
    def meets(batch: pa.RecordBatch, rows: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(n), rows

    return meets


#: The lengths of a batch's vectors, and how to take what the scores of some rows are made of.
Read = tuple[np.ndarray, Callable[[np.ndarray, int], object]]


def read_vectors(batch: pa.RecordBatch) -> Read:
    values, first, length = vectors_of(batch.column("vec"))
    return length, lambda rows, size: values[first[rows][:, None] + np.arange(size)]


def best_of_task(held, measure: Callable[[np.ndarray, object], np.ndarray], carry: Sequence[str], read: Callable[[pa.RecordBatch], Read] = read_vectors, meets: Callable[[np.ndarray], Meets] | None = None, least=None):
    """For every task the k best of each query, with the columns of their rows: what mapInArrow runs over a library.

    held: a broadcast of queries (see sent()). measure: the scores of some queries' vectors and what read() gives for some rows. meets: for the
    numbers of the queries of one kind and length, which of them meet which rows of a batch; all meet all otherwise. least: a
    broadcast of the scores that a hit must reach, a number a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kinds, ks, flat, starts, sizes = held.value
        best: dict = {}
        for kind, size in {*zip(kinds.tolist(), sizes.tolist())}:
            at = np.flatnonzero((kinds == kind) & (sizes == size))
            if size >= 0:
                found = Best(ks[at])
                if least is not None:
                    found.least = least.value[at].copy()
                best[kind, size] = (at, flat[starts[at][:, None] + np.arange(size)], found, meets(at) if meets else _all_meet(len(at)))
        carried = Carried(65_536 + 4 * int(ks.sum()))
        seen, empty = 0, None
        for batch in batches:
            rows_of = batch.select([*carry]) if carry else None
            empty = empty if empty is not None else rows_of
            items, of = batch.column("item_id").to_numpy(zero_copy_only=False), batch.column("kind").fill_null(-(1 << 62)).to_numpy()
            length, taken = read(batch)
            for (kind, size), (_, vectors, found, meet) in best.items():
                at = np.flatnonzero((of == kind) & (length == size))
                for queries, rows in meet(batch, at, of) if len(at) else ():
                    for low in range(0, len(rows), ROWS_AT_ONCE):
                        part = rows[low : low + ROWS_AT_ONCE]
                        x = taken(part, size)
                        for a in range(0, len(queries), QUERIES_AT_ONCE):
                            some = queries[a : a + QUERIES_AT_ONCE]
                            found.offer(some, items[part], measure(vectors[some], x), seen + part)
            if carry:
                carried.keep(rows_of, seen, [b for _, _, b, _ in best.values()])
            seen += len(batch)
        for at, _, found, _ in best.values():
            query, item, score, place = found.shrink()
            columns = [pa.array(ids[at[query]]), pa.array(item.astype(np.int64)), pa.array(score)]
            if carry and len(place):
                columns += [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else c.combine_chunks() for c in carried.take(place).columns]
            elif carry:
                if empty is None:
                    continue
                columns += empty.slice(0, 0).columns
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "item_id", "score", *carry])

    return run


def sent(rows: pa.Table, spark):
    """Queries (query_id, kind, vec, k) as flat arrays, broadcast."""
    flat, starts, sizes = vectors_of(rows.column("vec").combine_chunks()) if rows.num_rows else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return spark.sparkContext.broadcast((*(rows.column(c).to_numpy() for c in ("query_id", "kind", "k")), flat, starts, sizes))


def as_queries(queries: DataFrame, k: int) -> DataFrame:
    """(query_id, kind, vec, k) of queries, without those that have no vector or no kind."""
    named, routed = "embedding_id" in queries.columns, "k" in queries.columns
    kind = F.col("embedding_id").cast("long") if named else F.lit(0).cast("long")
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), kind.alias("kind"), F.col("vec").cast("array<double>").alias("vec"), (F.col("k") if routed else F.lit(k)).cast("int").alias("k"))
    return rows.filter("vec is not null and kind is not null")


def similarity_and_distance(score: Column, metric: str) -> tuple[Column, Column]:
    similarity = score if metric != "euclid" else 1 / (1 - score)
    distance = {"cosine": 1 - score, "euclid": -score, "dot": score}[metric]
    return similarity.alias("similarity"), distance.alias("distance")


def knn(queries: DataFrame, library: DataFrame, k: int = 10, metric: str = "cosine", carry: Sequence[str] = ()) -> DataFrame:
    """(query_id, item_id, similarity, distance, rank, carried columns): the k nearest library items of every query.

    queries: query_id, vec and, if they differ by query, embedding_id (the named vector or library to
    search) and k. library: item_id, vec, and embedding_id if queries have it. carry names columns of the library that hits
    bring along, so that no join fetches them. Rank 1 is the nearest, ties by item_id. distance is 1 - similarity for cosine, the
    distance for euclid, and the product itself for dot, which like similarity is larger for nearer items.

    The library is never shuffled: each task yields at most k candidates a query, which meet by query.
    Up to MOST_QUERIES queries are one broadcast; more are written and go in blocks, of which each is sent, passed
    over the library, written and released before the next, so that the driver never holds more than a block and one query.
    Vectors that are null or hold nulls, and cosines with zero vectors, are not found.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = library.sparkSession
    ship(spark)
    carry = list(carry)
    named, routed = "embedding_id" in queries.columns, "k" in queries.columns
    asked = as_queries(queries, k)
    kind = F.col("embedding_id").cast("long") if named else F.lit(0).cast("long")
    names = {c: f"_c{i}" for i, c in enumerate(carry)}  # apart from item_id, kind and vec
    rows = library.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), kind.alias("kind"), F.col("vec").cast("array<double>").alias("vec"), *(F.col(c).alias(n) for c, n in names.items()))
    schema = StructType([*StructType.fromDDL("query_id long, item_id long, score double").fields, *(rows.schema[n] for n in names.values())])
    first = asked.limit(MOST_QUERIES + 1).toArrow()
    if first.num_rows <= MOST_QUERIES:
        found = rows.mapInArrow(best_of_task(sent(first, spark), scorer(metric), list(names.values())), schema)
    else:
        work, passes = Workspace(spark, "knn"), []
        asked = work.save(asked, "asked")
        blocks = -(-asked.count() // MOST_QUERIES)
        for b in range(blocks):
            block = sent(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow(), spark)
            passes.append(work.save(rows.mapInArrow(best_of_task(block, scorer(metric), list(names.values())), schema), f"block{b}"))
            block.unpersist()
        found = reduce(DataFrame.unionByName, passes)
    best = top_k(found, ["query_id"], [F.desc("score"), F.col("item_id")], k=None if routed else k)
    if routed:
        limits = asked.select("query_id", "k")
        best = best.join(F.broadcast(limits) if first.num_rows <= MOST_QUERIES else limits, "query_id").filter("rank <= k").drop("k")
    return best.select("query_id", "item_id", *similarity_and_distance(F.col("score"), metric), "rank", *(F.col(n).alias(c) for c, n in names.items()))


def top_k(rows: DataFrame, keys: list[str], order: list, k: int | None) -> DataFrame:
    """rows with rank, the first k of each key (F1); Spark limits each key before it shuffles."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def knn_responses(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, valid, n_hits) of every query; one that finds nothing is invalid."""
    hits = found.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.col("n_hits").isNotNull().alias("valid"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def knn_to_items(queries: DataFrame, library: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Hits as candidate items with their texts and vectors, query group and the query's origin.

    queries: as for knn(), with query_group. A library with the column norm holds unit vectors, which are scaled back.
    """
    normed = "norm" in library.columns
    found = knn(queries, library, k, metric, ["external_id", "vec", *(["norm"] if normed else [])])
    if normed:
        found = found.withColumn("vec", rescale_by_norm(F.col("vec"), F.col("norm"))).drop("norm")
    return found.join(queries.select("query_id", "query_group"), "query_id")
