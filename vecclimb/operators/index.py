"""A stored index of a vector library (C8), and exact search that leaves out cells which cannot hold a hit.

Two levels: a row belongs to the cell of the nearest centre, which is a partition of the table, and its residual is held as a
product-quantised code. Approximate search reads the codes of a query's nearest cells, scores them from tables of a query's products
with the code book, and ranks the best again by their vectors. Exact search visits the cells of a query best first, as the triangle
inequality bounds what a cell of known radius can hold, and stops when no bound reaches the k-th hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecclimb.operators import knn as K
from vecclimb.session import Workspace, ship

#: Pairs of queries and cells that a block of queries has at most.
PAIRS_AT_ONCE = 4_000_000
#: Candidates that are ranked again by one broadcast.
MOST_CANDIDATES = 500_000
#: Cells that a query visits in the first round of exact search; every round visits this many times more.
GROWTH = 4
ENTRIES = 256  # of a code book, so that a code is a byte


@dataclass(frozen=True)
class Model:
    """centres: a row a cell; books: parts x ENTRIES x dimensions of a part. For cosine both are of unit vectors."""

    metric: str
    centres: np.ndarray
    books: np.ndarray

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def prepared(self, x: np.ndarray) -> np.ndarray:
        """Vectors in the space of the index; for cosine zero vectors become NaN."""
        if self.metric != "cosine":
            return x
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return K.scores_of(x, self.centres, "euclid").argmax(axis=1)

    def parts_of(self, x: np.ndarray) -> np.ndarray:
        """x by parts; the last is filled up with zeros."""
        m, _, width = self.books.shape
        out = np.zeros((len(x), m * width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, width)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, code, bias, distance from the centre) of prepared vectors.

        The approximation of x is centre + residual; bias is what a squared distance from it takes beside products with a query.
        """
        cell = self.cell_of(x)
        rest = x - self.centres[cell]
        parts = self.parts_of(rest)
        code = np.stack([K.scores_of(parts[:, p], self.books[p], "euclid").argmax(axis=1) for p in range(len(self.books))], axis=1).astype(np.uint8)
        near = np.stack([self.books[p][code[:, p]] for p in range(len(self.books))], axis=1).reshape(len(x), self.books.shape[0] * self.books.shape[2])[:, : self.size]
        bias = (2 * self.centres[cell] * near + near * near).sum(axis=1)
        return cell, code, bias, np.sqrt((rest * rest).sum(axis=1))

    def scores(self, q: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Approximate scores of prepared queries and rows (cell, code, bias), by table look-up."""
        cell, code, bias = rows
        tables = np.einsum("qmw,mew->mqe", self.parts_of(q), self.books)
        products = sum(table[:, code[:, p]] for p, table in enumerate(tables))
        cells, at = np.unique(cell, return_inverse=True)
        centres = self.centres[cells]
        if self.metric == "euclid":
            return (-(K.scores_of(q, centres, "euclid") ** 2))[:, at] + 2 * products - bias
        return (q @ centres.T)[:, at] + products

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """What no row of a cell, between low and high from its centre, scores above: queries x cells, a little widened."""
        if self.metric == "dot":
            out = q @ self.centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * high
        else:
            apart = -K.scores_of(q, self.centres, "euclid")
            near = np.maximum(0, np.maximum(apart - high, low - apart))
            out = -near if self.metric == "euclid" else 1 - near * near / 2
        return out + 1e-7 * (1 + np.abs(out))


def k_means(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:n]]
    for _ in range(rounds):
        near = K.scores_of(x, c, "euclid").argmax(axis=1)
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def train(library: DataFrame, metric: str, cells: int, parts: int, most: int = 20_000, seed: int = 5) -> Model | None:
    """Centres and code books by k-means on at most `most` vectors, the first by a hash of their ids; None without any vector.

    The length that most of them have is that of the index.
    """
    rows = library.filter("vec is not null").orderBy(F.xxhash64("item_id"), "item_id").limit(most).select(F.col("vec").cast("array<double>").alias("vec")).toArrow()
    if not rows.num_rows:
        return None
    values, starts, sizes = K.vectors_of(rows.column("vec").combine_chunks())
    if not (sizes > 0).any():
        return None
    size = int(np.bincount(sizes[sizes > 0]).argmax())
    at = starts[sizes == size]
    rng = np.random.Generator(np.random.PCG64(seed))
    space = Model(metric, np.zeros((1, size)), np.zeros((1, 1, size)))
    x = space.prepared(values[at[:, None] + np.arange(size)])
    x = x[np.isfinite(x).all(axis=1)]
    if not len(x):
        return None
    centres = k_means(x, cells, 10, rng)
    parts = min(parts, size)
    space = Model(metric, centres, np.zeros((parts, ENTRIES, -(-size // parts))))
    rest = space.parts_of(x - centres[space.cell_of(x)])
    books = [k_means(rest[:, p], ENTRIES, 8, rng) for p in range(parts)]
    return Model(metric, centres, np.stack([np.concatenate([b, np.repeat(b[:1], ENTRIES - len(b), axis=0)]) for b in books]))


@dataclass
class Found:
    """hits as knn() gives them; of the pairs of a query and a library row of its kind, how many were compared, and how many there are."""

    hits: DataFrame
    compared: int
    pairs: int


class VectorIndex:
    """An index in a folder that driver and executors share: model, rows by batch and cell, and what is in each batch's cells.

    A batch counts once its row counts are written, last of all; what an append that broke off has left is never read.
    Item ids are distinct. Rows whose vectors are null, of another length than the index, hold nulls or numbers that are not finite, or are
    zero under cosine are kept aside: exact search goes through them, and approximate search does not.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        ship(spark)
        held = self._read("model")
        self.model = None
        if held is not None:
            rows = held.orderBy("part", "no").collect()  # centres and code books
            vectors = {p: np.array([r["vec"] for r in rows if r["part"] == p]) for p in {r["part"] for r in rows}}
            self.model = Model(rows[0]["metric"], vectors.pop(-1), np.stack([vectors[p] for p in sorted(vectors)]))

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    @classmethod
    def build(cls, library: DataFrame, path: str, metric: str = "cosine", cells: int = 64, parts: int = 16, carry: Sequence[str] = ()) -> VectorIndex:
        """An index of (item_id, vec), embedding_id if there is one, and the carried columns. path must be new.

        cells should grow with the square root of the rows; they and the code books (cells + parts * 256 vectors) go through the driver.
        """
        if metric not in K.METRICS:
            raise ValueError(f"metric must be one of {K.METRICS}")
        spark = library.sparkSession
        model = train(library, metric, cells, parts)
        if model is not None:
            rows = [(metric, -1, i, c.tolist()) for i, c in enumerate(model.centres)] + [(metric, p, i, b.tolist()) for p, book in enumerate(model.books) for i, b in enumerate(book)]
            spark.createDataFrame(rows, "metric string, part int, no int, vec array<double>").coalesce(1).write.parquet(f"{path}/model")
        index = cls(spark, path)
        if model is not None:
            index.append(library, carry)
        return index

    def append(self, library: DataFrame, carry: Sequence[str] = ()) -> None:
        """Add rows under the centres and code books that there are."""
        model = self.model
        if model is None:
            raise ValueError("an index that was built of no vectors takes none; build it anew")
        kind = F.col("embedding_id").cast("long") if "embedding_id" in library.columns else F.lit(0).cast("long")
        rows = library.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), kind.alias("kind"), F.col("vec").cast("array<double>").alias("vec"), *carry)
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, K.ROWS_AT_ONCE) for i in range(0, len(batch), K.ROWS_AT_ONCE)):
                    values, starts, sizes = K.vectors_of(part.column("vec"))
                    fits = np.flatnonzero(sizes == model.size)
                    x = model.prepared(values[starts[fits][:, None] + np.arange(model.size)])
                    good = np.isfinite(x).all(axis=1)
                    fits, x = fits[good], x[good]
                    cell, code, bias, far = np.full(len(part), -1, np.int32), np.zeros((len(part), len(model.books)), np.uint8), np.zeros(len(part)), np.zeros(len(part))
                    cell[fits], code[fits], bias[fits], far[fits] = model.encoded(x)
                    codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(model.books)), len(part), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, codes, pa.array(bias), pa.array(far), pa.array(cell)], names=[*names, "code", "bias", "far", "cell"])

        schema = StructType([*rows.schema.fields, *StructType.fromDDL("code binary, bias double, far double, cell int").fields])
        batch = uuid.uuid4().hex
        rows.mapInArrow(run, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.path}/rows/batch={batch}")
        written = self.spark.read.parquet(f"{self.path}/rows/batch={batch}")
        stats = written.groupBy("kind", "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
        stats.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{self.path}/stats")

    def rows(self, cells: Sequence[int] | None = None) -> DataFrame:
        """The rows of all whole batches: item_id, kind, vec, code, bias, far, carried columns, batch, cell (-1: kept aside)."""
        batches = [r["batch"] for r in self._stats().select("batch").distinct().collect()]  # appends
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/batch={b}" for b in sorted(batches)))
        return rows if cells is None else rows.filter(F.col("cell").isin([int(c) for c in cells]))

    def _stats(self) -> DataFrame:
        found = self._read("stats")
        return found if found is not None else self.spark.createDataFrame([], "kind long, cell int, n long, low double, high double, batch string")

    def _blocks(self, queries: DataFrame, k: int, most: int) -> Iterator[pa.Table]:
        """Blocks of queries that have a vector of the index's length, all finite and, for cosine, not zero."""
        asked = K.as_queries(queries, k)
        first = asked.limit(most + 1).toArrow()
        if first.num_rows <= most:
            yield self._usable(first)
            return
        asked = Workspace(self.spark, "index").save(asked, "asked")
        blocks = -(-asked.count() // most) * 2
        for b in range(blocks):
            yield self._usable(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow())

    def _usable(self, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows
        values, starts, sizes = K.vectors_of(rows.column("vec").combine_chunks())
        ok = sizes == self.model.size
        x = self.model.prepared(values[starts[ok][:, None] + np.arange(self.model.size)])
        ok[ok] = np.isfinite(x).all(axis=1)
        return rows.filter(pa.array(ok))

    def _matrix(self, rows: pa.Table) -> np.ndarray:
        values, starts, _ = K.vectors_of(rows.column("vec").combine_chunks())
        return values[starts[:, None] + np.arange(self.model.size)]

    def _of_cells(self, met: list[tuple[int, np.ndarray]]):
        """meets() of best_of_task: queries meet the rows of the cells that they visit. met: (cell, query numbers)."""
        visits = self.spark.sparkContext.broadcast(dict(met))

        def meets(at: np.ndarray):
            def of(batch: pa.RecordBatch, rows: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                cell = batch.column("cell").to_numpy()[rows]
                for c in np.unique(cell).tolist():
                    queries = np.flatnonzero(np.isin(at, visits.value.get(c, ()), assume_unique=True))
                    if len(queries):
                        yield queries, rows[cell == c]

            return of

        return meets

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, again: int = 10, carry: Sequence[str] = ()) -> Found:
        """The k nearest among the best by code: of the rows in each query's `probes` nearest cells the k * again best codes are ranked by vectors.

        queries as for knn(). Scans read codes alone, of the visited cells alone; vectors are read of the visited cells where a candidate
        stands. compared counts rows ranked by their vectors.
        """
        hits, compared, pairs = [], 0, 0
        counts = self._counts()
        for rows in self._blocks(queries, k, max(1, min(K.MOST_QUERIES, MOST_CANDIDATES // (k * again)))) if self.model else ():
            if not rows.num_rows:
                continue
            x = self.model.prepared(self._matrix(rows))
            near = K.scores_of(x, self.model.centres, "dot" if self.model.metric == "dot" else "euclid")
            visited = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            met = [(c, np.flatnonzero((visited == c).any(axis=1))) for c in np.unique(visited).tolist()]
            wide = rows.set_column(rows.column_names.index("k"), "k", pa.array((rows.column("k").to_numpy() * again).astype(np.int32)))
            flat = pa.array(list(x), pa.list_(pa.float64()))
            held = K.sent(wide.set_column(rows.column_names.index("vec"), "vec", pa.chunked_array([flat])), self.spark)
            model = self.spark.sparkContext.broadcast(self.model)

            def read(batch: pa.RecordBatch) -> K.Read:
                n = len(batch)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, -1)
                bias, cell = batch.column("bias").to_numpy(), batch.column("cell").to_numpy()
                return np.full(n, model.value.size), lambda at, size: (cell[at], code[at], bias[at])

            table = self.rows([c for c, _ in met]).select("item_id", "kind", "code", "bias", "cell", "batch")
            schema = StructType([*StructType.fromDDL("query_id long, item_id long, score double").fields, table.schema["cell"], table.schema["batch"]])
            task = K.best_of_task(held, lambda q, r: model.value.scores(q, r), ["cell", "batch"], read, self._of_cells(met))
            best = K.top_k(table.mapInArrow(task, schema), ["query_id"], [F.desc("score"), F.col("item_id")], None)
            limits = self.spark.createDataFrame(rows.select(["query_id", "vec", "k"]))
            chosen = best.join(F.broadcast(limits), "query_id").filter(F.col("rank") <= F.col("k") * again).select("query_id", "item_id", "cell", "batch", F.col("vec").alias("_q"), "k")
            chosen = Workspace(self.spark, "candidates").save(chosen, "chosen")
            where = chosen.agg(F.count("*"), F.collect_set("cell")).first()  # cells at most
            compared += where[0]
            ranked = self.rows(where[1]).select("item_id", "cell", "batch", "vec", *carry).join(F.broadcast(chosen), ["item_id", "cell", "batch"])
            hits.append(self._ranked(ranked, carry))
            kinds = rows.column("kind").to_numpy()
            pairs += sum(int((kinds == kind).sum()) * n for kind, n in counts.items())
        return Found(reduce(DataFrame.unionByName, hits) if hits else self._none(carry), compared, pairs)

    def exact(self, queries: DataFrame, k: int = 10, carry: Sequence[str] = ()) -> Found:
        """The rows of knn(), from the cells that can hold them.

        A round reads the next best cells of every query, GROWTH times as many as the round before; a query is done when no
        cell left has a bound that reaches its k-th hit. So there are about log4(cells) rounds at most, each a pass over the visited partitions
        alone. compared counts the rows of visited cells.
        """
        if self.model is None:
            return Found(self._none(carry), 0, 0)
        cells = len(self.model.centres)
        work = Workspace(self.spark, "exact")
        stats = self._stats().groupBy("kind", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # cells x kinds
        counts = self._counts()
        tables, compared, pairs, no = [], 0, 0, 0
        names = {c: f"_c{i}" for i, c in enumerate(carry)}
        for rows in self._blocks(queries, k, max(64, min(K.MOST_QUERIES, PAIRS_AT_ONCE // cells))):
            if not rows.num_rows:
                continue
            x, kinds, ks = self.model.prepared(self._matrix(rows)), rows.column("kind").to_numpy(), rows.column("k").to_numpy()
            ids = rows.column("query_id").to_numpy()
            bound, size = np.full((len(x), cells), -np.inf), np.zeros((len(x), cells), np.int64)
            for kind in np.unique(kinds).tolist():
                of, mine = [s for s in stats if s["kind"] == kind and s["cell"] >= 0], kinds == kind
                low, high, n = np.zeros(cells), np.zeros(cells), np.zeros(cells, np.int64)
                for s in of:
                    low[s["cell"]], high[s["cell"]], n[s["cell"]] = s["low"], s["high"], s["n"]
                bound[mine] = np.where(n > 0, self.model.bounds(x[mine], low, high), -np.inf)
                size[mine] = n
                pairs += int(mine.sum()) * counts.get(kind, 0)
            held, least, take = K.sent(rows, self.spark), np.full(len(x), -np.inf), GROWTH
            own: list[DataFrame] = []
            while True:
                open_ = np.where(bound >= least[:, None], bound, -np.inf)
                order = np.argsort(-open_, axis=1, kind="stable")[:, :take]
                chosen = np.zeros_like(bound, bool)
                np.put_along_axis(chosen, order, True, axis=1)
                chosen &= np.isfinite(open_)
                if not chosen.any():
                    break
                compared += int(size[chosen].sum())
                met = [(c, np.flatnonzero(chosen[:, c])) for c in np.flatnonzero(chosen.any(axis=0)).tolist()]
                bound[chosen] = -np.inf
                table = self.rows([c for c, _ in met]).select("item_id", "kind", "vec", "cell", *(F.col(c).alias(n) for c, n in names.items()))
                schema = StructType([*StructType.fromDDL("query_id long, item_id long, score double").fields, *(table.schema[n] for n in names.values())])
                task = K.best_of_task(held, K.scorer(self.model.metric), list(names.values()), meets=self._of_cells(met), least=self.spark.sparkContext.broadcast(least))
                own.append(work.save(table.mapInArrow(task, schema), f"round{no}"))
                no += 1
                both = K.top_k(reduce(DataFrame.unionByName, own).select("query_id", "item_id", "score"), ["query_id"], [F.desc("score"), F.col("item_id")], int(ks.max()))
                edge = both.join(F.broadcast(self.spark.createDataFrame(rows.select(["query_id", "k"]))), "query_id").filter("rank = k").select("query_id", "score").collect()  # a row a query
                known = dict(map(tuple, edge))
                least = np.array([known.get(i, -np.inf) for i in ids.tolist()])
                take *= GROWTH
            tables += own
        found = reduce(DataFrame.unionByName, tables) if tables else None
        aside = self.rows([-1]).withColumnRenamed("kind", "embedding_id")
        asked = queries if "embedding_id" in queries.columns else queries.withColumn("embedding_id", F.lit(0))
        odd = K.knn(asked, aside, k, self.model.metric, carry) if any(s["cell"] < 0 for s in stats) else self._none(carry)
        score = F.col("distance") if self.model.metric == "dot" else 1 - F.col("distance") if self.model.metric == "cosine" else -F.col("distance")
        both = odd.select("query_id", "item_id", score.alias("score"), *(F.col(c).alias(n) for c, n in names.items()))
        both = both if found is None else found.unionByName(both)
        routed = "k" in queries.columns
        best = K.top_k(both, ["query_id"], [F.desc("score"), F.col("item_id")], None if routed else k)
        if routed:
            best = best.join(queries.select(F.col("query_id").cast("long").alias("query_id"), "k"), "query_id").filter("rank <= k").drop("k")
        hits = best.select("query_id", "item_id", *K.similarity_and_distance(F.col("score"), self.model.metric), "rank", *(F.col(n).alias(c) for c, n in names.items()))
        return Found(hits, compared, pairs)

    def _counts(self) -> dict[int, int]:
        """Rows in cells by kind."""
        return {r[0]: r[1] for r in self._stats().filter("cell >= 0").groupBy("kind").agg(F.sum("n")).collect()}

    def _ranked(self, rows: DataFrame, carry: Sequence[str]) -> DataFrame:
        """Candidates with vec, the query's vector _q and its k, ranked by their vectors."""
        from vecclimb.functions import vectors as V

        measure = {"cosine": V.cosine, "dot": V.dot, "euclid": lambda a, b: -V.euclid(a, b)}[self.model.metric]
        scored = rows.withColumn("score", measure(F.col("vec"), F.col("_q")))
        best = K.top_k(scored, ["query_id"], [F.desc("score"), F.col("item_id")], None).filter("rank <= k")
        return best.select("query_id", "item_id", *K.similarity_and_distance(F.col("score"), self.model.metric), "rank", *carry)

    def _none(self, carry: Sequence[str]) -> DataFrame:
        known = {f.name: f for f in self.rows().schema.fields} if self.model else {}
        extra = [known[c] for c in carry if c in known]
        return self.spark.createDataFrame([], StructType([*StructType.fromDDL("query_id long, item_id long, similarity double, distance double, rank int").fields, *extra]))
