"""Sums of vectors by key, combined in each task before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecclimb.session import ship

#: Keys whose sums a task holds; beyond that they are given out and begun anew.
MOST_KEYS = 4096


def _rows(held: dict[tuple, list], keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in held], schema.field(name).type) for i, name in enumerate(keys)]
    sums, counts = (pa.array([v[j].tolist() for v in held.values()], kind) for j, kind in enumerate((pa.list_(pa.float64()), pa.list_(pa.int64()))))
    return pa.RecordBatch.from_arrays([*columns, sums, counts], names=[*keys, "sums", "counts"])


def _added(held: dict[tuple, list], name: tuple, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add to a key's sums, by position; the longest vector gives the length."""
    if name not in held:
        held[name] = [sums.copy(), counts.copy()]
        return
    for j, new in enumerate((sums, counts)):
        old = held[name][j]
        if len(old) < len(new):
            old, new = new.copy(), old
            held[name][j] = old
        old[: len(new)] += new


def _partial(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            vectors = batch.column("vec")
            ends = np.asarray(vectors.offsets)
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            good = ~np.isnan(flat)
            flat = np.where(good, flat, 0.0)
            sizes = np.diff(ends)
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                number: dict[tuple, int] = {}
                codes = np.array([number.setdefault(names[r], len(number)) for r in rows.tolist()])
                order = np.argsort(codes, kind="stable")
                at = ends[rows[order]][:, None] + np.arange(size)
                first = np.searchsorted(codes[order], np.arange(len(number)))
                sums, counts = np.add.reduceat(flat[at], first), np.add.reduceat(good[at].astype(np.int64), first)
                for k, name in enumerate(number):
                    _added(held, name, sums[k], counts[k])
            if len(held) > MOST_KEYS:
                yield _rows(held, keys, schema)
                held.clear()
        if held:
            yield _rows(held, keys, schema)

    return run


def _merged(keys: list[str]):
    """The means of keys whose partial sums stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        schema = None

        def means() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], schema.field(name).type) for i, name in enumerate(keys)]
            vectors = [np.where(n > 0, s / np.maximum(n, 1), 0.0).tolist() for s, n in held.values()]
            return pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*keys, "vec"])

        for batch in batches:
            schema = batch.schema
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for name, sums, counts in zip(names, batch.column("sums").to_pylist(), batch.column("counts").to_pylist()):
                if len(held) > MOST_KEYS and name not in held:
                    yield means()
                    held.clear()
                _added(held, name, np.array(sums), np.array(counts))
        if held:
            yield means()

    return run


def mean_vectors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and vec: the mean of the keys' vectors, by position; null and empty vectors do not count, nor do nulls and NaN in one.

    A task gives a row a key, so a key of any number of rows reaches the only shuffle as a few; there they stream by in order of
    their keys. A position counts the vectors that have a number in it; where none has, the mean is 0.
    """
    ship(rows.sparkSession)
    given = rows.filter(F.size("vec") > 0).select(*keys, F.col("vec").cast("array<double>").alias("vec"))
    fields = [given.schema[k] for k in keys]
    terms = given.mapInArrow(_partial(keys), StructType([*fields, *StructType.fromDDL("sums array<double>, counts array<long>").fields]))
    sorted_ = terms.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(_merged(keys), StructType([*fields, *StructType.fromDDL("vec array<double>").fields]))


class Moments:
    """What a key's gradient needs of its rows, in one pass and mergeable: scores' mean and deviation, sums of vectors, the top.

    By the length of the vectors: their number, the sum of their scores' distances from the mean, their sum, and their sum weighted by
    those distances. So the weights can be put right as parts of a key meet and the mean moves.
    """

    def __init__(self):
        self.n, self.mean, self.m2 = 0, 0.0, 0.0
        self.sums: dict[int, list] = {}  # length -> number, distances, total, turned
        self.top: tuple | None = None  # (score, seq), vec

    def add(self, n: int, mean: float, m2: float, sums: dict[int, tuple], top: tuple) -> None:
        delta, whole = mean - self.mean, self.n + n
        moved = self.mean + delta * n / whole
        for size in sums:
            self.sums.setdefault(size, [0, 0.0, np.zeros(size), np.zeros(size)])
        for size, held in self.sums.items():
            parts = [(self.mean, held)] + ([(mean, sums[size])] if size in sums else [])
            moves = [(about - moved, part) for about, part in parts]
            held[3] = sum(part[3] + by * part[2] for by, part in moves)
            held[1] = sum(part[1] + by * part[0] for by, part in moves)
            held[0], held[2] = sum(part[0] for _, part in moves), sum(part[2] for _, part in moves)
        self.m2 += m2 + delta * delta * self.n * n / whole
        self.n, self.mean = whole, moved
        if self.top is None or top[0] > self.top[0]:
            self.top = top


_MOMENTS = "n long, mean double, m2 double, sums array<struct<n:bigint,apart:double,total:array<double>,turned:array<double>>>, top_score double"


def _order(seq) -> tuple:
    return tuple(seq.values()) if isinstance(seq, dict) else (seq,)


def _moments(keys: list[str], unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        schema = None
        for batch in batches:
            if not len(batch):
                continue
            schema = batch.schema
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            number: dict[tuple, int] = {}
            codes = np.array([number.setdefault(n, len(number)) for n in names])
            scores = batch.column("score").to_numpy(zero_copy_only=False)
            vectors = batch.column("vec")
            ends = np.asarray(vectors.offsets)
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(ends)
            order = np.argsort(codes, kind="stable")
            for code, rows in enumerate(np.split(order, np.searchsorted(codes[order], np.arange(1, len(number))))):
                s = scores[rows]
                mean = float(s.mean())
                sums = {}
                for size in np.unique(sizes[rows]).tolist():
                    at = rows[sizes[rows] == size]
                    x = flat[ends[at][:, None] + np.arange(size)]
                    if unit:
                        with np.errstate(invalid="ignore", divide="ignore"):
                            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                    good = np.isfinite(x).all(axis=1)
                    if size and good.any():
                        x, w = x[good], scores[at][good] - mean
                        sums[size] = (len(x), float(w.sum()), x.sum(axis=0), w @ x)
                best = rows[s == s.max()]
                row = max(((_order(batch.column("seq")[i].as_py()), i) for i in best.tolist()), key=lambda b: b[0])[1]
                top = ((float(scores[row]), _order(batch.column("seq")[row].as_py())), (batch.column("seq")[row].as_py(), vectors[row].as_py()))
                held.setdefault(names[rows[0]], Moments()).add(len(rows), mean, float(((s - mean) ** 2).sum()), sums, top)
            if len(held) > MOST_KEYS:
                yield _moment_rows(held, keys, schema)
                held.clear()
        if held:
            yield _moment_rows(held, keys, schema)

    return run


def tops_and_gradients(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """keys, vec and gradient: of each key the top's vector and the gradient at it.

    rows: keys, vec, score (a number), seq (ordered; a struct or a number). The top has the greatest score, and of equals the greatest seq. A
    gradient is the mean of a term a row, weighted by its advantage; as all terms are linear in the advantages, sums about a moving
    mean give it without the advantages, in one pass before one shuffle. Vectors that are null, hold nulls or numbers that are
    not finite, or differ from the top's in length give no term. The gradient is null where the top has no such vector.
    """
    ship(rows.sparkSession)
    given = rows.filter("not isnan(score)").select(*keys, F.col("vec").cast("array<double>").alias("vec"), F.col("score").cast("double").alias("score"), "seq")
    fields = [given.schema[k] for k in keys]
    parts = given.mapInArrow(_moments(keys, metric == "cosine"), StructType([*fields, *StructType.fromDDL(_MOMENTS).fields, given.schema["seq"], given.schema["vec"]]))
    sorted_ = parts.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(_tops(keys, metric), StructType([*fields, *StructType.fromDDL("vec array<double>, gradient array<double>").fields]))


def _moment_rows(held: dict[tuple, Moments], keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    m = list(held.values())
    kind = pa.list_(pa.struct([("n", pa.int64()), ("apart", pa.float64()), ("total", pa.list_(pa.float64())), ("turned", pa.list_(pa.float64()))]))
    sums = [[{"n": c, "apart": a, "total": t.tolist(), "turned": u.tolist()} for c, a, t, u in x.sums.values()] for x in m]
    columns = [pa.array([k[i] for k in held], schema.field(name).type) for i, name in enumerate(keys)]
    columns += [pa.array([x.n for x in m], pa.int64()), pa.array([x.mean for x in m]), pa.array([x.m2 for x in m]), pa.array(sums, kind), pa.array([x.top[0][0] for x in m])]
    columns += [pa.array([x.top[1][j] for x in m], schema.field(name).type) for j, name in enumerate(("seq", "vec"))]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "mean", "m2", "sums", "top_score", "seq", "vec"])


def _tops(keys: list[str], metric: str):
    """keys, vec and gradient of keys whose moments stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        schema = None

        def out() -> pa.RecordBatch:
            tops, gradients = [], []
            for m in held.values():
                vec = m.top[1][1]
                tops.append(vec)
                q = np.array(vec if vec is not None else [], np.float64)
                count, apart, _, turned = m.sums.get(len(q), (0, 0.0, None, np.zeros(len(q))))
                scale = (np.sqrt(m.m2 / m.n) + 1e-8) * max(count, 1)
                mean = turned / scale  # of advantage times vector
                if metric == "euclid":
                    mean = 2 * (q * apart / scale - mean) / max(len(q), 1)
                elif metric == "cosine":
                    with np.errstate(invalid="ignore", divide="ignore"):
                        mean = (q * (q @ mean) / (q @ q) - mean) / np.sqrt(q @ q)
                gradients.append(mean.tolist() if np.isfinite(mean).all() else None)
            columns = [pa.array([k[i] for k in held], schema.field(name).type) for i, name in enumerate(keys)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(tops, pa.list_(pa.float64())), pa.array(gradients, pa.list_(pa.float64()))], names=[*keys, "vec", "gradient"])

        for batch in batches:
            schema = batch.schema
            for r in batch.to_pylist():
                name = tuple(r[k] for k in keys)
                if len(held) > MOST_KEYS and name not in held:
                    yield out()
                    held.clear()
                sums = {len(s["total"]): (s["n"], s["apart"], np.array(s["total"]), np.array(s["turned"])) for s in r["sums"]}
                held.setdefault(name, Moments()).add(r["n"], r["mean"], r["m2"], sums, ((r["top_score"], _order(r["seq"])), (r["seq"], r["vec"])))
        if held:
            yield out()

    return run
