"""Benchmark decontamination: word windows of test items, looked up in every document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecclimb.llm import words as W
from vecclimb.session import Workspace, ship

#: Windows that may be a broadcast, about 300 bytes each in a worker; so many bytes of words in all, too.
#: More windows stay in Spark, and what the documents share with them meets them in a join.
MOST_WINDOWS, MOST_BYTES = 250_000, 64 << 20
_BITS = 22
#: Bits of the bitmap in front of the join, 16 MB whatever the number of windows.
_FRONT = 27
#: Occurrences of one window that one task of the join takes.
HOT = 100_000


def item_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n, hash, window binary): the distinct runs of n words of every item.

    An item of fewer words, but not none, is one window of its own length. window holds the
    words, lower-cased and joined by blanks.
    """
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for first, w in W.each(batch.column(1), W.ALPHANUMERIC):
                for k in range(len(w.bounds) - 1):
                    low, high = int(w.bounds[k]), int(w.bounds[k + 1])
                    size = min(n, high - low)
                    if size:
                        hashes = W.windows(w.hashes[low:high], size).view(np.int64)
                        out += [(ids[first + k], size, int(h), b" ".join(w.word(j) for j in range(low + i, low + i + size))) for i, h in enumerate(hashes)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["item_id", "n", "hash", "window"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id long, n int, hash long, window binary").distinct()


class _Lookup:
    """The broadcast windows: by length a bitmap and sorted hashes, and the items of each window."""

    def __init__(self, rows: list[tuple[int | None, int, int, bytes]]):
        self.items: dict[bytes, list[int]] = {}
        hashes: dict[int, list[int]] = {}
        for item, n, h, window in rows:
            self.items.setdefault(bytes(window), []).extend([] if item is None else [item])
            hashes.setdefault(n, []).append(h)
        self.hashes = {n: np.unique(np.array(h, np.int64).view(np.uint64)) for n, h in hashes.items()}
        self.bits = {}
        for n, h in self.hashes.items():
            self.bits[n] = np.zeros(1 << _BITS, bool)
            self.bits[n][h >> np.uint64(64 - _BITS)] = True

    def find(self, w: W.Words) -> Iterator[tuple[int, int, int, list[int]]]:
        """(text, first word, words, items) of every verified occurrence."""
        for n, hashes in self.hashes.items():
            runs = W.windows(w.hashes, n)
            at = np.flatnonzero(self.bits[n][runs >> np.uint64(64 - _BITS)])
            place = np.minimum(np.searchsorted(hashes, runs[at]), len(hashes) - 1)
            at = at[hashes[place] == runs[at]]
            text = np.searchsorted(w.bounds, at, "right") - 1
            for i, k in zip(at.tolist(), text.tolist()):
                if i + n <= w.bounds[k + 1]:
                    found = self.items.get(b" ".join(w.word(j) for j in range(i, i + n)))
                    if found is not None:
                        yield k, i - int(w.bounds[k]), n, found


def _in_front(windows: DataFrame) -> np.ndarray:
    """The bitmap of the first _FRONT bits of all hashes, eight to a byte, from at most 4,096 rows of 4 KB."""
    bit = F.shiftrightunsigned("hash", 64 - _FRONT)
    rows = windows.groupBy(F.floor(bit / 32768).alias("k")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(32768))).alias("bits"))
    out = np.zeros(1 << (_FRONT - 3), np.uint8)
    for k, bits in rows.collect():
        out[k * 4096 : (k + 1) * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _joined(texts: DataFrame, windows: DataFrame, work: Workspace) -> DataFrame:
    """(k1, k2, items, spans in words) of the texts (k1, k2, text) with any window, by a join.

    Only runs of words that pass the bitmap are shuffled, those of equal texts once; the words themselves
    are join keys. Windows that occur more than HOT times are salted.
    """
    sizes = sorted(r[0] for r in windows.select("n").distinct().collect())  # the length of an item at most, ten by default
    front = texts.sparkSession.sparkContext.broadcast(_in_front(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, w in W.each(batch.column(2), W.ALPHANUMERIC):
                for n in sizes:
                    runs = W.windows(w.hashes, n)
                    bit = runs >> np.uint64(64 - _FRONT)
                    at = np.flatnonzero((front.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                    text = np.searchsorted(w.bounds, at, "right") - 1
                    inside = at + n <= w.bounds[text + 1]
                    at, text = at[inside], text[inside]
                    if len(at):
                        row = pa.array(first + text)
                        words = pa.array([b" ".join(w.word(j) for j in range(i, i + n)) for i in at.tolist()], pa.binary())
                        columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array((at - w.bounds[text]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(runs[at].view(np.int64)), words]
                        yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "start", "n", "hash", "window"])

    seen = work.save(texts.mapInArrow(run, "k1 long, k2 long, start int, n int, hash long, window binary").distinct(), "seen")
    hot = work.save(seen.groupBy("hash").agg(F.count("*").alias("salts")).filter(F.col("salts") > HOT).withColumn("salts", F.ceil(F.col("salts") / HOT)), "hot")
    salts = F.coalesce("salts", F.lit(1))
    dealt = windows.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    seen = seen.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), salts)).drop("salts")
    key = ["hash", "n", "window", "salt"]
    hits = work.save(seen.join(dealt.select(*key).distinct(), key, "left_semi"), "hits")
    spans = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("spans"))
    named = hits.select("k1", "k2", *key).distinct().join(dealt.filter("item_id is not null"), key).select("k1", "k2", "item_id").distinct()
    return work.save(spans.join(named.groupBy("k1", "k2").agg(F.collect_list("item_id").alias("items")), ["k1", "k2"], "left"), "found")


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_overlaps(docs: DataFrame, items: DataFrame, n: int = 10, most_windows: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, keep..., n_words, n_hit, items array<long>, spans array<struct<start, end>>), a row for a row.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. n_hit
    counts the document words inside any occurrence of a window of any item, items the items with such
    windows, ascending; spans are the runs of hit words, in code points, end exclusive.

    The windows are counted. Up to most_windows, and MOST_BYTES of words, they are a broadcast hash set;
    beyond that they are joined with the runs of words that pass a bitmap of fixed size, and neither they
    nor the documents go through the driver. Hash hits are verified on words.

    Null and empty texts have no words; an item without words has no window; the windows of an item
    without id count as hits, but name no item. Repeated rows are judged each, further columns
    are ignored unless kept, and empty tables give empty results or no hits.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "overlaps")
    windows = work.save(item_windows(items, n, item_id_col, item_text_col), "windows")
    count, size = windows.agg(F.count("*"), F.sum(F.octet_length("window"))).first()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    names = rows.columns
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    none = {"items": F.expr("cast(array() as array<bigint>)"), "spans": F.expr("cast(array() as array<struct<start:int,end:int>>)")}
    if count <= most_windows and (size or 0) <= MOST_BYTES:
        held = spark.sparkContext.broadcast([tuple(r) for r in windows.select("item_id", "n", "hash", "window").collect()])
        state = rows.withColumns(none)
    else:
        held = None
        keys = {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")}  # two hashes stand for the text
        found = _joined(rows.select(*(c.alias(k) for k, c in keys.items()), "text"), windows, work)
        state = rows.withColumns({f"_{k}": c for k, c in keys.items()}).join(found, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left")
        state = state.select(*names, *(F.coalesce(k, c).alias(k) for k, c in none.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = None
        for batch in batches:
            lookup = lookup or _Lookup(held.value if held else [])
            found, before = batch.column("items").to_pylist(), batch.column("spans").to_pylist()
            items_out, spans_out = list(found), list(before)
            words, hits = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for first, w in W.each(batch.column(names.index("text")), W.ALPHANUMERIC):
                words[first : first + len(w.bounds) - 1] = np.diff(w.bounds)
                ranges = {k: [(s["start"], s["end"]) for s in before[first + k]] for k in range(len(w.bounds) - 1) if before[first + k]}
                named: dict[int, set[int]] = {k: set(found[first + k]) for k in ranges}
                for k, i, size, its in lookup.find(w):
                    ranges.setdefault(k, []).append((i, i + size))
                    named.setdefault(k, set()).update(its)
                for k, r in ranges.items():
                    r = _merged(r)
                    hits[first + k] = sum(b - a for a, b in r)
                    low = w.offsets[k]
                    code_points = np.cumsum((w.data[low : w.offsets[k + 1]] & 0xC0) != 0x80)
                    start = lambda byte: int(code_points[byte - low] - 1)
                    r = [(start(w.starts[w.bounds[k] + a]), int(code_points[w.ends[w.bounds[k] + b - 1] - 1 - low])) for a, b in r]
                    items_out[first + k] = sorted(named[k])
                    spans_out[first + k] = [{"start": a, "end": b} for a, b in r]
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words), pa.array(hits), pa.array(items_out, pa.list_(pa.int64())), pa.array(spans_out, span)], names=[*names, "n_words", "n_hit", "items", "spans"])

    return state.mapInArrow(run, StructType(rows.schema.fields + StructType.fromDDL("n_words long, n_hit long, items array<bigint>, spans array<struct<start:int,end:int>>").fields))


def without_overlaps(found: DataFrame) -> DataFrame:
    """The documents of find_overlaps() without any hit word, in their own columns."""
    return found.filter("n_hit = 0").drop("n_words", "n_hit", "items", "spans")


def spans_removed(found: DataFrame) -> DataFrame:
    """All documents of find_overlaps(), with the hit spans cut out of their texts; null stays null."""
    rest = """aggregate(spans, named_struct('at', 0, 'out', ''),
        (acc, s) -> named_struct('at', s.end, 'out', concat(acc.out, substring(text, acc.at + 1, s.start - acc.at))),
        acc -> concat(acc.out, substring(text, acc.at + 1)))"""
    return found.withColumn("text", F.expr(f"if(n_hit > 0, {rest}, text)")).drop("n_words", "n_hit", "items", "spans")
