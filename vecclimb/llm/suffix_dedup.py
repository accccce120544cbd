"""Exact removal of byte passages that also start earlier, by longest previous factors in suffix order.

A passage of `least` bytes is a window. Windows are dealt by an anchor: the least hash among the short strings
inside, which equal windows share wherever they stand. Neighbouring windows of one anchor are one segment, so the
shuffle carries two hashes a segment and no text. Equal segments keep their first occurrence. Where an anchor has different
segments, these and only these are fetched as text, and the suffixes that begin windows are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecclimb.llm import words as W
from vecclimb.llm.bitmap import bitmap_of, passes
from vecclimb.llm.skew import hot_keys, spread_join
from vecclimb.session import Workspace, ship

#: Bytes of the strings that anchor windows.
ANCHOR = 32
#: Different segments of one anchor that are sorted together; more are dealt to blocks, whose first windows meet by their hashes.
BLOCK_SEGMENTS = 1000
#: Text that a task sorts at a time.
SORTED_BYTES = 1 << 20
#: Bits of the bitmaps of anchors and of documents: 16 MB, whatever their number.
BITS = 27

_CODES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_PLACE = np.uint64((1 << 26) - 1)


@dataclass
class Segments:
    """Runs of windows with one anchor: text, first byte, past the last byte, hash of the anchor, hash of all bytes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray


def _sums(data: np.ndarray, kind: int = 0) -> np.ndarray:
    """Prefix sums whose differences, times a power, hash any run of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[kind][data] * W._powers(W._FACTOR, len(data)), out=out[1:])
    return out


def _runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * W._powers(W._INVERSE, len(sums))[starts]


def _segments(data: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(piece, start, end, anchor, digest) of consecutive pieces of data, none shorter than least."""
    size = min(ANCHOR, least)
    width = least - size + 1
    sums = _sums(data)
    n = len(data) - size + 1
    hashes = W.mix((sums[size:] - sums[:-size]) * W._powers(W._INVERSE, len(sums))[:n])
    ranked = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)  # of equal hashes the first
    blocks = np.full(-(-n // width) * width, ~np.uint64(0))
    blocks[:n] = ranked
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    counts = np.diff(edges) - least + 1
    at = W.ranges(edges[:-1], counts)
    anchor = (np.minimum(ahead[at], behind[at + width - 1]) & _PLACE).astype(np.int64)
    piece = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    start, anchor, held = at[first], anchor[first], np.diff(np.append(first, len(at)))
    end = start + held - 1 + least
    extent = ((anchor - start) << 32 | held).astype(np.uint64)
    return piece[first], start, end, hashes[anchor], W.mix(_runs(sums, start, end) ^ W.mix(extent))


def segments(texts: pa.Array, least: int) -> Iterator[Segments]:
    """The segments of all texts of least bytes or more, some texts at a time; very long ones in pieces of their windows."""
    data, offsets = W.buffers(texts)
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= least)
    pieces = -(-(sizes[rows] - least + 1) // W.SLICE_BYTES)
    skip = W.ranges(np.zeros(len(rows), np.int64), pieces) * W.SLICE_BYTES
    rows = np.repeat(rows, pieces)
    low = offsets[rows] + skip
    high = np.minimum(low + W.SLICE_BYTES + least - 1, offsets[rows + 1])
    for a, b in W.slices(np.concatenate([np.zeros(1, np.int64), np.cumsum(high - low)])):
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(high[a:b] - low[a:b])])
        piece, start, end, anchor, digest = _segments(np.concatenate([data[x:y] for x, y in zip(low[a:b], high[a:b])]), edges, least)
        shift = skip[a:b][piece] - edges[piece]
        yield Segments(rows[a:b][piece], start + shift, end + shift, anchor, digest)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchored(least: int):
    """A row for each segment that a slice of texts has first, and one with n, the number of its segments, for every text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "doc", "tie", "start", "size", "n"]
        for batch in batches:
            docs, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held = np.zeros(len(batch), np.int64)
            for s in segments(batch.column(2), least):
                held += np.bincount(s.row, minlength=len(batch))
                order = np.lexsort((s.start, ties[s.row], docs[s.row], s.digest, s.anchor))
                a, d = s.anchor[order], s.digest[order]
                order = order[np.concatenate([np.ones(1, bool), (a[1:] != a[:-1]) | (d[1:] != d[:-1])])]
                row = s.row[order]
                yield pa.RecordBatch.from_arrays([_long(s.anchor[order]), _long(s.digest[order]), pa.array(docs[row]), pa.array(ties[row]), pa.array(s.start[order].astype(np.int32)), pa.array((s.end - s.start)[order].astype(np.int32)), pa.nulls(len(order), pa.int32())], names=names)
            row = np.flatnonzero(held)
            none = pa.nulls(len(row), pa.int32())
            spread = _long(W.mix(docs[row].view(np.uint64) ^ W.mix(ties[row].view(np.uint64))))
            yield pa.RecordBatch.from_arrays([spread, spread, pa.array(docs[row]), pa.array(ties[row]), none, none, pa.array(held[row].astype(np.int32))], names=names)

    return run


def _run_starts(keys: int, first: bool):
    """Of sorted rows the first of every run of equal keys, or all others. Rows whose last column is set are all first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            new[0] = last is None
            for k in range(keys):
                x = batch.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
                new[0] |= last is not None and x[0] != last[k]
            last = [batch.column(k)[len(batch) - 1].as_py() for k in range(keys)]
            if batch.schema.names[-1] == "n":
                new |= batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(new if first else ~new))

    return run


def _passing(bitmap, name: str, wanted: bool = True):
    """Rows whose column is in the bitmap, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bitmap.value, batch.column(name).to_numpy()) == wanted))

    return run


def suffix_ranks(data: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Ranks of the first `length` bytes (16 at least) of the suffixes that begin at `at`, by prefix doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * length, np.uint8)]).astype(np.uint64)
    key = np.zeros(n + length, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n + length]
    rank, known = np.unique(key, return_inverse=True)[1], 8
    while 2 * known <= length:
        pair = rank.astype(np.uint64) << np.uint64(32)
        pair[:-known] |= rank[known:].astype(np.uint64)
        rank, known = np.unique(pair, return_inverse=True)[1], 2 * known
    return rank[at].astype(np.uint64) << np.uint64(32) | rank[at + length - known].astype(np.uint64)


def previous_factors(ranks: np.ndarray) -> np.ndarray:
    """Whether each suffix, given in text order, has an earlier one with the same rank: a previous factor of the ranked length.

    In suffix order, equal ranks in text order, the previous smaller position of a suffix is its neighbour before if that has the
    same rank; the next smaller one lies beyond its equals, and what it shares with the suffix is shorter than the ranked length.
    """
    order = np.argsort(ranks, kind="stable")
    out = np.zeros(len(ranks), bool)
    out[order[1:]] = ranks[order[1:]] == ranks[order[:-1]]
    return out


_REMOVED = "f1 long, f2 long, doc long, tie long, low int, high int"


def _compared(least: int):
    """Of segments sorted by anchor and block: ranges of windows that start earlier in the block, and the hashes of the rest where there are more blocks."""

    def removed(rows: pa.Table) -> pa.RecordBatch:
        doc, tie, start = (rows.column(c).to_numpy() for c in ("doc", "tie", "start"))
        order = np.lexsort((start, tie, doc))
        doc, tie, start = doc[order], tie[order], start[order].astype(np.int64)
        pieces = rows.column("piece").combine_chunks().cast(pa.large_binary()).take(pa.array(order))
        ends = np.frombuffer(pieces.buffers()[1], np.int64, len(order) + 1 + pieces.offset)[pieces.offset :]
        data, ends = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        counts = np.diff(ends) - least + 1
        at = W.ranges(ends[:-1], counts)
        segment = np.repeat(np.arange(len(order)), counts)
        again = previous_factors(suffix_ranks(data, least, at))
        edge = np.ones(len(at), bool)
        edge[1:] = (segment[1:] != segment[:-1]) | (again[1:] != again[:-1])
        first = np.flatnonzero(edge)
        length = np.diff(np.append(first, len(at)))
        first, length = first[again[first]], length[again[first]]
        low = start[segment[first]] + at[first] - ends[segment[first]]
        s = segment[first]
        open_ = np.flatnonzero(~again & rows.column("crossing").to_numpy()[order][segment])
        t = segment[open_]
        place = start[t] + at[open_] - ends[t]
        hashes = [W.mix(_runs(_sums(data, kind), at[open_], at[open_] + least)) for kind in (0, 1)]
        columns = [pa.chunked_array([pa.nulls(len(s), pa.int64()), _long(h)]) for h in hashes]
        joined = [np.concatenate(x) for x in ((doc[s], doc[t]), (tie[s], tie[t]), (low, place), (low + length, place + 1))]
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in columns), *(pa.array(x.astype(kind)) for x, kind in zip(joined, ("i8", "i8", "i4", "i4")))], names=["f1", "f2", "doc", "tie", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(0, len(batch), 2048):
                held.append(batch.slice(k, 2048))
                size += held[-1].nbytes
                if size < SORTED_BYTES:
                    continue
                rows = pa.Table.from_batches(held)
                anchor, block = (rows.column(c).to_numpy() for c in ("anchor", "block"))
                whole = int(np.flatnonzero((anchor != anchor[-1]) | (block != block[-1])).max(initial=-1)) + 1
                if whole:
                    yield removed(rows.slice(0, whole))
                held, size = rows.slice(whole).to_batches(), rows.slice(whole).nbytes
        if held and sum(map(len, held)):
            yield removed(pa.Table.from_batches(held))

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with its bytes for every segment that a text is asked for."""
    for batch in batches:
        data, offsets = W.buffers(batch.column("text"))
        asked = batch.column("asked")
        row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(asked.offsets)))
        fields = asked.flatten()
        start, size = (fields.field(c).to_numpy().astype(np.int64) for c in ("start", "size"))
        for k in range(0, len(row), 8192):
            r, s, z = row[k : k + 8192], start[k : k + 8192], size[k : k + 8192]
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(z)])
            piece = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(r), [None, pa.py_buffer(ends), pa.py_buffer(data[W.ranges(offsets[r] + s, z)])])
            yield pa.RecordBatch.from_arrays([*(fields.field(c).slice(k, 8192) for c in ("anchor", "block", "crossing")), *(batch.column(c).take(pa.array(r)) for c in ("doc", "tie")), pa.array(s.astype(np.int32)), piece.cast(pa.binary())], names=["anchor", "block", "crossing", "doc", "tie", "start", "piece"])


def _cut(least: int):
    """Texts without what is removed: segments that are not among the starts, and the ranges of windows in gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            known = batch.column("n").is_valid().to_numpy(zero_copy_only=False)
            starts, gone = batch.column("starts").to_pylist(), batch.column("gone").to_pylist()
            ranges: list[list] = [[] for _ in known]
            for s in segments(batch.column("text").cast(pa.large_string()), least):
                for lo, hi in zip(*_row_bounds(s.row)):
                    r = s.row[lo]
                    if known[r]:
                        other = ~np.isin(s.start[lo:hi], np.array(starts[r], np.int64))
                        ranges[r].append(np.stack([s.start[lo:hi][other], s.end[lo:hi][other]], axis=1))
            spans, kept = [], []
            for r in range(len(batch)):
                text = data[offsets[r] : offsets[r + 1]]
                ranges[r].extend(np.array([[g["low"], g["high"] - 1 + least]]) for g in gone[r] or [])
                if not sum(map(len, ranges[r])):
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                both = np.concatenate(ranges[r])
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, both[:, 0], 1)
                np.add.at(depth, both[:, 1], -1)
                away = np.concatenate([np.zeros(1, bool), np.cumsum(depth[:-1]) > 0, np.zeros(1, bool)])
                turns = np.flatnonzero(away[1:] != away[:-1]).reshape(-1, 2)
                spans.append([{"start": a, "end": b} for a, b in turns.tolist()])
                kept.append(text[~away[1:-1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copies"), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "copies", "n_bytes", "spans", "kept"])

    return run


def _row_bounds(row: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(row)) + 1
    return [0, *edge.tolist()], [*edge.tolist(), len(row)]


def without_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every text without the bytes of passages of `least` bytes that also start earlier.

    Texts are UTF-8 bytes, null is empty, and passages do not cross texts. Earlier is a smaller doc_id (null first), or a
    smaller place in the same text; rows that share a doc_id follow one another by a hash of their texts, and of
    rows equal in both one is the first. Passages are judged on the input. spans are the maximal removed runs, as byte
    ranges with their ends excluded; kept is the rest as binary, which may cut characters. Texts shorter than `least` stay whole.
    Equality of segments rests on 128 bits of hashes. least is 64 at least.

    Memory: slices of 1 MB of text, a document's own segments, blocks of BLOCK_SEGMENTS segments, two bitmaps of 16 MB.
    A passage in any number of texts is one row a slice in the shuffle; an anchor with very many different
    segments is dealt to blocks.
    """
    if least < 64:
        raise ValueError("passages have 64 bytes at least")
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "repeats")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = ids.groupBy("doc_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    unique = found["most"] < 2 and not found["nulls"]
    tie = F.lit(0).cast("long") if unique else F.xxhash64(F.col("doc_id").isNull(), "text")
    keyed = ids.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), tie.alias("tie"), "text")
    rows = keyed.select("doc", "tie", "text").mapInArrow(_anchored(least), "anchor long, digest long, doc long, tie long, start int, size int, n int")
    rows = rows.repartition("anchor", "digest").sortWithinPartitions("anchor", "digest", "doc", "tie", "start")
    firsts = work.save(rows.mapInArrow(_run_starts(2, True), rows.schema).drop("digest"), "firsts")

    # anchors of different segments: their first occurrences, as text
    counts = firsts.filter("n is null").groupBy("anchor").agg(F.count("*").alias("c"))
    shared = work.save(counts.filter("c > 1"), "shared")
    total = shared.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    near = spark.sparkContext.broadcast(bitmap_of(shared, F.col("anchor"), BITS))
    open_ = firsts.filter("n is null").drop("n").mapInArrow(_passing(near, "anchor"), firsts.drop("n").schema)
    open_ = spread_join(open_, shared, ["anchor"], hot_keys(shared, ["anchor"], "c", total))
    blocks = F.ceil(F.col("c") / BLOCK_SEGMENTS)
    block = F.pmod(F.xxhash64("doc", "tie", "start"), blocks)
    asked = F.struct("anchor", block.cast("int").alias("block"), (blocks > 1).alias("crossing"), "start", "size")
    asked = work.save(open_.groupBy("doc", "tie").agg(F.collect_list(asked).alias("asked")), "asked")
    texts = _of_documents(keyed, asked, unique).join(asked.hint("merge"), ["doc", "tie"])
    cut = texts.select("doc", "tie", "text", "asked").mapInArrow(_pieces, "anchor long, block int, crossing boolean, doc long, tie long, start int, piece binary")
    cut = cut.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    compared = work.save(cut.mapInArrow(_compared(least), _REMOVED), "compared")
    blocks_met = compared.filter("f1 is not null").repartition("f1", "f2").sortWithinPartitions("f1", "f2", "doc", "tie", "low").mapInArrow(_run_starts(2, False), _REMOVED)
    gone = compared.filter("f1 is null").unionByName(blocks_met).groupBy("doc", "tie").agg(F.collect_list(F.struct("low", "high")).alias("gone"))

    # documents that lose anything
    held = firsts.groupBy("doc", "tie").agg(F.max("n").alias("n"), F.count("n").cast("int").alias("copies"), F.collect_list(F.when(F.col("n").isNull(), F.col("start"))).alias("starts"))
    touched = held.join(gone, ["doc", "tie"], "left").filter((F.size("starts") < F.col("n")) | F.col("gone").isNotNull() | (F.col("copies") > 1))
    touched = work.save(touched, "touched")
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = _of_documents(keyed, touched, True, wanted=False).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), none.alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    met = _of_documents(keyed, touched, True).join(touched.hint("merge"), ["doc", "tie"], "left")
    if not unique:  # equal rows: one for all copies that have any segments
        met = met.withColumn("_no", F.when(F.col("copies") > 1, F.lit(0)).otherwise(F.monotonically_increasing_id())).dropDuplicates(["doc", "tie", "_no"])
    short = met.select("doc_id", "text", "n", "starts", "gone", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(_cut(least), "doc_id long, copies int, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    if not unique:
        later = F.col("copy") > 0
        all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
        short = short.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        short = short.withColumns({"spans": F.when(later, all_).otherwise(F.col("spans")), "kept": F.when(later, F.lit(b"")).otherwise(F.col("kept"))})
    return whole.unionByName(short.select(whole.columns))


def _key() -> Column:
    return F.xxhash64("doc", "tie")


def _of_documents(keyed: DataFrame, wanted_keys: DataFrame, unique: bool, wanted: bool = True) -> DataFrame:
    """Documents whose keys may be among those of a table, by a bitmap, or all that are surely not."""
    bitmap = keyed.sparkSession.sparkContext.broadcast(bitmap_of(wanted_keys, _key(), BITS))
    marked = keyed.withColumn("_key", _key())
    out = marked.mapInArrow(_passing(bitmap, "_key", wanted), marked.schema).drop("_key")
    return out if unique else out.dropDuplicates(["doc", "tie"])
