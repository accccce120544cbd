"""Token ids in Arrow stream files of equal-length sequences with masks, and reading them back."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecclimb.llm import words as W
from vecclimb.llm.memo import Memo
from vecclimb.session import Workspace, ship

#: Parts of texts in either half of a worker's memo, parts that the tokenizer takes at once, and bytes of a slice of texts.
MEMO, AT_ONCE, SLICE_BYTES = 250_000, 256, 4 << 20
_LOADED: dict[str, "WordEncoder"] = {}


def _parts_at_blanks(config: dict) -> bool:
    """Whether a tokenizer file drops white space, never joins across it, and looks at no characters beyond it.

    Of normalisers, composition, blanks for white space and lower case of single characters act within words.
    """
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    within = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in steps)
    split, *rest = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    kinds = split.get("pattern", {}).get("Regex", " ").split("|")
    words = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and all(k in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") or k.isascii() and k[0] == "'" and k[1:].isalpha() for k in kinds)
    alone = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in config.get("added_tokens", []))
    return bool(steps and within and words and alone and all(r["type"] == "ByteLevel" and not r["add_prefix_space"] and not r["use_regex"] for r in rest))


def _lower_cases(config: dict) -> bool:
    """Whether a tokenizer file that parts at blanks also takes ASCII letters of either case for the same."""
    return any(n["type"] == "Lowercase" for n in config["normalizer"]["normalizers"]) and not any(t["normalized"] for t in config.get("added_tokens", []))


#: ASCII letters and digits; other printable ASCII, which ends a word unless it begins a contraction.
_ASCII = np.arange(256)
_WORD = W.ALPHANUMERIC & (_ASCII < 128)
_MARK = (_ASCII > 32) & (_ASCII < 127) & ~_WORD & (_ASCII != ord("'"))
#: Lower case, and a blank for a line's end.
_SAME = W.LOWER.copy()
_SAME[10] = 32


class WordEncoder:
    """Ids of whole texts. Where a tokenizer never joins across blanks, the ids of a text are those of its
    parts between blanks, one after the other; equal parts are encoded once and kept. Where it lower-cases too,
    the marks after a word are a part of their own, and parts are equal whatever the case of their ASCII letters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_parts = _parts_at_blanks(config)
        self.lowers = self.by_parts and _lower_cases(config)
        self.added = [W.LOWER[np.frombuffer(t["content"].encode(), np.uint8)].tobytes() for t in config.get("added_tokens", [])]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.memo = Memo(MEMO)
        # a number is a word of its own, so a number of one id parts the words that the tokenizer takes at once
        single = [(c, self.tokenizer.encode(c, add_special_tokens=False).ids) for c in "\u00be\u00bc\u00b3\u00b9\u00b2\u00bd"]
        self.gap, self.gap_id = next(((c, ids[0]) for c, ids in single if len(ids) == 1), (None, -1)) if self.by_parts else (None, -1)

    @classmethod
    def load(cls, path: str) -> "WordEncoder":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _plain(self, data: np.ndarray) -> bool:
        """Whether no added token occurs, in any case: these are found before words are."""
        lower = W.LOWER[data].tobytes()
        return not any(t in lower for t in self.added)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; AT_ONCE parts make one text, so that a word does not cost a call."""
        alone = [i for i, p in enumerate(parts) if self.gap is None or self.gap in p]
        out = dict(zip(alone, (x.tobytes() for x in self._each([parts[i] for i in alone]))))
        rest = [i for i in range(len(parts)) if i not in out]
        groups = [rest[i : i + AT_ONCE] for i in range(0, len(rest), AT_ONCE)]
        for group, ids in zip(groups, self._each([f" {self.gap} ".join(parts[i].strip(" \n") for i in g) for g in groups])):
            ends = np.append(np.flatnonzero(ids == self.gap_id), len(ids)).tolist()
            data, width, low = ids.tobytes(), ids.itemsize, 0
            for i, end in zip(group, ends):
                out[i] = data[low * width : end * width]
                low = end + 1
        return [out[i] for i in range(len(parts))]

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts that offsets bounds in data, one after the other; their places at the bounds)."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        folds = self.lowers and self._plain(data)
        if folds:
            # a letter before a mark that may be composed with it keeps its case
            data = np.where(np.append(data[1:] < 128, True)[: len(data)], _SAME[data], data)

        def cuts(d: np.ndarray) -> np.ndarray:
            if not self.by_parts:
                return np.zeros(0, np.int64)
            at = (d == 32) | (d == 10)
            if folds:
                at[1:] |= _MARK[d[1:]] & _WORD[d[:-1]]
            return np.flatnonzero(at)

        parts = W.parts(data, offsets, cuts)
        known = self.memo.values(parts.distinct, self._encoded)
        return parts.joined([known[p] for p in parts.distinct], self.kind)


def _open(path: str):
    """A file for reading: memory-mapped where it is local, so that nothing is copied."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return pa.memory_map(name) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(name)


class StreamFile:
    """A file of write_token_files(): ids by position, without copying what is memory-mapped."""

    def __init__(self, path: str):
        self.table = pa.ipc.open_stream(_open(path)).read_all()
        chunks = self.table.column("ids").chunks
        self.values = [c.flatten().to_numpy(zero_copy_only=True) for c in chunks]
        self.ends = np.cumsum([len(v) for v in self.values], dtype=np.int64)

    def __len__(self) -> int:
        """Sequences."""
        return self.table.num_rows

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the i-th sequence."""
        row = self.table.slice(i, 1)
        return row.column("ids").chunk(0).flatten().to_numpy(), row.column("mask").chunk(0).flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The n ids from a position of the stream; a view if they lie in one batch."""
        out = []
        k = int(np.searchsorted(self.ends, start, "right"))
        while n > 0:
            at = start - (int(self.ends[k - 1]) if k else 0)
            out.append(self.values[k][at : at + n])
            start, n, k = start + len(out[-1]), n - len(out[-1]), k + 1
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint16), *out])


def write_token_files(docs: DataFrame, path: str, end_id: int, length: int = 2048, batch_rows: int = 64, file_ids: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every document, and return (doc_id, file, part, at, start, n_tokens), a row for a row.

    Ids are those of the tokenizer file at path, without special tokens, then end_id, in ascending
    order of doc_id (null first; rows that share one by a hash of the text, so that ranges may part them too).
    A range of documents is one or more Arrow stream files: record batches of batch_rows rows (ids:
    fixed_size_list[length], mask: the same of bool, false for what pads the last row). A file ends with the
    document that brings it to file_ids ids. at is the position in the file's stream, start that in the
    stream of all files by part.

    Files go to the shared folder under names that no other attempt of a task uses, and count only
    once the task's rows are committed, so that lost executors leave no half-read file. Null and
    empty texts are the end id alone. Repeated rows are all written; an empty table gives no rows. Memory
    follows a slice of texts, a batch of ids and the longest text.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "tokens")
    folder = f"{work.path}/files"
    folder = folder if "://" in folder else f"file://{os.path.abspath(folder.removeprefix('file:'))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordEncoder.load(path)
        kind = pa.uint16() if coder.kind == "<u2" else pa.uint32()
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        full = batch_rows * length
        file, files = None, 0
        for batch in batches:
            data, offsets = W.buffers(batch.column(1))
            for low, high in W.slices(offsets, SLICE_BYTES):
                ids, bounds = coder.encode_texts(data, offsets[low : high + 1])
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                first = 0
                while first < high - low:
                    if file is None:
                        file = _Writer(folder, (TaskContext.get().partitionId() << 32) + files, schema, coder.kind, full)
                        files += 1
                    # to the document that fills the file
                    last = min(high - low, int(np.searchsorted(bounds, bounds[first] + file_ids - file.at)))
                    last = max(last, first + 1)
                    n = last - first
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(low + first, n), pa.array([file.path] * n), pa.array(np.full(n, file.part)), pa.array(file.at + bounds[first:last] - bounds[first]), pa.array(np.diff(bounds[first : last + 1]))],
                        names=["doc_id", "file", "part", "at", "n_tokens"],
                    )
                    file.put(ids[bounds[first] : bounds[last]])
                    if file.at >= file_ids:
                        file.close()
                        file = None
                    first = last
        if file is not None:
            file.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = work.save(ordered.mapInArrow(run, "doc_id long, file string, part long, at long, n_tokens long"), "manifest")
    # one row a file, of file_ids ids or a range's rest: the window over them all stays small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = written.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return written.join(totals, "part").select("doc_id", "file", "part", "at", (F.col("base") + F.col("at")).alias("start"), "n_tokens")


class _Writer:
    """A file of write_token_files() while it is written."""

    def __init__(self, folder: str, part: int, schema: pa.Schema, kind: str, full: int):
        self.path, self.part, self.schema, self.full = f"{folder}/part-{part:016x}-{uuid.uuid4().hex[:12]}.arrow", part, schema, full
        fs, name = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(os.path.dirname(name), recursive=True)
        self.stream = fs.open_output_stream(name)
        self.writer = pa.ipc.new_stream(self.stream, schema)
        self.rest, self.at = np.zeros(0, kind), 0

    def put(self, ids: np.ndarray) -> None:
        self.at += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.full * self.full
        for low in range(0, whole, self.full):
            self._batch(self.rest[low : low + self.full])
        self.rest = self.rest[whole:]

    def _batch(self, ids: np.ndarray) -> None:
        length = self.schema.field("ids").type.list_size
        size = -(-len(ids) // length) * length
        mask = np.arange(size) < len(ids)
        padded = np.concatenate([ids, np.zeros(size - len(ids), ids.dtype)])
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            self._batch(self.rest)
        self.writer.close()
        self.stream.close()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of a manifest, from the files themselves.

    ids_crc32 is the unsigned CRC-32 of the document's ids as little-endian 32-bit numbers.
    """
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, None
        for batch in batches:
            sums = []
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))):
                if file != path:
                    path, held = file, StreamFile(file)
                sums.append(zlib.crc32(held.ids(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.select("file").distinct().count())
    dealt = manifest.repartition(files, "file").sortWithinPartitions("file", "at")
    return dealt.select("doc_id", "file", "at", "start", "n_tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
