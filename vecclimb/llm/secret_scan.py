"""Secrets in texts: a trigram index narrows each rule to candidate texts, a regex verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecclimb.llm import words as W
from vecclimb.session import ship


@dataclass(frozen=True)
class Rule:
    """A kind of secret; group is the part of a match that must have least characters (0: all)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # as [0-9a-f]+ of 16 or more: a match is a whole run either way
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: Strings that an exact part of a pattern may stand for, before it is treated as a break.
_MOST_STRINGS = 64

# A query is True (every text), ("and", queries), ("or", queries) or the number of a trigram.


def _of(text: bytes) -> int:
    return text[0] << 16 | text[1] << 8 | text[2]


def _all_of(strings: set[str]):
    """The query for texts that hold one of the strings."""
    ways = []
    for s in strings:
        data = s.lower().encode()
        if len(data) < 3:
            return True
        ways.append(("and", [_of(data[i : i + 3]) for i in range(len(data) - 2)]))
    return ways[0] if len(ways) == 1 else ("or", ways)


def _joined(kind: str, queries: list):
    if kind == "or":
        return True if True in queries or not queries else (kind, queries)
    queries = [q for q in queries if q is not True]
    return (kind, queries) if queries else True


def _analyse(tree) -> tuple[set[str] | None, object]:
    """(all strings that the pattern stands for, or None; a query that every matching text meets)."""
    exact: set[str] | None = {""}  # of the run since the last break
    whole, needs = True, []

    def broken() -> None:
        nonlocal exact, whole
        needs.append(_all_of(exact) if exact else True)
        exact, whole = {""}, False

    for op, arg in tree:
        strings, need = None, True
        if op is C.LITERAL:
            strings = {chr(arg)}
        elif op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
            strings = {chr(a) for _, a in arg}
        elif op is C.SUBPATTERN:
            strings, need = _analyse(arg[3])
        elif op is C.BRANCH:
            parts = [_analyse(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            need = _joined("or", [n for _, n in parts])
        elif op is C.MAX_REPEAT:
            low, high, inner = arg
            inside, inner_need = _analyse(inner)
            if low == 0 and high == 1 and inside is not None and len(inside) <= 2:
                strings = inside | {""}
            elif low >= 1:
                need = _all_of({s * min(low, 3) for s in inside}) if inside is not None else inner_need
        if strings is not None and len(exact) * len(strings) <= _MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
        else:
            broken()
            needs.append(_all_of(strings) if strings is not None else need)
    if whole:
        return exact, _all_of(exact)
    needs.append(_all_of(exact))
    return None, _joined("and", needs)


def trigram_query(pattern: str):
    """A Boolean query over trigrams of lower-cased bytes that every text with a match meets."""
    return _analyse(P.parse(pattern))[1]


def _trigrams(query) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(_trigrams, query[1]))


class Index:
    """Postings of the wanted trigrams over a block of texts: for each, the ascending text numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        self.n = len(offsets) - 1
        self.postings: dict[int, np.ndarray] = {}
        for low, high in W.slices(offsets):
            d = W.LOWER[data[offsets[low] : offsets[high]]].astype(np.uint32)
            codes = d[:-2] << 16 | d[1:-1] << 8 | d[2:] if len(d) > 2 else np.zeros(0, np.uint32)
            at = np.flatnonzero(wanted[codes])
            doc = np.searchsorted(offsets, at + offsets[low], "right") - 1
            keep = at + offsets[low] + 2 < offsets[doc + 1]  # no trigram reaches into the next text
            both = np.unique(codes[at[keep]].astype(np.int64) << 32 | doc[keep])
            for code in np.unique(both >> 32):
                found = both[both >> 32 == code] & 0xFFFFFFFF
                self.postings[int(code)] = np.concatenate([self.postings.get(int(code), found[:0]), found])

    def select(self, query) -> np.ndarray:
        """Numbers of the texts that meet the query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, int):
            return self.postings.get(query, np.zeros(0, np.int64))
        kind, parts = query
        sets = sorted(map(self.select, parts), key=len, reverse=kind == "or")
        out = sets[0]
        for s in sets[1:]:
            out = np.intersect1d(out, s, assume_unique=True) if kind == "and" else np.union1d(out, s)
        return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, spans array<struct<kind, start, end>>) and the columns in keep, for every row.

    Spans are matches, leftmost and not overlapping within a kind, in code points, end exclusive,
    ordered by start and then by the rules' order; a match that is too short is dropped.

    Every Arrow batch is a block with a trigram index of its own: no shuffle, and what a lost
    executor takes is indexed again with its block. The rules' Boolean queries intersect and unite
    postings; only the texts found are matched. A rule without mandatory trigrams scans all texts.

    Null and empty texts have no spans (and stay null or empty), repeated rows are scanned each,
    null ids are passed on, an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    compiled = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)), trigram_query(r.pattern)) for r in rules]
    names = [id_col, text_col, *keep]
    columns = docs.select(F.col(id_col), F.col(text_col), *keep)
    schema = StructType(columns.schema.fields + StructType.fromDDL("spans array<struct<kind:string,start:int,end:int>>").fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << 24, bool)
        wanted[[t for _, _, q in compiled for t in _trigrams(q)]] = True
        for batch in batches:
            data, offsets = W.buffers(batch.column(1))
            index = Index(data, offsets, wanted)
            candidates: dict[int, list[int]] = {}
            for i, (_, _, query) in enumerate(compiled):
                for k in index.select(query).tolist():
                    candidates.setdefault(k, []).append(i)
            spans: list[list[dict]] = []
            texts = batch.column(1)
            for k in range(len(batch)):
                found = []
                if k in candidates and (text := texts[k].as_py()):
                    for i in candidates[k]:
                        rule, pattern, _ = compiled[i]
                        found += [(m.start(), i, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                spans.append([{"kind": compiled[i][0].kind, "start": a, "end": b} for a, i, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*names, "spans"])

    return columns.mapInArrow(run, schema)


def joined_spans(spans: str, kinds: str = "") -> str:
    """SQL for kind:start:end of the spans (of some kinds), comma-joined."""
    chosen = f"filter({spans}, s -> s.kind in ({kinds}))" if kinds else spans
    return f"array_join(transform({chosen}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def redacted(found: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The rows of scan() with every span in the text replaced by mark; overlapping spans are one.

    Pieces of text between spans are kept as they are; null stays null. spans is dropped.
    """
    pieces = f"""aggregate(spans, named_struct('at', 0, 'out', ''),
        (acc, s) -> if(s.start < acc.at, named_struct('at', greatest(acc.at, s.end), 'out', acc.out),
            named_struct('at', s.end, 'out', concat(acc.out, substring({text_col}, acc.at + 1, s.start - acc.at), '{mark}'))),
        acc -> concat(acc.out, substring({text_col}, acc.at + 1)))"""
    return found.withColumn(text_col, F.expr(f"if(size(spans) > 0, {pieces}, {text_col})")).drop("spans")
