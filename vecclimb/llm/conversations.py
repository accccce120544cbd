"""Repair of the turn structure of conversations at least cost, by a dynamic program over a grammar.

A row is a symbol: the class of its role and its first fault. A symbol is a transfer matrix in the min-plus algebra
over the states of the wanted pattern; an entry holds a cost and the rope of the edits' initials. Re-Pair rules, learnt on the distinct
sequences of all conversations, replace pairs of symbols by one whose matrix is the product of theirs. So what
conversations have in common is evaluated once, and a conversation is the product of a few matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecclimb.session import Workspace, ship

#: Role initials with a part in the pattern; any other is the last class. Faults: none, truncated, blank, duplicate.
ROLES, OTHER = "sua", 3
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
#: The symbol of (role class, fault) is this code point plus 4 * class + fault; rules follow, from RULES on.
SYMBOLS, RULES = 0x4E00, 0x5000
#: Rows of a block: longer conversations are several blocks, whose matrices meet by FAN.
BLOCK_ROWS, FAN = 1024, 32
#: Rules are learnt in so many rounds, so many pairs a round.
ROUNDS, PAIRS = 8, 24

# States of the pattern (s?(ua)+)?: nothing yet, s, a user waits for its assistant, a pair is done.
START, SYSTEM, USER, DONE = range(4)
STATES = range(4)
_AFTER_USER = {START: USER, SYSTEM: USER, DONE: USER}
#: The states that a row of role class s, u, a leads to.
_STEPS = ({START: SYSTEM}, _AFTER_USER, {USER: DONE}, {})

# A rope is a text, or a pair of ropes. An entry is (cost, rope) or None; a matrix is a tuple of 16 entries.


def flat(rope) -> str:
    """The text of a rope."""
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += (top[1], top[0])
    return "".join(out)


def _better(a, b):
    """The cheaper entry; of equal costs the one whose text is less. Of such neither text begins with the other, as an insert costs."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or flat(a[1]) <= flat(b[1]) else b


def product(x: tuple, y: tuple) -> tuple:
    """The min-plus product of two matrices, or of a row and a matrix."""
    out = []
    for p in range(len(x) // 4):
        for q in STATES:
            best = None
            for m in STATES:
                a, b = x[4 * p + m], y[4 * m + q]
                if a and b:
                    best = _better(best, (a[0] + b[0], (a[1], b[1]) if a[1] and b[1] else a[1] or b[1]))
            out.append(best)
    return tuple(out)


def flattened(m: tuple) -> tuple:
    """A matrix whose ropes are texts."""
    return tuple(e and (e[0], flat(e[1])) for e in m)


def _matrix(entries: dict) -> tuple:
    return tuple(entries.get((p, q)) for p in STATES for q in STATES)


def _inserts() -> tuple:
    """Turns put in before a row: none, or one or two that the pattern asks for next (more lead nowhere new)."""
    out = {(p, p): (0, "") for p in STATES}
    for p in STATES:
        q = p
        for n in (1, 2):
            q = DONE if q == USER else USER
            out.setdefault((p, q), (2 * n, "I" * n))
    return _matrix(out)


INSERTS = _inserts()
#: What may follow the last row, to the states that end the pattern.
ENDS = tuple(e if q in (START, DONE) else None for (q, e) in zip((q for _ in STATES for q in STATES), INSERTS))


def symbol_matrix(symbol: int) -> tuple:
    """The matrix of a row, with inserts before it: keep, rerole (2), delete (3); 1 more for a truncated row that stays."""
    role, fault = divmod(symbol, 4)
    edits = {(p, p): (3, "D") for p in STATES}
    if fault in (CLEAN, TRUNCATED):
        more = int(fault == TRUNCATED)
        for p in STATES:
            q = DONE if p == USER else USER
            edits[p, q] = _better(edits.get((p, q)), (2 + more, "R"))
            if p in _STEPS[role]:
                q = _STEPS[role][p]
                edits[p, q] = _better(edits.get((p, q)), (more, "K"))
    return product(INSERTS, _matrix(edits))


@dataclass(frozen=True)
class Grammar:
    """Re-Pair rules in the order of their making: each a pair of characters, the symbol of rule k being RULES + k."""

    pairs: tuple[str, ...]

    def compress(self, text: str) -> str:
        for k, pair in enumerate(self.pairs):
            text = text.replace(pair, chr(RULES + k))
        return text

    def matrices(self) -> dict[str, tuple]:
        """The matrix of every symbol and rule, bottom-up."""
        out = {chr(SYMBOLS + s): flattened(symbol_matrix(s)) for s in range(16)}
        for k, pair in enumerate(self.pairs):
            out[chr(RULES + k)] = flattened(product(out[pair[0]], out[pair[1]]))
        return out


def repair_pairs(counts: list[tuple[str, int]], most: int) -> list[str]:
    """The pairs that a round replaces: the most frequent, ties by text, none sharing a symbol with one before it."""
    used: set[str] = set()
    out = []
    for pair, n in sorted(counts, key=lambda c: (-c[1], c[0])):
        if n > 1 and len(out) < most and not used & set(pair):
            out.append(pair)
            used |= set(pair)
    return out


def learn(texts: DataFrame, work: Workspace) -> Grammar:
    """Re-Pair rules of a table (seq, n) of distinct symbol texts and how often they occur.

    A round counts the neighbours of all texts in Spark and replaces up to PAIRS disjoint pairs. As a rule's symbol never meets more than
    16 + ROUNDS * PAIRS others, the counts that go to the driver are bounded by that number's square, whatever the rows.
    """
    pairs: list[str] = []
    current = texts
    for i in range(ROUNDS):
        at = F.sequence(F.lit(1), F.char_length("seq") - 1)
        found = current.filter(F.char_length("seq") > 1).select("n", F.explode(F.transform(at, lambda k: F.substring(F.col("seq"), k, F.lit(2)))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
        new = repair_pairs([tuple(r) for r in found.filter("n > 1").collect()], PAIRS)
        if not new:
            break
        seq: Column = F.col("seq")
        for k, pair in enumerate(new):
            seq = F.replace(seq, F.lit(pair), F.lit(chr(RULES + len(pairs) + k)))
        pairs += new
        current = work.save(current.withColumn("seq", seq), f"texts{i}")
    return Grammar(tuple(pairs))


def _evaluated(grammar):
    """The matrix of every block: the product of those of its symbols and rules, halves first. Rows keep their other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = grammar.value.matrices()

        @lru_cache(8192)
        def matrix(text: str) -> tuple:
            if len(text) == 1:
                return matrices[text]
            half = len(text) // 2
            return flattened(product(matrix(text[:half]), matrix(text[half:])))

        for batch in batches:
            yield _with_matrices(batch, [matrix(grammar.value.compress(s)) for s in batch.column("seq").to_pylist()])

    return run


_CELLS = "array<struct<cost:bigint,audit:string>>"


def _with_matrices(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    cells = pa.array([[e and {"cost": e[0], "audit": e[1]} for e in m] for m in found], kind)
    return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("k"), cells], names=["conv_id", "k", "cells"])


def _entries(cells: list) -> tuple:
    return tuple(e and (e["cost"], e["audit"]) for e in cells)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products of up to FAN matrices each, in order."""
    for batch in batches:
        found = []
        for parts in batch.column("parts").to_pylist():
            level = [_entries(p["cells"]) for p in parts]
            while len(level) > 1:
                level = [flattened(product(*level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            found.append(level[0])
        yield _with_matrices(batch, found)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, cost, audit): the best entry from the start to an end."""
    for batch in batches:
        costs, audits = [], []
        for cells in batch.column("cells").to_pylist():
            best = None
            for e in product(_entries(cells[:4]), ENDS):
                best = _better(best, e)
            costs.append(best[0])
            audits.append(flat(best[1]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["conv_id", "cost", "audit"])


class Walk:
    """The turns that the edits of an audit leave, the rows of the conversation coming one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _turn(self, role: str, text: str) -> tuple[str, str]:
        self.state = {"s": SYSTEM, "u": USER}.get(role[:1], DONE)
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The empty turns that stand before the next row, or after the last."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn("assistant" if self.state == USER else "user", "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._turn(role, text)
        elif edit == "R":
            yield self._turn("assistant" if self.state == USER else "user", text)


def _walked(turns: bool):
    """Of conversations that stream by in order, each led by its audit: the repaired turns, or a digest of them.

    Only an audit and the state of a hash are held, so that conversations of any length pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv, n, digest = None, None, 0, hashlib.sha256()
        ids, numbers, values, texts = [], [], [], []

        def take(found: Iterator[tuple[str, str]]) -> None:
            nonlocal n
            for role, text in found:
                if turns:
                    ids.append(conv), numbers.append(n), values.append(role), texts.append(text)
                else:
                    digest.update(("\n" if n else "").encode() + f"{role}:{text}".encode())
                n += 1

        def end() -> None:
            take(walk.inserted())
            if not turns:
                ids.append(conv), values.append(digest.hexdigest())

        def out(kind: pa.DataType) -> pa.RecordBatch:
            columns = {"conv_id": pa.array(ids, kind)} | ({"no": pa.array(numbers, pa.int64()), "role": pa.array(values, pa.string()), "text": pa.array(texts, pa.string())} if turns else {"repaired_sha256": pa.array(values, pa.string())})
            for held in (ids, numbers, values, texts):
                held.clear()
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "o", "role", "text"))
            for c, o, role, text in zip(*columns):
                if o < 0:
                    if walk:
                        end()
                    walk, conv, n, digest = Walk(text), c, 0, hashlib.sha256()
                else:
                    take(walk.row(role, text))
            yield out(kind)
        if walk:
            end()
            yield out(kind)

    return run


@dataclass
class Repaired:
    """conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit); how to get the repaired texts."""

    conversations: DataFrame
    _led: DataFrame

    def turns(self) -> DataFrame:
        """(conv_id, no, role, text): the turns of the repaired conversations, from 0."""
        return self._led.mapInArrow(_walked(True), f"conv_id {self._led.schema['conv_id'].dataType.simpleString()}, no long, role string, text string")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): of `role:text` of all turns, joined by newlines.

        A digest is taken in order, so the rows of a conversation, however many, stream through one task that holds none of them.
        """
        return self._led.mapInArrow(_walked(False), f"conv_id {self._led.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame) -> Repaired:
    """The cheapest repair of every conversation of (conv_id, turn, role, text) so that its role initials are (s?(ua)+)?.

    Rows stand by turn, nulls first; those of one turn by role, the beginning of the text, and a hash of both. Null roles and texts
    are one space. A row is blank (only ASCII white space), else duplicate (its role and text came earlier), else truncated (its last
    character that is no white space is none of `.!?`). Blank and duplicate rows must go. To keep a row costs 0, another role 2, to delete it 3, an
    empty turn 2, a truncated row that stays 1 more; of equally cheap repairs the one whose edits' initials
    (D, I, K, R) are least. gaps are turns that are missing between the least and the greatest; illegal counts neighbours whose
    initials are not su, ua or au. conv_id may be null, which is a conversation too. An empty table gives no rows.

    Rows are sorted by ranges and numbered there; duplicates are found by partial aggregates and a join by the number of a row; a
    conversation of any length is blocks of BLOCK_ROWS rows, whose matrices meet FAN at a time.
    """
    spark = rows.sparkSession
    ship(spark)
    work = Workspace(spark, "conversations")
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", "_begin", "d1"]
    base = base.withColumns({"_begin": F.substring("text", 1, 32), "d1": F.xxhash64("role", "text"), "d2": F.xxhash64("text", F.lit(1), "role"), "_any": F.monotonically_increasing_id()})
    ordered = base.repartitionByRange(*map(F.col, order), F.col("_any")).sortWithinPartitions(*order).withColumn("o", F.monotonically_increasing_id())
    ordered = work.save(ordered.drop("_begin", "_any"), "ordered")

    firsts = ordered.groupBy("conv_id", "d1", "d2").agg(F.min("o").alias("o")).select("o", F.lit(True).alias("first"))
    ending = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    initial = F.left("role", F.lit(1))
    role = reduce(lambda other, r: F.when(initial == ROLES[r], r).otherwise(other), range(len(ROLES)), F.lit(OTHER))
    marks = ordered.select("conv_id", "o", "turn", role.alias("role"), (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(CLEAN)
    every = "".join(chr(SYMBOLS + s) for s in range(16))
    symbols = marks.join(firsts.hint("merge"), "o", "left").select("conv_id", "o", F.substring(F.lit(every), F.col("role") * 4 + fault + 1, F.lit(1)).alias("sym"))

    blocks = symbols.groupBy("conv_id", F.floor(F.col("o") / BLOCK_ROWS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("o", "sym"))).alias("s"))
    blocks = work.save(blocks.select("conv_id", "block", F.array_join(F.transform("s", lambda x: x["sym"]), "").alias("seq")), "blocks")
    grammar = spark.sparkContext.broadcast(learn(work.save(blocks.groupBy("seq").agg(F.count("*").alias("n")), "distinct"), work))

    chars = lambda kind: "[" + "".join(chr(SYMBOLS + 4 * r + kind) for r in range(4)) + "]"
    count = lambda kind: F.regexp_count("seq", F.lit(chars(kind)))
    roles = F.translate("seq", every, "".join(c * 4 for c in ROLES + "o"))
    legal = sum((F.regexp_count(roles, F.lit(p)) for p in ("s(?=u)", "u(?=a)", "a(?=u)")), F.lit(0))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    edge = F.concat(F.lag(F.right(roles, F.lit(1))).over(by_block), F.left(roles, F.lit(1)))  # null before the first block
    numbered = blocks.select("conv_id", "seq", (F.row_number().over(by_block) - 1).alias("k"), (F.char_length("seq") - 1 - legal + F.coalesce((~edge.isin("su", "ua", "au")).cast("int"), F.lit(0))).alias("illegal"))
    counts = numbered.groupBy("conv_id").agg(F.sum(count(BLANK)).alias("blank"), F.sum(count(DUPLICATE)).alias("duplicate"), F.sum(count(TRUNCATED)).alias("truncated"), F.sum("illegal").alias("illegal"))
    turns = ordered.filter("turn is not null").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))

    conv = rows.schema["conv_id"].dataType.simpleString()
    cells = work.save(numbered.select("conv_id", "k", "seq").mapInArrow(_evaluated(grammar), f"conv_id {conv}, k int, cells {_CELLS}"), "cells")
    i = 0
    while (cells.agg(F.max("k")).first()[0] or 0) > 0:
        group = cells.groupBy("conv_id", F.floor(F.col("k") / FAN).cast("int").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("k", "cells"))).alias("parts"))
        cells = work.save(group.withColumnRenamed("_k", "k").mapInArrow(_joined, f"conv_id {conv}, k int, cells {_CELLS}"), f"cells{i}")
        i += 1
    audits = work.save(cells.mapInArrow(_finished, f"conv_id {conv}, cost long, audit string"), "audits")

    parts = counts.unionByName(turns, allowMissingColumns=True).unionByName(audits, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.max("audit").alias("audit"))
    led = ordered.select("conv_id", "o", "role", "text").unionByName(audits.select("conv_id", F.lit(-1).cast("long").alias("o"), F.lit("").alias("role"), F.col("audit").alias("text")))
    return Repaired(out, led.repartition("conv_id").sortWithinPartitions("conv_id", "o"))
