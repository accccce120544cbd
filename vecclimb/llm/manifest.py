"""A Merkle manifest of a dataset: hashes of rows, of languages and of the whole, with a proof for every row.

Levels of a tree are kept as concatenated strings. An aligned block of BLOCK nodes is one string of digests of 64 hex
digits; fixed-width substrings of it hash to the next level, again one string. The siblings of a node flank
it in its levels' strings, and the roots of the blocks are the nodes of the next tree, until one block holds all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecclimb.session import Workspace

#: Levels of a block, which has 2 ** LEVELS nodes.
LEVELS = 8
BLOCK = 1 << LEVELS
HEX = 64
#: Rows of a group that meet what belongs to the group in one task: 2 ** RANGE.
RANGE = 14

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field `-` if null, else its UTF-8 byte count, a colon and its text."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, order: list[str], work: Workspace, name: str) -> DataFrame:
    """rows with idx, gapless from 0 in a group, in the order given (nulls first; rows equal in it stand in any order).

    Rows are dealt by ranges of group and order, so that a large group is many ranges and no task sorts a whole one. Ranges
    are counted, and the numbers of a range follow those of the ranges before it.
    """
    dealt = rows.withColumn("_any", F.monotonically_increasing_id())  # parts equal rows, however many
    dealt = work.save(dealt.repartitionByRange(F.col(group), *map(F.col, order), F.col("_any")).withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order, "_any"))
    met = dealt.withColumn("_row", inside).join(offsets.hint("merge"), (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_row") - 1).alias("idx"))


def by_group(rows: DataFrame, group: str, few: DataFrame, name: str) -> DataFrame:
    """rows, numbered by idx in their group, joined to few, which has one row a group and its size n.

    A group is dealt to as many salts as it has ranges of 2 ** RANGE rows, and its row of few goes to each.
    """
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n").cast("long"), RANGE))))
    return rows.join(salted.hint("merge"), F.col(group).eqNullSafe(F.col(name)) & (F.shiftright(F.col("idx").cast("long"), RANGE) == F.col("_salt"))).drop("_salt")


def _node(level: Column, k: Column) -> Column:
    """The k-th digest of a level's string."""
    return F.substring(level, k * HEX + 1, F.lit(HEX))


def _above(level: Column) -> Column:
    """The next level's string: every two digests become theirs, a last single one its own."""
    pairs = F.ceil(F.octet_length(level) / (2 * HEX)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), pairs - 1), lambda k: F.sha2(F.substring(level, k * (2 * HEX) + 1, F.lit(2 * HEX)), 256))
    return F.array_join(hashes, "").cast("binary")


def depth(n: Column) -> Column:
    """Levels above n leaves until one node remains."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def tree(nodes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(tree, idx, n, siblings, root) of nodes (tree, idx, node): siblings is the proof, one string from the leaf upwards.

    idx is gapless from 0 in a tree, and n its number of leaves. Every pass hashes LEVELS levels of all blocks and leaves a
    row a block, so that there are log(n) / LEVELS passes; proofs of blocks then come down to their nodes, block by block.
    """
    passes: list[DataFrame] = []
    sizes = nodes.groupBy(F.col("tree").alias("_t")).agg(F.count("*").alias("n"))
    current = by_group(nodes, "tree", sizes, "_t").select("tree", "idx", "node", "n")
    while True:
        block = current.groupBy("tree", F.shiftright("idx", LEVELS).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("nodes"))
        lowest = F.array_join(F.transform("nodes", lambda x: x["node"]), "").cast("binary")
        up = F.least(depth(F.col("n")), F.lit(LEVELS))
        levels = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(lowest), lambda held, k: F.when(k <= up, F.concat(held, F.array(_above(F.element_at(held, -1))))).otherwise(held))
        passes.append(work.save(block.select("tree", "block", "n", levels.alias("levels")), f"{name}{len(passes)}"))
        if not passes[-1].filter(F.col("n") > BLOCK).limit(1).count():
            break
        tops = passes[-1].filter(F.col("n") > BLOCK)
        current = tops.select("tree", F.col("block").alias("idx"), F.element_at("levels", -1).cast("string").alias("node"), F.ceil(F.col("n") / BLOCK).alias("n"))
    proved: DataFrame | None = None
    for held in reversed(passes):
        own = held.filter(F.col("n") <= BLOCK).select("tree", "block", "n", "levels", F.lit("").alias("_rest"), F.element_at("levels", -1).cast("string").alias("root"))
        if proved is not None:
            known = proved.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("siblings").alias("_rest"), "root")
            large = held.filter(F.col("n") > BLOCK).join(known.hint("merge"), F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_i")))
            own = own.unionByName(large.select(own.columns))
        width = (F.octet_length(F.element_at("levels", 1)) / HEX).cast("int")
        nodes_ = own.select("*", F.explode(F.sequence(F.lit(0), width - 1)).alias("_k"))

        def sibling(level: Column, t: Column) -> Column:
            other = F.call_function("shiftright", F.col("_k"), t).bitwiseXOR(F.lit(1))
            return _node(level, other).cast("string")  # empty past the end

        below = F.slice("levels", F.lit(1), F.size("levels") - 1)
        segment = F.array_join(F.transform(below, sibling), "")
        proved = nodes_.select("tree", (F.col("block") * BLOCK + F.col("_k")).alias("idx"), "n", F.concat(segment, "_rest").alias("siblings"), "root")
    return proved


def fold(node: Column, idx: Column, n: Column, siblings: Column) -> Column:
    """The root that a node gives with its siblings: its place tells on which side they stand, or that there is none."""
    state = F.struct(node.alias("h"), F.lit(1).alias("at"))

    def step(s: Column, t: Column) -> Column:
        place = F.call_function("shiftright", idx, t)
        nodes = F.call_function("shiftright", n - 1, t) + 1
        other = F.substring(siblings, s["at"], F.lit(HEX))
        odd, lone = place.bitwiseAND(F.lit(1)) == 1, place == nodes - 1
        both = F.when(odd, F.concat(other, s["h"])).when(lone, s["h"]).otherwise(F.concat(s["h"], other))
        return F.struct(F.sha2(both, 256).alias("h"), (s["at"] + F.when(lone & ~odd, 0).otherwise(HEX)).alias("at"))

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), depth(n) - 1), state, step)["h"]).otherwise(node)


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, folded_root, verified): a digest and a proof of every row.

    A leaf is the digest of doc_id, source, lang, n_chars and text. The leaves of a language stand by doc_id, nulls first and equal
    ones by their digests; every two neighbours, and a last single one, become the digest of their hex digits
    until one remains, the subroot. The subroots stand by language, null first, and give the root likewise. siblings are the digests
    that lead from the leaf to the root, one after the other. claimed is an expression for n_chars as someone claims it to be; the
    root is then recomputed from the leaf that the claim gives, and verified says whether it is the manifest's.
    An empty table gives no rows. Rows of any number may share a language or a doc_id: they are dealt by ranges.
    """
    work = Workspace(docs.sparkSession, "manifest")
    columns = {c: F.col(c) for c in FIELDS}
    held = docs.select(F.col("doc_id"), F.col("lang"), leaf(list(columns.values())).alias("leaf"), leaf(list((columns | {"n_chars": claimed}).values())).alias("claim") if claimed is not None else F.lit(None).cast("string").alias("claim"))
    rows = work.save(numbered(held, "lang", ["doc_id", "leaf"], work, "leaves"), "numbered")
    proofs = tree(rows.select(F.col("lang").alias("tree"), "idx", F.col("leaf").alias("node")), work, "level")
    proofs = proofs.select(F.col("tree").alias("_lang"), F.col("idx").alias("_idx"), "n", "siblings", F.col("root").alias("subroot"))
    below = rows.join(proofs.hint("merge"), (F.col("idx") == F.col("_idx")) & F.col("lang").eqNullSafe(F.col("_lang")))

    langs = rows.filter("idx = 0").select("lang").join(proofs.filter("_idx = 0").select("_lang", "subroot"), F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", F.col("subroot").alias("node"), F.lit(0).alias("all"))
    places = work.save(numbered(langs, "all", ["lang"], work, "langs"), "subroots")
    top = tree(places.select(F.lit(0).alias("tree"), "idx", "node"), work, "top")
    top = places.join(top.select(F.col("idx").alias("_i"), F.col("n").alias("top_n"), F.col("siblings").alias("top_siblings"), "root"), F.col("idx") == F.col("_i"))
    top = top.select(F.col("lang").alias("_l"), F.col("idx").alias("top_idx"), "top_n", "top_siblings", "root")
    sizes = top.join(proofs.filter("_idx = 0").select("_lang", F.col("n").alias("rows")), F.col("_l").eqNullSafe(F.col("_lang"))).drop("_lang").withColumnRenamed("rows", "n")
    met = by_group(below.withColumnRenamed("n", "leaves"), "lang", sizes, "_l")
    from_leaf = fold(F.coalesce("claim", "leaf"), F.col("idx"), F.col("leaves"), F.col("siblings"))
    out = met.select("doc_id", "leaf", "subroot", "root", F.concat("siblings", "top_siblings").alias("siblings"), from_leaf.alias("_sub"), "top_idx", "top_n", "top_siblings")
    out = out.withColumn("folded_root", fold(F.col("_sub"), F.col("top_idx"), F.col("top_n"), F.col("top_siblings")))
    return out.select("doc_id", "leaf", "subroot", "root", "siblings", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
