"""Suffix-array dedup, the Merkle manifest and conversation repair against plain versions of their definitions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecclimb.llm import conversations as C
from vecclimb.llm import entry
from vecclimb.llm import manifest as M
from vecclimb.llm import suffix_dedup as S


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def nulls_first(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


# --- suffix-array dedup


def repeats(rows, least=100):
    """(doc_id, bytes, removed, runs, digest) of rows, which stand in order."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - least + 1):
            window = data[p : p + least]
            if window in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), len([1 for g, _ in itertools.groupby(gone) if g]), hashlib.sha256(kept).hexdigest()))
    return out


def found_repeats(spark, rows, least=100):
    docs = spark.createDataFrame([(i, t, "bait", 5, 1) for i, t in rows], "doc_id long, text string, kept string, spans int, n int").repartition(3)
    out = S.without_repeats(docs, least).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out), key=nulls_first)


def passages(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢 ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60), text(25), text(14), "x" * 260, "ab" * 90]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randint(1, 30)) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "short"), (203, "z" * 99), (204, "z" * 100), (205, "z" * 101), (206, shared[0]), (207, shared[0]), (-5, shared[1])]
    return rows


def test_repeats_equal_brute_force(spark):
    rows = passages()
    wanted = repeats(sorted(rows))
    assert found_repeats(spark, rows) == wanted
    assert any(w[2] and w[2] < w[1] for w in wanted) and any(w[2] == w[1] > 0 for w in wanted)
    assert found_repeats(spark, rows, 64) == repeats(sorted(rows), 64)


def test_one_passage_in_many_contexts_goes_through_blocks(spark):
    rng = random.Random(8)
    line = "the line that stands in every single text of this table, " + "".join(rng.choice("klmnop ") for _ in range(60))
    rows = [(i, "".join(rng.choice("qrstuv ") for _ in range(70)) + line + "".join(rng.choice("ghij ") for _ in range(70))) for i in range(2500)]
    assert found_repeats(spark, rows) == repeats(sorted(rows))


def test_repeats_of_equal_rows_null_ids_and_long_texts(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=2_300_000))
    rows = [(1, long), (2, "q" + long[1_048_000:1_049_500] + "q"), (7, "same " * 60), (7, "same " * 60), (7, "same " * 60), (9, "same " * 60), (None, long[5:300]), (None, long[5:300])]
    got = found_repeats(spark, rows)
    order = [(None, long[5:300]), (None, long[5:300]), (1, long), (2, rows[1][1])] + rows[2:6]
    assert got == sorted(repeats(order), key=nulls_first)
    assert found_repeats(spark, []) == []


def test_repeats_of_texts_that_share_an_id(spark):
    """One of the two comes first, whichever; together they lose what they share once."""
    common = "".join(random.Random(2).choices("abcdefgh ", k=150))
    got = found_repeats(spark, [(4, "left " + common), (4, common + " right")])
    assert sorted(g[2] for g in got) == [0, 150]


def test_suffix_ranks_order_windows():
    data = np.frombuffer(b"abracadabra abracadabra alakazam abracadabra", np.uint8)
    at = np.arange(len(data) - 20 + 1)
    ranks = S.suffix_ranks(data, 20, at)
    windows = [data[p : p + 20].tobytes() for p in at]
    for a, b in itertools.combinations(range(len(at)), 2):
        assert (ranks[a] < ranks[b]) == (windows[a] < windows[b]) and (ranks[a] == ranks[b]) == (windows[a] == windows[b])
    assert S.previous_factors(ranks).tolist() == [w in windows[:i] for i, w in enumerate(windows)]


def test_op11(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.op11_suffix_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == repeats(sorted(rows))


# --- Merkle manifest


def leaf_of(row, add=0):
    row = (*row[:3], None if row[3] is None else row[3] + add, row[4])
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    """(sibling or None, whether the node is the right one) upwards."""
    return [(level[(i >> t) ^ 1] if (i >> t) ^ 1 < len(level) else None, i >> t & 1) for t, level in enumerate(levels[:-1])]


def manifest_of(rows, tampered):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = levels_of([leaf_of(r) for r in by[lang]])
    top, out = levels_of([trees[x][-1][0] for x in langs]), []
    for k, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            steps = path(trees[lang], i) + path(top, k)
            h = leaf_of(r, int(tampered(r)))
            for sibling, right in steps:
                h = sha(*([h] if sibling is None else [sibling, h] if right else [h, sibling]))
            out.append((r[0], leaf_of(r), trees[lang][-1][0], top[-1][0], sha(*(s for s, _ in steps if s)), h, h == top[-1][0]))
    return sorted(out, key=nulls_first)


def by_id(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0


def test_manifest_equals_plain_trees(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["web", None, "books"]), rng.choices(["en", "de", "fr", None, "漢", ""], [700, 5, 1, 30, 257, 2])[0], rng.choice([None, i]), rng.choice([None, "", "é漢", "text " * (i % 50)])) for i in range(1500)]
    rows += [(7, "web", "en", 3, "equal")] * 40 + [(None, "web", "en", 3, "no id"), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "bait") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    got = M.manifest(docs, F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", "verified").collect()
    wanted = manifest_of(rows, by_id)
    assert sorted(map(tuple, got), key=nulls_first) == wanted
    assert not all(w[-1] for w in wanted)
    assert all(r.verified for r in M.manifest(docs).select("verified").collect())  # nothing claimed, nothing wrong


def test_manifest_of_many_passes(spark, monkeypatch):
    """Blocks of four nodes: the trees take four passes, and ranges of eight rows meet their language."""
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "RANGE", 3)
    rows = [(i, "web", "en" if i % 3 else f"l{i % 7}", i, f"text {i}") for i in range(150)]
    got = M.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", "verified").collect()
    assert sorted(map(tuple, got)) == manifest_of(rows, lambda r: False)


def test_manifest_of_few_rows(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert M.manifest(spark.createDataFrame([], kind)).count() == 0
    one = M.manifest(spark.createDataFrame([(1, "a", "en", 4, "text")], kind)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:1", "1:a", "2:en", "1:4", "4:text") and one.siblings == "" and one.verified


def test_op12(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = entry.op12_merkle_manifest(spark, sf).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got)) == manifest_of(rows, by_id)


# --- conversation repair

SPACE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns) by a search over states, which keeps for each state the least cost and text."""
    names, wanted = {"u": "user", "a": "assistant"}, lambda p: "a" if p == "u" else "u"
    current = {"0": (0, "", ())}

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def inserted():
        out = dict(current)
        for p, (cost, audit, turns) in current.items():
            for n in range(3):
                p = wanted(p)
                cost, audit, turns = cost + 2, audit + "I", (*turns, (names[p], ""))
                put(out, p, (cost, audit, turns))
        return out

    for (_, role, text), fault in zip(rows, faults):
        following = {}
        for p, (cost, audit, turns) in inserted().items():
            put(following, p, (cost + 3, audit + "D", turns))
            if fault in ("", "truncated"):
                cost += fault == "truncated"
                if role[:1] == wanted(p) or role[:1] == "s" and p == "0":
                    put(following, role[:1], (cost, audit + "K", (*turns, (role, text))))
                put(following, wanted(p), (cost + 2, audit + "R", (*turns, (names[wanted(p)], text))))
        current = following
    current = inserted()
    return min(v for p, v in current.items() if p in "0a")


def repaired_of(ids, rows):
    """The contract's row of every id, from rows after damage."""
    out = []
    for c in ids:
        own = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, faults, initials = [r[0] for r in own if r[0] is not None], faults_of(own), [r[1][:1] for r in own]
        cost, audit, left = cheapest(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left))))
    return sorted(out, key=nulls_first)


def found_repairs(spark, rows):
    frame = spark.createDataFrame([(*r, "bait", 9) for r in rows], "conv_id long, turn long, role string, text string, o string, seq int").repartition(4)
    found = C.repair(frame)
    digests = {r.conv_id: r.repaired_sha256 for r in found.digests().collect()}
    got = [tuple(r) + (digests[r.conv_id],) for r in found.conversations.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()]
    turns = {}
    for r in sorted(found.turns().collect(), key=lambda r: r.no):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(turns.get(c, []))) for c in digests} == digests
    return sorted(got, key=nulls_first)


def spoken(rng, n, conv):
    texts = ["Yes.", "Why not?", "Go on!  ", "cut off", "", " \t\n", "é漢.", "Ends.\x0b", "no\x85end"]
    return [(conv, rng.choice([None, t, t, t + rng.randint(0, 3)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u2"]), rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.random()}.") for t in range(n)]


def test_repairs_equal_a_search_over_states(spark):
    rng = random.Random(6)
    rows = [r for c in range(120) for r in spoken(rng, rng.randint(1, 9), c)] + spoken(rng, 5, None)
    assert found_repairs(spark, rows) == repaired_of({r[0] for r in rows}, rows)
    assert found_repairs(spark, []) == []


def test_long_conversations_are_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 16)
    monkeypatch.setattr(C, "FAN", 3)
    rng = random.Random(7)
    rows = [r for c, n in ((1, 700), (2, 33), (3, 1)) for r in spoken(rng, n, c)]
    assert found_repairs(spark, rows) == repaired_of({1, 2, 3}, rows)


def test_null_roles_and_texts_are_a_space(spark):
    rows = [(1, 0, None, None), (1, 1, "user", "Hi."), (1, 2, None, "Well.")]
    assert found_repairs(spark, rows) == repaired_of({1}, [tuple(" " if x is None else x for x in r) for r in rows])


def test_rules_change_no_matrix():
    """A text's matrix is the same with and without rules, and every entry is the best of all edits."""
    rng = random.Random(2)
    grammar = C.Grammar((chr(C.SYMBOLS) + chr(C.SYMBOLS + 4), chr(C.RULES) + chr(C.SYMBOLS + 8)))
    held = grammar.matrices()
    for _ in range(200):
        text = "".join(chr(C.SYMBOLS + rng.choice([0, 4, 8, 8, 4, 1, 9, 13])) for _ in range(rng.randint(1, 9)))
        plain = with_rules = None
        for c in text:
            plain = held[c] if plain is None else C.flattened(C.product(plain, held[c]))
        for c in grammar.compress(text):
            with_rules = held[c] if with_rules is None else C.flattened(C.product(with_rules, held[c]))
        assert plain == with_rules
    assert len(grammar.compress(chr(C.SYMBOLS) + chr(C.SYMBOLS + 4) + chr(C.SYMBOLS + 8))) == 1


def test_rules_are_the_most_frequent_pairs_that_share_no_symbol():
    assert C.repair_pairs([("ab", 5), ("bc", 9), ("de", 5), ("xy", 1), ("dd", 3)], 3) == ["bc", "de"]


def damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_op13(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, entry.op13_conversation_repair(spark, sf).select(columns).collect())) == repaired_of({r[0] for r in rows}, damage(rows))


def test_op13_of_nulls_and_lost_conversations(spark, tmp_path):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone."), (None, None, None, None), (5, None, "user", "Hi."), (5, 2, None, "text!")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted(map(tuple, entry.op13_conversation_repair(spark, str(tmp_path)).select(columns).collect()), key=nulls_first)
    assert got == repaired_of({lost, None, 5}, damage(rows))
    assert (lost, 0, 0, 0, 0, 0, 0, "", sha("")) in got


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op12_merkle_manifest", "op13_conversation_repair"])
def test_registered(name):
    assert name in entry.queries()
