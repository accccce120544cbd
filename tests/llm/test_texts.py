"""BPE, secrets, decontamination and token files against plain versions of their definitions."""

import base64
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from vecclimb.llm import bpe, decontaminate, secret_scan, token_files, words

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "é ß漢字 🙂 don't 12345 ,,,!!"), (5, "x" * 5000 + " " * 3000), (6, "ab" * 20000), (7, "same"), (7, "same"), (None, "no id <|endoftext|> \x1c\x85 "), (8, "a\n\n b\r\n")]


def frame(spark, rows=ODD, name="text"):
    return spark.createDataFrame([(*r, "bait", 3) for r in rows], f"doc_id long, {name} string, ids string, spans int")


def pretty(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def test_byte_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    wanted = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    rows = ODD + [(100 + i, "".join(rng.choice(["a", "the", " ", "\n", "é", "1", "'s", "\x1c", "ü", "ing", "?", "漢"]) for _ in range(60))) for i in range(200)]
    got = bpe.decode(bpe.encode(frame(spark, rows), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert pretty((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got) == pretty((i, wanted.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    once = bpe.encode(frame(spark, rows), RANKS, P.PATTERN, decoded=True).collect()
    assert pretty((r.doc_id, list(r.ids), bytes(r.decoded)) for r in once) == pretty((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got)
    assert bpe.encode(frame(spark).limit(0), RANKS, P.PATTERN).count() == 0


def test_backtracking_equals_merges():
    coder, rng = bpe.BytePairs.load(RANKS, P.PATTERN, bpe.classes_unlike(P.PATTERN)), random.Random(1)
    tokens = [t for t in coder.ranks if len(t) > 1]
    pieces = [b"".join(rng.choice(tokens) for _ in range(4)) for _ in range(300)] + [b"a" * n for n in range(1, 40)] + [bytes(rng.choice(b"aab e") for _ in range(30)) for _ in range(300)] + [b""]
    wanted = [([coder.ranks[p]] if p in coder.ranks else coder.merged(p)) for p in pieces]
    found, counts = coder.encode_pieces(pieces)
    assert found.tolist() == [t for x in wanted for t in x] and counts == [len(x) for x in wanted]
    for data in rng.sample(tokens, 300):  # a token is what its two halves merge to
        token = coder.ranks[data]
        assert (coder.left[token] >= 0) == (coder.merged(data) == [token])
        assert coder.left[token] < 0 or coder.tokens[coder.left[token]] + coder.tokens[coder.right[token]] == data


def test_bytes_of_any_text_are_split_as_by_tiktoken():
    """Code points whose class depends on the Unicode version included."""
    coder = bpe.BytePairs.load(RANKS, P.PATTERN, bpe.classes_unlike(P.PATTERN))
    wanted = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(9)
    odd = [chr(a) for ranges in bpe.classes_unlike(P.PATTERN).values() for a, _ in ranges]
    char = lambda: rng.choice([rng.choice("ab 1'\n,"), chr(rng.randrange(0x20, 0x250)), chr(rng.randrange(0xE000, 0x110000)), chr(rng.randrange(0xD800)), rng.choice(odd or ["x"])])
    texts = ["\U000190a4\ubb82", *("".join(char() for _ in range(rng.randrange(1, 12))) for _ in range(20_000))]
    texts += ["".join(rng.choice(["ab", " ", " ", "1", "'s", ",", "\t", "\n", "\x85", "\xa0", "\u1680", "\u2028", "\u3000", "é", "\u0301", "Â", "\U0001f642"]) for _ in range(rng.randrange(0, 30))) for _ in range(20_000)]
    ids, bounds = coder.encode_texts(*words.buffers(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [wanted.encode_ordinary(t) for t in texts]
    data, places = coder.decode(ids, bounds)
    assert [data[a:b].tobytes().decode() for a, b in zip(places, places[1:])] == texts


BASE = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12), "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18), "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16)}


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (p, flags, ok) in enumerate(BASE.values()) for m in re.finditer(p, text or "", flags) if ok(m)]
    return [(list(BASE)[k], a, b) for a, k, b in sorted(found)]


def test_secret_scan(spark):
    rng = random.Random(8)
    parts = ["password=", "Token : ", "api_key='", "apikey", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "short", " ", "\n", "é", "=", "SECRET", "0123456789abcdef", "abcdefghijklm"]
    rows = ODD + [(50 + i, "".join(rng.choice(parts) for _ in range(12))) for i in range(300)] + [(40, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36)]
    got = secret_scan.scan(frame(spark, rows)).collect()
    assert pretty((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE]) for r in got) == pretty((i, base_spans(t)) for i, t in rows)
    assert {s.kind for r in got if r.doc_id == 40 for s in r.spans} == {"pem", "forge", "hex"}
    clean = {r.doc_id: r.text for r in secret_scan.redacted(secret_scan.scan(frame(spark, [(1, "ab é password = abcdefghijklmnop x"), (2, None), (3, "z")]))).collect()}
    assert clean == {1: "ab é [SECRET] x", 2: None, 3: "z"}
    assert secret_scan.scan(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("pattern,texts", [(r"(abc|xyz)+def?", ["abcabcde", "xyzde"]), (r"[ab]cd[0-9]*ef+g", ["acd12effg"]), (r"a?b?c?", [""]), (r"(?i:hello)x{2}", ["HELLOxx"])])
def test_trigram_query_is_necessary(pattern, texts):
    """What a pattern matches meets its query."""
    query = secret_scan.trigram_query(pattern)
    wanted = np.zeros(1 << 24, bool)
    wanted[list(secret_scan._trigrams(query))] = True
    for text in texts:
        assert re.search(pattern, text)
        data = np.frombuffer(text.encode(), np.uint8)
        index = secret_scan.Index(data, np.array([0, len(data)]), wanted)
        assert index.select(query).tolist() == [0]


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_overlaps(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes, out = {len(w) for w in windows}, []
    for d, t in docs:
        w = WORD.findall((t or "").encode().lower())
        hit, named = set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if tuple(w[k : k + s]) in windows:
                    hit.update(range(k, k + s))
                    named |= windows[tuple(w[k : k + s])]
        out.append((d, len(w), len(hit), sorted(x for x in named if x is not None)))
    return out


@pytest.mark.parametrize("most", [250_000, 20])
def test_decontaminate(spark, most):
    rng = random.Random(most)
    text = lambda k: " ".join(rng.choice(["Alpha", "beta,", "gámma", "d3lta", "-"]) for _ in range(k))
    items = [(1, text(14)), (2, text(12)), (3, "rare words"), (4, None), (5, "..."), (6, text(12)), (6, "again"), (None, "nameless item")]
    docs = ODD + [(60 + i, text(9) + " " + (items[i % 3][1] or "") + " | " + text(20)) for i in range(60)] + [(30, "a nameless ITEM, again"), (31, "rare"), (32, "words rare words")]
    got = decontaminate.find_overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), most_windows=most)
    rows = got.collect()
    assert pretty((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows) == pretty(brute_overlaps(docs, items))
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in rows}
    assert spans[32] == [(6, 16)] and spans[30] == [(2, 22)]
    assert {r.doc_id: r.text for r in decontaminate.spans_removed(got).collect()}[32] == "words "
    kept = {r.doc_id for r in decontaminate.without_overlaps(got).collect()}
    assert 31 in kept and 32 not in kept
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.find_overlaps(frame(spark), empty).collect())


def test_token_files(spark):
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*ODD, (7, "another text of the same id"), (7, "a third"), *((1000 - i, f"Document {i}: Hello, WORLD!! ½ it's {i * 7919}") for i in range(300))]
    manifest = token_files.write_token_files(frame(spark, rows), path, 2, length=64, batch_rows=4, file_ids=3000)
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    at, wanted, stream = 0, [], []
    order = {t: h for t, h in spark.createDataFrame(rows, "id long, text string").selectExpr("text", "xxhash64(text)").collect()}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], order[r[1]])):  # repeated ids by a hash of the text
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        wanted.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stream += ids
        at += len(ids)
    assert got == wanted
    files = sorted(manifest.collect(), key=lambda r: r["start"])
    assert len({r["file"] for r in files}) >= at // 12_000  # 3,000 ids and a text of up to 10,000 each
    first = token_files.StreamFile(files[0]["file"])
    ids, mask = first.sequence(0)
    assert ids.tolist() == stream[:64] and mask.all() and len(first.sequence(len(first) - 1)[0]) == 64
    assert token_files.write_token_files(frame(spark).limit(0), path, 2).count() == 0


def test_words_are_encoded_as_in_whole_texts():
    path = P.path("word_bpe_49k.json")
    coder, tokenizer = token_files.WordEncoder.load(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    bits = ["a", "Ab", "İ", "I", "Σ", "s", "e\u0301", "\u0301", "\u0338", "=", "<", "'", "'s", "!", ".", "½", "²", "9", " ", " ", "\n", "\t", "\r\n", "\u3000", "\x85", "<|endoftext|>", "<|", "漢", "\U0001f642", "\x1c", "ﬁ", "\u212b", "_", "\u0130'"]
    texts = ["İ!", "İ'", "½ ½", "", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 15))) for _ in range(8000))]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x400), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), 32])) for _ in range(rng.randrange(1, 12))) for _ in range(12_000)]
    ids, bounds = coder.encode_texts(*words.buffers(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_of_any_case_with_marks_after_them():
    """A few texts a call, so that most calls hold no added token and take words of either case for the same."""
    path = P.path("word_bpe_49k.json")
    coder, tokenizer = token_files.WordEncoder.load(path), Tokenizer.from_file(path)
    rng = random.Random(16)
    bits = [*"aAhHtTwWjJsSiIkK01 '.,!$<|>\n\t\x7f\x00", "'s", "'RE", "'Ll", "\u0301", "\u0331", "\u0307", "\u030a", "\u02be", "é", "É", "ß", "ſ", "\u212a", "Σ", "ς", "½", "漢", "\x85", "\u3000"]
    calls = [[], [""], ["A", "\u0331"], ["TOKEN<|EndOfText|>Ab.", "ab."], ["<|endoftext|>"], *([("".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))) for _ in range(20)] for _ in range(1500))]
    for texts in calls:
        ids, bounds = coder.encode_texts(*words.buffers(pa.array(texts, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_take_whole_texts():
    path = P.path("byte_bpe_50k.json")
    coder, tokenizer = token_files.WordEncoder.load(path), Tokenizer.from_file(path)
    texts = ["two words  here", " x\ny", ""]
    ids, bounds = coder.encode_texts(*words.buffers(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_those_of_a_regex():
    texts = ["Ab c,d é1", None, "", "  x ", "漢字 a-b_c"] * 3
    for table, pattern in ((words.ALPHANUMERIC, WORD), (words.NOT_SPACE, re.compile(rb"[^\x20\x09-\x0D]+"))):
        got = [[w.word(i) for i in range(w.bounds[k], w.bounds[k + 1])] for _, w in words.each(pa.array(texts), table) for k in range(len(w.bounds) - 1)]
        assert got == [pattern.findall((t or "").encode().lower()) for t in texts]
    a, b = (next(words.each(pa.array([t]), words.NOT_SPACE))[1].hashes for t in ("Same word other", "x y same WORD z"))
    assert a[0] == b[2] and a[1] == b[3] and len(set(a.tolist())) == 3
