"""The registered queries as they are: every column of the contracts against plain computations over sf0.001."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.test_near_dedup import brute
from tests.llm.test_tables import check_shards
from tests.llm.test_texts import base_spans, brute_overlaps
from vecclimb.llm import entry


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_op1(spark, sf, texts):
    wanted = brute([(i, t) for i, t in texts], 3, 85)
    assert rows(entry.op1_minhash_near_dedup(spark, sf), "doc_id", "n_shingles", "component_id", "kept") == sorted((i, n, c, i == c) for i, (n, c) in wanted.items())


@pytest.mark.parametrize("query, modulus, held", [(entry.op2_quality, 3, 1), (entry.op3_toxicity, 5, 0)])
def test_op2_and_op3(spark, sf, texts, query, modulus, held):
    got = rows(query(spark, sf), "doc_id", "held_out", "score", "predicted")
    assert [(i, h) for i, h, _, _ in got] == [(i, zlib.crc32(str(i).encode()) % modulus == held) for i, _ in texts]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, _, s, p in got)


def test_op4(spark, sf, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = [(i, coder.encode_ordinary(t or ""), t or "") for i, t in texts]
    assert rows(entry.op4_byte_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == [(i, len(ids), sha(",".join(map(str, ids))), sha(t)) for i, ids, t in wanted]


def test_op5(spark, sf, texts):
    got = {r.doc_id: r for r in entry.op5_secret_scan(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        spans = base_spans(t)
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(",".join(joined)) and set(joined) <= set(r.spans.split(","))


def test_op6(spark, sf, texts):
    tokenizer, at, wanted = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        wanted.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(entry.op6_token_files(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32") == wanted


def test_op7(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in given], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in given])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    got = rows(entry.op7_vector_near_dedup(spark, sf), "vec_id", "n_links", "component_id", "kept")
    assert [(i, n) for i, n, _, _ in got] == [(r.vec_id, int(n)) for r, n in zip(given, linked.sum(axis=1))]
    assert all(k == (i == c) for i, _, c, k in got)


def test_op8(spark, sf, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    wanted = [(i, n, hit, len(named), sha(",".join(sorted(map(str, named)))), hit > 0) for i, n, hit, named in brute_overlaps(texts, items)]
    assert rows(entry.op8_decontaminate(spark, sf), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == wanted


def test_op9(spark, sf):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    got = {r.page_id: r for r in entry.op9_url_filter(spark, sf).collect()}
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        host, path = "", ""
        if page.url is not None and "://" in page.url:
            rest = page.url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[page.page_id]
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, r.verdict))


def test_op10(spark, sf, texts):
    check_shards(texts, entry.op10_sharding(spark, sf).collect(), 40)
