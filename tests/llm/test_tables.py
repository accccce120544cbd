"""Vectors, URLs and shards against plain versions, and the pipeline against its parts."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from vecclimb.llm import sharding, skew, url_filter, vector_dedup
from vecclimb.llm.vector_dedup import near_vectors
from vecclimb.session import Workspace


def vectors(seed, n=700, size=24):
    """Clusters around few directions, one of them holding a third, with copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, size))
    out = []
    for i in range(n):
        c = centres[0] if i % 3 == 0 else centres[rng.integers(20)]
        v = c + rng.normal(size=size) * rng.choice([0.02, 0.1, 0.2])
        out.append((i, (out[-1][1] if out and i % 7 == 0 else v.astype(np.float32).tolist()), int(i % 2)))
    return out


def test_near_vectors(spark):
    rows = vectors(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    cosine = x @ x.T
    clear = np.abs(cosine - 0.98) > 1e-9
    linked = (cosine >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    assert clear.all()
    links = sum(n for n, _, _ in got.values())
    assert links <= linked.sum() and links >= 0.99 * linked.sum()
    root = list(range(len(rows)))
    for i, j in zip(*np.nonzero(linked)):
        a, b = i, j
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def top(z):
        while root[z] != z:
            z = root[z]
        return z

    agree = sum(got[i][1] == top(i) for i in range(len(rows)))
    assert agree >= 0.99 * len(rows)


def test_near_vectors_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 0), (12, [1e-320, 0.0], 0), (12, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    frame = spark.createDataFrame([(*r, "bait") for r in rows], "vec_id long, embedding array<double>, label int, unit string")
    got = [tuple(r) for r in near_vectors(frame).collect()]
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r[1:])
    assert len(got) == len(rows)
    assert by[1] == [(4, 1, True)] and by[2] == [(4, 1, False)] and by[12] == [(4, 1, False)] * 2 and by[None] == [(4, 1, False)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_of_one_id_and_large_buckets(spark, monkeypatch):
    """Vectors that share an id are nodes of their own; blocks of a bucket and salted keys lose no link."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(skew, "LEAST_ROWS", 3)
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (1, [1.0, 0.0], 1)]
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    rng = np.random.default_rng(2)
    many = [(i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist(), 0) for i in range(200)]
    rows = near_vectors(spark.createDataFrame(many, "vec_id long, embedding array<double>, label int")).collect()
    assert all((r.n_links, r.component_id, r.kept) == (199, 0, r.vec_id == 0) for r in rows)


def test_hosts_paths_and_rules(spark):
    rows = [(1, "http://Example.COM/en/7x?q#f"), (2, "https://a.example.com/en/1"), (3, "ftp://b.net/de/"), (4, "x://example.net/de/8"), (5, None), (6, "no scheme"), (7, "http://c.org?x"), (8, "http://com/en/"), (9, "http://notcom.xcom/en/"), (10, "a://b://c/d"), (11, "http://d.org/es/#"), (11, "http://d.org/es/#")]
    frame = spark.createDataFrame([(*r, None, "bait") for r in rows], "page_id long, url string, html string, host string")
    got = defaultdict(list)
    for r in url_filter.judge(frame).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("example.com", "/en/7x", "example.com/en/7", "allow")]
    assert got[2] == [("a.example.com", "/en/1", "com/en/", "block")]
    assert got[3] == [("b.net", "/de/", "net/de/", "allow")] and got[4] == [("example.net", "/de/8", "example.net/de/8", "block")]
    assert got[5] == got[6] == [("", "", None, "allow")] and got[7] == [("c.org", "", None, "allow")]
    assert got[8][0][2] == "com/en/" and got[9][0][2] is None and got[10] == [("b:", "//c/d", None, "allow")]
    assert got[11] == [("d.org", "/es/", "org/es/", "block")] * 2
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_trust_flows_along_links(spark):
    link = lambda *to: " ".join(f"<a href='http://{h}/'>x</a>" for h in to)
    rows = [(1, "http://good.net/de/1", link("near.xyz", "good.net")), (2, "http://near.xyz/", link("far.xyz")), (3, "http://far.xyz/", None), (4, "http://spam.xyz/", link("bad.org") + " <a href='mailto:x@y'>m</a>"), (5, "http://bad.org/es/1", "<a class=k href=\"/inner\">"), (6, "http://alone.xyz/", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(frame).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow"}
    pages = frame.withColumn("host", url_filter.host_of(frame.url))
    edges = url_filter.host_edges(pages)
    found = {(r.src, r.dst): r.n for r in edges.collect()}
    assert found == {("good.net", "near.xyz"): 1, ("good.net", "good.net"): 1, ("near.xyz", "far.xyz"): 1, ("spam.xyz", "bad.org"): 1, ("bad.org", "bad.org"): 1}
    seeds = spark.createDataFrame([("good.net", 1.0)], "host string, weight double")
    rank = {r.host: r.rank for r in url_filter.personalised_rank(edges, seeds, Workspace(spark, "t"), "r", rounds=60).collect()}
    hosts = ["good.net", "near.xyz", "far.xyz"]
    m = np.array([[0.5, 0, 1], [0.5, 0, 0], [0, 1, 0]])  # columns: from; the host without links returns to the seed
    p = np.array([1.0, 0, 0])
    for _ in range(200):
        p = 0.85 * m @ p + 0.15 * np.array([1.0, 0, 0])
    assert np.allclose([rank[h] for h in hosts], p, atol=1e-6)


def check_shards(docs, rows, shards):
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((i is not None, i or 0) for i, _ in docs)
    held = Counter(r.shard for r in rows)
    n = len(docs)
    assert all(n // shards <= held[k] <= -(-n // shards) for k in range(shards))
    for k in held:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(held[k]))
    texts = dict(docs)
    for r in rows:
        if r.doc_id is not None and list(i for i, _ in docs).count(r.doc_id) == 1:
            data = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)


def test_shards(spark):
    docs = [(i, f"text {i}") for i in range(300)] + [(1000 + i, f"pair {i // 3}") for i in range(150)] + [(3000 + i, "a third of all") for i in range(220)] + [(5000, None), (5001, None), (5002, ""), (5003, ""), (None, "x"), (7, "text 7")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, shard int, size int")
    rows = sharding.shard(frame, 8).collect()
    check_shards(docs, rows, 8)
    groups = defaultdict(set)
    for r in rows:
        if r.doc_id is not None and 1000 <= r.doc_id < 1150:
            groups[(r.doc_id - 1000) // 3].add(r.shard)
    assert sum(len(s) for s in groups.values()) <= len(groups) * 1.1
    few = spark.createDataFrame(docs[:3], "doc_id long, text string")
    assert sorted(Counter(r.shard for r in sharding.shard(few, 8).collect()).values()) == [1, 1, 1]
    assert sharding.shard(frame.limit(0), 8).count() == 0


def cut_edges(rows, key):
    """(edges of equal texts between shards, all edges)."""
    by, all_ = Counter((key(r), r.shard) for r in rows), Counter(key(r) for r in rows)
    pairs = lambda c: sum(x * (x - 1) // 2 for x in c.values())
    return pairs(all_) - pairs(by), pairs(all_)


def least_cut(groups, quota):
    """The least cut of groups over shards, by trying every way to deal them (few and small)."""
    best = [None]

    def deal(i, room, kept):
        if i == len(groups):
            best[0] = max(best[0] or 0, kept)
            return

        def split(s, left, own, kept):
            if s == len(room):
                if not left:
                    deal(i + 1, [r - o for r, o in zip(room, own)], kept)
                return
            for c in range(min(left, room[s]) + 1):
                split(s + 1, left - c, [*own, c], kept + c * (c - 1) // 2)

        split(0, groups[i], [], kept)

    deal(0, list(quota), 0)
    return sum(g * (g - 1) // 2 for g in groups) - best[0]


def test_shards_cut_few_edges(spark):
    """Against the best of all ways, on tables with no, few and many unlinked documents."""
    for groups, single, shards in (((7, 4, 3, 2), 2, 3), ((5, 5, 5, 3), 0, 3), ((11, 3, 2), 4, 3), ((6, 6, 2, 2), 0, 2), ((9,), 0, 4)):
        docs = [(100 * g + i, f"group {g}") for g, c in enumerate(groups) for i in range(c)] + [(5000 + i, f"alone {i}") for i in range(single)]
        rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), shards).collect()
        check_shards(docs, rows, shards)
        n = len(docs)
        cut, all_ = cut_edges([r for r in rows if r.doc_id < 5000], lambda r: r.doc_id // 100)
        assert cut <= least_cut(groups, [n // shards + (k < n % shards) for k in range(shards)]) + 0.05 * all_, (groups, cut)


def test_a_group_larger_than_shards_fills_them(spark):
    docs = [(i, "a third of all") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(300)] + [(2000 + i, f"text {i}") for i in range(300)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()
    check_shards(docs, rows, 10)
    assert sorted(Counter(r.shard for r in rows if r.doc_id < 400).values()) == [100] * 4
    assert cut_edges([r for r in rows if 1000 <= r.doc_id < 1300], lambda r: (r.doc_id - 1000) // 2)[0] <= 7


def test_null_ids_and_texts_are_dealt(spark):
    docs = [(None, None)] * 90 + [(None, "same")] * 60 + [(i, "same") for i in range(30)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()
    check_shards(docs, rows, 6)
    assert sorted(Counter(r.shard for r in rows if r.size == 20).values()) == [30] * 3


def test_pipeline_equals_its_parts(spark, sf):
    import corpus_pipeline as C
    from tests.llm.test_near_dedup import brute
    from tests.llm.test_texts import base_spans, brute_overlaps
    from vecclimb.session import table

    docs = table(spark, sf, "documents")
    kept = C.drop_toxic(spark, docs, sf).select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in kept}
    assert 0.7 * docs.count() < len(texts) < docs.count()
    one = {i for i, (_, c) in brute(list(texts.items()), 5, 80).items() if i == c}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = {i for i, _, hit, _ in brute_overlaps([(i, texts[i]) for i in one], items) if not hit}
    rows = C.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == clean and len(rows) == len(clean)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in rows)
    assert any(base_spans(texts[i]) for i in clean)


def test_pipeline_stages_take_odd_rows(spark, sf):
    import corpus_pipeline as C

    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (3, "copy of a text with words", "en", None, 25), (3, "copy of a text with words", "en", None, 25), (4, "copy of a text with words", "en", "s", 25), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        out = start
        for name, stage in C.STAGES:
            out = stage(spark, out, sf)
            if name != C.STAGES[-1][0]:
                assert tuple(out.columns) == C.COLUMNS
        got = sorted((r.doc_id is not None, r.doc_id) for r in out.collect())
        assert got == ([] if start is not docs else [(False, None), (True, 1), (True, 2), (True, 3)])
