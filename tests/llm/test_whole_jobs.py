"""Groups, links and windows of any size are done whole."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_tables import check_shards
from tests.llm.test_texts import brute_overlaps, pretty
from vecclimb.llm import decontaminate, sharding, url_filter
from vecclimb.session import Workspace


def shards_of_texts(spark, docs, shards):
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), shards).collect()
    check_shards(docs, rows, shards)
    texts, found = dict(docs), defaultdict(set)
    for r in rows:
        found[texts[r.doc_id]].add(r.shard)
    return found


def test_large_groups_touch_as_few_shards_as_they_fill(spark):
    sizes = {"a third of all": 400, "half a shard": 80, "most of a shard": 130, "a tenth": 15}
    docs = [(i, f"text {i}") for i in range(575)]
    for name, n in sizes.items():
        docs += [(1000 * len(docs) + i, name) for i in range(n)]
    found = shards_of_texts(spark, docs, 8)  # 1,200 documents, 150 a shard
    assert {name: len(found[name]) for name in sizes} == {"a third of all": 3, "half a shard": 1, "most of a shard": 1, "a tenth": 1}


def test_small_groups_are_cut_at_shard_ends_only(spark):
    docs = [(i, f"text {i // 4}") for i in range(3200)]  # nothing is unlinked, 400 a shard: the groups propagate
    found = shards_of_texts(spark, docs, 8)
    assert sum(len(s) - 1 for s in found.values()) <= 2 * 8


def test_distrust_reaches_the_end_of_a_chain(spark):
    """Production defaults: 25 hosts in a row, the last links to a blocked one."""
    link = lambda h: f"<a href='http://{h}/'>x</a>"
    rows = [(i, f"http://h{i}.xyz/", link(f"h{i + 1}.xyz")) for i in range(1, 25)] + [(25, "http://h25.xyz/", link("bad.org")), (26, "http://bad.org/es/1", None)]
    rows += [(31, "http://alone.xyz/", link("alone.xyz"))]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(1, 27)} == {"block"} and got[31] == "allow"


def test_ranks_settle_or_raise(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 3), ("b", "b", 1), ("b", "c", 1), ("c", "d", 2)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 2.0)], "host string, weight double")
    with pytest.raises(RuntimeError):
        url_filter.personalised_rank(edges, seeds, Workspace(spark, "t"), "r", rounds=3)


def test_large_benchmarks_are_joined(spark, monkeypatch):
    """Beyond most_windows no window is broadcast; hot windows are salted; repeated texts and ids stay."""
    sent, context = [], type(spark.sparkContext)
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    monkeypatch.setattr(decontaminate, "HOT", 3)
    items = [(i, f"benchmark item {i} asks for {i * i} and more words than ten of them") for i in range(40)] + [(99, "common words"), (98, "Common, words"), (None, "no id")]
    docs = [(i, f"common words {i % 7} | {items[i % 40][1]} common words") for i in range(50)] + [(7, "common words"), (7, "common words"), (None, "no id"), (8, None), (9, ""), (10, "words common")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.find_overlaps(frame, spark.createDataFrame(items, "item_id long, text string"), most_windows=20).collect()
    assert pretty((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows) == pretty(brute_overlaps(docs, items))
    assert sent and not any(isinstance(value, list) for value in sent)


def test_verdicts_are_those_of_a_dense_solution(spark):
    """Hosts of a random graph of layers (few rounds) with links to themselves, a third of the links of three layers to
    one host, against ranks solved with matrices."""
    rng = random.Random(11)
    hosts = [f"h{i}.{rng.choice(['net', 'org', 'xyz', 'xyz', 'xyz'])}" for i in range(60)]
    weight, pages = Counter(), []
    for i in range(400):
        host = rng.choice(hosts[:50])  # the others are linked to, but have no pages
        path = {"net": "/de/", "org": "/es/"}.get(host.split(".")[1], "/") if rng.random() < 0.6 else "/other"
        layer = hosts.index(host) // 10
        links = [hosts[32] if layer < 3 and rng.random() < 0.33 else rng.choice([host, *hosts[10 * layer + 10 :]]) for _ in range(rng.randrange(3))]
        weight.update((host, to) for to in links)
        pages.append((i, f"http://{host}{path}", " ".join(f'<a href="http://{to}/x">y</a>' for to in links)))
    at = {h: k for k, h in enumerate(hosts)}
    links = np.zeros((60, 60))
    for (a, b), n in weight.items():
        links[at[b], at[a]] = n

    def ranks(m, suffix, path):
        start = np.zeros(60)
        for _, url, _ in pages:
            host, _, rest = url[7:].partition("/")
            start[at[host]] += host.endswith(suffix) and f"/{rest}".startswith(path)
        out = m.sum(axis=0)
        visits = np.linalg.solve(np.eye(60) - 0.85 * m / np.where(out > 0, out, 1), start)
        return visits / visits.sum()

    trust, distrust = ranks(links, ".net", "/de/"), ranks(links.T, ".org", "/es/")
    assert not np.any((trust + distrust > 0) & (np.abs(distrust - trust) < 1e-4 * (trust + distrust)))
    wanted = {}
    for i, url, _ in pages:
        host, _, rest = url[7:].partition("/")
        rule = "allow" if host.endswith(".net") and rest == "de/" else "block" if host.endswith(".org") and rest == "es/" else None
        wanted[i] = rule or ("block" if distrust[at[host]] > trust[at[host]] else "allow")
    by_host = Counter(v for (i, url, _), v in zip(pages, wanted.values()) if url.endswith("/other"))
    assert min(by_host["allow"], by_host["block"]) > 20
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge(frame).collect()} == wanted
