"""Deep pages, partner bitmaps, bucketed upserts and ids of colliding keys, against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from vecclimb.operators import relations as R
from vecclimb.operators import upserts as I
from vecclimb.operators.bitmaps import BITS, PartnerIndex
from vecclimb.operators.buckets import upsert_bucketed, upserted, write_bucketed
from vecclimb.operators.pages import By, PagedTable
from vecclimb.session import Workspace


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.3 else (0.5 if rng.random() < 0.4 else round(rng.random(), 2)), rng.choice(["a", "b", None])) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "result_id long, score double, kind string").repartition(5)


ORDERS = {
    "score": ([By("score", descending=True), By("result_id")], lambda r: (r[1] is None, -(r[1] or 0), r[0])),
    "nulls first": ([By("score", descending=True, nulls_last=False), By("result_id", descending=True)], lambda r: (r[1] is not None, -(r[1] or 0), -r[0])),
    "kind, score": ([By("kind"), By("score", nulls_last=True), By("result_id")], lambda r: (r[2] is not None, r[2] or "", r[1] is None, r[1] or 0, r[0])),
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_pages_are_slices_of_the_sorted_table(spark, scored, name):
    rows, df = scored
    order, key = ORDERS[name]
    wanted = [r[0] for r in sorted(rows, key=key)]
    pages = PagedTable.build(df, order, Workspace(spark, "pages").path, 100)
    assert pages.total == 1500 and len(pages.counts) > 5
    for offset, limit in ((0, 10), (95, 230), (1490, 40), (1300, None)):
        got = pages.page(offset, limit).collect()
        end = 1500 if limit is None else offset + limit
        assert [r.result_id for r in got] == wanted[offset:end]
        assert [r.place for r in got] == list(range(offset, min(end, 1500)))
    assert sorted((r.place, r.result_id) for r in pages.rows().collect()) == list(enumerate(wanted))
    again = PagedTable(spark, pages.path)  # opened without the rows it was built from
    for at in (0, 731, 1499):
        row = pages.page(at, 1).first().asDict()
        assert [r.result_id for r in again.after(row, 120).collect()] == wanted[at + 1 : at + 121]


def test_a_deep_page_reads_its_ranges_only(spark, scored):
    pages = PagedTable.build(scored[1], [By("result_id")], Workspace(spark, "pages").path, 100)
    ranges, start = pages.covering(1200, 50)
    assert sum(n for _, n in ranges) <= 500 and start <= 1200
    page = pages.page(1200, 50)
    assert "PartitionFilters" in plan(page) and len(page.inputFiles()) == len(pages.counts)
    held = pages._stored.filter(F.col("_range").between(ranges[0][0], ranges[-1][0]))
    assert held.count() == sum(n for _, n in ranges)
    assert [r.result_id for r in pages.after({"result_id": 1200}, 5).collect()] == [1201, 1202, 1203, 1204, 1205]
    assert [r.result_id for r in pages.after({"result_id": 5000}, 5).collect()] == []


def test_pages_of_nothing(spark):
    empty = PagedTable.build(spark.createDataFrame([], "id long, score double"), [By("score"), By("id")], Workspace(spark, "pages").path)
    assert empty.total == 0 and empty.page(0, 5).collect() == [] == empty.page(5, 0).collect() and empty.after({"score": None, "id": 1}).collect() == [] and empty.rows().count() == 0
    with pytest.raises(ValueError):
        PagedTable.build(spark.createDataFrame([(1, 2)], "id long, place long"), [By("id")], Workspace(spark, "pages").path)
    with pytest.raises(ValueError):
        empty.page(-1, 5)


def test_partners_by_bitmaps(spark):
    rng = random.Random(5)
    names = "abcdef"
    marks = {i * 7 - 3000: rng.choices([*names, None], k=rng.randrange(5)) if rng.random() < 0.95 else None for i in range(900)}
    marks |= {10**15 + i: ["a"] for i in range(300)}  # a kind of a quarter of all
    rules = [("a", "b"), ("a", "c"), ("b", "b"), ("d", "a"), ("e", "z"), (None, "a"), ("f", None)]
    fragments = spark.createDataFrame(list(marks.items()), "id long, marks array<string>").repartition(4)
    table = spark.createDataFrame(rules, "left_mark string, right_mark string")
    index = PartnerIndex(fragments, table, Workspace(spark, "partners").path, rows_a_range=200)
    allowed = {r for r in rules if None not in r}
    partners = {
        left: sorted(right for right, theirs in marks.items() if right != left and any((a, b) in allowed for a in mine or [] for b in theirs or []))
        for left, mine in marks.items()
    }
    assert dict(map(tuple, index.counts().collect())) == {k: len(v) for k, v in partners.items()}
    assert dict(map(tuple, R.marked_partner_counts(fragments, table.dropna()).collect())) == {k: len(v) for k, v in partners.items()}
    for offset, limit in ((0, 3), (40, 25), (250, 200), (0, 2000)):
        got = {(r.left_id, r.place): r.right_id for r in index.page(offset, limit).collect()}
        assert got == {(k, offset + i + 1): p for k, v in partners.items() for i, p in enumerate(v[offset : offset + limit])}
    some = spark.createDataFrame([(10**15,), (-3000,), (5,)], "id long")
    assert {r.left_id for r in index.page(0, 5, some).collect()} <= {10**15, -3000}


def test_partners_over_several_bitmaps(spark):
    n = BITS * 2 + 10
    fragments = spark.range(n).select("id", F.expr("if(id % 3 = 0, array('x'), array('y', 'x'))").alias("marks"))
    rules = spark.createDataFrame([("y", "x")], "left_mark string, right_mark string")
    index = PartnerIndex(fragments, rules, Workspace(spark, "partners").path)
    one = spark.createDataFrame([(BITS + 1,), (0,)], "id long")  # BITS + 1 has no y
    got = sorted((r.place, r.right_id) for r in index.page(BITS - 2, 4, spark.createDataFrame([(BITS,)], "id long")).collect())
    assert got == [(BITS - 1, BITS - 2), (BITS, BITS - 1), (BITS + 1, BITS + 1), (BITS + 2, BITS + 2)]
    assert index.page(0, 5, one).count() == 0
    assert {tuple(r) for r in index.counts().groupBy("partners").count().collect()} == {(0, -(-n // 3)), (n - 1, n - -(-n // 3))}


def test_partners_of_nothing(spark):
    index = PartnerIndex(spark.createDataFrame([], "id long, marks array<string>"), spark.createDataFrame([], "left_mark string, right_mark string"), Workspace(spark, "partners").path)
    assert index.counts().count() == 0 and index.page(0, 4).count() == 0


def test_bucketed_upserts_do_not_shuffle_the_table(spark):
    rng = random.Random(9)
    old = {(i, i % 3): str(i) for i in range(400)}
    target = spark.createDataFrame([(*k, v) for k, v in old.items()], "item_id long, plugin_id long, external_id string")
    news = [(rng.randrange(600), rng.randrange(3), None if s % 10 == 0 else f"n{s}", s) for s in range(500)]
    updates = spark.createDataFrame(news, "item_id long, plugin_id long, external_id string, seq long")
    work, keys = Workspace(spark, "buckets"), ["item_id", "plugin_id"]
    names = [f"buckets_{work.path[-12:]}_{i}" for i in range(3)]
    write_bucketed(target, names[0], keys, 8, f"{work.path}/0")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in upserted(spark.table(names[0]), updates, keys):
            lines = plan(df).splitlines()
            scans = [i for i, line in enumerate(lines) if "FileScan" in line]
            assert len(scans) == 1 and "Bucketed: true" in lines[scans[0]]
            depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-"))
            above = [i for i in range(scans[0]) if depth(i) < depth(scans[0]) and all(depth(j) > depth(i) for j in range(i + 1, scans[0] + 1))]
            assert above and not any("Exchange" in lines[i] for i in above)
        first = upsert_bucketed(names[0], updates, keys, 8, names[1], f"{work.path}/1")
        wanted = dict(old)
        for item, plugin, external, _ in news:
            wanted[item, plugin] = external
        assert {(r.item_id, r.plugin_id): r.external_id for r in first.collect()} == wanted and first.count() == len(wanted)
        second = upsert_bucketed(names[1], updates.limit(0), keys, 8, names[2], f"{work.path}/2")
        assert sorted(map(str, second.collect())) == sorted(map(str, first.collect())) and spark.table(names[0]).count() == 400
        assert "Exchange hashpartitioning" not in plan(second.groupBy(*keys).count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        for name in names:
            spark.sql(f"drop table if exists {name}")


def test_colliding_keys_get_their_own_ids(spark):
    stem = F.length("item").cast("long") * 256  # every text of a length collides
    known = spark.createDataFrame([(3 * 256, "old"), (3 * 256 + 4, "odd"), (7, "given")], "item_id long, item string")
    fresh = spark.createDataFrame([("new",), ("abc",), ("four",), ("x",)], "item string")
    got = {r["item"]: r.item_id for r in I.with_fresh_ids(fresh, "item", known, "item_id", stem).collect()}
    assert got == {"abc": 3 * 256 + 5, "new": 3 * 256 + 6, "four": 4 * 256, "x": 256}
    many = spark.range(300).select(F.format_string("%03d", "id").alias("item"))
    with pytest.raises(Exception, match="no slot left"):
        I.with_fresh_ids(many, "item", known, "item_id", stem).collect()
    none = known.filter("false")
    kept = I.with_fresh_ids(many.limit(250), "item", none, "item_id", stem).agg(F.count_distinct("item_id")).first()
    assert kept[0] == 250
    merged, out = I.checkin_items(known, spark.createDataFrame([("new", 1), ("new", 2), ("old", 3), (None, 4)], "item string, n long"))
    ids = {r.n: r.item_id for r in out.collect()}
    assert ids[1] == ids[2] not in (3 * 256, None) and ids[3] == 3 * 256 and ids[4] is None and merged.count() == 4
