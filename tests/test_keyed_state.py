"""Keyed streaming state: replayed files, results that expire, status by run events, state that shrinks."""

import pytest
from pyspark.sql import functions as F

from vecclimb.session import Workspace, ship
from vecclimb.streaming import state


@pytest.fixture
def stream(spark):
    """Run a processor over files, one a batch; (rows, state rows after every batch)."""
    ship(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_store(spark)

    def run(process, files, schema):
        path = Workspace(spark, "state").path
        for rows in files:
            texts = spark.createDataFrame([(k, f"2024-01-01 {t}", *rest) for k, t, *rest in rows], schema.replace("at timestamp", "at string"))
            texts.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{path}/in")
            query = process(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append(query.lastProgress.stateOperators[0].numRowsTotal)
        return spark.read.parquet(f"{path}/out").collect(), sizes

    sizes = []
    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def clock(at):
    return at.strftime("%H:%M")


def test_replayed_files_give_each_run_once(stream):
    files = [[("a", "10:00"), ("b", "10:01"), ("a", "10:02")], [("a", "10:00"), ("b", "10:01"), ("a", "10:02"), ("c", "10:05")], [("d", "14:00")], [("e", "14:01"), ("a", "14:02")]]
    rows, sizes = stream(lambda s: state.runs_once(s, 3600, "10 minutes"), files, "key string, at timestamp")
    assert sorted((r.key, clock(r["at"])) for r in rows) == [("a", "10:00"), ("a", "14:02"), ("b", "10:01"), ("c", "10:05"), ("d", "14:00"), ("e", "14:01")]
    assert max(sizes) >= sizes[-1] and sizes[-1] < 2 * 6  # the morning's keys are gone


def test_expired_results_are_executed_again(stream):
    ask = lambda k, t: (k, t, "request", None)
    files = [[ask("a", "10:00"), ask("b", "10:00")], [("a", "10:01", "result", 5.0), ("b", "10:01", "result", None), ask("a", "10:30"), ask("b", "10:30")], [ask("a", "11:01"), ask("a", "11:02")], [("a", "11:03", "result", 6.0), ask("a", "11:04")], [ask("z", "15:00")], [ask("z", "15:01")]]
    rows, sizes = stream(lambda s: state.cached_results(s, 3600, "1 hour"), files, "key string, at timestamp, kind string, value double")
    got = {(r.key, clock(r["at"])): (r.value, r.source) for r in rows}
    assert got == {("a", "10:00"): (None, "execute"), ("b", "10:00"): (None, "execute"), ("a", "10:30"): (5.0, "cache"), ("b", "10:30"): (None, "execute"), ("a", "11:01"): (5.0, "cache"), ("a", "11:02"): (None, "execute"), ("a", "11:04"): (6.0, "cache"), ("z", "15:00"): (None, "execute"), ("z", "15:01"): (None, "execute")}
    assert sizes[3] > sizes[-1]


def test_status_follows_run_events(stream):
    files = [[("1", "10:00", "STARTED"), ("2", "10:00", "STARTED"), ("1", "10:00", "STARTED"), ("3", "10:00", "OTHER")], [("1", "10:05", "FAILURE"), ("2", "10:04", "SUCCESS"), ("2", "10:01", "STARTED")], [("1", "10:06", "STARTED"), ("2", "10:07", "CANCELED")], [("9", "15:00", "STARTED")], [("9", "15:01", "SUCCESS"), ("1", "15:02", "STARTED")]]
    rows, sizes = stream(lambda s: state.run_statuses(s, 3600, "1 hour"), files, "key string, at timestamp, event string")
    got = sorted((r.key, clock(r["at"]), r.status) for r in rows)
    assert got == [("1", "10:00", "running"), ("1", "10:05", "failed"), ("1", "15:02", "running"), ("2", "10:00", "running"), ("2", "10:04", "complete"), ("2", "10:07", "cancelled"), ("9", "15:00", "running"), ("9", "15:01", "complete")]
