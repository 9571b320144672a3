"""Health as streaming state: stale results, cooldowns that end, forgetting, and a restart from the checkpoint."""

import random
from datetime import datetime, timezone

import pytest

from millrace.operators import instances
from millrace.streaming import health


def at(seconds):
    return datetime.fromtimestamp(1_700_000_000 + seconds, timezone.utc)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(health._PROVIDER, None)
    health.keep_state_in_rocksdb(spark)
    yield spark
    spark.conf.unset(health._PROVIDER) if before is None else spark.conf.set(health._PROVIDER, before)


def test_the_state_after_each_result():
    zero = (0, 0, 0, 0, 0)
    failed = health.after(zero, 10, 20, False)
    assert failed == (0, 20, 1, 80, 20)
    assert health.after(failed, 15, 30, True) == (0, 20, 1, 80, 30)  # began before the failure ended
    assert health.after(failed, 15, 30, False) == (0, 20, 1, 80, 30)
    again = health.after(failed, 20, 30, False)
    assert again == (0, 30, 2, 150, 30)
    passed = health.after(again, 31, 40, True)
    assert passed == (40, 0, 0, 0, 40) and health.after(passed, 35, 41, True) == (41, 0, 0, 0, 41) and health.after(passed, 35, 41, False) == (40, 0, 0, 0, 41)
    for _ in range(20):
        failed = health.after(failed, failed[4], failed[4] + 1, False)
    assert failed[2] == health.COUNTED and failed[3] - failed[1] == health.LONGEST


def test_a_table_of_checks(spark):
    """A hot key and many small ones, folded in the order in which checks ended."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", f"k{rng.randrange(40)}", None]), s, s + rng.randrange(90), rng.random() < 0.4) for s in (rng.randrange(3000) for _ in range(3000))]
    want = {}
    for k, s, e, ok in sorted(rows, key=lambda r: (r[2], r[1], r[3])):
        want[k] = instances.after(want.get(k, (0, 0, 0, 0)), s, e, ok)
    df = spark.createDataFrame(rows, "k string, s int, e int, ok boolean").repartition(6)
    got = {r["k"]: tuple(r)[1:] for r in instances.health(df, "k", "s", "e", "ok").collect()}
    assert got == want and len(got) > 30
    assert instances.health(df.limit(0), "k", "s", "e", "ok").count() == 0


def test_a_stream_of_checks(rocksdb, tmp_path):
    spark, src, out, mark = rocksdb, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    schema = "origin string, began timestamp, ended timestamp, ok boolean"
    put = lambda rows: spark.createDataFrame([(k, at(a), at(b), ok) for k, a, b, ok in rows], schema).coalesce(1).write.mode("append").parquet(src)
    put([("a", 0, 5, False), ("b", 0, 4, True), ("a", 3, 9, True), ("c", 0, 7, False)])

    def go():
        """All that is there, by a query of its own that goes on from the checkpoint."""
        stream = spark.readStream.schema(schema).parquet(src)
        found = health.states(stream, "origin", "began", "ended", "ok", late="0 seconds", forget=5000)
        seen = []

        def take(df, n):
            df.write.mode("append").parquet(out)
            seen.extend((r["key"], r["event"], r["failures"], r["retry_at"] and r["retry_at"] - 1_700_000_000) for r in df.collect())

        q = found.writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(take).start()
        q.awaitTermination()
        return sorted(seen)

    # the pass of a began before its failure ended, so it is stale
    assert go() == [("a", "failing", 1, 65), ("b", "healthy", 0, 0), ("c", "failing", 1, 67)]
    put([("a", 50, 60, False), ("d", 60, 70, True)])  # a cools down longer; c's cooldown ends once the watermark is at 70
    assert go() == [("a", "failing", 2, 180), ("c", "ready", 1, 67), ("d", "healthy", 0, 0)]
    put([("d", 300, 310, True), ("c", 305, 311, True)])
    assert go() == [("a", "ready", 2, 180), ("c", "healthy", 0, 0), ("d", "healthy", 0, 0)]
    put([("d", 5000, 5100, True)])
    assert go() == [("a", "forgotten", 2, 180), ("b", "forgotten", 0, 0), ("d", "healthy", 0, 0)]
    put([("a", 5150, 5200, False), ("e", 10, 20, True)])  # a starts anew, e is too late
    assert go() == [("a", "failing", 1, 5260)]


def test_another_store_is_refused(spark):
    rows = spark.createDataFrame([], "k string, a timestamp, b timestamp, ok boolean")
    if spark.conf.get(health._PROVIDER, None) != health.ROCKSDB:
        with pytest.raises(ValueError):
            health.states(rows, "k", "a", "b", "ok")
