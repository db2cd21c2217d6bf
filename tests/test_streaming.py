import time

from pyspark.sql import functions as F

from polyfold.sources.store import Store
from polyfold.streaming import tail


def test_log_tail_and_channel(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    x, seen = store.log("l"), []
    x.log("one", 1.0), store.log("other").log("no", 1.0)
    x.live(lambda t, d: seen.append((t, d)), since=0.0, checkpoint=str(tmp_path / "c"), once=True).awaitTermination()
    x.log("two", 2.0)
    x.live(lambda t, d: seen.append((t, d)), since=0.0, checkpoint=str(tmp_path / "c"), once=True).awaitTermination()
    assert seen == [(1.0, "one"), (2.0, "two")]
    c, a, b = store.channel("c"), [], []
    c.publish("before")
    time.sleep(0.05)
    queries = [c.listen(a.append), c.listen(b.append)]
    time.sleep(0.3)
    for w in ("hello", "world"):
        c.publish(w)
    end = time.time() + 20
    while time.time() < end and not (len(a) == 2 == len(b)):
        time.sleep(0.1)
    [q.stop() for q in queries]
    assert a == b == ["hello", "world"]


def test_windowed(spark, tmp_path):
    spark.createDataFrame([(0.0, 1), (30.0, 2), (60.0, 3), (200.0, 4)], "t double, v int").select(F.timestamp_seconds("t").alias("ts"), "v").write.parquet(str(tmp_path / "e"))
    s = tail.windowed(tail.table_stream(spark, str(tmp_path / "e")), "ts", 60, [F.sum("v").alias("v")])
    got = tail.collect_now(s, "w", "complete").select(F.unix_timestamp("window_start"), "v").collect()
    assert sorted(map(tuple, got)) == [(0, 3), (60, 3), (180, 4)]


def test_events_follow(spark, tmp_path):
    store, seen, e = Store(spark, str(tmp_path / "s")), [], tail.Events()
    d = store.dict("d")
    d.set("a", 1), d.delete("a")
    off = e.attach("del", lambda r: seen.append(r["key"]))
    e.follow(tail.operations(d._ops, "d"), lambda r: r["op"], once=True).awaitTermination()
    off(), e.emit("del", {"key": "x"})
    assert seen == ["a"]
