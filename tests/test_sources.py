"""The changelog source, package metadata and blobs."""

import threading
from xmlrpc.server import SimpleXMLRPCServer

import pytest
from pyspark.sql import functions as F

from sieveline.sources import changelog

KIND = "name string, version string, ts timestamp, action string, serial bigint"


def feed(spark, path, lo, hi):
    rows = spark.range(lo, hi + 1).select(F.concat(F.lit("p"), F.col("id") % 3).alias("name"), F.col("id").cast("string").alias("version"), F.lit("2026-01-01").cast("timestamp").alias("ts"), F.lit("new release").alias("action"), F.col("id").alias("serial"))
    rows.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, **options):
    changelog.register(spark)
    return spark.readStream.format("changelog").options(path=path, **options).load()


def run(spark, log, out, checkpoint):
    q = log.writeStream.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(r["serial"] for r in spark.read.parquet(out).collect())


def test_batches_are_ranges_of_serials(spark, tmp_path):
    path = str(tmp_path / "log")
    feed(spark, path, 1, 40)
    feed(spark, path, 41, 95)
    changelog.register(spark)
    rows = spark.read.format("changelog").options(path=path, since=10, rowsPerPartition=20).load()
    assert rows.schema.simpleString() == f"struct<{KIND.replace(', ', ',').replace(' ', ':')}>" and rows.rdd.getNumPartitions() == 5
    assert sorted(r["serial"] for r in rows.collect()) == list(range(11, 96))
    assert spark.read.format("changelog").options(path=path, since=95).load().count() == 0


def test_a_stream_resumes_without_loss_or_repeats(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "check"))
    feed(spark, path, 1, 30)
    assert run(spark, stream(spark, path, start="earliest", rowsPerPartition=7), out, checkpoint) == list(range(1, 31))
    feed(spark, path, 31, 50)
    assert run(spark, stream(spark, path, start="earliest"), out, checkpoint) == list(range(1, 51))
    assert run(spark, stream(spark, path, start="earliest"), out, checkpoint) == list(range(1, 51))


def test_a_stream_from_now_sees_nothing_of_the_past(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "check"))
    feed(spark, path, 1, 30)
    spark.createDataFrame([], KIND + ", batch int").write.parquet(out)
    assert run(spark, stream(spark, path), out, checkpoint) == []
    feed(spark, path, 31, 35)
    assert run(spark, stream(spark, path), out, checkpoint) == list(range(31, 36))


def test_a_feed_that_fails_leaves_the_offset(tmp_path, monkeypatch, spark):
    path = str(tmp_path / "log")
    feed(spark, path, 1, 30)
    reader = changelog.ChangelogStream({"path": path, "start": "12", "maxPerBatch": "5"})
    assert reader.initialOffset() == {"serial": 12} and reader.latestOffset() == {"serial": 17}
    down = lambda self: (_ for _ in ()).throw(OSError("down"))
    monkeypatch.setattr(changelog.TableFeed, "last", down)
    assert reader.latestOffset() == {"serial": 12} and reader.partitions({"serial": 12}, {"serial": 12}) == []
    monkeypatch.undo()
    reader.partitions({"serial": 12}, {"serial": 17})
    assert reader.latestOffset() == {"serial": 22}
    again = changelog.ChangelogStream({"path": path})
    monkeypatch.setattr(changelog.TableFeed, "last", down)
    with pytest.raises(OSError):
        again.latestOffset()  # restarted and down: it stops, and its offset stays
    assert changelog.high_water({"path": path}) is None
    monkeypatch.undo()
    assert changelog.high_water({"path": path}) == 30 and changelog.high_water({"path": str(tmp_path / "none")}) is None


def test_an_index_over_xml_rpc(spark):
    rows = [("a", "1.0", 0, "new release", 10), ("a", "1.0", 0, "add py3 file", 11), ("b", "2.0", 86400, "new release", 9), ("a", None, 0, "remove", 12)]
    server = SimpleXMLRPCServer(("127.0.0.1", 0), allow_none=True, logRequests=False)
    server.register_function(lambda: 12, "changelog_last_serial")
    server.register_function(lambda since: [list(r) for r in rows if r[4] > since], "changelog_since_serial")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    changelog.register(spark)
    log = spark.read.format("changelog").options(endpoint=f"http://127.0.0.1:{server.server_address[1]}", since=9).load()
    assert {(r["name"], r["version"], r["serial"]) for r in log.collect()} == {("a", "1.0", 10), ("a", "1.0", 11), ("a", None, 12)}
    server.shutdown()
    for bad in ({"endpoint": "file:///etc/passwd"}, {}):
        with pytest.raises(ValueError):
            changelog.feed(bad)


def test_the_changelog_drives_the_tick(spark, tmp_path):
    from sieveline.streaming import state, tick

    path, root, checkpoint = (str(tmp_path / x) for x in ("log", "state", "check"))
    for lo, hi in ((1, 20), (21, 25)):
        feed(spark, path, lo, hi)
        tick.run(stream(spark, path, start="earliest", rowsPerPartition=8), root, checkpoint).awaitTermination()
        assert tick.cursor(spark, root) == hi and state.read(spark, root, "releases").count() == hi


def test_a_batch_without_since_has_every_row(spark, tmp_path):
    path = str(tmp_path / "log")
    for serials in ([0, 5, -3], [None, 9, 0]):  # an index may count from 0; tables may hold anything
        spark.createDataFrame([(f"p{s}", "1", None, "new release", s) for s in serials], KIND).coalesce(1).write.mode("append").parquet(path)
    changelog.register(spark)
    read = lambda **o: sorted((r["serial"] for r in spark.read.format("changelog").options(path=path, **o).load().collect()), key=repr)
    assert read(rowsPerPartition=4) == [-3, 0, 0, 5, 9, None] and read() == [-3, 0, 0, 5, 9, None]
    assert read(since=0) == [5, 9] and read(since=-1) == [0, 0, 5, 9]
    assert run(spark, stream(spark, path, start="earliest"), str(tmp_path / "out"), str(tmp_path / "check")) == [-3, 0, 0, 5, 9]


def test_the_changelog_query_keeps_serial_zero(spark, tmp_path):
    from sieveline.plans.sources import changelog_source

    spark.sql("SELECT * FROM VALUES (0L, timestamp_ntz'2024-01-01', 7L, 'signup', 1D, '{}'), (1L, timestamp_ntz'2024-01-01', 8L, 'signup', 1D, '{}'), (-2L, NULL, 9L, 'signup', 1D, '{}'), (NULL, NULL, 5L, 'signup', 1D, 'x'), (3L, NULL, 7L, 'view', 1D, '{}') AS t(event_id, ts, user_id, event_type, value, props)").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["name"], r["version"], r["serial"]) for r in changelog_source(spark, str(tmp_path)).collect()}
    assert got == {("7", "{}", 0), ("8", "{}", 1), ("9", "{}", -2), ("5", "x", None)}
