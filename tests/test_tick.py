"""Ticks, retries, the cursor, and state by key."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveline.streaming import state, tick

KIND = "name string, version string, serial bigint"


def releases(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


def stages(spark, root):
    return {(r["name"], r["version"]): r["stage"] for r in state.read(spark, root, "releases").collect()}


def failing(names, calls):
    def process(rows):
        calls.extend((r["name"], r["attempts"]) for r in rows.collect())
        return rows.select("name", "version", F.when(F.col("name").isin(*names), "fetch_failed").otherwise("triaged").alias("stage"), F.lit(1.5).alias("score"))

    return process


def test_a_failed_release_holds_the_cursor_until_it_is_done(spark, tmp_path):
    root, calls = str(tmp_path / "state"), []
    rows = releases(spark, ("good", "1", 10), ("victim", "1", 11), ("after", "1", 12))
    tick.advance(spark, root, rows, failing(["victim"], calls), "0")
    assert tick.cursor(spark, root) == 10 and stages(spark, root) == {("good", "1"): "triaged", ("victim", "1"): "fetch_failed", ("after", "1"): "triaged"}
    assert [(r["name"], r["attempts"]) for r in tick.waiting(spark, root).collect()] == [("victim", 1)]
    tick.advance(spark, root, releases(spark, ("later", "2", 15)), failing(["victim"], calls), "1")
    assert tick.cursor(spark, root) == 10 and tick.waiting(spark, root).first()["attempts"] == 2
    tick.retry(spark, root, failing([], calls))
    assert tick.cursor(spark, root) == 15 and tick.waiting(spark, root).count() == 0 and set(stages(spark, root).values()) == {"triaged"}
    assert sorted(calls) == [("after", 0), ("good", 0), ("later", 0), ("victim", 0), ("victim", 1), ("victim", 2)]


def test_done_releases_are_skipped_and_batches_come_once(spark, tmp_path):
    root, calls = str(tmp_path / "state"), []
    rows = releases(spark, ("a", "1", 3), ("a", "1", 5), ("b", None, 4))
    for batch in ("0", "0", "1"):
        tick.advance(spark, root, rows, failing([], calls), batch)
    assert tick.cursor(spark, root) == 5 and [c for c in calls if c[0] == "a"] == [("a", 0)]
    again = releases(spark, ("a", "1", 9))
    tick.advance(spark, root, again, failing([], calls), "2")
    assert tick.cursor(spark, root) == 9 and len([c for c in calls if c[0] == "a"]) == 1
    assert state.point(spark, root, "releases", {"name": "a", "version": "1"}).first()["serial"] == 5


def test_a_crash_leaves_one_batch_or_the_other(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    tick.advance(spark, root, releases(spark, ("a", "1", 1)), failing([], []), "0")
    put = state._put
    monkeypatch.setattr(state, "_put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        tick.advance(spark, root, releases(spark, ("b", "1", 2)), failing([], []), "1")
    assert tick.cursor(spark, root) == 1
    monkeypatch.setattr(state, "_put", put)
    calls = []
    tick.advance(spark, root, releases(spark, ("b", "1", 2)), failing([], calls), "1")
    assert tick.cursor(spark, root) == 2 and calls == []  # finished from the staging, not processed again
    state._drop(spark, f"{root}/_staged")
    spark.range(1).write.parquet(f"{root}/_staged/releases")
    state.recover(spark, root)
    assert not state.exists(spark, f"{root}/_staged") and len(stages(spark, root)) == 2


def test_a_small_batch_touches_few_files_whatever_the_history(spark, tmp_path):
    root = str(tmp_path / "state")
    many = spark.range(5000).select(F.concat(F.lit("p"), "id").alias("name"), F.lit("1").alias("version"), F.col("id").alias("serial"))
    tick.advance(spark, root, many, failing([], []), "0")
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(root, "releases").rglob("*.parquet")}
    before = files()
    tick.advance(spark, root, releases(spark, ("p7", "2", 6000), ("p9", "2", 6001)), failing([], []), "1")
    assert 1 <= len({p.parent for p, at in files().items() if before.get(p) != at}) <= 2 and len({p.parent for p in before}) == 64
    dealt, held = state.touched(spark, root, "releases", releases(spark, ("p7", "2", 6000)), tick.KEY)
    assert len({Path(f).parent for f in held.inputFiles()}) == 64 and "PartitionFilters: [isnotnull" in held._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in held._jdf.queryExecution().toString()
    one = state.point(spark, root, "releases", {"name": "p7", "version": "2"})
    assert one.first()["serial"] == 6000 and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    assert state.read(spark, root, "releases").count() == 5002


def test_partial_updates_keep_what_they_lack(spark, tmp_path):
    root = str(tmp_path / "state")
    kind = "name string, version string, stage string, score double, at bigint"
    first = spark.createDataFrame([("a", "1", "triaged", 7.0, 1), ("b", "1", "triaged", 2.0, 1)], kind)
    state.commit(spark, root, "0", {"t": state.upserted(spark, root, "t", first, tick.KEY, "at", 4)})
    more = spark.createDataFrame([("a", "1", "reviewed", 2, "x")], "name string, version string, stage string, at bigint, owner string")
    state.commit(spark, root, "1", {"t": state.upserted(spark, root, "t", more, tick.KEY, "at", 4)})
    got = {r["name"]: (r["stage"], r["score"], r["owner"]) for r in state.read(spark, root, "t").collect()}
    assert got == {"a": ("reviewed", 7.0, "x"), "b": ("triaged", 2.0, None)}
    alerts = spark.createDataFrame([("a", "1", 5), ("a", "1", 4), ("c", "1", 9)], "name string, version string, serial bigint")
    state.commit(spark, root, "2", {"s": state.inserted(spark, root, "s", alerts, tick.KEY, "serial", 4)})
    state.commit(spark, root, "3", {"s": state.inserted(spark, root, "s", alerts.withColumn("serial", F.lit(1).cast("long")), tick.KEY, "serial", 4)})
    assert sorted((r["name"], r["serial"]) for r in state.read(spark, root, "s").collect()) == [("a", 4), ("c", 9)]


def test_a_fresh_cursor_starts_from_now(spark, tmp_path):
    root = str(tmp_path / "state")
    assert tick.seeded(spark, root, None) is None and tick.seeded(spark, root, 5000, backfill=True) == 0 and tick.cursor(spark, root) is None
    assert tick.seeded(spark, root, 5000) == 5000 == tick.cursor(spark, root)
    assert tick.seeded(spark, root, 7000) == 5000  # established: no new start


def test_the_stream_runs_ticks(spark, tmp_path):
    kind = "name string, version string, action string, serial long"
    rows = [("a", "1", "new release", 5), ("a", "1", "new release", 7), ("b", "1", "remove", 8), ("c", None, "new release", 9)]
    root = str(tmp_path / "state")
    for i in range(2):
        spark.createDataFrame([(n, v, a, s + 10 * i) for n, v, a, s in rows], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        tick.run(spark.readStream.schema(kind).parquet(f"{tmp_path}/log"), root, f"{tmp_path}/check").awaitTermination()
        assert [(r["name"], r["version"], r["stage"]) for r in state.read(spark, root, "releases").collect()] == [("a", "1", "triaged")]
        assert tick.cursor(spark, root) == 7 + 10 * i
