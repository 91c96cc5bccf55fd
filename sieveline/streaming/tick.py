"""The tick: new releases of a changelog, and those that failed before, are processed, and what becomes of them is merged into keyed state.

Tables under one root (see state): `releases` (name, version, serial, stage, ...), `open` (name, version, serial, attempts), the releases that aren't done, and
`cursor` (stream, cursor, seen). They change together, once a batch. The cursor is the greatest serial up to which every release is done: below the least open serial, or all
that was seen. A release that fails holds it back, is tried again by every later tick and lets it go when it is done; releases after it run meanwhile."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.lookup import keyed_left
from sieveline.operators.releases import changelog
from sieveline.operators.triage import TERMINAL, open_releases
from sieveline.streaming import state

KEY = ["name", "version"]
#: Failed releases and the cursor are few rows: one bucket each.
FEW = 1
Process = Callable[[DataFrame], DataFrame]


def waiting(spark: SparkSession, root: str) -> DataFrame:
    """(name, version, serial, attempts) of the releases that aren't done."""
    held = state.read(spark, root, "open")
    return spark.createDataFrame([], "name string, version string, serial bigint, attempts int") if held is None else held.where("attempts > 0").drop("bucket")


def cursor(spark: SparkSession, root: str) -> int | None:
    held = state.read(spark, root, "cursor")
    row = None if held is None else held.first()
    return row and row["cursor"]


def advance(spark: SparkSession, root: str, releases: DataFrame, process: Process, batch: str, buckets: int = state.BUCKETS) -> None:
    """One tick over releases (name, version, serial). process takes (name, version, serial, attempts) and returns (name, version, stage, ...): a
    stage of TERMINAL ends a release, any other, or no row, leaves it open. Releases that are done are skipped, yet the cursor passes them."""
    state.recover(spark, root)
    if state.done(spark, root) == batch:
        return
    before, held = waiting(spark, root), state.read(spark, root, "releases")
    fresh = releases.groupBy(*KEY).agg(F.max("serial").cast("long").alias("serial"))
    listed = fresh.withColumn("attempts", F.lit(0)).unionByName(before).groupBy(*KEY).agg(F.max("serial").alias("serial"), F.max("attempts").alias("attempts"))
    if held is not None:
        _, near = state.touched(spark, root, "releases", listed, KEY, buckets)
        listed = open_releases(listed, near, KEY)
    todo = _kept(listed, root, "todo")
    found = process(todo)
    told = _kept(keyed_left(todo, found.select(*[c for c in found.columns if c not in ("serial", "attempts")]), KEY).withColumn("stage",
        F.coalesce("stage", F.lit("fetch_failed"))), root, "told")
    ended = F.col("stage").isin(*TERMINAL)
    # rows that are done leave the open table as rows without attempts, since a bucket is always rewritten whole
    still = told.where(~ended).select(*KEY, "serial", (F.col("attempts") + 1).alias("attempts"))
    still = still.unionByName(spark.createDataFrame([(None, None, None, 0)], still.schema)).withColumn("bucket", F.lit(0))
    stop = still.where("attempts > 0").agg(F.min("serial")).first()[0]
    old = state.read(spark, root, "cursor")
    past = old.first() if old is not None else None
    seen = max((x for x in (fresh.agg(F.max("serial")).first()[0], past and past["seen"]) if x is not None), default=None)
    reached = seen if stop is None else stop - 1
    reached = max((x for x in (reached, past and past["cursor"]) if x is not None), default=None)
    marks = spark.createDataFrame([("changelog", reached, seen, 0)], "stream string, cursor bigint, seen bigint, bucket int")
    rows = told.drop("attempts")
    state.commit(spark, root, batch, {"releases": state.upserted(spark, root, "releases", rows, KEY, "serial", buckets), "open": still, "cursor": marks})
    for name in ("todo", "told"):
        state._drop(spark, f"{root}/_work/{name}")


def _kept(rows: DataFrame, root: str, name: str) -> DataFrame:
    """rows as a table, so that a release is processed once, whatever is read of it after."""
    path = f"{root}/_work/{name}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def retry(spark: SparkSession, root: str, process: Process) -> None:
    """A tick without new releases: only what is open."""
    advance(spark, root, waiting(spark, root).select(*KEY, "serial").limit(0), process, f"retry-{secrets.token_hex(8)}")


def run(log: DataFrame, root: str, checkpoint: str, process: Process | None = None, **trigger):
    """Starts the query: new releases of a streaming changelog (name, version, action, serial) through process into the state at root.

    Without process every release is `triaged` at once. trigger: availableNow=True for one tick, processingTime="300 seconds" for a watch."""
    done = process or (lambda rows: rows.select(*KEY, F.lit("triaged").alias("stage")))

    def step(batch: DataFrame, number: int) -> None:
        advance(batch.sparkSession, root, changelog(batch), done, str(number))

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def seeded(spark: SparkSession, root: str, newest: int | None, backfill: bool = False) -> int | None:
    """Where a run starts. An established cursor goes on from where it is; a fresh one starts at the newest serial, or at 0 to work through the past. None: the newest
    serial is unknown, so nothing is to run and the cursor stays fresh."""
    at = cursor(spark, root)
    if at:
        return at
    if backfill:
        return 0
    if newest is not None:
        state.recover(spark, root)
        state.commit(spark, root, "seed", {"cursor": spark.createDataFrame([("changelog", newest, newest, 0)], "stream string, cursor bigint, seen bigint, bucket int")})
    return newest
