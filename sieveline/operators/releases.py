"""Operators on releases: changelog, predecessor, differences, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import deletions
from sieveline.operators.lookup import LAST, dealt, last_before

#: In microseconds.
DAY = 86_400_000_000


def changelog(log: DataFrame, action: str = "new release") -> DataFrame:
    """(name, version, serial): the last serial of each release among rows (name, version, action, serial)."""
    return log.where((F.col("action") == action) & F.col("version").isNotNull()).groupBy("name", "version").agg(F.max("serial").alias("serial"))


def tick(releases: DataFrame, limit: int = 2000) -> DataFrame:
    """The first releases by serial; rows of one serial come by name and version."""
    ties = [c for c in ("name", "version") if c in releases.columns]
    return releases.orderBy("serial", *ties).limit(limit)


def cursor_prefix(rows: DataFrame, key: str = "stream", previous: DataFrame | None = None) -> DataFrame:
    """(key, cursor): the last serial up to which all of a key's rows are terminal; rows (key, serial, terminal).

    Fails closed: a null state is open, null keys are a key of their own, and an open row without a serial holds its whole key back. Where a
    key's first row is open, its cursor is that of `previous` (key, cursor), or the key has no row. The first open serial per key is one
    aggregate and meets the rows again; no window sorts a hot key in one task."""
    open_ = ~F.coalesce(F.col("terminal"), F.lit(False))
    stop = rows.where(open_).groupBy(F.col(key).alias("k")).agg(F.min(F.coalesce("serial", F.lit(-(1 << 62)))).alias("stop"))
    kept = rows.join(stop, F.col(key).eqNullSafe(F.col("k")), "left").where(F.col("stop").isNull() | (F.col("serial") < F.col("stop")))
    out = kept.groupBy(key).agg(F.max("serial").alias("cursor")).where("cursor IS NOT NULL")
    if previous is not None:
        out = out.unionByName(previous.select(key, "cursor")).groupBy(key).agg(F.max("cursor").alias("cursor"))
    return out


def predecessors(releases: DataFrame, width: int = 3650 * DAY) -> DataFrame:
    """releases (package, version, ts, eligible) plus prior: the package's latest eligible other version with a smaller ts.

    Of equal ts the least version stands. A release without any has a null prior. A release without a ts has no bound: its prior is
    the package's latest eligible version; it is no prior itself. A package's releases are searched in stretches of `width` microseconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = releases.withColumn("order__", F.coalesce(at, F.lit(LAST)))
    return last_before(rows, ["package"], "order__", F.col("version"), F.col("eligible") & F.col("ts").isNotNull(), "prior", width).drop("order__")


def added_members(members: DataFrame, pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(version, member) of members (version, member) that the version's prior in pairs (version, prior) lacks. tasks: as for lookup.dealt."""
    key = ["prior", "member"]
    new = dealt(members, tasks, "version").join(dealt(pairs, tasks, "version"), "version").select("version", "prior", "member").distinct()
    old = dealt(members.select(F.col("version").alias("prior"), "member"), tasks, *key).distinct()
    return dealt(new, tasks, *key).join(old, key, "left_anti").select("version", "member")


def tree_status(files: DataFrame, pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(version, path, status): added, removed or modified paths of files (version, path, content) against the prior. tasks: as for lookup.dealt."""
    key = ["version", "path"]
    at = dealt(files, tasks, "version")
    new = at.join(dealt(pairs, tasks, "version"), "version").select("version", "path", F.col("content").alias("new"))
    old = at.select(F.col("version").alias("prior"), "path", F.col("content").alias("old")).join(dealt(pairs, tasks, "prior"), "prior").select("version", "path", "old")
    both = dealt(new, tasks, *key).join(dealt(old, tasks, *key), key, "full_outer").where(~F.col("new").eqNullSafe(F.col("old")))
    return both.select("version", "path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified").alias("status"))


def rank_cap(rows: DataFrame, key: str, by: list[Column], cap: int) -> DataFrame:
    """rows plus place and screened: whether a row is among the first cap of its key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    return rows.withColumn("place", place).withColumn("screened", F.col("place") <= cap)


def typosquats(names: DataFrame, corpus: DataFrame, least: int = 5) -> DataFrame:
    """(name, target, distance): the nearest corpus name within edit distance 1 or 2 of each name of at least `least` letters.

    An equi-join on deletion neighbourhoods: two strings within distance 2 share a string of at most two deletions.
    Ties go to the first target. Names of the corpus itself have no row."""
    outside = names.where(F.length("name") >= least).distinct().join(corpus.select("name").distinct(), "name", "left_anti")
    known = corpus.where(F.length("name") >= least - 2).select(F.col("name").alias("target")).distinct()
    left, right = outside.select("name", F.explode(deletions(F.col("name"))).alias("key")), known.select("target", F.explode(deletions(F.col("target"))).alias("key"))
    pairs = left.join(right, "key").where(F.abs(F.length("name") - F.length("target")) <= 2).select("name", "target").distinct()
    near = pairs.withColumn("distance", F.levenshtein("name", "target")).where(F.col("distance").between(1, 2))
    return near.groupBy("name").agg(F.min(F.struct("distance", "target")).alias("m")).select("name", "m.target", "m.distance")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each key, that of the greatest order: an upsert of a snapshot with later batches."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    best = rows.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("m"))
    return best.select(*key, *[F.col("m")[c].alias(c) for c in (order, *rest)])
