"""Joins that other operators are made of: at most one row per key, and the last fact of a key before a point of its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the stretches in which a key's order is searched, for serials; a hot key is dealt to as many tasks as it has stretches.
SERIALS = 100_000
#: An order before and after all others.
FIRST, LAST = -(1 << 62), 1 << 62
#: Rows of the largest table that one task of a join takes, about.
ROWS = 250_000


def tasks_for(rows: DataFrame, each: int = ROWS) -> int:
    """The number of tasks that gives each its share of rows, whatever the table's size; counting a table of Parquet files reads their footers alone."""
    return max(1, -(-rows.count() // each))


def dealt(rows: DataFrame, tasks: int | None, *key: str | Column) -> DataFrame:
    """rows dealt to `tasks` tasks by key, so that what a task holds doesn't grow with the table; with None Spark chooses their number."""
    return rows if tasks is None else rows.repartition(tasks, *key)


def keyed_left(left: DataFrame, right: DataFrame, key: list[str], tasks: int | None = None) -> DataFrame:
    """left joined with at most one row of right per key, null keys alike; the columns of left, then those of right without the key. tasks: as for dealt."""
    named = right.select(*[F.col(k).alias(f"{k}__r") for k in key], *[c for c in right.columns if c not in key])
    if tasks is not None:
        # structs are equal if their fields are, nulls alike, so that rows are dealt and joined by the same value
        mine, theirs = F.struct(*[F.col(k).alias(k) for k in key]), F.struct(*[F.col(f"{k}__r").alias(k) for k in key])
        return dealt(left, tasks, mine).join(dealt(named, tasks, theirs), mine == theirs, "left").drop(*[f"{k}__r" for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    return left.join(named, same, "left").drop(*[f"{k}__r" for k in key])


def last_before(rows: DataFrame, key: list[str], order: str, value: Column, fact: Column, name: str, width: int = SERIALS) -> DataFrame:
    """rows plus `name`: the value of the key's last row with `fact` and a smaller order; null if there is none.

    Of facts of equal order the least value stands. order is a whole number; rows without one see nothing and are seen by none. Null keys are keys. The order is cut into
    stretches of `width`: within a stretch a window looks back, and each stretch's last fact is carried to those after it, so that
    no task sorts all rows of one key. Both read one shuffle."""
    has = F.coalesce(fact, F.lit(False)) & F.col(order).isNotNull()
    cut = [*key, "stretch__"]
    # the least of (-order, value) is the last fact, of equal orders the least value
    dealt = rows.withColumn("stretch__", F.floor(F.col(order) / width)).withColumn("fact__", F.when(has, F.struct((-F.col(order)).alias("o"), value.alias("v"))))
    past = Window.partitionBy(*key).orderBy("stretch__").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy(*cut).agg(F.min("fact__").alias("end__")).select(*cut, F.min("end__").over(past).alias("carried__"))
    near = Window.partitionBy(*cut).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    out = keyed_left(dealt.withColumn("local__", F.min("fact__").over(near)), carried, cut)
    found = F.when(F.col(order).isNotNull(), F.least("local__", "carried__"))
    return out.withColumn(name, found["v"]).drop("stretch__", "fact__", "local__", "carried__")
