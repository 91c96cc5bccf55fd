"""State by key as Parquet tables partitioned by a hash of the key: a small batch reads and rewrites the buckets of its keys and no others.

Each table is a folder of `bucket=` partitions, written by Spark's dynamic partition overwrite. A batch's new buckets, of all tables, are first written to
a staging folder that is complete once its marker stands, and then put in place; whoever comes next finishes a complete staging and drops an incomplete
one, so a crash at any point leaves all tables at one batch or the other. The marker names the batch, and a batch that is done already is skipped when
it comes again. One writer at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def _drop(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def bucket(key: list[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table, None before its first batch. Columns that later batches added are null in older rows."""
    path = f"{root}/{name}"
    return spark.read.option("mergeSchema", "true").parquet(path) if exists(spark, path) else None


def point(spark: SparkSession, root: str, name: str, key: dict[str, object], buckets: int = BUCKETS) -> DataFrame | None:
    """The row of one key; the scan is pruned to the key's bucket."""
    table = read(spark, root, name)
    if table is None:
        return None
    kinds = {c: table.schema[c].dataType for c in key}
    at = spark.range(1).select(F.pmod(F.xxhash64(*[F.lit(v).cast(kinds[c]) for c, v in key.items()]), F.lit(buckets)).cast("int")).first()[0]
    rows = table.where(F.col("bucket") == at)
    for c, v in key.items():
        rows = rows.where(F.col(c).eqNullSafe(F.lit(v).cast(kinds[c])))
    return rows.drop("bucket")


def touched(spark: SparkSession, root: str, name: str, rows: DataFrame, key: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame | None]:
    """(rows with their bucket; what the table holds in the buckets of rows). The driver sees at most `buckets` numbers."""
    dealt = rows.withColumn("bucket", bucket(key, buckets))
    table = read(spark, root, name)
    if table is None:
        return dealt, None
    at = [r[0] for r in dealt.select("bucket").distinct().collect()]
    return dealt, table.where(F.col("bucket").isin(*at)) if at else table.where("false")


def upserted(spark: SparkSession, root: str, name: str, rows: DataFrame, key: list[str], order: str, buckets: int = BUCKETS) -> DataFrame:
    """The touched buckets after partial updates: each column has its last value that isn't null, those of rows after those of the table, among them by order.

    Columns may be added. Rows of the table that no update meets stay as they are."""
    dealt, held = touched(spark, root, name, rows, key, buckets)
    both = dealt.withColumn("new__", F.lit(1))
    if held is not None:
        both = held.withColumn("new__", F.lit(0)).unionByName(both, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "new__")]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("new__", F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    return both.groupBy(*key).agg(*[last(c) for c in rest])


def inserted(spark: SparkSession, root: str, name: str, rows: DataFrame, key: list[str], order: str, buckets: int = BUCKETS) -> DataFrame:
    """The touched buckets with the rows whose key was absent; of equal keys in rows the first by order comes in."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    first = rows.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("m")).select(*key, *[F.col("m")[c].alias(c) for c in (order, *rest)])
    dealt, held = touched(spark, root, name, first, key, buckets)
    if held is None:
        return dealt
    return held.unionByName(dealt.join(held.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def recover(spark: SparkSession, root: str) -> None:
    """Finishes what a crash has left: a complete staging is put in place, an incomplete one goes."""
    staged = f"{root}/_staged"
    if exists(spark, f"{staged}/_WHOLE/_SUCCESS"):
        _put(spark, root)
    elif exists(spark, staged):
        _drop(spark, staged)


def _put(spark: SparkSession, root: str) -> None:
    whole = spark.read.parquet(f"{root}/_staged/_WHOLE").collect()  # a row for each table
    for r in whole:
        part = spark.read.parquet(f"{root}/_staged/{r['name']}")
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{r['name']}")
    spark.createDataFrame([(r["batch"], r["name"]) for r in whole], "batch string, name string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_done")
    _drop(spark, f"{root}/_staged")


def done(spark: SparkSession, root: str) -> str | None:
    """The batch that was put in place last."""
    return spark.read.parquet(f"{root}/_done").first()["batch"] if exists(spark, f"{root}/_done") else None


def commit(spark: SparkSession, root: str, batch: str, tables: dict[str, DataFrame]) -> None:
    """Puts the buckets of all tables in place of those that stand, together. Buckets that a frame has no rows of stay as they are."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/_staged/{name}")
    spark.createDataFrame([(batch, name) for name in tables], "batch string, name string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_staged/_WHOLE")
    _put(spark, root)
