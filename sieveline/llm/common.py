"""Shared helpers of the training-data operators: tables, shared scratch space, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token pattern of the contracts: runs of anything but space and \t \n \v \f \r.
TOKEN = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (null ids hash as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of contract tokens of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where the cluster names none (tests on one machine) a local folder is chosen."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/t-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, so a lost
    executor costs a re-read and never a recomputation."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables made by cut() that nothing reads any more: what was made from them is written itself."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def components(nodes: DataFrame, links: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), by repeated hooking of each
    root to the least neighbouring root and pointer jumping. All state stays in Spark tables; the
    driver sees one boolean count per round. Rounds grow with the logarithm of the diameter."""
    spark = nodes.sparkSession
    last = edges = cut(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    touched = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    lab = cut(touched.select("id", F.col("id").alias("c")))
    while True:
        # edges between current roots
        la, lb = lab.select(F.col("id").alias("a"), F.col("c").alias("ca")), lab.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        edges = edges.join(la, "a").join(lb, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        old, edges = last, cut(edges)
        last = edges
        free(old)
        if edges.isEmpty():
            free(edges)
            break
        hook = edges.groupBy(F.col("b").alias("r")).agg(F.min("a").alias("p"))  # always to a smaller root: no cycles
        hook = cut(hook)
        while True:  # pointer jumping
            up = hook.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            jumped = cut(hook.join(up, "p", "left").select("r", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            hook = jumped.select("r", "p")
            if jumped.where("moved").isEmpty():
                break
        lab = cut(lab.join(hook.withColumnRenamed("r", "c"), "c", "left").select("id", F.coalesce("p", "c").alias("c")))
        # the next round's edges are those between roots, so labels of roots are needed only
        edges = edges.select("a", "b")
    out = nodes.select(F.col(id_col).cast("long").alias("id")).join(lab, "id", "left")
    return out.select("id", F.coalesce("c", "id").alias("component"))
