"""Archives in a folder, refused unread where they are too large."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAP = 50 << 20


def blobs(spark: SparkSession, path: str, cap: int = CAP, names: str = "*.tar.gz") -> DataFrame:
    """(path, length, content, outcome, reason) of the files below a folder: content up to `cap` bytes, else refused_to_fetch for download-size.

    The bound on the length is pushed to the scan, which opens no file above it; the refusals come from the listing alone."""
    files = lambda: spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path)
    none = F.lit(None).cast("string")
    read = files().where(F.col("length") <= cap).select("path", "length", "content", none.alias("outcome"), none.alias("reason"))
    refused = files().where(F.col("length") > cap).select("path", "length", F.lit(None).cast("binary").alias("content"),
        F.lit("refused_to_fetch").alias("outcome"), F.lit("download-size").alias("reason"))
    return read.unionByName(refused)
