"""Tables written in between, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df as a written table: what is made of it reads the table, so that nothing is computed twice and a lost executor costs a re-read.

    It goes to the folder of spark.checkpoint.dir; only where a session names none, as on one machine, a local folder is made."""
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not context.getCheckpointDir():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = context.getCheckpointDir()
    path = f"{root.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
