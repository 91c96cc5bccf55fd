"""What was known of a release's owners when it came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.lookup import FIRST, SERIALS, keyed_left, last_before
from sieveline.operators.triage import owners_changed

def prior_owners(batch: DataFrame, state: DataFrame, width: int = SERIALS) -> DataFrame:
    """batch (package, version, serial, prior, owners, ...) plus prior_owners, what is known of the owners of (package, prior), and maintainer_changed.

    A release sees what earlier ticks have stored (state: package, version, owners) and the releases of its own batch with smaller serials; of
    these the last with owners stands. A release without a prior, or whose prior nobody has recorded, has null and no change."""
    asks = batch.where(F.col("prior").isNotNull()).select("package", F.col("prior").alias("of"), "serial",
        F.lit(None).cast(batch.schema["owners"].dataType).alias("told"), F.col("version").alias("for"), F.lit(True).alias("asks"))
    told = batch.select("package", F.col("version").alias("of"), "serial", F.col("owners").alias("told"),
        F.lit(None).cast(batch.schema["version"].dataType).alias("for"), F.lit(False).alias("asks"))
    stored = state.select("package", F.col("version").alias("of"), F.lit(FIRST).alias("serial"), F.col("owners").alias("told"),
        F.lit(None).cast(batch.schema["version"].dataType).alias("for"), F.lit(False).alias("asks"))
    rows = asks.unionByName(told).unionByName(stored)
    seen = last_before(rows, ["package", "of"], "serial", F.col("told"), F.col("told").isNotNull(), "prior_owners", width).where("asks")
    found = seen.select("package", F.col("for").alias("version"), "serial", "prior_owners").dropDuplicates(["package", "version", "serial"])
    out = keyed_left(batch, found, ["package", "version", "serial"])
    return out.withColumn("maintainer_changed", owners_changed(F.col("owners"), F.col("prior_owners")))
