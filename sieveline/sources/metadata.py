"""An index's package documents (JSON) as tables: versions and files, requirements, owners. Documents drift, so they are read as VARIANT, and what a
document lacks or has in another form becomes a null, never a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import requirement_name


def parsed(docs: DataFrame, text: str = "json") -> DataFrame:
    """docs (package, json) with `doc` and `outcome`: unreadable-metadata for null texts, for what is no JSON and for what is no object."""
    doc = F.try_parse_json(F.col(text))
    good = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    return docs.withColumn("doc", F.when(good, doc)).withColumn("outcome", F.when(~good, F.lit("unreadable-metadata"))).drop(text)


def _get(doc: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(doc), path, kind)


def _entries(rows: DataFrame, column: Column, names: list[str]) -> DataFrame:
    """rows with (pos, key, value) of the members of a variant column; a row without any keeps one with nulls."""
    spark = SparkSession.active()
    pos, key, value = names
    spread = spark.tvf.variant_explode_outer(column.outer())
    return rows.lateralJoin(spread).withColumnsRenamed({"pos": pos, "key": key, "value": value})


def files(docs: DataFrame) -> DataFrame:
    """(package, version, pos, packagetype, url, uploaded, yanked): a row for each file of each version of parsed documents.

    uploaded is the text as it stands, since times of one form sort as texts. Versions without files have one row with nulls beside the version."""
    held = docs.where(F.col("doc").isNotNull()).select("package", _get("doc", "$.releases", "variant").alias("releases"))
    versions = _entries(held, F.col("releases"), ["v_pos", "version", "files"]).select("package", "version", "files").where("version IS NOT NULL")
    spread = _entries(versions, F.col("files"), ["pos", "f_key", "file"])
    return spread.select("package", "version", "pos", _get("file", "$.packagetype").alias("packagetype"), _get("file", "$.url").alias("url"),
        _get("file", "$.upload_time_iso_8601").alias("uploaded"), F.coalesce(_get("file", "$.yanked", "boolean"), F.lit(False)).alias("yanked"))


def sdists(found: DataFrame) -> DataFrame:
    """(package, version, url, uploaded, yanked): the first source archive of each version; versions without one have nulls."""
    first = F.min(F.when(F.col("packagetype") == "sdist", F.struct("pos", "url", "uploaded", "yanked"))).alias("m")
    return found.groupBy("package", "version").agg(first).select("package", "version", "m.url", "m.uploaded", "m.yanked", F.col("m").isNotNull().alias("has_sdist"))


def earliest(found: DataFrame) -> DataFrame:
    """(name, earliest): the first readable upload time of any file of a package; null where none is readable."""
    return found.groupBy(F.col("package").alias("name")).agg(F.min(F.try_to_timestamp("uploaded")).alias("earliest"))


def requirements(docs: DataFrame) -> DataFrame:
    """(package, name): distinct normalised names that parsed documents require."""
    held = docs.where(F.col("doc").isNotNull()).select("package", _get("doc", "$.info.requires_dist", "array<string>").alias("lines"))
    return held.select("package", F.explode("lines").alias("line")).select("package", requirement_name(F.col("line")).alias("name")).where("name <> ''").distinct()


def owners(docs: DataFrame) -> DataFrame:
    """(package, author, maintainer, owners): names and account names only; addresses are not read. A package without roles has an empty list."""
    roles = _get("doc", "$.ownership.roles", "array<variant>")
    users = F.transform(F.coalesce(roles, F.array().cast("array<variant>")), lambda r: F.try_variant_get(r, "$.user", "string"))
    return docs.where(F.col("doc").isNotNull()).select("package", _get("doc", "$.info.author").alias("author"),
        _get("doc", "$.info.maintainer").alias("maintainer"), F.filter(users, lambda u: u.isNotNull()).alias("owners"))
