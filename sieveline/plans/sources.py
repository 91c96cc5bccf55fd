"""Sources as queries: the changelog, package metadata, blobs; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.text import web_scheme
from sieveline.operators import releases as R
from sieveline.operators import triage as T
from sieveline.plans.triage import query, table
from sieveline.sources import changelog
from sieveline.sources import metadata as M


@query("""SELECT CAST(user_id AS VARCHAR) AS name, props AS version, max(event_id) AS serial FROM events
WHERE event_type = 'signup' AND props IS NOT NULL GROUP BY ALL""")
def changelog_source(spark, d):
    changelog.register(spark)
    log = spark.read.format("changelog").options(path=f"{d}/events.parquet", name="user_id", version="props", action="event_type", serial="event_id",
        rowsPerPartition="100000").load()
    return R.changelog(log, "signup")


def _index(spark, d):
    """Package documents of customers: each of their orders is a version with a wheel and, unless it is pending, a source archive. Customers of some segments have documents that drift."""
    o = table(spark, d, "orders")
    wheel = F.struct(F.lit("bdist_wheel").alias("packagetype"), F.concat(F.lit("w/"), "o_orderkey").alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("upload_time_iso_8601"), (F.col("o_orderstatus") == "F").alias("yanked"))
    source = F.struct(F.lit("sdist").alias("packagetype"), F.concat(F.lit("s/"), "o_orderkey").alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("upload_time_iso_8601"), (F.col("o_orderstatus") == "F").alias("yanked"))
    files = F.when(F.col("o_orderstatus") == "P", F.array(wheel)).otherwise(F.array(wheel, source))
    versions = o.groupBy(F.col("o_custkey").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), files))).alias("releases"))
    c = table(spark, d, "customer").join(versions, F.col("c_custkey") == F.col("k"), "left")
    role = F.struct(F.lit("Owner").alias("role"), F.lower("c_mktsegment").alias("user"), F.lit("x@example.org").alias("email"))
    info = F.struct(F.col("c_name").alias("author"),
        F.array(F.concat(F.lit("Dep_"), "c_nationkey", F.lit(" >= 1.0; extra == 'x'")), F.lit("zlib.ng")).alias("requires_dist"))
    whole = F.to_json(F.struct(info.alias("info"), "releases", F.struct(F.array(role).alias("roles")).alias("ownership")))
    odd = F.when(F.col("c_mktsegment") == "MACHINERY",
        F.concat(F.lit('{"releases": '), F.col("c_custkey"), F.lit(', "info": [], "ownership": null}'))).when(F.col("c_mktsegment") == "BUILDING",
        F.col("c_name"))
    return c.select(F.col("c_custkey").alias("package"), F.when(F.col("c_nationkey") == 7, None).otherwise(F.coalesce(odd, whole)).alias("json"))


GOOD = "c_nationkey <> 7 AND c_mktsegment NOT IN ('MACHINERY', 'BUILDING')"


@query(f"""SELECT c_custkey AS package, CAST(o_orderkey AS VARCHAR) AS version, o_orderstatus <> 'P' AS has_sdist,
CASE WHEN o_orderstatus <> 'P' THEN 's/' || o_orderkey END AS url, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS uploaded,
CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS yanked FROM customer JOIN orders ON o_custkey = c_custkey WHERE {GOOD}""")
def index_versions(spark, d):
    return M.sdists(M.files(M.parsed(_index(spark, d))))


@query("SELECT c_custkey AS package, 'unreadable-metadata' AS outcome FROM customer WHERE c_nationkey = 7 OR c_mktsegment = 'BUILDING'")
def index_unreadable(spark, d):
    return M.parsed(_index(spark, d)).where("outcome IS NOT NULL").select("package", "outcome")


@query(f"""SELECT c_custkey AS package, CASE WHEN {GOOD} THEN c_name END AS author, CASE WHEN {GOOD} THEN lower(c_mktsegment) ELSE '' END AS owners
FROM customer WHERE c_nationkey <> 7 AND c_mktsegment <> 'BUILDING'""")
def index_owners(spark, d):
    return M.owners(M.parsed(_index(spark, d))).select("package", "author", F.array_join("owners", ",").alias("owners"))


@query(f"""SELECT c_custkey AS package, unnest(['dep-' || c_nationkey, 'zlib-ng']) AS name FROM customer WHERE {GOOD}""")
def index_requirements(spark, d):
    return M.requirements(M.parsed(_index(spark, d)))


@query(f"SELECT c_custkey AS name, CAST(min(o_orderdate)::DATE AS VARCHAR) AS earliest FROM customer JOIN orders ON o_custkey = c_custkey WHERE {GOOD} GROUP BY ALL")
def index_earliest(spark, d):
    return M.earliest(M.files(M.parsed(_index(spark, d)))).select("name", F.date_format("earliest", "yyyy-MM-dd").alias("earliest"))


@query("""SELECT DISTINCT lower(regexp_replace(trim(p_name), '[-_.]+', '-', 'g')) AS name FROM part WHERE p_size % 5 <> 0 AND trim(p_name) <> ''""")
def corpus_scan(spark, d):
    lines = table(spark, d, "part").select(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" # "), "p_name")).when(F.col("p_size") % 7 == 0,
        F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(F.col("p_name")).alias("value"))
    return T.corpus_names(lines.unionByName(lines.select(F.lit("  ").alias("value")).limit(1)))


@query("SELECT page_id, coalesce(lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%', false) AS web FROM pages")
def url_schemes(spark, d):
    return table(spark, d, "pages").select("page_id", web_scheme(F.col("url")).alias("web"))
