"""The triage operators as queries on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import html_escape, location_weight, normalize_name
from sieveline.operators import releases as R
from sieveline.operators import rules as rule
from sieveline.operators import triage as T
from sieveline.operators.lookup import dealt, tasks_for

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT user_id AS name, event_type || CAST(event_id % 5 AS VARCHAR) AS version, max(event_id) AS serial FROM events WHERE event_type = 'signup' GROUP BY ALL")
def changelog_dedupe(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("name"), F.concat("event_type", (F.col("event_id") % 5).cast("string")).alias("version"), F.col("event_type").alias("action"), F.col("event_id").alias("serial"))
    return R.changelog(log, "signup")


@query("SELECT user_id AS name, event_id AS serial FROM events WHERE event_type = 'signup' ORDER BY event_id LIMIT 2000")
def tick_limit(spark, d):
    return R.tick(table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("name"), F.col("event_id").alias("serial")))


@query("SELECT o_orderkey AS release FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def terminal_antijoin(spark, d):
    state = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("release"), F.when(F.col("l_linestatus") == "O", "reviewed").otherwise("fetch_failed").alias("stage"))
    return T.open_releases(table(spark, d, "orders").select(F.col("o_orderkey").alias("release")), state, ["release"])


@query("SELECT stream, max(serial) AS cursor FROM (SELECT user_id AS stream, event_id AS serial, bool_and(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM events) WHERE ok GROUP BY stream")
def cursor_prefix(spark, d):
    return R.cursor_prefix(table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("serial"), (F.col("event_type") != "error").alias("terminal")))


PRIOR = "SELECT a.o_orderkey AS version, (SELECT b.o_orderkey FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus <> 'F' AND b.o_orderdate < a.o_orderdate ORDER BY b.o_orderdate DESC, b.o_orderkey LIMIT 1) AS prior FROM orders a"


def _prior(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") != "F").alias("eligible"))
    return R.predecessors(o).select("version", "prior")


@query(PRIOR)
def predecessor_asof(spark, d):
    return _prior(spark, d)


@query(f"WITH p AS ({PRIOR}) SELECT DISTINCT version, l_partkey AS member FROM p JOIN lineitem ON l_orderkey = version WHERE prior IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = prior AND x.l_partkey = lineitem.l_partkey)")
def added_deps(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), F.col("l_partkey").alias("member"))
    return R.added_members(members, _prior(spark, d).where("prior IS NOT NULL"), tasks_for(members))


FILES = "SELECT l_orderkey AS version, l_partkey AS path, max(l_quantity) AS content FROM lineitem GROUP BY ALL"


@query(f"WITH p AS (SELECT * FROM ({PRIOR}) WHERE prior IS NOT NULL), f AS ({FILES}), n AS (SELECT version, path, content AS new FROM f JOIN p USING (version)), o AS (SELECT p.version, path, content AS old FROM f JOIN p ON f.version = p.prior) SELECT version, path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'modified' END AS status FROM n FULL OUTER JOIN o USING (version, path) WHERE new IS DISTINCT FROM old")
def file_status_join(spark, d):
    lines = table(spark, d, "lineitem")
    n = tasks_for(lines)
    files = dealt(lines, n, "l_orderkey").groupBy(F.col("l_orderkey").alias("version"), F.col("l_partkey").alias("path")).agg(F.max("l_quantity").alias("content"))
    return R.tree_status(files, _prior(spark, d).where("prior IS NOT NULL"), n)


@query("WITH s AS (SELECT l_partkey, min(l_shipdate) AS first FROM lineitem GROUP BY ALL) SELECT p_partkey AS name, CASE WHEN first IS NULL THEN 'nonexistent' WHEN first > TIMESTAMP '1992-03-01' THEN 'brand-new' END AS reason FROM part LEFT JOIN s ON l_partkey = p_partkey")
def dep_reputation(spark, d):
    seen = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.min("l_shipdate").alias("first"))
    new = F.when(F.col("first").isNull(), "nonexistent").when(F.col("first") > F.lit("1992-03-01").cast("timestamp_ntz"), "brand-new")
    return table(spark, d, "part").select(F.col("p_partkey").alias("name")).join(seen, "name", "left").select("name", new.alias("reason"))


@query("SELECT l_orderkey AS release, l_partkey AS dep, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) <= 3 AS screened FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def dep_lookup_cap(spark, d):
    deps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("release"), F.col("l_partkey").alias("dep")).distinct()
    return R.rank_cap(deps, "release", [F.col("dep")], 3).select("release", "dep", "screened")


PATH = "CASE doc_id % 5 WHEN 0 THEN 'setup.py' WHEN 1 THEN 'pkg/__init__.py' WHEN 2 THEN 'tests/t.py' WHEN 3 THEN 'docs/x.py' ELSE 'pkg/m.py' END"
WEIGHT = "CASE WHEN doc_id % 5 IN (0, 1) THEN 3.0 WHEN doc_id % 5 IN (2, 3) THEN 0.2 ELSE 1.0 END"


@query(f"SELECT doc_id, CAST({WEIGHT} AS DOUBLE) AS weight FROM documents")
def location_weights(spark, d):
    return table(spark, d, "documents").select("doc_id", location_weight(F.expr(PATH)).alias("weight"))


PACK = rule.load([
    {"id": "shout", "applies_to": "code", "weight": 20, "location_scaled": False, "match": {"regex": {"pattern": "[A-Z]{5}!!"}}},
    {"id": "early", "applies_to": "code", "weight": 45, "match": {"all": [{"location_at_least": 3}, {"any": [{"regex": {"pattern": "[0-9]{4}"}}, {"blob_present": True}]}]}},
    {"id": "marks", "applies_to": "code", "weight": 5, "match": {"all": [{"regex": {"pattern": "[$&*]{3}"}}, {"not": {"regex": {"pattern": "@"}}}]}},
])


@query(f"WITH f AS (SELECT doc_id, (CASE WHEN regexp_matches(text, '[A-Z]{{5}}!!') THEN 20.0 ELSE 0 END) AS a, (CASE WHEN doc_id % 5 IN (0, 1) AND (regexp_matches(text, '[0-9]{{4}}') OR length(text) > 20000) THEN 45.0 ELSE 0 END) AS b, (CASE WHEN regexp_matches(text, '[$&*]{{3}}') AND NOT contains(text, '@') THEN 5.0 ELSE 0 END) AS c FROM documents) SELECT doc_id, CAST(a + b + c AS DOUBLE) AS score, CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS BIGINT) AS n_rules, a + b + c >= 40 AS escalate FROM f WHERE a + b + c > 0")
def rule_scores(spark, d):
    facts = table(spark, d, "documents").select("doc_id", location_weight(F.expr(PATH)).alias("location_weight"), F.split("text", "\n").alias("added"), (F.length("text") > 20000).alias("blob"))
    return rule.scores(facts, PACK, ["doc_id"])


@query("SELECT c_custkey, lower(regexp_replace(trim(c_name), '[-_.#]+', '-', 'g')) AS name FROM customer")
def name_normalize(spark, d):
    return table(spark, d, "customer").select("c_custkey", normalize_name(F.translate("c_name", "#", "-")).alias("name"))


BATCHES = "SELECT doc_id, 0 AS batch, toxic AS verdict FROM labels UNION ALL SELECT doc_id, 1 AS batch, quality AS verdict FROM labels WHERE toxic = 1"


@query(f"SELECT doc_id, batch, verdict FROM ({BATCHES}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC) = 1")
def verdict_upsert(spark, d):
    x = table(spark, d, "labels")
    first, second = x.select("doc_id", F.lit(0).alias("batch"), F.col("toxic").alias("verdict")), x.where("toxic = 1").select("doc_id", F.lit(1).alias("batch"), F.col("quality").alias("verdict"))
    return R.latest(first.unionByName(second), ["doc_id"], "batch")


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS url FROM pages")
def html_escapes(spark, d):
    return table(spark, d, "pages").select("page_id", html_escape(F.col("url")).alias("url"))
