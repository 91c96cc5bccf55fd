"""Scores, screening, routing, queues and state as queries on the driver's tables; each SQL is written apart from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import releases as R
from sieveline.operators import triage as T
from sieveline.operators.changes import routed
from sieveline.plans.triage import PRIOR, _prior, query, table

#: Rules stand in the order N, R, A; files by their number as text.
FIRED = """SELECT l_orderkey AS release, l_returnflag AS rule, CAST(l_partkey AS VARCHAR) AS file, l_quantity AS weight, l_linenumber AS lo,
CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS place FROM lineitem WHERE l_quantity > 45"""


def _fired(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_quantity > 45")
    place = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    file, line = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    return rows.select(F.col("l_orderkey").alias("release"), place.alias("place"), file.alias("item"), F.col("l_returnflag").alias("rule"),
        file.alias("file"), F.col("l_quantity").alias("weight"), line.alias("lo"), line.alias("hi"))


@query(f"""WITH f AS ({FIRED}) SELECT o_orderkey AS release, CAST(coalesce(sum(weight), 0) AS DOUBLE) AS score, count(rule) AS n_rules,
coalesce(string_agg(rule || '@' || file, '; ' ORDER BY place, file, weight), '') AS fired, coalesce(sum(weight), 0) >= 90 AS escalate
FROM orders LEFT JOIN f ON f.release = o_orderkey GROUP BY o_orderkey""")
def triage_scores(spark, d):
    releases = table(spark, d, "orders").select(F.col("o_orderkey").alias("release"))
    out = T.release_scores(releases, _fired(spark, d), ["release"], 90.0)
    return out.select("release", "score", "n_rules", F.array_join(F.transform("fired", lambda x: F.concat_ws("@", x.rule, x.file)), "; ").alias("fired"), "escalate")


@query(f"""WITH f AS ({FIRED}), r AS (SELECT *, row_number() OVER (PARTITION BY release ORDER BY weight DESC, place, file) AS place_ FROM f)
SELECT release, string_agg(rule || '@' || file, '; ' ORDER BY place_) AS top FROM r WHERE place_ <= 2 GROUP BY release""")
def top_fired_rules(spark, d):
    fired = _fired(spark, d)
    return T.top_rules(T.release_scores(fired, fired, ["release"]), 2).select("release", "top")


@query("""WITH f AS (SELECT l_suppkey AS release, l_partkey AS file, sum(l_quantity) AS weight, count(DISTINCT l_returnflag || l_linenumber) AS locations
FROM lineitem GROUP BY ALL) SELECT release, file, weight, locations, row_number() OVER (PARTITION BY release ORDER BY weight DESC, file) AS place
FROM f QUALIFY place <= 40""")
def file_weights_top(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("release"), F.col("l_returnflag").alias("rule"),
        F.col("l_partkey").alias("file"), F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("lo"), F.col("l_linenumber").alias("hi"))
    return T.file_weights(rows, ["release"]).withColumn("place", F.col("place").cast("long"))


@query("""WITH n AS (SELECT DISTINCT substr(p_name, 2) AS name FROM part), c AS (SELECT DISTINCT p_name AS target FROM part),
x AS (SELECT name, target, levenshtein(name, target) AS distance FROM n, c WHERE name NOT IN (SELECT target FROM c) AND length(name) >= 5)
SELECT name, target, CAST(distance AS INTEGER) AS distance FROM x WHERE distance BETWEEN 1 AND 2
QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, target) = 1""")
def typosquat_join(spark, d):
    parts = table(spark, d, "part").select("p_name")
    return R.typosquats(parts.select(F.expr("substr(p_name, 2)").alias("name")), parts.withColumnRenamed("p_name", "name"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS release, CASE WHEN l_quantity > 30 THEN p_name WHEN l_quantity > 20 THEN substr(p_name, 2)
ELSE 'dep' || l_partkey END AS name FROM lineitem JOIN part ON p_partkey = l_partkey), c AS (SELECT DISTINCT p_name AS target FROM part),
o AS (SELECT * FROM a WHERE name NOT IN (SELECT target FROM c)),
t AS (SELECT name, target FROM (SELECT DISTINCT name FROM o), c WHERE length(name) >= 5 AND levenshtein(name, target) BETWEEN 1 AND 2
      QUALIFY row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, target), target) = 1),
l AS (SELECT release, name, row_number() OVER (PARTITION BY release ORDER BY name) AS place FROM o WHERE name NOT IN (SELECT name FROM t)),
i AS (SELECT 'dep' || p_partkey AS name, TIMESTAMP '1992-01-01' + to_days(p_size) AS earliest FROM part WHERE p_size <= 40),
r AS (SELECT release, l.name, CASE WHEN place > 2 THEN 'not-screened-cap' WHEN i.name IS NULL THEN 'nonexistent'
      WHEN earliest > TIMESTAMP '1992-01-21 12:00:00' THEN 'brand-new' END AS reason FROM l LEFT JOIN i ON i.name = l.name)
SELECT release, name, reason, CAST(NULL AS VARCHAR) AS target FROM r WHERE reason IS NOT NULL
UNION ALL SELECT release, name, 'typosquat', target FROM o JOIN t USING (name)""")
def screen_dependencies(spark, d):
    part = table(spark, d, "part")
    name = F.when(F.col("l_quantity") > 30, F.col("p_name")).when(F.col("l_quantity") > 20,
        F.expr("substr(p_name, 2)")).otherwise(F.concat(F.lit("dep"), F.col("l_partkey")))
    added = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("release"), name.alias("name"))
    index = part.where("p_size <= 40").select(F.concat(F.lit("dep"), F.col("p_partkey")).alias("name"),
        F.expr("timestamp_ntz'1992-01-01' + make_dt_interval(p_size)").alias("earliest"))
    return T.screen(added, part.select(F.col("p_name").alias("name")), index, F.expr("timestamp_ntz'1992-02-20 12:00:00'"), cap=2)


@query(f"""WITH p AS (SELECT * FROM ({PRIOR}) WHERE prior IS NOT NULL),
s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 7) FILTER (l_returnflag <> 'A')) AS owners FROM lineitem GROUP BY ALL)
SELECT version, coalesce(a.owners <> b.owners, false) AS changed FROM p JOIN s a ON a.k = version JOIN s b ON b.k = prior""")
def owner_set_change(spark, d):
    """Names in two cases, and empty ones."""
    name = F.concat(F.lit("Owner"), (F.col("l_suppkey") % 7).cast("string"))
    name = F.when(F.col("l_returnflag") == "A", "").when(F.col("l_linenumber") % 2 == 0, F.upper(name)).otherwise(name)
    owners = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(name).alias("owners"))
    new, old = owners.select(F.col("l_orderkey").alias("version"), F.col("owners").alias("a")), owners.select(F.col("l_orderkey").alias("prior"),
        F.col("owners").alias("b"))
    return _prior(spark, d).join(new, "version").join(old, "prior").select("version", T.owners_changed(F.col("a"), F.col("b")).alias("changed"))


@query("""SELECT a.o_orderkey AS version, (SELECT b.o_orderkey FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus <> 'F'
AND b.o_orderpriority <> '5-LOW' AND (a.o_orderpriority = '5-LOW' OR b.o_orderdate < a.o_orderdate) ORDER BY b.o_orderdate DESC, b.o_orderkey LIMIT 1) AS prior
FROM orders a""")
def predecessor_without_time(spark, d):
    """Orders of the lowest priority have no time."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("ts"), (F.col("o_orderstatus") != "F").alias("eligible"))
    return R.predecessors(o).select("version", "prior")


@query("SELECT c_custkey, lower(trim(c_mktsegment)) IN ('automobile', 'machinery') AS denied FROM customer")
def denylist_flags(spark, d):
    listed = spark.createDataFrame([(" AUTOMOBILE ",), ("Machinery",), ("",)], "name string")
    return T.denied(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("name")), listed).select("c_custkey", "denied")


@query("""SELECT o_orderkey AS release, CASE WHEN o_orderpriority = '1-URGENT' THEN 'refused_to_extract' WHEN o_orderpriority = '2-HIGH' THEN 'fetch_failed'
WHEN o_orderpriority = '3-MEDIUM' THEN 'no_sdist' WHEN o_orderstatus = 'O' THEN 'new_package_skipped' WHEN o_totalprice >= 100000 THEN 'escalated' ELSE 'triaged' END AS stage,
o_orderpriority <> '2-HIGH' AS terminal, o_orderpriority = '1-URGENT' AS heuristic FROM orders""")
def outcome_stages(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("1-URGENT", "refused_to_extract", "2-HIGH", "timeout", "3-MEDIUM", "no_sdist")])
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("release"), names[F.col("o_orderpriority")].alias("outcome"),
        (F.col("o_orderstatus") == "O").alias("is_new"), F.col("o_totalprice").alias("score"))
    return T.stages(rows, "skip", 100_000.0).select("release", "stage", "terminal", "heuristic")


@query("""SELECT user_id, event_type, min(event_id) AS alert FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.value > 90) GROUP BY ALL""")
def alert_dedupe(spark, d):
    rows = table(spark, d, "events")
    return T.new_alerts(rows.select("user_id", "event_type", F.col("event_id").alias("alert")), rows.where("value > 90"), ["user_id", "event_type"], "alert")


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'reviewed' ELSE 'triaged' END AS stage, CAST(quality AS DOUBLE) AS score,
CASE WHEN quality = 0 THEN 'checked' END AS human, CASE WHEN quality = 0 THEN 2 WHEN toxic = 1 THEN 1 ELSE 0 END AS at FROM labels""")
def partial_merge(spark, d):
    x = table(spark, d, "labels")
    state = x.select("doc_id", F.lit("triaged").alias("stage"), F.col("quality").cast("double").alias("score"),
        F.lit(None).cast("string").alias("human"), F.lit(0).alias("at"))
    staged, seen = x.where("toxic = 1").select("doc_id", F.lit("reviewed").alias("stage"),
        F.lit(1).alias("at")), x.where("quality = 0").select("doc_id", F.lit("checked").alias("human"), F.lit(2).alias("at"))
    return T.merged(state, staged.unionByName(seen, allowMissingColumns=True), ["doc_id"], "at")


def _verdicts(spark, d) -> DataFrame:
    """(release, classification, available) from labels: toxic ones are malicious, bad ones suspicious."""
    of = F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "suspicious").otherwise("benign")
    return table(spark, d, "labels").select(F.col("doc_id").alias("release"), of.alias("classification"), F.lit(True).alias("available"))


@query("""WITH v AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'malicious' WHEN quality = 0 THEN 'suspicious' ELSE 'benign' END AS c, doc_id IN (SELECT conv_id FROM conversations) AS up FROM labels)
SELECT doc_id AS release, CASE WHEN up THEN c END AS classification, CASE WHEN NOT up THEN 'review_failed' WHEN c = 'suspicious' THEN 'needs_adjudication' ELSE 'reviewed' END AS stage,
NOT up OR c = 'malicious' AS alert, CASE WHEN NOT up THEN 'suspicious-heuristic' WHEN c = 'malicious' THEN c END AS alert_class FROM v""")
def route_verdicts(spark, d):
    """Labels without a conversation have no verdict."""
    talked = table(spark, d, "conversations").select(F.col("conv_id").alias("release"), F.lit(True).alias("up")).distinct()
    rows = _verdicts(spark, d).join(talked, "release", "left").withColumn("available", F.coalesce("up", F.lit(False))).withColumn("classification",
        F.when(F.col("available"), F.col("classification")))
    return routed(rows).select("release", "classification", "stage", "alert", "alert_class")


@query("SELECT doc_id AS release, 'alerted' AS stage, true AS alert, 'suspicious-heuristic' AS alert_class FROM labels")
def route_without_reviewer(spark, d):
    return routed(_verdicts(spark, d), reviewer=False).select("release", "stage", "alert", "alert_class")


@query("""SELECT a.o_custkey AS package, CAST(a.o_orderkey AS VARCHAR) AS version, (SELECT CAST(b.o_orderkey AS VARCHAR) FROM orders b WHERE b.o_custkey = a.o_custkey
AND CAST(b.o_orderkey AS VARCHAR) < CAST(a.o_orderkey AS VARCHAR) ORDER BY b.o_orderkey DESC LIMIT 1) AS prior FROM orders a""")
def smaller_versions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").cast("string").alias("version"), F.col("o_orderkey").alias("serial"))
    return T.last_smaller_version(o, o.select("package", "version"))


@query("""SELECT doc_id AS release, source, 'needs_adjudication' AS stage, 'suspicious' AS classification FROM documents JOIN labels USING (doc_id)
WHERE toxic <> 1 AND quality = 0 AND source <> 'src1'""")
def pending_queue(spark, d):
    v = routed(_verdicts(spark, d))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("release"), "source")
    labelled = docs.join(v, "release").select("release", "classification", F.when(F.col("source") == "src1", "benign").alias("human_label"))
    return T.pending(docs.join(v.select("release", "stage"), "release"), labelled)


@query("""SELECT doc_id AS release, source, CASE WHEN toxic = 1 THEN 'malicious' WHEN quality = 0 THEN 'suspicious' ELSE 'benign' END AS classification,
CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS rank FROM documents JOIN labels USING (doc_id)""")
def verdict_report(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("release"), "source")
    return T.report(docs, _verdicts(spark, d).drop("available"))


@query("""SELECT doc_id AS release FROM documents d LEFT JOIN labels l USING (doc_id) WHERE n_chars <= 2000 AND lang <> 'en'
AND (toxic = 1 OR quality = 0 OR source = 'src2')""")
def evidence_backlog(spark, d):
    docs = table(spark, d, "documents")
    releases = docs.select(F.col("doc_id").alias("release"), F.when(F.col("n_chars") > 2000, F.col("text")).alias("evidence"),
        F.when(F.col("lang") != "en", 1).otherwise(0).alias("n_rules"))
    alerts = docs.where("source = 'src2'").select(F.col("doc_id").alias("release"), F.lit("suspicious-heuristic").alias("classification"))
    return T.backlog(releases, _verdicts(spark, d), alerts).select("release")


@query("""WITH c AS (SELECT conv_id, max_by(CASE turn % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'suspicious' ELSE 'benign' END, turn) AS label
FROM conversations GROUP BY conv_id)
SELECT doc_id AS release, label AS human_label, label IS NOT NULL AND label <> 'benign' AS alert, label IS NOT NULL AND label = 'malicious' AS urgent
FROM labels LEFT JOIN c ON conv_id = doc_id""")
def adjudication(spark, d):
    label = F.when(F.col("turn") % 3 == 0, "malicious").when(F.col("turn") % 3 == 1, "suspicious").otherwise("benign")
    made = table(spark, d, "conversations").select(F.col("conv_id").alias("release"), label.alias("label"), F.col("text").alias("note"), F.col("turn").alias("at"))
    return T.adjudicated(_verdicts(spark, d), made).select("release", "human_label", "alert", "urgent")
