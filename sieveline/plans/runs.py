"""Assembly, prior owners, review inputs, evidence and backfill as queries on the driver's tables; each SQL is written apart from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import assembly as A
from sieveline.operators import review as V
from sieveline.operators import triage as T
from sieveline.operators.asof import prior_owners
from sieveline.operators.lookup import dealt, tasks_for
from sieveline.plans.triage import PRIOR, _prior, query, table

INDEX = """SELECT 'c-' || o_custkey AS package, CAST(o_orderkey AS VARCHAR) AS version, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS ts,
'u' || o_orderkey AS url, o_orderstatus = 'P' AS yanked, o_orderpriority <> '3-MEDIUM' AS has FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey > 3"""


def _index(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer").where("c_nationkey > 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    low = F.col("o_orderpriority") == "5-LOW"
    return o.select(F.concat(F.lit("c-"), "o_custkey").alias("package"), F.col("o_orderkey").cast("string").alias("version"),
        F.when(~low, F.col("o_orderdate")).alias("ts"), F.concat(F.lit("u"), "o_orderkey").alias("url"),
        (F.col("o_orderstatus") == "P").alias("yanked"), (F.col("o_orderpriority") != "3-MEDIUM").alias("has_sdist"))


def _assembled(spark, d, policy: str) -> DataFrame:
    releases = table(spark, d, "orders").select(F.concat(F.lit("c-"), "o_custkey").alias("package"),
        F.col("o_orderkey").cast("string").alias("version"), F.col("o_orderkey").alias("serial"))
    listed = table(spark, d, "customer").where("c_acctbal < -500").select(F.concat(F.lit(" C__"), "c_custkey").alias("name"))
    return A.assembled(releases, _index(spark, d), listed, policy)


@query(f"""WITH i AS ({INDEX}), r AS (SELECT 'c-' || o_custkey AS package, CAST(o_orderkey AS VARCHAR) AS version, o_orderkey AS serial, c_acctbal < -500 AS bad
FROM orders JOIN customer ON c_custkey = o_custkey), j AS (SELECT r.*, i.ts, i.url, coalesce(i.has, false) AS has, package IN (SELECT package FROM i) AS known FROM r LEFT JOIN i USING (package, version)),
p AS (SELECT *, (SELECT {{'version': b.version, 'url': b.url}} FROM i b WHERE b.package = j.package AND b.version <> j.version AND b.has AND NOT b.yanked AND b.ts IS NOT NULL
AND (j.ts IS NULL OR NOT j.has OR b.ts < j.ts) ORDER BY b.ts DESC, b.version LIMIT 1) AS prior FROM j),
o AS (SELECT *, CASE WHEN bad THEN 'refused_to_fetch' WHEN NOT known THEN 'fetch_failed' WHEN NOT has THEN 'no_sdist' WHEN prior IS NULL THEN 'new_package_skipped' END AS outcome FROM p)
SELECT package, version, serial, outcome, CASE WHEN outcome IS NULL OR outcome = 'new_package_skipped' THEN url END AS url, CASE WHEN outcome IS NULL THEN prior.version END AS prior,
CASE WHEN outcome IS NULL THEN prior.url END AS prior_url, CASE WHEN outcome IS NULL THEN false WHEN outcome = 'new_package_skipped' THEN true END AS is_new FROM o""")
def assembled_releases(spark, d):
    """Every outcome: listed customers, customers that the index lacks, orders without an archive, first orders, and updates."""
    return _assembled(spark, d, "skip")


FILE = "CASE WHEN l_partkey % 3 = 0 THEN 'pkg' || l_partkey || '/__init__.py' ELSE 'pkg' || l_partkey || '/m.py' END"


def _targets(spark, d) -> DataFrame:
    """Orders as releases of their customers, with their priors."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("version"))
    n = tasks_for(o)
    return dealt(o, n, "version").join(dealt(_prior(spark, d), n, "version"), "version").select("package", "version", "prior", F.col("prior").isNull().alias("is_new"), F.lit(None).cast("string").alias("outcome"))


def _lines(spark, d, n: int) -> DataFrame:
    """Line items with their orders' packages, dealt by order to n tasks."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("l_orderkey"))
    return dealt(table(spark, d, "lineitem"), n, "l_orderkey").join(dealt(o, n, "l_orderkey"), "l_orderkey")


def _files(spark, d, n: int) -> DataFrame:
    path = F.concat(F.lit("pkg"), "l_partkey", F.when(F.col("l_partkey") % 3 == 0, "/__init__.py").otherwise("/m.py"))
    return _lines(spark, d, n).groupBy("package", F.col("l_orderkey").alias("version"),
        path.alias("path")).agg(F.max("l_quantity").alias("content"))


@query(f"""WITH p AS ({PRIOR}), f AS (SELECT l_orderkey AS v, {FILE} AS path, max(l_quantity) AS content FROM lineitem GROUP BY ALL),
n AS (SELECT p.version, p.prior, path, content FROM p JOIN f ON v = p.version), o AS (SELECT p.version, path, content FROM p JOIN f ON v = p.prior)
SELECT coalesce(n.version, o.version) AS version, coalesce(n.path, o.path) AS path,
CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS kind, n.content AS new, o.content AS old
FROM n FULL JOIN o ON n.version = o.version AND n.path = o.path WHERE n.content IS DISTINCT FROM o.content
AND (o.path IS NOT NULL OR n.prior IS NOT NULL OR n.path LIKE '%\\_\\_init\\_\\_.py' ESCAPE '\\')""")
def changed_trees(spark, d):
    n = tasks_for(table(spark, d, "lineitem"))
    return A.trees(_targets(spark, d), _files(spark, d, n), tasks=n).select("version", "path", "kind", "new", "old")


@query(f"""WITH p AS (SELECT * FROM ({PRIOR}) WHERE prior IS NOT NULL) SELECT DISTINCT version, l_suppkey AS name FROM p JOIN lineitem ON l_orderkey = version
WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = prior AND x.l_suppkey = lineitem.l_suppkey)""")
def added_requirements(spark, d):
    n = tasks_for(table(spark, d, "lineitem"))
    requires = _lines(spark, d, n).select("package", F.col("l_orderkey").alias("version"), F.col("l_suppkey").alias("name"))
    return A.added_requirements(_targets(spark, d), requires, n).select("version", "name")


@query(f"""WITH w AS (SELECT l_orderkey AS k, string_agg(DISTINCT 'S' || l_suppkey % 5, ',' ORDER BY 'S' || l_suppkey % 5) AS owners FROM lineitem GROUP BY ALL),
b AS (SELECT o_orderkey AS version, prior, w.owners FROM orders JOIN ({PRIOR}) p ON version = o_orderkey LEFT JOIN w ON k = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01'),
s AS (SELECT o_orderkey AS version, w.owners FROM orders JOIN w ON k = o_orderkey WHERE o_orderdate < TIMESTAMP '1995-01-01'),
f AS (SELECT b.version, b.owners, coalesce(s.owners, e.owners) AS prior_owners, s.version IS NOT NULL AS stored FROM b LEFT JOIN s ON s.version = b.prior LEFT JOIN b e ON e.version = b.prior AND e.version < b.version)
SELECT version, prior_owners, coalesce(prior_owners <> owners, false) AS maintainer_changed FROM f""")
def prior_owner_lookup(spark, d):
    """Orders before 1995 are state, later ones a batch in the order of their keys: both supply priors, and a later key doesn't."""
    owners = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("S"),
        (F.col("l_suppkey") % 5).cast("string")))).alias("owners"))
    o = table(spark, d, "orders").join(owners, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("package"),
        F.col("o_orderkey").alias("version"), F.col("o_orderkey").alias("serial"), "owners", "o_orderdate")
    new = F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")
    out = prior_owners(o.where(new).join(_prior(spark, d), "version"), o.where(~new), width=5000)
    return out.select("version", F.array_join("prior_owners", ",").alias("prior_owners"), "maintainer_changed")


REVIEWED = """WITH ch AS (SELECT l_orderkey AS k, 'f' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS path, CASE WHEN count(*) > 1 THEN 'modified' ELSE 'added' END AS kind,
string_agg(DISTINCT '- ' || l_returnflag || l_linestatus, chr(10) ORDER BY '- ' || l_returnflag || l_linestatus) || chr(10) || string_agg('+ line ' || l_linenumber, chr(10) ORDER BY l_linenumber) AS body FROM lineitem GROUP BY ALL),
fi AS (SELECT l_orderkey AS k, 'f' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS path, l_quantity AS w, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS place,
CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_linenumber END AS lo FROM lineitem WHERE l_quantity > 35),
re AS (SELECT o_orderkey AS k, 'p' || o_custkey AS package, CAST(o_orderkey AS VARCHAR) AS version, o_orderstatus = 'O' AS first, coalesce((SELECT sum(w) FROM fi WHERE fi.k = o_orderkey), 0) AS score FROM orders),
we AS (SELECT ch.k, ch.path, '--- file: ' || ch.path || ' (' || kind || ') ---' || chr(10) || body AS text, coalesce((SELECT sum(w) FROM fi WHERE fi.k = ch.k AND fi.path = ch.path), 0) AS w, first FROM ch JOIN re USING (k)),
al AS (SELECT *, count(*) OVER (PARTITION BY k) AS changes, max(w) OVER (PARTITION BY k) AS most FROM we),
ra AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w DESC, path) AS place FROM al WHERE first OR w > 0 OR most = 0 QUALIFY NOT first OR place <= 40)"""


def _reviewed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(releases, changed, fired) of orders: parts are files, lines their lines."""
    rows = table(spark, d, "lineitem")
    path = F.concat(F.lit("f"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    removed = F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus")))
    added = F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("line "), n.cast("string")))
    changed = rows.groupBy(F.col("l_orderkey").alias("k"),
        path.alias("path")).agg(F.when(F.count("*") > 1, "modified").otherwise("added").alias("kind"),
        F.array(F.struct(removed.alias("removed"), added.alias("added"))).alias("hunks"))
    line = F.when(F.col("l_linestatus") == "O", 0).otherwise(F.col("l_linenumber"))
    fired = rows.where("l_quantity > 35").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("place"),
        path.alias("item"), F.lit("rule").alias("rule"), F.col("l_quantity").alias("weight"), path.alias("file"), line.alias("lo"), line.alias("hi"))
    score = fired.groupBy("k").agg(F.sum("weight").alias("score"))
    releases = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("p"), "o_custkey").alias("package"),
        F.col("o_orderkey").cast("string").alias("version"), (F.col("o_orderstatus") == "O").alias("is_first"))
    return releases.join(score, "k", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), changed, fired


NOTE = "chr(10) || '[TRUNCATED: lowest-risk hunks omitted to fit the input cap.]'"


@query(f"""{REVIEWED}, lo AS (SELECT fi.k, fi.path || ':' || fi.lo || '-' || fi.lo AS loc, min({{'w': -fi.w, 'place': fi.place, 'item': fi.path}}) AS m FROM fi SEMI JOIN ra ON ra.k = fi.k AND ra.path = fi.path GROUP BY ALL),
la AS (SELECT k, string_agg(loc, ', ' ORDER BY m, loc) AS locations FROM lo GROUP BY k),
he AS (SELECT k, 'package: ' || package || chr(10) || 'version: ' || version || chr(10) || 'is_first_release: ' || CASE WHEN first THEN 'True (FIRST RELEASE - whole-package scan, no prior baseline)' ELSE 'False' END
|| chr(10) || 'triage_score: ' || CAST(round_even(score, 0) AS BIGINT) || chr(10) || 'flagged_locations: ' || coalesce(locations, '') || chr(10) || 'untrusted_content_marker: ' AS head FROM re LEFT JOIN la USING (k)),
us AS (SELECT ra.*, length(head) + 3 * 48 + 3 + 61 + sum(length(text) + 1) OVER (PARTITION BY ra.k ORDER BY place) AS used FROM ra JOIN he USING (k)),
bo AS (SELECT k, string_agg(text, chr(10) ORDER BY place) FILTER (used <= 520) AS body, count(*) FILTER (used <= 520) AS sent, count(*) AS ranks, max(changes) AS changes FROM us GROUP BY k),
ma AS (SELECT k, '===UNTRUSTED-' || substr(sha256('fixed|0|' || k), 1, 32) || '===' AS m FROM re)
SELECT k, head || m || chr(10) || chr(10) || m || chr(10) || coalesce(body, '') || chr(10) || m || CASE WHEN sent < ranks OR ranks <> changes THEN {NOTE} ELSE '' END AS input
FROM he JOIN ma USING (k) LEFT JOIN bo USING (k)""")
def review_inputs(spark, d):
    return V.review_inputs(*_reviewed(spark, d), ["k"], cap=520, secret="fixed", tasks=tasks_for(table(spark, d, "lineitem")))


@query(f"""{REVIEWED}, co AS (SELECT al.*, row_number() OVER (PARTITION BY al.k ORDER BY w DESC, path) AS place FROM al WHERE EXISTS (SELECT 1 FROM fi WHERE fi.k = al.k AND fi.path = al.path AND fi.lo <> 0)),
he AS (SELECT k, 'package: ' || package || chr(10) || 'version: ' || version || chr(10) || 'triage_score: ' || CAST(round_even(score, 0) AS BIGINT) || chr(10) || chr(10) AS head FROM re),
us AS (SELECT co.*, head, length(head) + 61 + sum(length(text) + 2) OVER (PARTITION BY co.k ORDER BY place) AS used FROM co JOIN he USING (k)),
bo AS (SELECT k, head, string_agg(text, chr(10) || chr(10) ORDER BY place) FILTER (used <= 150) AS body, count(*) FILTER (used <= 150) AS sent, count(*) AS ranks, max(substr(text, 1, greatest(0, 150 - length(head) - 61))) FILTER (place = 1) AS start FROM us GROUP BY k, head)
SELECT re.k, CASE WHEN bo.k IS NULL THEN '' ELSE head || CASE WHEN sent > 0 THEN body ELSE start END || CASE WHEN sent < ranks THEN {NOTE} ELSE '' END END AS evidence FROM re LEFT JOIN bo USING (k)""")
def evidence_texts(spark, d):
    return V.evidence_texts(*_reviewed(spark, d), ["k"], cap=150, tasks=tasks_for(table(spark, d, "lineitem")))


@query("SELECT (SELECT count(*) FROM documents) AS releases_total, count(*) AS verdicts_total, count_if(toxic = 1 OR quality = 0) AS flagged_total FROM labels")
def status_counters(spark, d):
    shown = F.when(F.col("toxic") == 1, "Malicious").when(F.col("quality") == 0, "SUSPICIOUS").when(F.col("quality") == 1, "benign")
    return T.counters(table(spark, d, "documents"), table(spark, d, "labels").select(shown.alias("classification")))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN date_diff('second', ts, TIMESTAMP '2024-02-01') END AS age,
event_type <> 'error' AND date_diff('second', ts, TIMESTAMP '2024-02-01') > 900 AS stale FROM events""")
def poll_ages(spark, d):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("at "), F.col("ts").cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    age, stale = T.poll_age(text, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return table(spark, d, "events").select("event_id", age.alias("age"), stale.alias("stale"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_returnflag || '@' || l_partkey || ':' || l_linenumber || '-' || (l_linenumber + 1) AS t,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, CAST(l_partkey AS VARCHAR)) AS place, l_quantity AS w FROM lineitem)
SELECT k, '[SUSPICIOUS] score=' || CAST(round_even(sum(w) / 4, 0) AS BIGINT) || ' p' || k || ' 1.' || k || ' :: ' || string_agg(t, '; ' ORDER BY place) FILTER (place <= 3)
|| CASE WHEN k % 2 = 0 THEN chr(10) || '  attack=none confidence=' || CASE WHEN k % 4 = 0 THEN '0.50' ELSE '?' END || ' model=m' || chr(10) || '  cited_hunk=a:1' || chr(10) || '  reason: why' ELSE '' END AS text
FROM f GROUP BY k""")
def alert_texts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("place"),
        F.col("l_partkey").cast("string").alias("item"), F.col("l_returnflag").alias("rule"), F.col("l_partkey").cast("string").alias("file"),
        F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + 1).alias("hi"))
    k = F.col("k").cast("string")
    review = {"reasoning": F.when(F.col("k") % 2 == 0, "why"), "confidence": F.when(F.col("k") % 4 == 0, 0.5), "attack_type": F.lit("none"),
        "model": F.lit("m"), "cited_hunk": F.lit("a:1")}
    return T.release_scores(rows, rows, ["k"]).select("k",
        T.alert_text(F.concat(F.lit("p"), k), F.concat(F.lit("1."), k), F.lit("suspicious"), F.col("score") / 4, F.col("fired"), review, 3).alias("text"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_returnflag AS rule, l_quantity AS w, CAST(l_partkey AS VARCHAR) AS file, l_linenumber AS lo FROM lineitem)
SELECT k, '[' || string_agg('{"rule":"' || rule || '","weight":' || w || ',"file":"' || file || '","lines":[' || lo || ',' || lo || ']}', ',' ORDER BY lo, file, rule, w) || ']' AS json,
string_agg(rule || ':' || lo, ' ' ORDER BY lo, file, rule, w) AS again FROM f GROUP BY k""")
def rules_as_json(spark, d):
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), line.alias("place"), F.col("l_partkey").cast("string").alias("item"),
        F.col("l_returnflag").alias("rule"), F.col("l_partkey").cast("string").alias("file"), F.col("l_quantity").alias("weight"), line.alias("lo"),
        line.alias("hi"))
    out = T.release_scores(rows, rows, ["k"]).select("k", T.encoded(F.col("fired")).alias("json"))
    return out.withColumn("again", F.array_join(F.transform(T.decoded(F.col("json")), lambda x: F.concat_ws(":", x.rule, x.lo.cast("string"))), " "))


@query("""SELECT doc_id AS release, CASE WHEN n_chars > 2000 THEN 'stored' WHEN lang = 'en' THEN 'rebuilt' END AS shown, n_chars > 2000 AS evidence_stored,
CASE WHEN n_chars <= 2000 AND lang <> 'en' THEN 'gone' END AS fetch_error FROM documents JOIN labels USING (doc_id) WHERE toxic <> 1 AND quality = 0""")
def pending_evidence(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    releases = docs.select(F.col("doc_id").alias("release"), F.lit("needs_adjudication").alias("stage"), F.when(F.col("n_chars") > 2000, "stored").alias("evidence"))
    open_ = labels.where("toxic <> 1 AND quality = 0").select(F.col("doc_id").alias("release"), F.lit("suspicious").alias("classification"),
        F.lit(None).cast("string").alias("human_label"))
    rebuilt = docs.select(F.col("doc_id").alias("release"), F.when(F.col("lang") == "en", "rebuilt").alias("text"), F.when(F.col("lang") != "en", "gone").alias("error"))
    return V.pending_listing(T.pending(releases, open_), rebuilt, ["release"]).select("release", "shown", "evidence_stored", "fetch_error")


@query(f"""WITH i AS ({INDEX}), b AS (SELECT 'c-' || o_custkey AS package, CAST(o_orderkey AS VARCHAR) AS version, o_orderstatus = 'O' AS was FROM orders WHERE o_totalprice > 200000),
j AS (SELECT b.*, c.c_acctbal < -500 AS bad, i.ts, coalesce(i.has, false) AS has, b.package IN (SELECT package FROM i) AS known FROM b JOIN customer c ON 'c-' || c.c_custkey = b.package LEFT JOIN i ON i.package = b.package AND i.version = b.version),
o AS (SELECT *, CASE WHEN bad THEN 'refused_to_fetch' WHEN NOT known THEN 'fetch_failed' WHEN NOT has THEN 'no sdist' END AS why,
(SELECT x.version FROM i x WHERE x.package = j.package AND x.version <> j.version AND x.has AND NOT x.yanked AND x.ts IS NOT NULL AND (j.ts IS NULL OR x.ts < j.ts) ORDER BY x.ts DESC, x.version LIMIT 1) AS p FROM j),
e AS (SELECT *, CASE WHEN was THEN NULL ELSE p END AS prior FROM o)
SELECT package, version, CASE WHEN why IS NULL THEN prior END AS prior, coalesce(why, CASE WHEN prior IS NULL AND NOT was THEN 'no code payload to render' END) AS error,
why IS NULL AND (prior IS NOT NULL OR was) AS captured FROM e""")
def backfill_status(spark, d):
    """Large orders again: those that were first are scanned without a prior; evidence stands for all but new ones that weren't first."""
    key = ["package", "version"]
    todo = table(spark, d, "orders").where("o_totalprice > 200000").select(F.concat(F.lit("c-"), "o_custkey").alias("package"),
        F.col("o_orderkey").cast("string").alias("version"), (F.col("o_orderstatus") == "O").alias("was_first"))
    again = V.baselines(todo, _assembled(spark, d, "surface"), key)
    evidence = again.select(*key, F.when(F.col("is_new") & ~F.col("was_first"), "").otherwise("text").alias("evidence"))
    out = T.keyed_left(again, V.backfilled(again, evidence, key), key)
    return out.select(*key, "prior", "error", "captured")
