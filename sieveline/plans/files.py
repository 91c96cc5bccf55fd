"""Queries on lines, files and scalars over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.text import blob, humanize_age, percent, requirement_name, url_quote
from sieveline.operators import changes as C
from sieveline.plans.triage import query, table


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9+/=]{128}') OR length(x) > 500 OR (length(x) >= 64 AND round(list_entropy(string_split(x[1:64], '')), 9) > 4.5))) > 0 AS blob FROM documents")
def blob_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", blob(F.split("text", "\n")).alias("blob"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_extract(trim(p_name), '^[A-Za-z0-9][A-Za-z0-9._-]*', 0), '[-_.]+', '-', 'g')) AS name FROM part")
def requirement_parse(spark, d):
    return table(spark, d, "part").select("p_partkey", requirement_name(F.col("p_name")).alias("name"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(round_even(CAST(l_discount AS DOUBLE) * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS pct FROM lineitem")
def confidence_pct(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", percent(F.col("l_discount")).alias("pct"))


@query("WITH s AS (SELECT event_id, event_id * 37 % 400000 AS s FROM events), u AS (SELECT *, CASE WHEN s >= 86400 THEN 86400 WHEN s >= 3600 THEN 3600 ELSE 60 END AS z, CASE WHEN s >= 86400 THEN ' day' WHEN s >= 3600 THEN ' hour' ELSE ' minute' END AS n FROM s) SELECT event_id, CASE WHEN s < 60 THEN 'just now' ELSE CAST(s // z AS VARCHAR) || n || CASE WHEN s // z = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM u")
def humanized_ages(spark, d):
    return table(spark, d, "events").select("event_id", humanize_age(F.col("event_id") * 37 % 400000).alias("age"))


@query("SELECT page_id, url_encode(url) AS url FROM pages")
def url_quotes(spark, d):
    return table(spark, d, "pages").select("page_id", url_quote(F.col("url")).alias("url"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS place FROM lineitem")
def file_weight_rank(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.ranked(rows, ["l_orderkey"], "l_quantity", ["l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, sum(l_quantity + 1) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS used FROM lineitem) WHERE used <= 80")
def evidence_budget(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.budgeted(C.ranked(rows, ["l_orderkey"], "l_quantity", ["l_linenumber"]), ["l_orderkey"], F.col("l_quantity"), 80, 1).select("l_orderkey", "l_linenumber")
