"""Every triage query against its SQL, rows and values."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sieveline.operators import releases, rules, triage
from sieveline.operators.patterns import java_pattern
import sieveline.plans.files  # noqa: F401  adds its queries
import sieveline.plans.runs  # noqa: F401  adds its queries
import sieveline.plans.sources  # noqa: F401  adds its queries
import sieveline.plans.state  # noqa: F401  adds its queries
from sieveline.plans.triage import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, DATA).toArrow()
    want = con.execute(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    key = lambda t: sorted(zip(*[t.column(c).to_pylist() for c in sorted(t.column_names)], strict=True), key=repr)
    assert key(got) == key(want)
    assert got.num_rows


ONE = {"id": "a", "applies_to": "code", "weight": 1, "match": {"syntax_error": True}}


def nested(depth):
    match = {"syntax_error": True}
    for _ in range(depth):
        match = {"not": match}
    return match


BROKEN = [
    None, [], "x", {}, {"id": "a"}, ONE | {"id": None}, ONE | {"id": ""}, ONE | {"id": ["a"]}, ONE | {"weight": "x"}, ONE | {"weight": True}, ONE | {"weight": "nan"}, ONE | {"weight": [1]},
    ONE | {"applies_to": "galaxy"}, ONE | {"applies_to": ["code"]}, ONE | {"applies_to": None}, ONE | {"match": None}, ONE | {"match": "__import__('os')"}, ONE | {"match": nested(3000)}, ONE | {"match": {"any": [{"syntax_error": True}] * 5000}},
    *[ONE | {"match": m} for m in (
        {"all": []}, {"all": {}}, {"not": []}, {"a": 1, "b": 2}, {"danger": {"x": 1}}, {3: True}, {"syntax_error": 1}, {"blob_present": False}, {"location_at_least": "3"}, {"location_at_least": True}, {"location_at_least": float("nan")},
        {"bound_call": {}}, {"bound_call": {"category": "rootkit"}}, {"bound_call": {"category": []}}, {"bound_call": {"category": [["exec"]]}}, {"bound_call": {"name": 3}}, {"bound_call": {"odd": "x"}}, {"autoexec_call": {"name": "system"}},
        {"autoexec_call": {"category": "exec", "name": "x"}}, {"import_present": "os"}, {"import_present": {"module": ["os"]}}, {"regex": "a"}, {"regex": {"pattern": "("}}, {"regex": {"pattern": "a" * 5000}}, {"regex": {"pattern": 3}},
        {"dep_reason": "typosquat"}, {"binary_reason": "new-binary"}, {"maintainer_changed": True}, {"category": "exec"}, {"reason": "typosquat"},
    )],
    {"id": "x", "applies_to": "binary", "weight": 1, "match": {"binary_reason": "new-binarry"}}, {"id": "x", "applies_to": "binary", "weight": 1, "match": {"binary_reason": ["a"]}}, {"id": "x", "applies_to": "dep", "weight": 1, "match": {"dep_reason": {"k": "v"}}},
    {"id": "x", "applies_to": "dep", "weight": 1, "match": {"dep_reason": "new-binary"}}, {"id": "x", "applies_to": "maintainer", "weight": 1, "match": {"maintainer_changed": False}},
]


@pytest.mark.parametrize("raw", BROKEN)
def test_broken_rules_are_dropped(raw):
    assert rules.valid(raw) is None and rules.load([raw, ONE]) == rules.load([ONE])


def test_first_of_equal_rule_ids_stands():
    assert [r.weight for r in rules.load([ONE, ONE | {"weight": 2}, ONE | {"id": 7, "weight": "3"}])] == [1.0, 3.0]


#: Patterns that Python compiles; some have no equal in Spark's engine, and some mean another thing there unless they are written anew.
PATTERNS = [
    r"(?P<my_x>x)a(?P=my_x)\Z", "[[&&]b", '{"key', "a{x", "a{,2}b", "a(?#c)b", "(?P<é>a)", "\\U0001F600", r"\d{4}", r"^\w+$", r"\bund\b", r"\Bx", r"\s{2}", r"[^\W\d]{3}", r"[\D]z", "(?i)straße", "(?i:AB)c", "(?s)a.b", "a.b", "(?m)^b$", r"(?a)\w\d",
    "(?x) a  b # c", "(?<=a)b", "(?<!a)b", "a(?=b)", "(?:a|b)*c", "(a+)+d", "(x)?(?(1)y|z)", r"(a)(b)\2", "a*?b", "a++b", "(?>a+)b", "", "|", "[]a]", "[^]a]", r"\x41\u00e9", "[a-z&&[aeiou]]", r"\Ax", "x$", "a\tb", r"\N{LATIN SMALL LETTER E WITH ACUTE}", "[\ud800-\udfff]",
]
LINES = ["", "xax", "[b", '{"key', "a{x", "aab", "ab", "a{,2}b", "é", "😀", "1234", "٣٤٥٦", "ab\n", "wörter", "a und b", "undo", "ax", "a  b", "a\u00a0\u2003b", "___", "abc", "12z", "STRASSE", "straße", "ABc", "a\nb", "a\rb", "x\nb\ny", "bb", "aaac", "cababc", "aaaad", "xy", "z", "abb", "A\u00e9", "x", "x\n", "a\tb", "&", "]", "²", "Ⅷ9"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_mean_what_they_mean_in_python(spark, pattern):
    pack = rules.load([{"id": "a", "applies_to": "code", "weight": 1, "match": {"regex": {"pattern": pattern}}}])
    facts = spark.createDataFrame([(i, [None, x]) for i, x in enumerate(LINES)] + [(-1, None), (-2, [])], "k int, added array<string>").withColumn("location_weight", F.lit(1.0)).coalesce(1)
    got = {r["k"] for r in rules.fired(facts, pack, ["k"]).collect()}
    assert got == {i for i, x in enumerate(LINES) if re.search(pattern, x)}


def test_long_lines_and_deep_trees_run(spark):
    pack = rules.load([{"id": str(i), "applies_to": "code", "weight": 1, "match": m} for i, m in enumerate([{"regex": {"pattern": "(?:a|b)*c"}}, {"regex": {"pattern": "(?:ab?)+$"}}, nested(38), {"any": [{"regex": {"pattern": f"q{j}"}} for j in range(300)] + [{"blob_present": True}]}])])
    facts = spark.createDataFrame([(1, ["ab" * 4_000 + "c"], True, False)], "k int, added array<string>, blob boolean, syntax_error boolean").withColumn("location_weight", F.lit(1.0))
    assert len(pack) == 4 and {r["rule"] for r in rules.fired(facts, pack, ["k"]).collect()} == {"0", "3"}


def test_native_patterns_need_no_python():
    assert all(java_pattern(p) for p in (r"curl .*\| ?sh", r"\bexec\(", "[A-Za-z0-9+/=]{128}", r"(?i)password\s*=")) and java_pattern("(?:ab|c)*d") is None


def test_cursor_fails_closed(spark):
    kind = "stream string, serial long, terminal boolean"
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("a", 3, True), (None, 1, False), (None, 2, True), ("b", 5, True), ("c", 1, False), ("d", None, False), ("d", 4, True), ("e", None, True)], kind)
    got = {r["stream"]: r["cursor"] for r in releases.cursor_prefix(rows).collect()}
    assert got == {"a": 1, "b": 5}
    old = spark.createDataFrame([(None, 0), ("c", 9), ("b", 2)], "stream string, cursor long")
    assert {r["stream"]: r["cursor"] for r in releases.cursor_prefix(rows, previous=old).collect()} == {"a": 1, "b": 5, None: 0, "c": 9}


def test_scores_of_null_keys_and_adjudication(spark):
    fired = spark.createDataFrame([(None, 1, "b", "r2", 5.0, "b", 1, 2), (None, 0, "z", "r1", 7.0, "z", 1, 2), (None, 0, "c", "r1", None, "c", 0, 0), ("x", 0, "c", "r1", 50.0, "c", 0, 0)], "k string, place int, item string, rule string, weight double, file string, lo int, hi int")
    got = {r["k"]: r for r in triage.release_scores(fired.select("k").unionByName(fired.selectExpr("'none' AS k")), fired, ["k"]).collect()}
    assert (got[None]["score"], [x["file"] for x in got[None]["fired"]]) == (12.0, ["c", "z", "b"]) and got["x"]["escalate"] and got["none"]["fired"] == []
    verdicts = spark.createDataFrame([(i,) for i in range(5)], "release int")
    made = spark.createDataFrame([(0, "benign", "", 1), (1, "suspicious", "", 1), (2, "malicious", "", 1), (3, "odd", "", 1), (3, "benign", "", 2)], "release int, label string, note string, at int")
    assert [(r["alert"], r["urgent"]) for r in triage.adjudicated(verdicts, made).orderBy("release").collect()] == [(False, False), (True, False), (True, True), (False, False), (False, False)]


def test_owners_and_screened_names(spark):
    kind = "a array<string>, b array<string>"
    rows = spark.createDataFrame([(["Al", ""], ["al", None]), (["al"], ["bo"]), ([""], ["bo"]), (None, ["bo"]), (["al"], [])], kind)
    assert [r[0] for r in rows.select(triage.owners_changed(F.col("a"), F.col("b"))).collect()] == [False, True, False, False, False]
    added = spark.createDataFrame([("1", "Requests"), ("1", "reqursts"), ("1", ""), ("1", None), ("1", "no_such.thing")], "release string, name string")
    corpus, index = spark.createDataFrame([("requests",)], "name string"), spark.createDataFrame([], "name string, earliest timestamp")
    assert sorted((r["name"], r["reason"]) for r in triage.screen(added, corpus, index, F.current_timestamp()).collect()) == [("no-such-thing", "nonexistent"), ("reqursts", "typosquat")]
