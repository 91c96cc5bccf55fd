"""The standard rules on facts of files, findings, dependencies and owners."""

from sieveline.operators import changes as C
from sieveline.operators import triage as T
from sieveline.operators.rules import fired, fired_rules
from sieveline.operators.shipped import RAW, RULES, STANDARD

CODE = {
    "combo-fetch-exec": ("a.py", b"import requests\nexec(requests.get('u').text)\n"),
    "combo-decode-exec": ("b.py", b"import base64\nexec(base64.b64decode('x'))\n"),
    "combo-cred-network": ("c.py", b"import os, requests\nrequests.post('u', os.getenv('T'))\n"),
    "syntax-error-suspicious": ("d.py", b"def (\n"),
    "primitives": ("e.py", b"x = '" + b"QUJD" * 50 + b"'\n"),
    "autoexec-location": ("setup.py", b"import os\nos.system('id')\n"),
}


def code_facts(spark, files):
    new = spark.createDataFrame([(k, p, c) for k, (p, c) in files.items()], "v string, path string, content binary")
    return C.file_facts(C.changed_files(new, new.limit(0), ["v"]), ["v"])


def test_each_standard_rule_fires(spark):
    assert len(RAW) == len(RULES) == 13 and {k: len(v) for k, v in STANDARD.items()} == {"code": 6, "binary": 3, "dep": 3, "maintainer": 1}
    binary = spark.createDataFrame([("n", "x.so", "new-binary"), ("n", "y.py", "source-too-large"), ("n", "z.php", "foreign-language-source"), ("n", "q", None)], "v string, path string, reason string")
    dep = spark.createDataFrame([("n", "reqursts", "typosquat"), ("n", "nope", "nonexistent"), ("n", "new", "brand-new"), ("n", "many", "not-screened-cap")], "v string, name string, reason string")
    owner = spark.createDataFrame([("n", True), ("m", False)], "v string, maintainer_changed boolean")
    got = fired_rules(RULES, ["v"], code_facts(spark, CODE), binary, dep, owner)
    rows = got.collect()
    assert {r["rule"] for r in rows} == {r.id for r in RULES}
    assert all(any(r["v"] == k and r["rule"] == k for r in rows) for k in CODE)
    scored = {r["v"]: r for r in T.release_scores(got, got, ["v"]).collect()}
    assert [x["rule"] for x in scored["n"]["fired"]] == ["binary-source-too-large", "foreign-language-source", "binary-new-binary", "dep-typosquat", "dep-nonexistent", "dep-brand-new", "maintainer-set-change"]
    assert (scored["n"]["score"], scored["autoexec-location"]["score"], scored["syntax-error-suspicious"]["score"]) == (175.0, 60.0, 20.0)
    assert {(x["file"], x["lo"], x["hi"]) for x in scored["n"]["fired"] if x["rule"].startswith("maint")} == {("<ownership>", 0, 0)}
    assert [(x["lo"], x["hi"]) for x in scored["combo-decode-exec"]["fired"]] == [(1, 2), (1, 2)]


def test_standard_rules(spark):
    files = {"1": ("setup.py", b"import base64\nexec(base64.b64decode('x'))\n"), "2": ("tests/t.py", b"def (\n"), "3": ("m.py", b"x = 1\n")}
    got = sorted((r.v, r.rule, r.weight) for r in fired(code_facts(spark, files), STANDARD["code"], ["v"]).collect())
    assert got == [("1", "autoexec-location", 45.0), ("1", "combo-decode-exec", 45.0), ("1", "primitives", 15.0), ("2", "syntax-error-suspicious", 4.0)]
    found = spark.createDataFrame([("1", "new-binary"), ("2", None)], "v string, reason string")
    one = [STANDARD["binary"], STANDARD["dep"]]
    assert [[(r.v, r.rule, r.weight) for r in fired(found.selectExpr("*", "1D AS location_weight"), x, ["v"]).collect()] for x in one] == [[("1", "binary-new-binary", 10.0)], []]
