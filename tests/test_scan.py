"""Whole runs from new releases to alerts, evidence and state."""

import io
import tarfile

from pyspark.sql import functions as F

from sieveline.operators import review, triage
from sieveline.operators.scan import KEY, Tables, heuristic_alerts, scan
from sieveline.sources.archives import extract
from sieveline.sources.tables import kept
from sieveline.streaming import state, tick


def sdist(**files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, content in files.items():
            info = tarfile.TarInfo(f"p/{name}")
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


SAFE = sdist(**{"setup.py": b"from setuptools import setup\nsetup()\n", "m.py": b"V = 1\n"})
BAD = sdist(**{"setup.py": b"from setuptools import setup\nimport os, base64\nexec(base64.b64decode('aWQ='))\nos.system('id')\nsetup()\n",
    "m.py": b"V = 2\n", "x.so": b"\x7f"})
VERSIONS = [
    ("victim", "1.0", "2026-01-01", SAFE), ("victim", "1.1", "2026-02-01", BAD), ("safe", "1.0", "2026-01-01", SAFE),
        ("bomb", "1.0", "2026-01-01", b"junk"), ("bomb", "1.1", "2026-01-02", SAFE), ("bad-name", "1", "2026-01-01", BAD),
    ("first", "1", "2026-01-01", sdist(**{"m.py": b"import os\nos.system('x')\nexec('x')\n", "pkg/__init__.py": b"import os\nos.system('x')\n"})),
        ("moved", "1", "2026-01-01", SAFE), ("moved", "2", "2026-01-09", sdist(**{"m.py": b"V = 3\n"})),
]
RELEASES = [(p, v, i + 10) for i, (p, v, _, _) in enumerate(VERSIONS)] + [("wheel", "1", 50), ("gone", "1", 51)]


def tables(spark):
    index = spark.createDataFrame([(p, v, t, f"u/{p}/{v}", False, True) for p, v, t, _ in VERSIONS] + [("wheel", "1", None, None, None, False)],
        "package string, version string, ts string, url string, yanked boolean, has_sdist boolean").withColumn("ts", F.to_timestamp("ts"))
    blobs = spark.createDataFrame([(p, v, b) for p, v, _, b in VERSIONS], "package string, version string, content binary")
    requires = spark.createDataFrame([("victim", "1.0", "requests"), ("victim", "1.1", "requests"), ("victim", "1.1", "reqursts"),
        ("victim", "1.1", "numpy"), ("first", "1", "reqursts")], "package string, version string, name string")
    owners = spark.createDataFrame([("moved", "1", ["al"]), ("moved", "2", ["Al", "mallory"]), ("victim", "1.0", ["v"]), ("victim", "1.1", ["V"])],
        "package string, version string, owners array<string>")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    return Tables(index, kept(extract(blobs, KEY)), requires, owners, owners.limit(0), names("Bad_Name"), names("requests", "numpy"),
        spark.createDataFrame([], "name string, earliest timestamp"))


def test_a_run_scores_every_release(spark):
    releases = spark.createDataFrame(RELEASES, "package string, version string, serial bigint")
    out = scan(releases, tables(spark), F.lit("2026-06-01").cast("timestamp"))
    got = {(r["package"], r["version"]): r for r in out.releases.collect()}
    assert len(got) == len(RELEASES)
    assert {k: r["stage"] for k, r in got.items()} == {
        ("victim", "1.0"): "triaged", ("victim", "1.1"): "escalated", ("safe", "1.0"): "triaged", ("bomb", "1.0"): "refused_to_extract",
            ("bomb", "1.1"): "refused_to_extract", ("bad-name", "1"): "refused_to_fetch",
        ("first", "1"): "escalated", ("moved", "1"): "triaged", ("moved", "2"): "triaged", ("wheel", "1"): "no_sdist", ("gone", "1"): "fetch_failed",
    }
    victim, first, moved = got["victim", "1.1"], got["first", "1"], got["moved", "2"]
    assert [x["rule"] for x in victim["fired"]] == ["binary-new-binary", "combo-decode-exec", "dep-typosquat", "primitives", "autoexec-location"]
    assert (victim["prior"], victim["score"], victim["is_new"]) == ("1.0", 10 + 45 + 40 + 15 + 45, False)
    assert "+ os.system('id')" in victim["evidence"] and "V = 2" not in victim["evidence"] and got["safe", "1.0"]["evidence"] == ""
    assert {x["file"] for x in first["fired"]} == {"pkg/__init__.py"} and first["is_new"]  # surface only, no screening of first releases
    assert [x["rule"] for x in moved["fired"]] == ["maintainer-set-change"]
    alerts = {(r["package"], r["version"]): triage.decoded(F.lit(r["fired"])) is not None for r in heuristic_alerts(out.releases).collect()}
    assert set(alerts) == {("victim", "1.1"), ("first", "1"), ("bomb", "1.0"), ("bomb", "1.1")}
    inputs = review.review_inputs(out.releases.where("stage = 'escalated'").withColumn("is_first", F.col("is_new")), out.changed, out.fired, KEY)
    texts = {(r["package"], r["version"]): r["input"] for r in inputs.collect()}
    assert "setup.py:2-4" in texts["victim", "1.1"] and "FIRST RELEASE" in texts["first", "1"] and len(texts) == 2


def test_ticks_alert_once(spark, tmp_path):
    root, t = str(tmp_path / "state"), tables(spark)

    def process(todo):
        releases = todo.select(F.col("name").alias("package"), "version", "serial")
        return scan(releases, t, F.lit("2026-06-01").cast("timestamp")).releases.select(F.col("package").alias("name"), "version",
            F.when(F.col("stage") == "escalated", "alerted").otherwise(F.col("stage")).alias("stage"), "score")

    releases = spark.createDataFrame([r for r in RELEASES if r[0] in ("victim", "safe", "gone")], "name string, version string, serial bigint")
    for batch in ("0", "1"):
        tick.advance(spark, root, releases, process, batch)
        held = {(r["name"], r["version"]): r["stage"] for r in state.read(spark, root, "releases").collect()}
        assert held == {("victim", "1.0"): "triaged", ("victim", "1.1"): "alerted", ("safe", "1.0"): "triaged", ("gone", "1"): "fetch_failed"}
        assert tick.cursor(spark, root) == 50 and tick.waiting(spark, root).first()["attempts"] == int(batch) + 1


def test_alerts_that_cannot_be_sent(spark, tmp_path):
    def send(text):
        if text == "bad":
            raise OSError

    alerts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good")], "k int, text string")
    assert {r["k"]: r["delivery_status"] for r in triage.delivered(alerts, ["k"], send).collect()} == {1: "sent", 2: "failed", 3: "sent"}


def test_smaller_versions_by_serial(spark):
    held = spark.createDataFrame([("p", "1.0", 5), ("p", "1.1", 3), ("p", "2.0", 9), ("q", "1.0", 1)], "package string, version string, serial bigint")
    wanted = spark.createDataFrame([("p", "1.5"), ("p", "1.0"), ("r", "1")], "package string, version string")
    assert {(r["package"], r["version"]): r["prior"] for r in triage.last_smaller_version(held, wanted).collect()} == {("p", "1.5"): "1.0",
        ("p", "1.0"): None, ("r", "1"): None}
