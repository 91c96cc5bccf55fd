"""Archives, hunks, facts, evidence, verdicts and the streaming tick on small fixtures."""

import gzip
import hashlib
import io
import tarfile

from sieveline.functions.code import file_facts, line_hunks
from sieveline.operators import changes as C
from sieveline.sources.archives import Limits, extract


def archive(**files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


GOOD = archive(**{"p-1/setup.py": b"x = 1\n", "p-1/a.so": b"\x7fELF", "p-1/web/i.PHP": b"<?", "p-1/../evil.py": b"no", "/abs.py": b"no", "p-1/README": b"r"})


def test_archives(spark):
    rows = spark.createDataFrame([("good", GOOD), ("junk", b"junk"), ("none", None), ("cut", GOOD[:-40])], "pkg string, content binary")
    got = extract(rows, ["pkg"]).collect()
    assert sorted((r.path, r.kind, r.reason) for r in got if r.pkg == "good") == [("a.so", "binary", "new-binary"), ("setup.py", "source", None),
        ("web/i.PHP", "binary", "foreign-language-source")]
    assert {r.pkg: r.kind for r in got if r.pkg != "good"} == {"junk": "refused", "none": "refused", "cut": "refused"}


def kinds(spark, blob, **limits):
    rows = extract(spark.createDataFrame([("a", blob)], "pkg string, content binary"), ["pkg"], limits=Limits(**limits)).collect()
    return sorted((r.path or "", r.kind, r.reason) for r in rows)


def test_archive_limits(spark):
    """The first breach in the order of the members names the reason."""
    refused = lambda why: [("", "refused", why)]
    assert kinds(spark, GOOD, members=2) == refused("member-count") and kinds(spark, GOOD, total=5) == refused("size") and kinds(spark, GOOD, member=5) == refused("size")
    assert kinds(spark, GOOD, name=5) == refused("name-length") and kinds(spark, GOOD, name=5, members=0) == refused("member-count")
    assert kinds(spark, archive(a=bytes(100_000)), decompressed=50_000) == refused("decompressed-size")
    assert kinds(spark, archive(**{"p/a.py": bytes(20)}), source=10) == [("a.py", "binary", "source-too-large")]
    assert kinds(spark, gzip.compress(b"")) in ([], refused("bad-archive"))


def test_archive_members(spark):
    """Repeated paths, foreign files over the limit, names without a folder, contents and hashes."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, content in [("p/a.py", b"old"), ("p/a.py", b"new"), ("top.py", b"t"), ("p/", None), ("p/x.so", b"\x7f"), ("p/setup.py.PHP", b"<"),
            *[(f"p/{i}.rb", b"r") for i in range(5)], ("p/c.c", b"c")]:
            info = tarfile.TarInfo(name)
            info.type, info.size = (tarfile.DIRTYPE, 0) if content is None else (tarfile.REGTYPE, len(content))
            t.addfile(info, io.BytesIO(content or b""))
    blobs = spark.createDataFrame([("a", out.getvalue(), 1), (None, out.getvalue(), 2), ("a", out.getvalue(), 3)], "pkg string, content binary, item int")
    got = [r for r in extract(blobs, ["pkg"], limits=Limits(foreign=3)).collect() if r.pkg is None]
    assert sorted((r.path, r.reason) for r in got if r.reason) == [("0.rb", "foreign-language-source"), ("1.rb", "foreign-language-source"),
        ("setup.py.PHP", "foreign-language-source"), ("x.so", "new-binary")]
    assert sorted(r.path for r in got if r.reason is None) == ["a.py", "top.py"]
    assert {(r.path, r.content, r.sha256) for r in got} >= {("a.py", b"new", None), ("x.so", None, hashlib.sha256(b"\x7f").hexdigest())}


def test_facts():
    text = b"import os, base64 as b\nfrom subprocess import run\ndef f():\n    exec(b.b64decode('x'))\nrun('ls')\nf()\nlambda: os.getenv('K')\n"
    every = set(range(1, 9))
    assert file_facts("a.py", text, every) == {"syntax_error": False, "modules": ["base64", "os", "subprocess"],
        "categories": ["credential", "decode", "exec", "process"], "names": ["b64decode", "exec", "getenv", "run"],
        "autoexec": ["decode", "exec", "process"]}
    assert file_facts("a.py", text, {5})["categories"] == ["process"]
    assert file_facts("a.py", b"def (", every)["syntax_error"]
    assert file_facts("a.cfg", text, every)["categories"] == [] == file_facts("a.py", None, every)["modules"]
    assert file_facts("a.py", b"from os import system\nfrom . import system\nsystem('x')", every)["categories"] == []
    assert file_facts("a.py", b"import urllib\nurllib.request.urlopen('u')", every)["categories"] == ["network"]


def test_changed_files_and_evidence(spark):
    kind = "v string, path string, content binary"
    new = spark.createDataFrame([("1", "setup.py", b"a\nb\nc\n"), ("1", "n.py", b"import os\nos.system('x')\n"), ("1", "eol.py", b"a\r\n"), ("1", "same.py", b"s")], kind)
    old = spark.createDataFrame([("1", "setup.py", b"a\nc\n"), ("1", "gone.py", b"g\n"), ("1", "eol.py", b"a\n"), ("1", "same.py", b"s")], kind)
    changed = C.changed_files(new, old, ["v"])
    got = {r.path: (r.kind, r.added, r.lines) for r in changed.collect()}
    assert got == {"setup.py": ("modified", ["b"], [2]), "n.py": ("added", ["import os", "os.system('x')"], [1, 2]), "gone.py": ("removed", [], [])}
    facts = {r.path: r for r in C.file_facts(changed, ["v"]).collect()}
    assert facts["n.py"].categories == ["process"] and facts["setup.py"].location_weight == 3.0 and "gone.py" not in facts
    assert line_hunks(None, None) == []


def test_verdicts(spark):
    full = '{"classification": "%s", "confidence": %s, "attack_type": "odd", "reasoning": "r", "cited_hunk": "h", "recommended_action": "odd", "urgent": true}'
    rows = [("m", full % ("malicious", "7")), ("s", full % ("suspicious", '"x"')), ("b", full % ("benign", "0.5")), ("u", full % ("unsure", "1")),
        ("j", "no json"), ("l", "{}"), ("n", None)]
    got = {r.k: r for r in C.routed(C.verdicts(spark.createDataFrame(rows, "k string, reply string"), ["k"])).collect()}
    assert [(got[k].confidence, got[k].attack_type, got[k].recommended_action, got[k].stage, got[k].alert) for k in "msb"] == [(1.0, "none",
        "report-to-pypi", "reviewed", True), (0.0, "none", "monitor", "needs_adjudication", False), (0.5, "none", "monitor", "reviewed", False)]
    assert all(not got[k].available and got[k].stage == "review_failed" and got[k].alert and got[k].confidence is None for k in "ujln")
