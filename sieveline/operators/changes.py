"""From two trees of files to facts, ranked files, evidence within a budget, and reviewed verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.code import facts, hunks
from sieveline.functions.text import blob, location_weight
from sieveline.operators.triage import HEURISTIC

# The reviewer's contract.
CLASSES = ("malicious", "suspicious", "benign")
ACTIONS = ("report-to-pypi", "monitor", "dismiss")
ATTACKS = ("install-hook-rce", "credential-exfil", "typosquat", "obfuscated-loader", "dropper", "build-backend-rce", "vcs-dep", "none")
VERDICT = "classification string, confidence string, attack_type string, reasoning string, cited_hunk string, recommended_action string, urgent string"


def changed_files(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """(key, path, kind, content, hunks, added, lines) of files (key, path, content) that differ between two trees, as changed_lines gives them."""
    a, b = new.select(*key, "path", F.col("content").alias("new")), old.select(*key, "path", F.col("content").alias("old"))
    both = a.join(b, [*key, "path"], "full_outer").where(~F.col("new").eqNullSafe(F.col("old")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return changed_lines(both.withColumn("kind", kind), key)


def changed_lines(trees: DataFrame, key: list[str]) -> DataFrame:
    """(key, path, kind, content, hunks, added, lines) of differing files (key, path, kind, new, old).

    Files whose lines are all equal have no row; added: the new lines, lines: their 1-based numbers."""
    out = trees.select(*key, "path", "kind", F.col("new").alias("content"), hunks("old", "new").alias("hunks")).where(F.size("hunks") > 0)
    lines = F.flatten(F.transform("hunks",
        lambda h: F.when(h.new_to > h.new_from, F.sequence(h.new_from + 1, F.greatest(h.new_to, h.new_from + 1))).otherwise(F.array().cast("array<int>"))))
    return out.withColumn("added", F.flatten(F.transform("hunks", lambda h: h.added))).withColumn("lines", lines)


def file_facts(changed: DataFrame, key: list[str]) -> DataFrame:
    """Facts that rules read, of changed files with an added line. blob counts in Python files that parse."""
    some = changed.where(F.size("lines") > 0).withColumn("f", facts("path", "content", "lines"))
    python = F.col("path").rlike(r"\.(py|pyx|pyi)$") & ~F.col("f.syntax_error")
    return some.select(*key, "path", location_weight(F.col("path")).alias("location_weight"), "added", "f.*",
        (python & blob(F.col("added"))).alias("blob"), F.element_at("lines", 1).alias("first_line"), F.element_at("lines", -1).alias("last_line"))


def ranked(files: DataFrame, key: list[str], weight: str, tie: list[str]) -> DataFrame:
    """files plus place: 1 for the heaviest of its key, ties by `tie`."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(weight), *tie)))


def budgeted(files: DataFrame, key: list[str], length: Column, budget: int, extra: int = 0) -> DataFrame:
    """The first files of each key, by place, as long as their lengths (and `extra` for each) sum to the budget at most."""
    total = F.sum(length + extra).over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("used", total).where(F.col("used") <= budget)


def render(path: Column, hunks_: Column, kind: Column) -> Column:
    """A file's header with its kind of change, and its removed and added lines."""
    side = lambda lines, mark: F.transform(lines, lambda x: F.concat(F.lit(mark), x))
    body = F.flatten(F.transform(hunks_, lambda h: F.concat(side(h.removed, "- "), side(h.added, "+ "))))
    head = F.concat(F.lit("--- file: "), path, F.lit(" ("), kind, F.lit(") ---"))
    return F.array_join(F.concat(F.array(head), body), "\n")


def verdicts(replies: DataFrame, key: list[str], reply: str = "reply") -> DataFrame:
    """(key, available, classification, confidence, attack_type, reasoning, cited_hunk, recommended_action, urgent) of JSON replies.

    A reply that is no object, lacks a field or has an unknown classification is unavailable, with null fields. Unknown attack
    types become none, unknown actions follow the classification, and confidence is clamped to 0..1 (0 if unreadable)."""
    v = replies.select(*key, F.from_json(reply, VERDICT).alias("v"), F.json_object_keys(reply).alias("names"))
    needed = [x.split()[0] for x in VERDICT.split(", ")]
    ok = F.coalesce(F.size(F.array_intersect("names", F.array(*map(F.lit, needed)))) == len(needed),
        F.lit(False)) & F.coalesce(F.col("v.classification").isin(*CLASSES), F.lit(False))
    of = lambda c: F.when(F.col("available"), c)
    number = F.expr("try_cast(v.confidence AS double)")
    confidence = F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))
    action = F.when(F.col("v.recommended_action").isin(*ACTIONS), F.col("v.recommended_action")).when(F.col("v.classification") == "malicious",
        ACTIONS[0]).otherwise(ACTIONS[1])
    attack = F.when(F.col("v.attack_type").isin(*ATTACKS), F.col("v.attack_type")).otherwise("none")
    cols = {"classification": F.col("v.classification"), "confidence": confidence, "attack_type": attack, "reasoning": F.col("v.reasoning"),
        "cited_hunk": F.col("v.cited_hunk"), "recommended_action": action, "urgent": F.coalesce(F.expr("try_cast(v.urgent AS boolean)"), F.lit(False))}
    return v.withColumn("available", ok).select(*key, "available", *[of(c).alias(n) for n, c in cols.items()])


def routed(rows: DataFrame, reviewer: bool = True) -> DataFrame:
    """rows (available, classification) plus stage, alert and alert_class: benign is reviewed, suspicious waits for a person, malicious
    alerts and is reviewed; without a verdict the heuristic alerts and the review counts as failed, to be tried again. With the reviewer off
    every row alerts by the heuristic and is done."""
    if not reviewer:
        return rows.withColumn("stage", F.lit("alerted")).withColumn("alert", F.lit(True)).withColumn("alert_class", F.lit(HEURISTIC))
    c, up = F.col("classification"), F.coalesce("available", F.lit(False))
    stage = F.when(~up, "review_failed").when(c == "suspicious", "needs_adjudication").otherwise("reviewed")
    alert = ~up | F.coalesce(c == "malicious", F.lit(False))
    return rows.withColumn("stage", stage).withColumn("alert", alert).withColumn("alert_class", F.when(~up, HEURISTIC).when(alert, c))
