"""From fired rules, dependencies, owners and verdicts to scored releases, queues and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import normalize_name
from sieveline.operators.lookup import keyed_left
from sieveline.operators.releases import typosquats

THRESHOLD, LOOKUPS, BRAND_NEW_DAYS, TOP_FILES, TOP_RULES = 40.0, 10, 30, 40, 5
# Outcomes of a fetch that gave no files, and the stages in which a release is done.
OUTCOMES = ("refused_to_fetch", "refused_to_extract", "fetch_failed", "no_sdist", "new_package_skipped")
TERMINAL = ("triaged", "alerted", "reviewed", "new_package_skipped", "needs_adjudication", "refused_to_extract", "no_sdist", "refused_to_fetch")
SEVERITY = ("malicious", "suspicious")
HEURISTIC = "suspicious-heuristic"
FIRED = "array<struct<place:int,item:string,rule:string,file:string,weight:double,lo:int,hi:int>>"


def open_releases(releases: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """The releases that state (key, stage) doesn't hold as done; null keys are open."""
    done = state.where(F.col("stage").isin(*TERMINAL)).select(*key).distinct()
    return releases.join(done, key, "left_anti")


def release_scores(releases: DataFrame, fired: DataFrame, key: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, n_rules, fired, escalate) for every release; fired: its rules (FIRED) in the order of the ruleset, then of its files.

    A release without a fired rule has score 0 and an empty list. Null weights count as 0, null keys are keys. `fired` is as fired_rules gives it."""
    one = F.struct("place", "item", "rule", "file", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"), "lo", "hi")
    per = fired.groupBy(*key).agg(F.array_sort(F.collect_list(one)).cast(FIRED).alias("fired"), F.sum("weight").cast("double").alias("score"))
    out = keyed_left(releases.select(*key).distinct(), per, key).select(*key, F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("fired", F.array().cast(FIRED)).alias("fired"))
    return out.select(*key, "score", F.size("fired").cast("long").alias("n_rules"), "fired", (F.col("score") >= threshold).alias("escalate"))


def top_rules(scored: DataFrame, n: int = TOP_RULES) -> DataFrame:
    """scored with `top`: its n heaviest fired rules as text, heaviest first, ties in the order of `fired`."""
    heavy = F.transform("fired", lambda x, i: F.struct((-x.weight).alias("w"), i.alias("i"), F.concat_ws("@", x.rule, x.file).alias("t")))
    return scored.withColumn("top", F.array_join(F.transform(F.slice(F.array_sort(heavy), 1, n), lambda x: x.t), "; "))


def file_weights(fired: DataFrame, key: list[str], top: int = TOP_FILES) -> DataFrame:
    """(key, file, weight, locations, place) of the `top` heaviest files of each key; locations: distinct (rule, lo, hi); ties by name."""
    per = fired.groupBy(*key, "file").agg(F.sum("weight").alias("weight"), F.countDistinct("rule", "lo", "hi").alias("locations"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("weight"), "file"))
    return per.withColumn("place", place).where(F.col("place") <= top)


def screen(added: DataFrame, corpus: DataFrame, index: DataFrame, now: Column, cap: int = LOOKUPS, days: int = BRAND_NEW_DAYS) -> DataFrame:
    """(release, name, reason, target) of the added dependencies (release, name) that look wrong.

    In this order: names of the corpus are fine, names near one are typosquats; of the rest the first `cap` of a release, by name, are
    looked up in index (name, earliest) and the others reported as not screened; unknown names are nonexistent, names first seen less
    than `days` whole days before `now` are brand-new. A known name without a date is fine, and so is one whose lookup failed, which stands in the index without a date. Names are compared as normalize_name gives
    them; null and empty ones have no row."""
    known = corpus.select(normalize_name(F.col("name")).alias("name")).where("name <> ''").distinct()
    named = added.select("release", normalize_name(F.col("name")).alias("name")).where("name <> ''").distinct()
    rest = named.join(known, "name", "left_anti")
    near = typosquats(rest.select("name"), known).select("name", "target")
    rest = rest.join(near, "name", "left")
    open_ = rest.where("target IS NULL")
    place = F.row_number().over(Window.partitionBy("release").orderBy("name"))
    first = index.groupBy(normalize_name(F.col("name")).alias("name")).agg(F.min("earliest").alias("earliest"), F.lit(True).alias("exists"))
    looked = open_.withColumn("place", place).join(first, "name", "left")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("earliest")) / 86400)
    reason = F.when(F.col("place") > cap, "not-screened-cap").when(F.col("exists").isNull(), "nonexistent").when(age < days, "brand-new")
    found = looked.select("release", "name", reason.alias("reason"), F.lit(None).cast("string").alias("target")).where("reason IS NOT NULL")
    return found.unionByName(rest.where("target IS NOT NULL").select("release", "name", F.lit("typosquat").alias("reason"), "target"))


def owners_changed(current: Column, prior: Column) -> Column:
    """Whether two arrays of owners differ as sets without regard to case; null and empty names don't count; false if either has no name."""
    fold = lambda a: F.array_sort(F.array_distinct(F.transform(F.filter(a, lambda x: x != ""), lambda x: F.lower(x))))
    return F.coalesce((F.size(fold(current)) > 0) & (F.size(fold(prior)) > 0) & (fold(current) != fold(prior)), F.lit(False))


def denied(names: DataFrame, denylist: DataFrame) -> DataFrame:
    """names plus `denied`: whether the normalised name is on the denylist (name), in any spelling; false for null and empty names."""
    listed = denylist.select(normalize_name(F.trim("name")).alias("n")).distinct().withColumn("hit", F.lit(True))
    rows = names.withColumn("n", normalize_name(F.trim(F.coalesce("name", F.lit("")))))
    return rows.join(listed, "n", "left").withColumn("denied", F.coalesce("hit", F.lit(False)) & (F.col("n") != "")).drop("n", "hit")


def stages(rows: DataFrame, policy: str = "scan", threshold: float = THRESHOLD) -> DataFrame:
    """rows (outcome, is_new, score) plus stage, terminal and heuristic: where a fetched release ends.

    outcome: null if the fetch gave files, else one of OUTCOMES; an unknown one counts as fetch_failed, which alone is open, so that
    the cursor stays before it. A refused archive alerts by the heuristic. Under the policy `skip` new packages end unseen."""
    outcome = F.when(F.col("outcome").isin(*OUTCOMES) | F.col("outcome").isNull(), F.col("outcome")).otherwise("fetch_failed")
    skipped = F.col("is_new") & F.lit(policy == "skip")
    stage = F.when(outcome.isNotNull(), outcome).when(skipped, "new_package_skipped").when(F.col("score") >= threshold, "escalated").otherwise("triaged")
    return rows.withColumn("stage", stage).withColumn("terminal", F.col("stage") != "fetch_failed").withColumn("heuristic", F.col("stage") == "refused_to_extract")


def new_alerts(rows: DataFrame, sent: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row, by order, of each key (package, version, classification) that `sent` lacks: insert if absent."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    first = rows.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("m"))
    return first.join(sent.select(*key).distinct(), key, "left_anti").select(*key, *[F.col("m")[c].alias(c) for c in (order, *rest)])


def merged(state: DataFrame, updates: DataFrame, key: list[str], order: str) -> DataFrame:
    """state after partial updates: each column has its last value that isn't null, by order; columns are those of state.

    Ties of order go to the greater value. So a later stage keeps an earlier score, and a new verdict what a person added."""
    rows = state.unionByName(updates, allowMissingColumns=True).select(*state.columns)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c)
    return rows.groupBy(*key).agg(*[last(c) for c in state.columns if c not in (*key, order)], F.max(order).alias(order)).select(*state.columns)


def pending(releases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Releases (release, stage, ...) that wait for a person, with their verdict (release, classification, human_label, ...)."""
    open_ = verdicts.where("human_label IS NULL").drop("human_label")
    return releases.where("stage = 'needs_adjudication'").join(open_, "release")


def report(releases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All verdicts with their release and `rank` (malicious, suspicious, all others), worst first, later releases first."""
    c = F.col("classification")
    rank = F.when(c == SEVERITY[0], 0).when(c == SEVERITY[1], 1).otherwise(2)
    return releases.join(verdicts, "release").withColumn("rank", rank).orderBy("rank", F.desc("release"))


def backlog(releases: DataFrame, verdicts: DataFrame, alerts: DataFrame, wide: bool = False) -> DataFrame:
    """Releases (release, evidence, n_rules) with a fired rule and no stored evidence; unless wide, only those with a bad verdict or an alert that isn't benign."""
    rows = releases.where("evidence IS NULL AND n_rules > 0")
    if wide:
        return rows
    bad = verdicts.where(F.col("classification").isin(*SEVERITY)).select("release")
    told = alerts.where("classification IS NOT NULL AND classification <> 'benign'").select("release")
    return rows.join(bad.unionByName(told).distinct(), "release", "left_semi")


def adjudicated(verdicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """verdicts (release, ...) with human_label and human_note of the last decision (release, label, note, at), `alert` (any label but benign)
    and `urgent` (malicious).

    Verdicts without a decision have nulls and no alert; decisions on unknown releases have no row."""
    last = decisions.groupBy("release").agg(F.max(F.struct("at", "label", "note")).alias("m"))
    out = verdicts.drop("human_label", "human_note").join(last, "release", "left")
    label = F.col("m.label")
    out = out.withColumn("human_label", label).withColumn("human_note", F.col("m.note")).withColumn("alert", F.coalesce(label != "benign", F.lit(False)))
    return out.withColumn("urgent", F.coalesce(label == "malicious", F.lit(False))).drop("m")


def alert_text(package: Column, version: Column, classification: Column, score: Column, fired: Column, review: dict[str, Column] | None = None,
    n: int = TOP_RULES) -> Column:
    """An alert's text: what, the score as a whole number (half to even), the n heaviest rules; with a reviewer's reasoning its attack, confidence, model, hunk and reason."""
    heavy = F.slice(F.array_sort(F.transform(fired, lambda x,
        i: F.struct((-x.weight).alias("w"), i.alias("i"), F.format_string("%s@%s:%d-%d", x.rule, x.file, x.lo, x.hi).alias("t")))), 1, n)
    head = F.concat(F.lit("["), F.upper(classification), F.lit("] score="), F.bround(score).cast("bigint").cast("string"), F.lit(" "), package,
        F.lit(" "), version, F.lit(" :: "), F.array_join(F.transform(heavy, lambda x: x.t), "; "))
    if review is None:
        return head
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    confidence = F.coalesce(F.format_string("%.2f", review["confidence"].cast("double")), F.lit("?")) if "confidence" in review else F.lit("?")
    confidence = F.when(review["confidence"].isNull(), "?").otherwise(confidence) if "confidence" in review else confidence
    block = F.concat(F.lit("\n  attack="), text(review["attack_type"]), F.lit(" confidence="), confidence, F.lit(" model="), text(review["model"]),
        F.lit("\n  cited_hunk="), text(review["cited_hunk"]), F.lit("\n  reason: "), review["reasoning"])
    return F.concat(head, F.when(review["reasoning"].isNotNull(), block).otherwise(""))


def counters(releases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: releases_total, verdicts_total and flagged_total, the verdicts of SEVERITY in any case."""
    flagged = F.coalesce(F.lower("classification").isin(*SEVERITY), F.lit(False)).cast("long")
    each = releases.select(F.lit(1).alias("r"), F.lit(0).alias("v"),
        F.lit(0).cast("long").alias("f")).unionByName(verdicts.select(F.lit(0).alias("r"), F.lit(1).alias("v"), flagged.alias("f")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(total("r").alias("releases_total"), total("v").alias("verdicts_total"), total("f").alias("flagged_total"))


def poll_age(updated_at: Column, now: Column, limit: int = 900) -> tuple[Column, Column]:
    """(seconds since an ISO time, whether they exceed the limit); null and false for what is no time."""
    at = F.try_to_timestamp(updated_at)
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return age, F.coalesce(age > limit, F.lit(False))


def encoded(fired: Column) -> Column:
    """A list of fired rules as the JSON text that state keeps: rule, weight, file and lines."""
    return F.to_json(F.transform(fired, lambda x: F.struct(x.rule.alias("rule"), x.weight.alias("weight"), x.file.alias("file"), F.array(x.lo, x.hi).alias("lines"))))


def decoded(text: Column) -> Column:
    """encoded() read back (FIRED); an empty list for null, empty or unreadable text."""
    rows = F.from_json(text, "array<struct<rule:string,weight:double,file:string,lines:array<int>>>")
    out = F.transform(rows, lambda x, i: F.struct(i.alias("place"), F.lit("").alias("item"), x.rule.alias("rule"), x.file.alias("file"),
        x.weight.alias("weight"), F.get(x.lines, 0).alias("lo"), F.get(x.lines, 1).alias("hi")))
    return F.coalesce(out.cast(FIRED), F.array().cast(FIRED))


def last_smaller_version(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (package, version) plus prior: of the package's stored versions (package, version, serial) that are smaller as texts, the one of the greatest serial."""
    held = stored.select(F.col("package").alias("p"), F.col("version").alias("v"), "serial")
    pairs = wanted.select("package", "version").distinct().join(held, (F.col("package") == F.col("p")) & (F.col("v") < F.col("version")))
    return keyed_left(wanted, pairs.groupBy("package", "version").agg(F.max_by("v", F.struct("serial", "v")).alias("prior")), ["package", "version"])


def delivered(alerts: DataFrame, key: list[str], send) -> DataFrame:
    """(key, delivery_status) of alerts (key, text): `sent`, or `failed` where send(text) raises; an alert that fails is on record all the same.

    Give it the alerts that new_alerts has found, after they are stored: an alert is sent at least once, and a task that is repeated may send it again."""

    def run(batches):
        for rows in batches:
            status = []
            for text in rows["text"]:
                try:
                    send(text)
                    status.append("sent")
                except Exception:  # whatever the receiver's client raises
                    status.append("failed")
            yield rows[key].assign(delivery_status=status)

    kinds = ", ".join(f"`{k}` {alerts.schema[k].dataType.simpleString()}" for k in key)
    return alerts.select(*key, "text").mapInPandas(run, f"{kinds}, delivery_status string")


def corpus_names(lines: DataFrame, line: str = "value") -> DataFrame:
    """(name): the normalised names of a popularity list, one a line; blank lines and comments (#) are skipped."""
    text = F.trim(F.col(line))
    return lines.where((text != "") & ~text.startswith("#")).select(normalize_name(text).alias("name")).where("name <> ''").distinct()
