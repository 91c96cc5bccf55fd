"""One run from new releases to scored ones: assembly, differences, facts, rules, evidence and stages, over tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators import assembly
from sieveline.operators.asof import prior_owners
from sieveline.operators.changes import changed_lines, file_facts
from sieveline.operators.lookup import keyed_left
from sieveline.operators.review import evidence_texts
from sieveline.operators.rules import Rule, fired_rules
from sieveline.operators.shipped import RULES
from sieveline.operators.triage import HEURISTIC, THRESHOLD, encoded, release_scores, screen, stages
from sieveline.sources.tables import kept

KEY = ["package", "version"]


@dataclass(frozen=True)
class Tables:
    """What a run reads, beside the releases (package, version, serial).

    index: (package, version, ts, url, yanked, has_sdist), see assembly.assembled. members: what archives.extract makes of the archives, keyed by (package,
    version). requires: (package, version, name). owners: (package, version, owners). stored: the same of earlier runs. denylist, corpus: (name). lookups: (name, earliest)."""

    index: DataFrame
    members: DataFrame
    requires: DataFrame
    owners: DataFrame
    stored: DataFrame
    denylist: DataFrame
    corpus: DataFrame
    lookups: DataFrame


@dataclass(frozen=True)
class Scanned:
    """releases: a row for each with outcome, prior, is_new, score, fired, stage, terminal, heuristic, evidence and owners; changed and fired: what its review input is made of."""

    releases: DataFrame
    changed: DataFrame
    fired: DataFrame


def _refused(targets: DataFrame, members: DataFrame) -> DataFrame:
    """targets with the outcome refused_to_extract where their own archive, or their prior's, is refused."""
    bad = members.where("kind = 'refused'").select("package", F.col("version").alias("of")).distinct().withColumn("refused", F.lit(True))
    own = keyed_left(targets.withColumn("of", F.col("version")), bad.withColumnRenamed("refused", "r1"), ["package", "of"]).drop("of")
    both = keyed_left(own.withColumn("of", F.col("prior")), bad.withColumnRenamed("refused", "r2"), ["package", "of"]).drop("of")
    hit = F.coalesce("r1", F.lit(False)) | (F.coalesce("r2", F.lit(False)) & F.col("prior").isNotNull())
    return both.withColumn("outcome", F.when(F.col("outcome").isNull() & hit, "refused_to_extract").otherwise(F.col("outcome"))).drop("r1", "r2")


def scan(releases: DataFrame, t: Tables, now: Column, rules: list[Rule] = RULES, policy: str = "surface", threshold: float = THRESHOLD) -> Scanned:
    """Releases (package, version, serial) as Scanned. A release that isn't scanned, by its outcome, has score 0, no rules and no evidence.

    Every stage is a join or an aggregate keyed by release; nothing is collected. Targets, changed files and fired rules are written as tables, since several stages
    read them. Dependencies are screened for updates only, findings in archives are those of the new one."""
    targets = kept(_refused(assembly.assembled(releases, t.index, t.denylist, policy), t.members))
    open_ = targets.where("outcome IS NULL")
    sources = t.members.where("kind = 'source'").select(*KEY, "path", "content")
    changed = kept(changed_lines(assembly.trees(targets, sources, policy), KEY))
    binary = t.members.where("kind = 'binary'").join(open_.select(*KEY), KEY, "left_semi").select(*KEY, "path", "reason", "item")
    added = assembly.added_requirements(targets, t.requires).select(F.struct(*KEY).alias("release"), "name")
    dep = screen(added, t.corpus, t.lookups, now).select("release.package", "release.version", "name", "reason")
    held = keyed_left(targets, t.owners.groupBy(*KEY).agg(F.first("owners").alias("owners")), KEY)
    owned = kept(prior_owners(held, t.stored))
    fired = kept(fired_rules(rules, KEY, file_facts(changed, KEY), binary, dep, owned.where("outcome IS NULL").select(*KEY, "maintainer_changed")))
    scored = keyed_left(owned, release_scores(owned, fired, KEY, threshold), KEY)
    staged = stages(scored, policy, threshold)
    texts = evidence_texts(staged.select(*KEY, "score"), changed, fired, KEY)
    out = keyed_left(staged, texts, KEY)
    return Scanned(out.drop("prior_owners", "escalate"), changed, fired)


def heuristic_alerts(scanned: DataFrame) -> DataFrame:
    """(package, version, classification, score, fired, serial) of releases whose archive was refused or, where no reviewer is asked, whose score escalates."""
    rows = scanned.where("heuristic OR stage = 'escalated'")
    return rows.select(*KEY, F.lit(HEURISTIC).alias("classification"), "score", encoded(F.col("fired")).alias("fired"), "serial")
