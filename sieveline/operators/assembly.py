"""From new releases to what is to be scanned: one pass that carries each release's outcome as a column, then its files and added dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.lookup import LAST, dealt, keyed_left
from sieveline.operators.releases import DAY
from sieveline.operators.triage import denied
from sieveline.sources.archives import is_surface

POLICIES = ("surface", "full", "skip")


def assembled(releases: DataFrame, index: DataFrame, denylist: DataFrame, policy: str = "surface", width: int = 3650 * DAY) -> DataFrame:
    """releases (package, version, serial) plus outcome, url, prior, prior_url and is_new.

    index (package, version, ts, url, yanked, has_sdist) has a row for each known version, and one with a null version for a package without any. In this
    order: a name on the denylist is refused_to_fetch and nothing else is looked at; a package that the index lacks is fetch_failed; a version without a source archive is
    no_sdist; under the policy `skip` a release without predecessor is new_package_skipped; the others have a null outcome. The prior is the
    package's latest other version with a source archive that isn't yanked, whose time is smaller; of equal times the least version stands; without a time of
    its own a release has no bound.

    Releases and index meet in one aggregate on (package, version), from which both the releases' own archives and the search for priors come. The
    search is that of asof.last_before, with the presence of a package carried along: stretches of `width` microseconds of a package are searched apart."""
    if policy not in POLICIES:
        raise ValueError(f"policy: one of {POLICIES}")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    known = index.select("package", "version", micros.alias("at"), "url", "yanked", "has_sdist")
    asked = releases.select("package", "version", "serial", F.lit(True).alias("asked"))
    both = asked.unionByName(known.withColumn("known", F.lit(True)), allowMissingColumns=True)
    one = both.groupBy("package", "version").agg(
        F.max("serial").alias("serial"), F.coalesce(F.max("asked"), F.lit(False)).alias("asked"), F.coalesce(F.max("known"), F.lit(False)).alias("known"),
        F.max(F.when(F.col("has_sdist"), F.struct(F.lit(1).alias("x"), "url", "at", F.coalesce("yanked", F.lit(False)).alias("yanked")))).alias("sdist"),
    )
    # releases without a time come after all others
    one = one.withColumn("order__", F.coalesce(F.col("sdist.at"), F.lit(LAST)))
    fact = F.col("sdist").isNotNull() & ~F.col("sdist.yanked") & F.col("sdist.at").isNotNull() & F.col("version").isNotNull()
    held = F.struct(F.col("version").alias("version"), F.col("sdist.url").alias("url"))
    dealt = one.withColumn("stretch__", F.floor(F.col("order__") / width)).withColumn("fact__", F.when(fact, F.struct((-F.col("order__")).alias("o"), held.alias("v"))))
    # the least of (-time, version) is the latest, of equal times the least version
    ends = dealt.groupBy("package", "stretch__").agg(F.min("fact__").alias("end"), F.max("known").alias("known"))
    package = Window.partitionBy("package")
    past = package.orderBy("stretch__").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("package", "stretch__", F.min("end").over(past).alias("carried__"), F.max("known").over(package).alias("present__"))
    near = Window.partitionBy("package", "stretch__").orderBy("order__").rangeBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("local__", F.min("fact__").over(near)).where("asked")
    out = keyed_left(local, carried, ["package", "stretch__"]).withColumn("prior__", F.least("local__", "carried__")["v"])
    listed = denied(out.withColumn("name", F.col("package")), denylist)
    outcome = (
        F.when(F.col("denied"), "refused_to_fetch").when(~F.col("present__"), "fetch_failed").when(F.col("sdist").isNull(), "no_sdist")
        .when(F.col("prior__").isNull() & F.lit(policy == "skip"), "new_package_skipped")
    )
    out = listed.withColumn("outcome", outcome)
    looked = F.col("outcome").isNull() | (F.col("outcome") == "new_package_skipped")
    value = lambda c: F.when(looked, c)
    return out.select("package", "version", "serial", "outcome", value(F.col("sdist.url")).alias("url"),
        value(F.col("prior__.version")).alias("prior"), value(F.col("prior__.url")).alias("prior_url"), value(F.col("prior__").isNull()).alias("is_new"))


def _roles(targets: DataFrame) -> DataFrame:
    """(package, of, version, new, is_new): the versions whose rows a release needs: its own, and its prior's."""
    role = lambda of, new: F.struct(of.alias("of"), F.lit(new).alias("new"))
    each = targets.where("outcome IS NULL").select("package", "version", "is_new",
        F.explode(F.array(role(F.col("version"), True), role(F.col("prior"), False))).alias("r"))
    return each.select("package", "version", "is_new", "r.of", "r.new").where("of IS NOT NULL")


def _with_roles(rows: DataFrame, roles: DataFrame, tasks: int | None) -> DataFrame:
    """rows (package, of, ...) of the versions that roles name, once for each role."""
    key = ["package", "of"]
    return dealt(rows, tasks, *key).join(dealt(roles, tasks, *key), key)


def trees(targets: DataFrame, files: DataFrame, policy: str = "surface", tasks: int | None = None) -> DataFrame:
    """(package, version, path, kind, new, old) of the paths that differ between a release and its prior, in one scan of files (package, version, path, content).

    kind: added, removed or modified. Under the policy `surface` a release without a prior has only the files that run by themselves. tasks: as for lookup.dealt."""
    rows = _with_roles(files.select("package", F.col("version").alias("of"), "path", "content"), _roles(targets), tasks)
    side = lambda new: F.max(F.when(F.col("new") == new, F.struct(F.col("content").alias("c"))))
    both = dealt(rows, tasks, "package", "version", "path").groupBy("package", "version", "is_new", "path").agg(side(True).alias("a"), side(False).alias("b"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified")
    out = both.where(~F.col("a.c").eqNullSafe(F.col("b.c")) | F.col("a").isNull() | F.col("b").isNull())
    if policy == "surface":
        out = out.where(~F.col("is_new") | is_surface(F.col("path")))
    return out.select("package", "version", "path", kind.alias("kind"), F.col("a.c").alias("new"), F.col("b.c").alias("old"))


def added_requirements(targets: DataFrame, requires: DataFrame, tasks: int | None = None) -> DataFrame:
    """(package, version, name): what an update requires and its prior doesn't, in one scan of requires (package, version, name); releases without a prior have no row. tasks: as for lookup.dealt."""
    rows = _with_roles(requires.select("package", F.col("version").alias("of"), "name"), _roles(targets).where(~F.col("is_new")), tasks)
    both = dealt(rows, tasks, "package", "version", "name").groupBy("package", "version", "name").agg(F.max("new").alias("now"), F.max(~F.col("new")).alias("before"))
    return both.where(F.col("now") & ~F.col("before")).select("package", "version", "name")
