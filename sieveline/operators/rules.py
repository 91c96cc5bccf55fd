"""Declarative rules compiled to Columns: a rule's match tree becomes one boolean expression, all rules of a scope one scan.

A rule is a mapping with `id`, `applies_to` (code, binary, dep or maintainer), `weight`, `match` and, if wanted, `attack_type`,
`location_scaled` and `description`. match is a tree of `all`, `any` and `not` over predicates; each predicate belongs to one scope. Whatever breaks this is
dropped when rules are loaded and never stops a run: unknown names, wrong scopes or values, patterns that Python can't compile, trees deeper than
`DEEPEST` or larger than `MOST_NODES`."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.patterns import any_line, compiles

DEEPEST, MOST_NODES = 40, 500
# Categories of calls and reasons of findings.
CATEGORIES = ("decode", "exec", "process", "network", "credential")
BINARY_REASONS = ("source-too-large", "foreign-language-source", "new-binary")
DEP_REASONS = ("typosquat", "nonexistent", "brand-new")
#: What stands for the file of a fired rule on a release's owners.
OWNERSHIP = "<ownership>"


@dataclass(frozen=True)
class Rule:
    id: str
    weight: float
    match: dict
    scaled: bool = False
    scope: str = "code"
    attack_type: str = ""
    description: str = ""


def _categories(value: object) -> list[str] | None:
    """The categories that an argument names, None if one is unknown or there is none."""
    names = value if isinstance(value, list) else [value]
    return names if names and all(isinstance(x, str) and x in CATEGORIES for x in names) else None


def _overlap(column: str, names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, names))), F.lit(False))


def _bound_call(args: dict) -> Column:
    found = F.lit(False)
    if "category" in args:
        found = found | _overlap("categories", _categories(args["category"]))
    if "name" in args:
        found = found | F.coalesce(F.array_contains("names", args["name"]), F.lit(False))
    return found


def _bound_call_ok(args: object) -> bool:
    if not isinstance(args, dict) or not args or set(args) - {"category", "name"}:
        return False
    return ("category" not in args or _categories(args["category"]) is not None) and isinstance(args.get("name", ""), str)


def _flag(column: str) -> Callable[[object], Column]:
    return lambda _: F.coalesce(F.col(column), F.lit(False))


def _number(v: object) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool) and abs(v) < 1e300


_true = lambda v: v is True
_reason = lambda v: F.col("reason").eqNullSafe(F.lit(v))
#: Predicate: its scope, whether an argument is good, the column it states.
PREDICATES: dict[str, tuple[str, Callable[[object], bool], Callable[[object], Column]]] = {
    "bound_call": ("code", _bound_call_ok, _bound_call),
    "autoexec_call": ("code", lambda v: isinstance(v, dict) and set(v) == {"category"} and _categories(v["category"]) is not None,
        lambda v: _overlap("autoexec", _categories(v["category"]))),
    "import_present": ("code", lambda v: isinstance(v, dict) and isinstance(v.get("module"), str),
        lambda v: F.coalesce(F.array_contains("modules", v["module"]), F.lit(False))),
    "regex": ("code", lambda v: isinstance(v, dict) and compiles(v.get("pattern")), lambda v: any_line("added", v["pattern"])),
    "blob_present": ("code", _true, _flag("blob")),
    "syntax_error": ("code", _true, _flag("syntax_error")),
    "location_at_least": ("code", _number, lambda v: F.coalesce(F.col("location_weight") >= float(v), F.lit(False))),
    "binary_reason": ("binary", lambda v: isinstance(v, str) and v in BINARY_REASONS, _reason),
    "dep_reason": ("dep", lambda v: isinstance(v, str) and v in DEP_REASONS, _reason),
    "maintainer_changed": ("maintainer", _true, _flag("maintainer_changed")),
}
SCOPES = ("code", "binary", "dep", "maintainer")


def _sound(root: object, scope: str) -> bool:
    """Whether a match tree is well formed; walks without recursion, so that no depth can stop it."""
    todo, nodes = [(root, 1)], 0
    while todo:
        node, depth = todo.pop()
        nodes += 1
        if depth > DEEPEST or nodes > MOST_NODES or not isinstance(node, dict) or len(node) != 1:
            return False
        key, value = next(iter(node.items()))
        if key == "not":
            todo.append((value, depth + 1))
        elif key in ("all", "any"):
            if not isinstance(value, list) or not value or len(value) > MOST_NODES:
                return False
            todo.extend((x, depth + 1) for x in value)
        elif not isinstance(key, str) or key not in PREDICATES or PREDICATES[key][0] != scope or not PREDICATES[key][1](value):
            return False
    return True


def valid(raw: object) -> Rule | None:
    """The rule that a raw mapping states, None if it is broken; never raises."""
    if not isinstance(raw, dict):
        return None
    id_, scope, weight = raw.get("id"), raw.get("applies_to"), raw.get("weight")
    if not isinstance(id_, str | int) or isinstance(id_, bool) or str(id_) == "" or not isinstance(scope,
        str) or scope not in SCOPES or not _sound(raw.get("match"), scope):
        return None
    try:
        number = None if isinstance(weight, bool) else float(weight)
    except (TypeError, ValueError, OverflowError):
        return None
    if number is None or not math.isfinite(number):
        return None
    text = lambda k: str(raw.get(k) or "") if isinstance(raw.get(k), str | int | float | None) else ""
    return Rule(str(id_), number, raw["match"], bool(raw.get("location_scaled", False)), scope, text("attack_type"), text("description"))


def load(raws: list[object]) -> list[Rule]:
    """Valid rules in order; of equal ids the first stands."""
    out: dict[str, Rule] = {}
    for r in map(valid, raws):
        if r:
            out.setdefault(r.id, r)
    return list(out.values())


def _joined(parts: list[Column], both: bool) -> Column:
    """All or any of the parts, halved again and again so that long lists make no deep expression."""
    if len(parts) == 1:
        return parts[0]
    a, b = _joined(parts[: len(parts) // 2], both), _joined(parts[len(parts) // 2 :], both)
    return a & b if both else a | b


def compiled(node: dict) -> Column:
    key, value = next(iter(node.items()))
    if key == "not":
        return ~compiled(value)
    if key in ("all", "any"):
        return _joined([compiled(x) for x in value], key == "all")
    return PREDICATES[key][2](value)


def _met(rows: DataFrame, rules: list[Rule], keep: list[Column], scaled: bool) -> DataFrame:
    """keep and f (place, rule, weight) of each rule that a row meets; all rules in one scan."""
    one = lambda i, r: F.when(compiled(r.match),
        F.struct(F.lit(i).alias("place"), F.lit(r.id).alias("rule"),
        (F.lit(r.weight) * (F.col("location_weight") if scaled and r.scaled else F.lit(1.0))).alias("weight")))
    return rows.select(*keep, F.explode(F.filter(F.array(*[one(i, r) for i, r in rules]), lambda x: x.isNotNull())).alias("f"))


def fired(facts: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """(key, rule, weight): a row for each rule that a row of facts meets."""
    return _met(facts, list(enumerate(rules)), [F.col(k) for k in key], True).select(*key, "f.rule", "f.weight")


def fired_rules(rules: list[Rule], key: list[str], code: DataFrame | None = None, binary: DataFrame | None = None, dep: DataFrame | None = None,
    maintainer: DataFrame | None = None) -> DataFrame:
    """(key, place, item, rule, weight, file, lo, hi) of every rule of a ruleset on the rows of its scope.

    place: the rule's number in the ruleset; item: the row's order within its release. code has (key, path, first_line, last_line, facts...), binary (key, path,
    reason[, item]), dep (key, name, reason), maintainer (key, maintainer_changed). Only code rules have lines and follow the location; others have lines 0 to 0."""
    kinds = {
        "code": (code, F.col("path"), lambda d: (F.col("path"), F.col("first_line"), F.col("last_line"))),
        "binary": (binary, F.coalesce("path", F.lit("?")),
            lambda d: (F.lpad(F.col("item").cast("string"), 12, "0") if "item" in d.columns else F.col("path"), F.lit(0), F.lit(0))),
        "dep": (dep, F.coalesce("name", F.lit("?")), lambda d: (F.col("name"), F.lit(0), F.lit(0))),
        "maintainer": (maintainer, F.lit(OWNERSHIP), lambda d: (F.lit(""), F.lit(0), F.lit(0))),
    }
    out = None
    for scope, (rows, file, order) in kinds.items():
        mine = [(i, r) for i, r in enumerate(rules) if r.scope == scope]
        if rows is None or not mine:
            continue
        item, lo, hi = order(rows)
        keep = [*map(F.col, key), item.cast("string").alias("item"), file.alias("file"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")]
        part = _met(rows, mine, keep, scope == "code").select(*key, "f.place", "item", "f.rule", "f.weight", "file", "lo", "hi")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no rows of any scope that the rules are for")
    return out


def scores(facts: DataFrame, rules: list[Rule], key: list[str], threshold: float = 40.0) -> DataFrame:
    """(key, score, n_rules, escalate) for keys with a rule that fires."""
    out = fired(facts, rules, key).groupBy(*key).agg(F.sum("weight").alias("score"), F.count("*").alias("n_rules"))
    return out.withColumn("escalate", F.col("score") >= threshold)
