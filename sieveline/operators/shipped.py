"""The standard rules in the order in which they stand in their files: binaries, combinations, dependencies, maintainers, primitives."""

from __future__ import annotations

from sieveline.functions.code import CALLS, EXECUTORS
from sieveline.operators.rules import Rule, load

#: Every category that a call can have.
EVERY = sorted({category for category, _ in CALLS.values()} | ({"exec"} if EXECUTORS else set()))


def _call(*categories: str) -> dict:
    return {"bound_call": {"category": list(categories)}}


def _rule(id_: str, scope: str, weight: float, attack: str, match: dict, scaled: bool = False) -> dict:
    return {"id": id_, "applies_to": scope, "weight": weight, "attack_type": attack, "location_scaled": scaled, "match": match}


# Ids, scopes, weights, attack types and conditions.
RAW: list[dict] = [
    _rule("binary-source-too-large", "binary", 20, "size-evasion", {"binary_reason": "source-too-large"}),
    _rule("foreign-language-source", "binary", 25, "foreign-code", {"binary_reason": "foreign-language-source"}),
    _rule("binary-new-binary", "binary", 10, "opaque-binary", {"binary_reason": "new-binary"}),
    _rule("combo-fetch-exec", "code", 45, "network-exec", {"all": [_call("network"), _call("exec")]}),
    _rule("combo-decode-exec", "code", 45, "obfuscated-loader", {"all": [_call("decode"), _call("exec")]}),
    _rule("combo-cred-network", "code", 45, "credential-exfil", {"all": [_call("credential"), _call("network")]}),
    _rule("dep-typosquat", "dep", 40, "dependency-typosquat", {"dep_reason": "typosquat"}),
    _rule("dep-nonexistent", "dep", 40, "dependency-confusion", {"dep_reason": "nonexistent"}),
    _rule("dep-brand-new", "dep", 20, "dependency-brand-new", {"dep_reason": "brand-new"}),
    _rule("maintainer-set-change", "maintainer", 20, "account-takeover", {"maintainer_changed": True}),
    _rule("syntax-error-suspicious", "code", 20, "obfuscation", {"syntax_error": True}, scaled=True),
    _rule("primitives", "code", 5, "primitive-use", {"any": [_call(*EVERY), {"blob_present": True}]}, scaled=True),
    _rule("autoexec-location", "code", 45, "install-hook",
        {"all": [{"location_at_least": 3.0}, {"any": [{"autoexec_call": {"category": c}} for c in ("process", "exec", "network")]}]}),
]
RULES: list[Rule] = load(RAW)
STANDARD: dict[str, list[Rule]] = {scope: [r for r in RULES if r.scope == scope] for scope in ("code", "binary", "dep", "maintainer")}
