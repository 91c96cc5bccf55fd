"""Python's regular expressions as Column predicates.

A pattern is read by Python's own parser and written anew for Spark's engine, class by class, so that \\d, \\w, \\s, the anchors, dots and
case mean what they mean in Python. Spark's engine walks repeated groups by recursion and can overflow its stack on long lines; patterns with
such a repeat, or with a construct it lacks, are run by Python in Arrow batches instead. Every pattern that Python compiles runs one way or the other."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 1000
#: The members of \d, \w and \s, for texts and under the ASCII flag.
DIGIT = {False: r"\p{Nd}", True: "0-9"}
WORD = {False: r"\p{L}\p{N}_", True: "A-Za-z0-9_"}
SPACE = {False: r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", True: r"\x{9}-\x{d}\x{20}"}
ANY = r"[\x{0}-\x{10ffff}]"


class Unstated(Exception):
    """The pattern has no equal in Spark's engine."""


def compiles(pattern: object) -> bool:
    if not isinstance(pattern, str) or len(pattern) > LONGEST:
        return False
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError, MemoryError, ValueError):
        return False
    return True


def _char(code: int) -> str:
    if 0xD800 <= code < 0xE000:
        raise Unstated
    return rf"\x{{{code:x}}}"


def _members(category: object, ascii_: bool) -> tuple[str, bool]:
    """(class body, whether it is what the category lacks)."""
    name = str(category).removeprefix("CATEGORY_").removeprefix("UNI_")
    table = {"DIGIT": DIGIT, "SPACE": SPACE, "WORD": WORD}.get(name.removeprefix("NOT_"))
    if table is None:
        raise Unstated
    return table[ascii_], name.startswith("NOT_")


def _set(items: list, ascii_: bool) -> str:
    negated, inside, others = False, "", []
    for op, value in items:
        if op is C.NEGATE:
            negated = True
        elif op is C.LITERAL:
            inside += _char(value)
        elif op is C.RANGE:
            inside += f"{_char(value[0])}-{_char(value[1])}"
        elif op is C.CATEGORY:
            body, outside = _members(value, ascii_)
            if outside:
                others.append(f"[^{body}]")
            else:
                inside += body
        else:
            raise Unstated
    parts = ([f"[{inside}]"] if inside else []) + others
    one = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?!{one}){ANY}" if negated else one


def _edge(flags: int) -> tuple[str, str]:
    w = f"[{WORD[bool(flags & re.A)]}]"
    return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))", f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"


SINGLE = (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN)


def _stated(tree: object, flags: int) -> str:
    out = []
    for op, value in tree:
        if op is C.LITERAL:
            out.append(_char(value))
        elif op is C.NOT_LITERAL:
            out.append(f"[^{_char(value)}]")
        elif op is C.ANY:
            out.append(ANY if flags & re.S else r"[^\x{a}]")
        elif op is C.IN:
            out.append(f"(?:{_set(value, bool(flags & re.A))})")
        elif op is C.AT:
            many = bool(flags & re.M)
            at = {
                C.AT_BEGINNING: r"(?:\A|(?<=\x{a}))" if many else r"\A", C.AT_BEGINNING_STRING: r"\A", C.AT_END: r"(?=\x{a}|\z)" if many else r"(?=\x{a}?\z)",
                C.AT_END_STRING: r"\z", C.AT_BOUNDARY: _edge(flags)[0], C.AT_NON_BOUNDARY: _edge(flags)[1],
            }.get(value)
            if at is None:
                raise Unstated
            out.append(at)
        elif op is C.BRANCH:
            out.append(f"(?:{'|'.join(_stated(x, flags) for x in value[1])})")
        elif op is C.SUBPATTERN:
            group, more, less, inner = value
            now = (flags | more) & ~less
            body = _stated(inner, now)
            if (now ^ flags) & re.I:
                body = f"(?{'iu' if now & re.I else '-i'}:{body})"
            out.append(f"(?:{body})" if group is None else f"(?<g{group}>{body})")
        elif op is C.GROUPREF:
            out.append(rf"\k<g{value}>")
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            if len(inner) != 1 or inner[0][0] not in SINGLE:
                if high is C.MAXREPEAT or high > 16:
                    raise Unstated  # recursion by the length of the line
            last = "" if high is C.MAXREPEAT else str(int(high))
            end = {C.MAX_REPEAT: "", C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}[op]
            out.append(f"(?:{_stated(inner, flags)}){{{int(low)},{last}}}{end}")
        elif op in (C.ASSERT, C.ASSERT_NOT):
            sign = "=" if op is C.ASSERT else "!"
            out.append(f"(?{'' if value[0] > 0 else '<'}{sign}{_stated(value[1], flags)})")
        elif op is C.ATOMIC_GROUP:
            out.append(f"(?>{_stated(value, flags)})")
        elif op is C.FAILURE:
            out.append("(?!)")
        else:
            raise Unstated
    return "".join(out)


def java_pattern(pattern: str) -> str | None:
    """The pattern for Spark's engine; None if Python has to run it (or can't compile it)."""
    if not compiles(pattern):
        return None
    try:
        tree = _parser.parse(pattern)
        flags = tree.state.flags
        out = _stated(tree, flags)
    except (Unstated, RecursionError, OverflowError):
        return None
    out = f"(?iu:{out})" if flags & re.I else out
    return out if len(out) <= 100 * LONGEST and _accepted(out) else None


def _accepted(text: str) -> bool:
    """Whether Spark's engine compiles it; without a running session the translation is trusted."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is None:
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(text)
    except Exception as e:  # the engine's own error, in whatever form the gateway gives it
        if "PatternSyntaxException" in str(e) or "StackOverflow" in str(e) or "IllegalArgument" in str(e):
            return False
        raise
    return True


def any_line(lines: str, pattern: str) -> Column:
    """Whether the pattern is found in a line of an array column; false for null arrays and null lines."""
    java = java_pattern(pattern)
    if java is not None:
        return F.coalesce(F.exists(lines, lambda x: F.coalesce(x.rlike(java), F.lit(False))), F.lit(False))

    def run(rows: pd.Series) -> pd.Series:
        found = re.compile(pattern).search
        return pd.Series([r is not None and any(x is not None and found(x) is not None for x in r) for r in rows], dtype=bool)

    return F.coalesce(F.pandas_udf(run, "boolean")(lines), F.lit(False))
