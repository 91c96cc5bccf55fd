"""Column functions of names, paths and report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of file locations, first match wins.
LOCATIONS = ((r"((^|/)(setup\.py|setup\.cfg|pyproject\.toml|__init__\.py|conftest\.py|sitecustomize\.py)|\.pth)$", 3.0), (r"(^|/)(tests?|docs?|examples?)(/|$)", 0.2))


def normalize_name(name: Column) -> Column:
    """Package name with runs of - _ . as one hyphen, trimmed and in lower case."""
    return F.lower(F.regexp_replace(F.trim(name), r"[-_.]+", "-"))


def location_weight(path: Column) -> Column:
    out = F.lit(1.0)
    for pattern, weight in reversed(LOCATIONS):
        out = F.when(path.rlike(pattern), F.lit(weight)).otherwise(out)
    return out


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def deletions(word: Column) -> Column:
    """All distinct strings that up to two deletions make of a word; two words within edit distance 2 share one."""
    one = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    once = F.array_distinct(one(word))
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, one))))


def requirement_name(line: Column) -> Column:
    """Normalised package name at the head of a requirement line; empty where it has none."""
    return normalize_name(F.regexp_extract(F.trim(line), r"^[A-Za-z0-9][A-Za-z0-9._-]*", 0))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's code points in bits, to nine places; null for an empty text."""
    n = F.length(text)
    chars = F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, 1)))
    count = lambda c: n - F.length(F.replace(text, c, F.lit('')))
    spread = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc + count(c) * F.log2(count(c).cast("double")))
    return F.when(n > 0, F.round(F.log2(n.cast("double")) - spread / n, 9))


def blob(lines: Column) -> Column:
    """Whether a line looks like encoded data: a base64 run of 128, over 500 code points, or 64 of high entropy at its start."""
    dense = lambda x: F.when(F.length(x) >= 64, entropy(F.substring(x, 1, 64)) > 4.5).otherwise(F.lit(False))
    return F.coalesce(F.exists(lines, lambda x: x.rlike("[A-Za-z0-9+/=]{128}") | (F.length(x) > 500) | dense(x)), F.lit(False))


def percent(value: Column) -> Column:
    """A confidence as a percentage, half to even; `?` where it is no number, values above 1 being percentages already."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), "?").otherwise(F.concat(F.bround(F.when(v <= 1, v * 100).otherwise(v)).cast("bigint").cast("string"), F.lit("%")))


def humanize_age(seconds: Column) -> Column:
    out = F.lit("just now")
    for unit, size in (("minute", 60), ("hour", 3600), ("day", 86400)):
        n = F.floor(seconds / size)
        out = F.when(seconds >= size, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""), F.lit(" ago"))).otherwise(out)
    return out


def url_quote(text: Column) -> Column:
    """Percent encoding of all but unreserved characters."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def web_scheme(url: Column) -> Column:
    """Whether an address is http or https; false for null, empty and bare ones."""
    return F.coalesce(url.rlike(r"(?i)\Ahttps?:"), F.lit(False))
