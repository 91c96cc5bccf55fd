"""Main-text extraction by tag-path ratios (operator 1).

Every text block of a page lies at a root-to-leaf tag path. Text length (without the text of links) and punctuation are summed per
path; the ratio of a path is its text per block (a long-text path is prose, a short-text path is chrome), its second ratio is
punctuation per block. Both are smoothed over the block sequence, fused by a product and thresholded against the page's mean.
The passing paths choose the content:
- an article or main element that holds most of their mass is the article; its blocks are taken, but those of paths that fail and
  are links for the most part, or lie in an element with a class word of page furniture;
- else the elements that directly hold a good share of the mass are: blocks of passing paths are taken, and what stands between
  them in those elements (short paragraphs, headings, lists), with the same exceptions. A heading just before them is taken too.

Elements that never hold article text (scripts, menus, forms ...) are cut first by name, role or style. Class and id words
are evidence only: an element named by a whole word of page furniture goes if it holds less than half of the page's
text, or if an article or main element stands outside it; any other with such a word, also as a part, lowers its paths' ratios, and its
blocks stay if their path passes.

Defined results: null or empty html gives empty text; a page with no prose block gives what text is left
outside boilerplate; malformed markup is read to its end in linear time, however deep; repeated rows give equal rows; nothing is capped, and a page is one row, so the
whole job is one narrow scan with no shuffle."""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import table

# Elements and class words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form script style noscript template svg canvas iframe object button select option textarea label dialog menu audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription share sharing social comment comments disqus replies respond related recommended recommendations pagination pager toolbar login signup search skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
CONTENT = frozenset("article main".split())
GROUPS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody".split())

_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_PUNCT = re.compile(r"[.,;:!?…。，；：！？、]")
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HEADING = re.compile(r"h[1-6]$")
_SCOPE = frozenset("article section div main td th li body html table".split())


#: What class and id say of an element: nothing, a furniture word as a part, as a whole; CUT: furniture by name, role or style.
PLAIN, PART, WHOLE, CUT = range(4)
#: Least share of the page's text that keeps an element named as furniture; factor on the ratios of such blocks.
MAJOR, HINTED = 0.5, 0.5
HINT = "!"  # ends an element's name in a path if its class or id has a furniture word


def _furniture(name: str, attrs: str, inside: bool) -> int:
    """How far an element is page furniture; inside: it stands within article or main."""
    if name in DROPPED or name == "header" and not inside:
        return CUT
    if "=" not in attrs and "hidden" not in attrs:
        return PLAIN
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", _QUOTED.sub("''", attrs)):
        return CUT
    found = PLAIN
    for key, *value in _ATTR.findall(attrs):
        v = "".join(value).lower()
        key = key.lower()
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and not FURNITURE.isdisjoint(re.split(r"[^a-z0-9]+", v)):
            found = max(found, PART if FURNITURE.isdisjoint(v.split()) else WHOLE)
        if key == "role" and v in ROLES or key == "style" and re.search(r"display\s*:\s*none", v) or key == "aria-hidden" and v == "true":
            return CUT
    return found


class Tree:
    """Nodes with a parent of a lower number; 0 is the root."""

    def __init__(self):
        self.parent, self.name = [0], [""]

    def add(self, parent: int, name: str) -> int:
        self.parent.append(parent)
        self.name.append(name)
        return len(self.parent) - 1

    def sums(self, at: dict[int, float]) -> list[float]:
        """What lies at each node or below it."""
        out = [0.0] * len(self.parent)
        for k, v in at.items():
            out[k] += v
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def under(self, tops: set[int], passes=lambda name: False) -> list[bool]:
        """Whether each node is one of tops or below one, with no node between that `passes` names."""
        out = [k in tops for k in range(len(self.parent))]
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]] and not passes(self.name[k])
        return out


class Block(NamedTuple):
    path: int  # in the tree of paths
    element: int  # in the tree of elements
    text: str
    linked: int  # characters in links


def blocks(page: str) -> tuple[list[Block], Tree, Tree]:
    """(non-empty blocks outside furniture in page order, tree of tag paths, tree of elements)."""
    paths, elements = Tree(), Tree()
    known: dict[tuple[int, str], int] = {}  # path of a parent path and a name
    stack: list[tuple[str, bool, int, int, int]] = []  # (name, dropped from here on, path, element, number if named as furniture else 0)
    opened: dict[str, int] = defaultdict(int)
    around: list[int] = []  # numbers of the open elements named as furniture
    out: list[Block] = []
    under: list[tuple[int, ...]] = []  # elements named as furniture around each block
    named = links = linked = 0
    free: set[int] = set()  # those of them that stand outside article and main
    piece: list[str] = []

    def flush() -> None:
        nonlocal linked
        if piece:
            text = " ".join(_html.unescape("".join(piece)).split())
            if text:
                out.append(Block(stack[-1][2] if stack else 0, stack[-1][3] if stack else 0, text, min(linked, len(text))))
                under.append(tuple(around))
            piece.clear()
        linked = 0

    def close() -> str:
        name, _, _, _, number = stack.pop()
        opened[name] -= 1
        if number:
            around.pop()
        return name

    pos, n = 0, len(page)
    low = page.lower() if "<" in page else page
    if len(low) != n:  # a few letters change length in lower case
        low = page
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos and not (stack and stack[-1][1]):
            piece.append(page[pos:at])
            linked += links and len(page[pos:at].strip())
        if at == n:
            break
        nxt = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        closing = nxt == "/"
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            if nxt in ("!", "?", "/"):
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            else:  # a bare "<" is text
                if not (stack and stack[-1][1]):
                    piece.append("<")
                pos = at + 1
            continue
        name = m[0].lower()
        e = _TAG_END.match(page, m.end())
        end = e.end() if e else page.find(">", m.end()) + 1
        if end <= 0:
            break
        attrs, pos = page[m.end() : end - 1], end
        if name == "a":
            links = int(not closing)
        if name in INLINE and not (not closing and "=" in attrs and _furniture(name, attrs, True) >= WHOLE):
            continue
        if closing:
            if opened[name]:
                flush()
                while close() != name:
                    pass
            continue
        flush()
        if name == "br" or name in VOID:
            continue
        if name in RAW:
            end = low.find(f"</{name}", pos)
            stop = page.find(">", end) if end >= 0 else -1
            pos = n if stop < 0 else stop + 1
            continue
        if name in _CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            want = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ("p",))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in want:
                    while len(stack) > k:
                        close()
                    break
                if stack[k][0] in _SCOPE or stack[k][0] in ("ul", "ol", "dl", "table"):
                    break
        if attrs.endswith("/") and name not in _CLOSES_P:
            continue
        gone = bool(stack) and stack[-1][1]
        inside = any(opened[x] for x in CONTENT)
        kind = _furniture(name, attrs, inside)
        if kind == WHOLE:
            named += 1
            around.append(named)
            if not inside:
                free.add(named)
        shown = name + HINT if kind in (PART, WHOLE) else name
        above = stack[-1] if stack else ("", False, 0, 0, 0)
        if (above[2], shown) not in known:
            known[above[2], shown] = paths.add(above[2], shown)
        stack.append((name, gone or kind == CUT, known[above[2], shown], elements.add(above[3], shown), named if kind == WHOLE else 0))
        opened[name] += 1
    flush()
    held: dict[int, int] = defaultdict(int)
    for x, numbers in zip(out, under, strict=True):
        for k in numbers:
            held[k] += len(x.text)
    least = MAJOR * sum(len(x.text) for x in out)
    article = paths.under({k for k, name in enumerate(paths.name) if name in CONTENT})
    outside = [set(numbers) for x, numbers in zip(out, under, strict=True) if article[x.path]] if free else []
    kept = {k for k in held if held[k] >= least and not (k in free and any(k not in numbers for numbers in outside))}
    return [x for x, numbers in zip(out, under, strict=True) if kept.issuperset(numbers)], paths, elements


def main_text(page: str | None, sigma: float = 1.0, strictness: float = 0.5, share: float = 0.3, linked: float = 0.5) -> tuple[str, int, int]:
    """(text, blocks seen, blocks kept).

    sigma: width of the Gaussian over the block sequence. strictness: a path passes if its fused ratio is at least this part of the page's
    mean. share: least part of the passing mass in an article or main element, and a third of it in an element that holds content.
    linked: part of links from which a failing path's blocks go."""
    found, paths, elements = blocks(page or "")
    if not found:
        return "", 0, 0
    length, chars, marks, count, links = (defaultdict(int) for _ in range(5))
    for x in found:
        length[x.path] += len(x.text) - x.linked
        chars[x.path] += len(x.text)
        links[x.path] += x.linked
        marks[x.path] += len(_PUNCT.findall(x.text))
        count[x.path] += 1
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]

    def smooth(values: list[float]) -> list[float]:
        padded = [values[0]] * reach + values + [values[-1]] * reach
        total = sum(weights)
        return [sum(w * padded[i + j] for j, w in enumerate(weights)) / total for i in range(len(values))]

    named = [False] * len(paths.name)
    for k in range(1, len(named)):
        named[k] = named[paths.parent[k]] or paths.name[k].endswith(HINT)
    size, punct = smooth([length[x.path] / count[x.path] for x in found]), smooth([marks[x.path] / count[x.path] for x in found])
    fused = [a * (1 + b) * (HINTED if named[x.path] else 1) for a, b, x in zip(size, punct, found, strict=True)]
    mean = sum(fused) / len(fused)
    per_path: dict[int, list[float]] = defaultdict(list)
    for x, v in zip(found, fused, strict=True):
        per_path[x.path].append(v)
    own = {k: length[k] / count[k] * (1 + marks[k] / count[k]) for k in per_path}  # neighbours alone don't carry a path
    passed = {k for k, v in per_path.items() if sum(v) / len(v) >= strictness * mean and own[k] >= strictness * mean} or set(per_path)
    ratio = {k: length[k] + 10 * marks[k] for k in passed}
    mass = paths.sums(ratio)
    hinted = lambda name: name.endswith(HINT)
    semantic = [k for k, name in enumerate(paths.name) if name in CONTENT and mass[k] >= share * mass[0] and mass[k] > 0]
    chrome = {k for k in count if k not in passed and links[k] >= linked * chars[k] > 0}
    if semantic:
        root = max(semantic, key=lambda k: (mass[k], -k))
        below, plain = paths.under({root}), paths.under({root}, hinted)
        kept = [below[x.path] and (x.path in passed or plain[x.path] and x.path not in chrome) for x in found]
    else:
        held: dict[int, float] = defaultdict(float)
        for x in found:
            if x.path in passed:
                # an element that only groups words (p, li ...) belongs to the one around it
                at = elements.parent[x.element] if elements.name[x.element].rstrip(HINT) in GROUPS else x.element
                held[at] += len(x.text) - x.linked
        least = share / 3 * sum(held.values())
        plain = elements.under({k for k, v in held.items() if v >= least and k}, hinted)
        kept = [x.path in passed or plain[x.element] and x.path not in chrome for x in found]
        for i in range(len(found) - 2, -1, -1):
            if kept[i + 1] and not named[found[i].path] and _HEADING.match(elements.name[found[i].element]):
                kept[i] = True
    return " ".join(x.text for x, k in zip(found, kept, strict=True) if k), len(found), sum(kept)


def extract(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keys plus text, n_chars, n_blocks, n_kept per row of pages. Other columns are not read."""
    src = pages.select(*keys, html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", text string, n_chars bigint, n_blocks bigint, n_kept bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(x.as_py()) for x in b.column(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keys)], pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                names=[*keys, "text", "n_chars", "n_blocks", "n_kept"],
            )

    return src.mapInArrow(run, schema)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", F.col("n_blocks"), F.col("n_kept"))
