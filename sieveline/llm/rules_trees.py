"""Quality rules: gradient-boosted trees over document statistics (operator 12).

Fixed rules come first (`base_failed`); what passes them is judged by boosted trees on the shares of `FEATURES`. Trees are grown on
histograms with the logistic loss, their depth is bounded, and some features may move the score one way only (`MONOTONE`: more
symbols, repeats or shouting never make a text better): a split against the direction is refused, and the two sides of a split are
bounded by the middle of their values all the way down, so that the whole model is monotone.

The model is flattened into node arrays (feature, threshold, children, value); a leaf leads to itself, so scoring is one gather per level
for all rows and trees at once. The arrays have a fixed size and are broadcast.

Spark plan: one narrow scan counts and scores. The model is fitted on at most about `ROWS_PER_CLASS` labelled rows of each class,
chosen by a hash of the id; their statistics are made on the executors, and the driver gets one row of FEATURES for each.

Defined results: null and empty texts have no words and fail; conflicting labels of an id count as the least, null labels don't count; without
labels of both classes the score is the share of class 1 (1 without labels); repeated rows are judged alike, ids may repeat or be null;
other columns are not read; an empty table gives an empty result. Words and lines are compared by 64-bit hashes within a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import fold, table
from sieveline.llm.scan import Words, classes, gram_keys
from sieveline.llm.vec import U, buffers, mix, slices

ROWS_PER_CLASS = 8000
TREES, DEPTH, RATE, BINS, RIDGE, LEAF_WEIGHT = 80, 3, 0.2, 64, 1.0, 2.0
#: Fixed rules: fewest words; most percent of the words in repeated windows.
FEWEST, REPEATED = 50, 50
KEEP = 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "letters", "stops", "bare", "marks", "words_per_line", "distinct"]
#: Direction in which a feature may move the score: 1 up, -1 down, 0 both.
MONOTONE = np.array([0, 0, -1, -1, -1, -1, 0, 1, 0, -1, -1, 0, 0])

KIND = classes(b"\x20\x09\x0a\x0b\x0c\x0d")
_flag = lambda chars: np.isin(np.arange(256), list(chars))
SYMBOL, STOP, MARK = _flag(b"#*$%&|<>"), _flag(b".,;:?"), _flag(b"!#*$%&|<>@^_~=+\\/{}[]`")
UPPER, DIGIT = _flag(range(65, 91)), _flag(range(48, 58))
LETTER = UPPER | _flag(range(97, 123)) | _flag(range(192, 256))  # beyond ASCII by the lead byte
POINT = ~_flag(range(128, 192))  # one for each code point


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS as integers, FEATURES) of each text."""
    t = Words(data, offsets, KIND, fold=False)
    d, off = t.data, offsets - offsets[0]
    rows = len(off) - 1

    def upto(flag: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(flag, dtype=np.int64))

    total = lambda flag: np.diff(upto(flag)[off])
    per = lambda x: np.bincount(t.doc, weights=x, minlength=rows)[:rows].astype(np.int64)
    points = upto(POINT[d])
    chars = per(points[t.end] - points[t.start])

    # lines: those with a word that equal an earlier one of their text
    cuts = np.unique(np.concatenate([np.flatnonzero(d == 10) + 1, off]))
    begin, stop = cuts[:-1], cuts[1:]
    stop = stop - ((stop > begin) & (d[np.maximum(stop, 1) - 1] == 10)) if len(stop) else stop
    solid = upto(KIND[d] == 0)
    full = solid[stop] > solid[begin]
    lines = Words.__new__(Words)
    lines.data, lines.start, lines.end = d, begin[full], stop[full]
    at = np.searchsorted(off, begin[full], "right") - 1
    key = mix(lines.hashes() ^ mix(at.astype(U)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    dup = np.bincount(at[again], minlength=rows)
    n_lines = np.bincount(at, minlength=rows)

    # words in windows of three that their text has twice or more
    h = t.hashes()
    n = len(h)
    own = mix(t.doc.astype(U) + U(1))
    window = np.flatnonzero(t.doc[:-2] == t.doc[2:]) if n > 2 else np.zeros(0, np.int64)
    _, of, times = np.unique(gram_keys(h, window, 3) ^ own[window], return_inverse=True, return_counts=True)
    hit = window[times[of] > 1]
    covered = np.zeros(n + 2, bool)
    for j in range(3):
        covered[hit + j] = True
    repeats = per(covered[:n])
    _, one = np.unique(h ^ own, return_index=True)
    distinct = np.bincount(t.doc[one], minlength=rows)

    letters, upper = upto(LETTER[d]), upto(UPPER[d])
    bare = per(letters[t.end] == letters[t.start])
    counts = np.stack([t.count, chars, total(SYMBOL[d]), dup, repeats], 1).astype(np.int64)
    words, glyphs = np.maximum(1, t.count), np.maximum(1, chars)
    some = np.maximum(1, total(LETTER[d]))
    ends = per(STOP[d[t.end - 1]] if n else np.zeros(0))
    x = [
        np.log1p(t.count), chars / words, counts[:, 2] / words, dup / np.maximum(1, n_lines), repeats / words, total(UPPER[d]) / some, total(DIGIT[d]) / glyphs,
        total(LETTER[d]) / glyphs, ends / words, bare / words, total(MARK[d]) / words, np.log1p(t.count / np.maximum(1, n_lines)), np.log1p(distinct) / np.log1p(words),
    ]
    return counts, np.stack(x, 1).astype(float)


@dataclass
class Forest:
    """Node arrays of all trees; `roots` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int = DEPTH

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _weight(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + RIDGE)


def _gain(value: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Fall of the loss if a side with sums g, h gets this value."""
    return -(g * value + 0.5 * (h + RIDGE) * value * value)


def grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, monotone: np.ndarray, depth: int) -> list[list]:
    """Nodes [feature, threshold, left, right, value] of one tree, root first, by histograms of each node's rows."""
    k = bins.shape[1]
    nodes: list[list] = []

    def split(rows: np.ndarray, low: float, high: float, left: int) -> int:
        at = len(nodes)
        value = float(np.clip(_weight(g[rows].sum(), h[rows].sum()), low, high))
        nodes.append([0, np.inf, at, at, value])
        if not left or len(rows) < 2:
            return at
        flat = (bins[rows] + np.arange(k) * BINS).ravel()
        gs, hs = (np.cumsum(np.bincount(flat, np.repeat(w[rows], k), k * BINS).reshape(k, BINS), 1) for w in (g, h))
        gl, hl = gs[:, :-1], hs[:, :-1]
        gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
        vl, vr = (np.clip(_weight(a, b), low, high) for a, b in ((gl, hl), (gr, hr)))
        gain = _gain(vl, gl, hl) + _gain(vr, gr, hr) - _gain(value, g[rows].sum(), h[rows].sum())
        gain[(hl < LEAF_WEIGHT) | (hr < LEAF_WEIGHT) | ((vr - vl) * monotone[:, None] < 0)] = -np.inf
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] <= 1e-9:
            return at
        mid = float((vl[f, b] + vr[f, b]) / 2)
        go = bins[rows, f] <= b
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[f])]
        nodes[at][:2] = [int(f), float(edges[f][b])]
        nodes[at][2] = split(rows[go], *bounds[0], left - 1)
        nodes[at][3] = split(rows[~go], *bounds[1], left - 1)
        return at

    split(np.arange(len(bins)), -np.inf, np.inf, depth)
    return nodes


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray = MONOTONE, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    share = float(y.mean()) if len(y) else 1.0
    start = float(np.log(np.clip(share, 1e-9, 1) / np.clip(1 - share, 1e-9, 1)))
    edges = [np.append(e := np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)), np.full(BINS - len(e), np.inf)) if len(x) else np.full(BINS, np.inf) for f in range(x.shape[1])]
    parts: list[list] = []
    roots, score = [], np.full(len(y), start)
    if 0 < share < 1:
        bins = np.stack([np.searchsorted(e[:-1], x[:, f], "left") for f, e in enumerate(edges)], 1)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = grow(bins, edges, p - y, np.maximum(p * (1 - p), 1e-6), monotone, depth)
            base = len(parts)
            roots.append(base)
            parts += [[f, t, a + base, b + base, rate * v] for f, t, a, b, v in tree]
            score = score + _arrays(parts[base:], [0], 0.0, depth, base).log_odds(x)
    return _arrays(parts, roots, start, depth)


def _arrays(parts: list[list], roots: list[int], start: float, depth: int, base: int = 0) -> Forest:
    f, t, a, b, v = (np.array([n[i] for n in parts], kind) for i, kind in enumerate((np.int64, float, np.int64, np.int64, float)))
    return Forest(f, t, a - base, b - base, v, np.array(roots, np.int64), start, depth)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Forest:
    """Trees from docs (doc_id, text) and labels (doc_id, quality) outside the held-out fold that pass the fixed rules."""
    known = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    per = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not per:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    share = F.create_map(*[x for k, n in sorted(per.items()) for x in (F.lit(k), F.lit(min(1.0, rows_per_class / n)))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20) < share[F.col("y")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(2))
            for lo, hi in slices(offsets):
                counts, x = statistics(data, offsets[lo : hi + 1])
                at = np.flatnonzero(~failed(counts))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + at)), b.column(1).take(pa.array(lo + at)), pa.array(list(x[at]), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<double>").toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("y").to_pylist(), got.column("x").to_pylist(), strict=True))
    return train(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))


def failed(counts: np.ndarray) -> np.ndarray:
    """The fixed rules."""
    return (counts[:, 0] < FEWEST) | (100 * counts[:, 4] > REPEATED * counts[:, 0])


def judge(docs: DataFrame, model: Forest) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and score (probability of quality 1) per row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *COUNTS, "base_failed", "kept", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            for lo, hi in slices(offsets):
                counts, x = statistics(data, offsets[lo : hi + 1])
                bad, p = failed(counts), held.value.probability(x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, counts.T), pa.array(bad), pa.array(~bad & (p >= KEEP)), pa.array(p)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
