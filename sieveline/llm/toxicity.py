"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks (operator 4).

Kernel: the gap-weighted subsequence kernel of order 3, normalised: two words are alike if they share letter triples in
order, each weighted by a decay for every letter it spans. A letter pushed into an insult, or one left out, lowers the
likeness a little instead of breaking the match. Marks inside words are dropped, look-alike digits read as letters, and
runs of single letters ("i d i o t") joined.

Training (numpy on the driver) uses at most `rows_per_class` labelled documents of each class, chosen by a hash. Their
words are told apart by document frequency; the landmarks are the words that speak most for the toxic class and as many
frequent clean ones. The Nyström map of a word is K_mm^(-1/2) k_m(word). Labels belong to documents, so the SVM learns
by multiple instances: a toxic document's highest-scoring words are its positive examples, all words of clean documents
negative ones, in a few rounds. A one-variable logistic curve turns a document's highest word margin into a score.

Scoring: the margin is linear in the kernel, so it collapses into one weight per letter triple; a word costs one table
lookup per triple. Each task keeps margins of words it has met in a bounded cache.

Defined results: null and empty texts, and texts without words, get the score of no evidence (the curve at the lowest margin);
without labels of both classes every score is the training base rate, 0 if unknown; words longer than 24 letters are
read in overlapping windows; whole texts are read; ids may repeat or be null."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import fold, table, words

ROWS_PER_CLASS, LANDMARKS, DECAY, LONGEST = 800, 96, 0.6, 24
CACHE_WORDS = 400_000
FLOOR = -1.5
SYMBOLS = 64

# Characters read as letters.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
_MARKS = re.compile(r"[\W\d_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:[\s.,_*-]+[^\W\d_](?!\S)){2,}")


def fold_word(token: str) -> str:
    """Lower case, outer marks off, look-alikes read as letters where letters surround them, inner marks off."""
    t = _EDGES.sub("", token.lower())
    if not t.isalpha():
        if any(c.isalpha() for c in t):
            t = t.translate(LOOKALIKE)
        t = _MARKS.sub("", t)
    return t


def units(text: str) -> set[str]:
    """Distinct raw tokens of a text, and its spelled-out words."""
    out = set(text.split())
    if any(len(x) == 1 for x in out):
        out.update("".join(_MARKS.split(m[0])) for m in _SPELLED.finditer(text))
    return out


def encode(word: str) -> np.ndarray:
    """Letter codes between two edge marks (0), so that a short word is not just a part of a longer one."""
    return np.array([0, *[ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SYMBOLS - 27) for c in word], 0], np.int64)


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(n: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all i < j < k below n, decay**span of each)."""
    if n not in _TRIPLES:
        at = np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3)
        _TRIPLES[n] = (at, decay ** (at[:, 2] - at[:, 0] + 1).astype(float))
    return _TRIPLES[n]


def codes(block: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Triple codes (rows x triples) of encoded words of one length."""
    return (block[:, at[:, 0]] * SYMBOLS + block[:, at[:, 1]]) * SYMBOLS + block[:, at[:, 2]]


def self_kernel(block: np.ndarray, decay: float) -> np.ndarray:
    """k(x, x) of encoded words of one length: the square of each distinct triple's total weight, summed."""
    at, w = triples(block.shape[1], decay)
    c = codes(block, at)
    order = np.argsort(c, axis=1, kind="stable")
    c, v = np.take_along_axis(c, order, 1), w[order]
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    new[:, 0] = True
    sums = np.add.reduceat(v.ravel(), np.flatnonzero(new.ravel()))
    row = np.nonzero(new)[0]
    return np.bincount(row, weights=sums * sums, minlength=len(block))


def windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + step, step)]


def by_length(items: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, encoded block) of items of equal length, empty ones left out."""
    sizes = np.array([len(x) + 2 if x else 0 for x in items], np.int64)
    for n in np.unique(sizes):
        if n >= 3:
            at = np.flatnonzero(sizes == n)
            step = max(1, 2_000_000 // len(triples(int(n), DECAY)[0]))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                yield part, np.stack([encode(items[i]) for i in part])


def kernel(items: list[str], marks: list[str], decay: float = DECAY) -> np.ndarray:
    """Normalised kernel of items against marks (words of at most LONGEST letters)."""
    rows: dict[int, int] = {}
    parts = []
    for j, block in by_length(marks):
        at, w = triples(block.shape[1], decay)
        c = codes(block, at)
        for code in np.unique(c):
            rows.setdefault(int(code), len(rows))
        parts.append((j, c, w, np.sqrt(self_kernel(block, decay))))
    seen = np.array(sorted(rows), np.int64)
    weight = np.zeros((len(seen) + 1, len(marks)), np.float32)  # the last row stands for triples of no landmark
    for j, c, w, norm in parts:
        for i, mark in enumerate(j):
            np.add.at(weight[:, mark], np.searchsorted(seen, c[i]), w / norm[i])
    out = np.zeros((len(items), len(marks)), np.float32)
    for i, block in by_length(items):
        at, w = triples(block.shape[1], decay)
        norm = np.sqrt(self_kernel(block, decay))
        step = max(1, 40_000 // len(w))
        for a in range(0, len(i), step):
            c = codes(block[a : a + step], at)
            k = np.searchsorted(seen, c)
            k[seen[np.minimum(k, len(seen) - 1)] != c] = len(seen)
            out[i[a : a + step]] = np.matmul(w.astype(np.float32)[None, None, :], weight[k])[:, 0] / norm[a : a + step, None]
    return out


@dataclass
class Model:
    """Margin of a word: weights[triple] summed by decay**span, over the word's norm, plus bias; score: logistic(slope * margin + offset)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    landmarks: list[str]

    def margins(self, items: list[str]) -> np.ndarray:
        """Margins of folded words, not below FLOOR.

        k(x, x) is at least the sum of its squared weights, so most words are known to lie below FLOOR without it."""
        pieces = [(i, p) for i, x in enumerate(items) for p in windows(x)]
        raw = np.full(len(pieces), FLOOR)
        for at, block in by_length([p for _, p in pieces]):
            t, w = triples(block.shape[1], DECAY)
            top = self.weights[codes(block, t)] @ w
            best = np.where(top > 0, top / np.sqrt((w * w).sum()), 0) + self.bias
            near = np.flatnonzero(best > FLOOR) if self.bias <= FLOOR else np.arange(len(at))
            if len(near):
                raw[at[near]] = top[near] / np.sqrt(self_kernel(block[near], DECAY)) + self.bias
        out = np.full(len(items), FLOOR)
        if pieces:
            np.maximum.at(out, np.array([i for i, _ in pieces]), raw)
        return np.maximum(out, FLOOR)

    def probability(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 25, reg: float = 1e-5) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps over the rows inside the margin, each halved until the loss falls."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = weight / weight.sum()
    ridge = np.full(a.shape[1], reg)
    ridge[-1] = 1e-9
    loss = lambda m, v: float(weight @ np.maximum(m, 0) ** 2 + 0.5 * ridge @ (v * v))
    v = np.zeros(a.shape[1])
    m = 1.0 - y * (a @ v)
    now = loss(m, v)
    for _ in range(steps):
        on = m > 0
        part, w = a[on], weight[on]
        grad = ridge * v - 2.0 * part.T @ (w * y[on] * m[on])
        hess = 2.0 * (part * w[:, None]).T @ part + np.diag(ridge)
        move, scale = np.linalg.solve(hess, grad), 1.0
        slope = y * (a @ move)
        while scale > 1e-4 and loss(m + scale * slope, v - scale * move) > now:
            scale /= 2
        v, m = v - scale * move, m + scale * slope
        before, now = now, loss(m, v)
        if before - now < 1e-9 * before:
            break
    return v[:-1], float(v[-1])


def train(texts: list[list[str]], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 6) -> Model:
    """Model from the raw tokens of each labelled text."""
    y = np.array(labels, int)
    bags = [sorted({p for t in x for w in [fold_word(t)] if w for p in windows(w)}) for x in texts]
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        p = (n1 + 1e-9) / (n1 + n0 + 1e-9) if n1 + n0 else 0.0
        return Model(np.zeros(SYMBOLS**3), FLOOR, 0.0, float(np.log(max(p, 1e-12) / max(1 - p, 1e-12))), [])
    df: dict[str, list[int]] = {}
    for bag, label in zip(bags, y, strict=True):
        for x in bag:
            df.setdefault(x, [0, 0])[label] += 1
    vocab = sorted(df)
    d0, d1 = np.array([df[x][0] for x in vocab], float), np.array([df[x][1] for x in vocab], float)
    odds = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    power = odds * np.sqrt(np.maximum(d1 - d0 * n1 / n0, 0))
    toxic = [vocab[i] for i in np.argsort(-power, kind="stable")[: landmarks // 2] if power[i] > 0]
    clean = [vocab[i] for i in np.argsort(-d0, kind="stable") if vocab[i] not in set(toxic)][: landmarks - len(toxic)]
    marks = toxic + clean
    kmm = kernel(marks, marks)
    val, vec = np.linalg.eigh(kmm)
    keep = val > 1e-6 * val.max()
    root = vec[:, keep] / np.sqrt(val[keep])
    km = kernel(vocab, marks)
    phi = km @ root
    index = {x: i for i, x in enumerate(vocab)}
    inst = [np.array([index[x] for x in bag], int) for bag in bags]
    score = np.where(d0 > 0, -1.0, 0.0) + np.minimum(power / max(power.max(), 1e-9), 1.0)
    spoken = np.flatnonzero(d0 > 0)
    for _ in range(rounds):
        # how often each word is among the two highest of a text of either class
        tops = np.zeros((2, len(vocab)))
        for bag, label in zip(inst, y, strict=True):
            if len(bag):
                tops[label, bag[np.argpartition(-score[bag], min(1, len(bag) - 1))[:2]]] += 1
        # a toxic text's top word is an example only if the class really prefers it, and not one text of it alone
        pos = np.flatnonzero((tops[1] > 0) & (odds > 1.0) & (d1 >= max(2, n1 / 100)))
        if not len(pos):
            pos = np.flatnonzero(tops[1] > 0)
        up, down = np.sqrt(tops[1][pos]), np.sqrt(d0[spoken])
        hard = tops[0][spoken]
        x = np.vstack([phi[pos], phi[spoken]])
        t = np.concatenate([np.ones(len(pos)), -np.ones(len(spoken))])
        w, b = _svm(x, t, np.concatenate([up / up.sum(), 0.5 * down / down.sum() + 0.5 * hard / max(hard.sum(), 1.0)]))
        score = phi @ w + b
    alpha = root @ w
    weights = np.zeros(SYMBOLS**3)
    for j, block in by_length(marks):
        at, dw = triples(block.shape[1], DECAY)
        c, norm = codes(block, at), np.sqrt(self_kernel(block, DECAY))
        for i, m in enumerate(j):
            np.add.at(weights, c[i], alpha[m] * dw / norm[i])
    best = np.array([max([FLOOR, *score[bag]]) for bag in inst])
    slope, offset = _logistic(best, y)
    return Model(weights, float(b), slope, offset, marks)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic curve of y on x by Newton steps, classes weighted equally, with a small ridge."""
    a = np.stack([x, np.ones(len(x))], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-4 * b
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        b = b - np.linalg.solve(h, g)
    return float(max(b[0], 0.0)), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Model from docs (doc_id, text) and labels (doc_id, toxic) outside the held-out fold.

    The sample's ids are few by their bound, so they are broadcast; the documents are scanned once, not shuffled."""
    known = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    per = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not per:
        return train([], [])
    share = F.create_map(*[x for k, n in sorted(per.items()) for x in (F.lit(k), F.lit(min(1.0, rows_per_class / n)))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20) < share[F.col("toxic")])
    got = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.array_distinct(words("text")).alias("w")).toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("toxic").to_pylist(), got.column("w").to_pylist(), strict=True), key=lambda r: (r[0], r[1], r[2]))
    return train([r[2] for r in rows], [int(r[1]) for r in rows])


def score(docs: DataFrame, model: Model, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, score and the word with the highest margin, for every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = held.value, {}
        for b in batches:
            scores, worst = [], []
            bags = [units(x.as_py() or "") for x in b.column(1)]
            for lo in range(0, len(bags), 500):
                part = bags[lo : lo + 500]
                new = sorted(set().union(*part).difference(cache))
                if len(cache) + len(new) > cache_words:
                    cache.clear()
                    new = sorted(set().union(*part))
                cache.update(zip(new, m.margins([fold_word(x) for x in new]).tolist(), strict=True))
                for bag in part:
                    top = max(bag, key=lambda t: (cache[t], t)) if bag else ""
                    scores.append(m.probability(cache[top] if bag else FLOOR))
                    worst.append(top)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(worst, pa.string())], names=["doc_id", "score", "worst"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, worst string")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst")
