"""Document quality by hierarchical empirical Bayes (operator 8).

A logistic classifier on surface statistics of the whole text gives each document its evidence: the log odds of good
against bad, less the odds of the training sample. Hosts and the paths below them give the prior. Every document counts
towards its path and host with its classifier probability; two beta priors, one of hosts around the corpus mean and one
of paths around their host's mean, have strengths fitted by the method of moments over the groups, so that a sparse site
leans on its host and a sparse host on the corpus. A document's own count is taken out of its site before the site
speaks about it. Posterior log odds are the evidence plus the log odds of that prior.

Spark plan: one scan writes (row, site, evidence) as a table; two grouped sums with map-side combine give the sites, so a
host with a third of all rows costs each task one partial row; sites are broadcast up to `broadcast_rows`, else
joined by shuffle, in which AQE splits a hot site. The classifier is fitted on at most about `rows_per_class` labelled
rows of each class, chosen by a hash; everything else covers all rows.

Defined results: null and empty texts have the statistics of an empty text; null host or path is a site of its own; with
no labels of both classes the evidence is 0 and the score the share of class 1 in the sample (0.5 without labels);
repeated rows count each and score alike; ids may repeat or be null; other columns are not read; an empty table gives an
empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, fold, table
from sieveline.llm.vec import buffers, slices

ROWS_PER_CLASS = 4000
BROADCAST_ROWS = 200_000
#: Bounds of the fitted strengths (pseudo-documents) and of evidence and prior in log odds.
STRENGTH, EVIDENCE, PRIOR = (1.0, 1000.0), 12.0, 4.0

_CLASS = np.zeros(256, np.int64)  # 0 other marks, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 quote or bracket, 8 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]], _CLASS[128:] = 1, 2, 3, 4, 5, 8
_CLASS[[ord(c) for c in ".,;:?"]], _CLASS[[ord(c) for c in "'\"()-"]] = 6, 7
STATS = 9 + 8


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS numbers per text: shares of byte classes, and what its words look like."""
    d = data[offsets[0] : offsets[-1]]
    off = offsets - offsets[0]
    n, rows = len(d), len(off) - 1
    size = np.diff(off)
    c = _CLASS[d]
    row = np.repeat(np.arange(rows), size)
    share = np.bincount(row * 9 + c, minlength=rows * 9).reshape(rows, 9).astype(float)
    solid = (c != 4) & (c != 5)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = solid[:-1], solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    end = np.flatnonzero(solid & (~after | edge[1:]))
    first, last, at, length = c[start], c[end], row[start], end - start + 1
    letters = np.isin(c, (1, 2, 8))
    seen = np.zeros(n + 1, np.int64)
    np.cumsum(letters, out=seen[1:])
    with_letters = seen[end + 1] - seen[start]
    per = lambda x: np.bincount(at, weights=x.astype(float), minlength=rows)
    tokens = np.maximum(1, np.bincount(at, minlength=rows)).astype(float)
    upper = np.zeros(n + 1, np.int64)
    np.cumsum(c == 2, out=upper[1:])
    shout = (with_letters > 1) & (2 * (upper[end + 1] - upper[start]) > with_letters)
    words = [per(last == 0), per(first == 0), per(with_letters == 0), per(shout), per(last == 6), per(length > 20), per((first == 2) & ~shout)]
    mean = np.log1p(per(length) / tokens)
    return np.hstack([share / np.maximum(1, size)[:, None], np.stack([w / tokens for w in words] + [mean], 1)])


def _spread(x: np.ndarray) -> np.ndarray:
    """The statistics and their square roots: small shares matter most near 0."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


@dataclass
class Classifier:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    base: float  # log odds of the training sample, as weighted

    def evidence(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((_spread(stats) - self.centre) / self.scale, -8, 8)
        return np.clip(z @ self.weights + self.bias - self.base, -EVIDENCE, EVIDENCE)


def train(stats: np.ndarray, y: np.ndarray, ridge: float = 2e-3, steps: int = 40) -> Classifier:
    """Logistic regression by Newton steps; both classes weigh the same, so its base odds are even."""
    k = 2 * STATS
    if len(set(y.tolist())) < 2:
        return Classifier(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.0)
    x = _spread(stats)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - centre) / scale, -8, 8)
    a = np.hstack([z, np.ones((len(z), 1))])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    penalty = np.array([ridge] * k + [1e-6])
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        w = w - np.linalg.solve(hess, grad)
    return Classifier(centre, scale, w[:k], float(w[k]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[Classifier, float]:
    """(classifier, share of class 1) from docs (doc_id, text) and labels (doc_id, quality) outside the held-out fold.

    Statistics of the sampled rows are made on the executors; the driver gets STATS numbers for each, as many rows as the bound allows."""
    known = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    per = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not per:
        return train(np.zeros((0, STATS)), np.zeros(0)), 0.5
    share = F.create_map(*[x for k, n in sorted(per.items()) for x in (F.lit(k), F.lit(min(1.0, rows_per_class / n)))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20) < share[F.col("y")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(2))
            for lo, hi in slices(offsets):
                x = statistics(data, offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y int, x array<double>").toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("y").to_pylist(), got.column("x").to_pylist(), strict=True))
    total = sum(per.values())
    return train(np.array([r[2] for r in rows]).reshape(-1, STATS), np.array([r[1] for r in rows])), per.get(1, 0) / total


def _logit(p: Column) -> Column:
    return F.greatest(F.lit(-PRIOR), F.least(F.lit(PRIOR), F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-documents of the beta prior of group means k/n around mean, by the method of moments over all groups."""
    m = F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))
    r = groups.select(m.alias("m"), "n", (F.col("k") / F.col("n")).alias("p")).agg(
        F.sum(F.col("n") * F.pow(F.col("p") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))).alias("s"), F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn")
    ).first()
    if not r["g"] or r["n"] <= r["g"]:
        return STRENGTH[1]
    rho = (r["s"] - r["g"]) / (r["n"] - r["g"])  # part of the binomial variance that lies between groups
    return STRENGTH[1] if rho <= 0 else float(min(STRENGTH[1], max(STRENGTH[0], 1 / rho - 1)))


def posteriors(docs: DataFrame, model: Classifier, base: float, host: str = "source", path: str = "lang", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, evidence, prior, score per row of docs (doc_id, text, host column, path column)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    src = docs.select(docs["doc_id"].alias("doc_id"), docs[host].cast("string").alias("h"), docs[path].cast("string").alias("p"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(3))
            for lo, hi in slices(offsets):
                e = held.value.evidence(statistics(data, offsets[lo : hi + 1]))
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(lo, hi - lo) for k in range(3)], pa.array(e)], names=["doc_id", "h", "p", "e"])

    odds = float(np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
    seen = cut(src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, h string, p string, e double"))
    seen = seen.withColumn("q", 1 / (1 + F.exp(-(F.col("e") + odds))))
    paths = cut(seen.groupBy("h", "p").agg(F.count("*").alias("n"), F.sum("q").alias("k")))
    hosts = paths.groupBy(F.col("h").alias("hh")).agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hk").alias("k")).first()
    mean = total["k"] / total["n"] if total["n"] else base
    s_host = _strength(hosts.select(F.col("hn").alias("n"), F.col("hk").alias("k")), F.lit(mean))
    sites = cut(paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).select(F.col("h").alias("sh"), F.col("p").alias("sp"), "n", "k", "hn", "hk"))
    s_path = _strength(sites, (F.col("hk") + s_host * mean) / (F.col("hn") + s_host))
    few = sites.count() <= broadcast_rows
    joined = seen.join(F.broadcast(sites) if few else sites, F.col("h").eqNullSafe(F.col("sh")) & F.col("p").eqNullSafe(F.col("sp")))
    host_mean = (F.col("hk") - F.col("q") + s_host * mean) / (F.col("hn") - 1 + s_host)
    path_mean = (F.col("k") - F.col("q") + s_path * host_mean) / (F.col("n") - 1 + s_path)
    prior = F.least(F.lit(1.0), F.greatest(F.lit(0.0), path_mean))
    return joined.select("doc_id", F.col("e").alias("evidence"), prior.alias("prior")).withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("prior"))))))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, evidence, prior, score (probability of quality 1) and keep (score >= 0.5) for all documents."""
    docs = table(spark, sf_dir, "documents")
    model, base = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    out = posteriors(docs, model, base)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "evidence", "prior", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
