"""Vector code compression by product quantisation with the filtering form of Lloyd's rounds (operator 13).

Vectors become integers, floor(1024 x), and are cut into `PARTS` equal parts, each with a codebook of `ENTRIES` entries. One pass
deals the vectors of each partition into chunks and orders every chunk's parts as a kd-tree: halves by the median of the widest
side, down to leaves of LEAF parts. The chunks are written once as a table, so that no round builds trees or reads vectors
again and a lost executor costs a re-read.

A round walks each tree from its root with the entries that can still be nearest. Of a node's entries the nearest to the middle of
its bounding box is compared with the others: an entry is out if it is nowhere in the box nearer, found at the one corner that favours it most. A
node with one entry left is assigned whole, by its cached sum and count; parts of the leaves that keep several are compared with those. A task
adds its chunks up and sends at most PARTS * ENTRIES sums; the driver holds the codebooks alone, whose size is fixed.

Distances are exact: 64-bit floats where every product fits their 53 bits, else Python integers.

Defined results: rows with null vectors, or with null or non-finite components, go, and count nowhere; with fewer than ENTRIES rows the
codebooks are as small; of rows with equal ids the first codebook takes the least vector first, null ids come last; repeated rows count
each; vectors shorter than the longest are filled up with zeros, also to a multiple of PARTS above 0; an empty table gives an empty
result; components beyond 2**62 / 1024 count as that much, errors beyond 64 bits as the largest long; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF, CHUNK_VALUES = 32, 1 << 18  # parts in a leaf; components in a chunk
BROADCAST_LABELS = 100_000
#: Labels with at least 1 / HOT of the rows are at most HOT and joined by broadcast.
HOT = 1000
FAR = 2.0**62
LONG = (1 << 63) - 1


def integers(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = np.floor(x.astype(np.float64) * SCALE)
    return np.clip(y, -FAR, FAR).astype(np.int64)


def kd_order(x: np.ndarray) -> np.ndarray:
    """Places of the rows of x, as the leaves of a kd-tree hold them; len(x) is LEAF times a power of two."""
    order = np.arange(len(x)).reshape(1, -1)
    while order.shape[1] > LEAF:
        y = x[order]
        wide = (y.max(1) - y.min(1)).argmax(1)
        along = np.take_along_axis(y, wide[:, None, None], 2)[:, :, 0]
        half = order.shape[1] // 2
        by = np.argpartition(along, half, axis=1)
        order = np.take_along_axis(order, by, 1).reshape(-1, half)
    return order.ravel()


def padded(rows: int) -> int:
    size = LEAF
    while size < rows:
        size *= 2
    return size


class Tree:
    """Boxes, sums and counts of all nodes over points in kd-order; the last points, beyond `rows`, weigh nothing."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, codes: np.ndarray):
        d = points.shape[1]
        most = max(int(np.abs(points).max(initial=0)), max((abs(int(v)) for v in codes.ravel()), default=0))
        kind = np.float64 if 16 * most * most * max(1, d) < 2**53 else object
        self.x, self.weight, self.codes = points.astype(kind), weight, codes.astype(kind)
        leaves = self.x.reshape(-1, LEAF, d)
        self.levels = [(leaves.min(1), leaves.max(1))]
        weighted = np.where(weight[:, None], self.x, 0)
        self.sums, self.counts = [weighted.reshape(-1, LEAF, d).sum(1)], [weight.reshape(-1, LEAF).sum(1)]
        while len(self.levels[0][0]) > 1:
            lo, hi = self.levels[0]
            self.levels.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))
            self.sums.insert(0, self.sums[0][::2] + self.sums[0][1::2])
            self.counts.insert(0, self.counts[0][::2] + self.counts[0][1::2])

    def walk(self) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """([(level, nodes, entry of each whole node)], leaf and entry of the pairs that are left at the leaves)."""
        z = self.codes
        square = (z * z).sum(1)
        node, entry = np.zeros(len(z), np.int64), np.arange(len(z))
        whole = []
        for level, (lo, hi) in enumerate(self.levels):
            start = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else node
            if not len(start):
                break
            group = np.cumsum(np.append(True, node[1:] != node[:-1])) - 1
            # nearest to the middle of the box, ties to the lower index, at twice the scale to stay whole
            d = ((2 * z[entry] - (lo + hi)[node]) ** 2).sum(1)
            near = np.flatnonzero(d == np.minimum.reduceat(d, start)[group])
            best = entry[near[np.searchsorted(group[near], np.arange(len(start)))]][group]
            u = z[entry] - z[best]
            gap = square[entry] - square[best] - 2 * (np.where(u > 0, hi[node], lo[node]) * u).sum(1)
            kept = (gap < 0) | ((gap == 0) & (entry <= best))
            node, entry, group = node[kept], entry[kept], group[kept]
            size = np.bincount(group, minlength=len(start))
            one = (size == 1)[group]
            whole.append((level, node[one], entry[one]))
            node, entry, size = node[~one], entry[~one], size[size > 1]
            if level + 1 < len(self.levels):  # each open node's entries go to both children
                begin = np.repeat(np.append(0, np.cumsum(size)[:-1]) if len(size) else size, 2)
                twice = np.repeat(size, 2)
                at = np.repeat(begin - np.append(0, np.cumsum(twice)[:-1]) if len(twice) else twice, twice) + np.arange(twice.sum())
                side = np.repeat(np.tile([0, 1], len(size)), twice)
                node, entry = 2 * node[at] + side, entry[at]
        return whole, node, entry

    def assigned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each point; sums and counts of each entry)."""
        whole, leaf, entry = self.walk()
        out = np.zeros(len(self.x), np.int64)
        sums = np.zeros(self.codes.shape, self.x.dtype)
        counts = np.zeros(len(self.codes), np.int64)
        for level, nodes, at in whole:
            np.add.at(sums, at, self.sums[level][nodes])
            np.add.at(counts, at, self.counts[level][nodes])
            span = len(self.x) // len(self.levels[level][0])
            out[(nodes[:, None] * span + np.arange(span)).ravel()] = np.repeat(at, span)
        leaves, of = np.unique(leaf, return_inverse=True)
        if len(leaves):
            points = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
            open_ = np.zeros((len(leaves), len(self.codes)), bool)
            open_[of, entry] = True
            x, z = self.x[points], self.codes
            d = (z * z).sum(1) - 2 * (x @ z.T)
            out[points] = at = np.where(np.repeat(open_, LEAF, 0), d, np.inf if d.dtype != object else 1 << 400).argmin(1)
            real = self.weight[points]
            np.add.at(sums, at[real], x[real])
            counts += np.bincount(at[real], minlength=len(counts))
        return out, sums, counts


def _chunks(kept: DataFrame, dims: int) -> DataFrame:
    """A row per chunk: ids, labels, and of each part position the rows' places in kd-order and the points so ordered."""
    spark = kept.sparkSession
    rows = 1 << max(6, (CHUNK_VALUES // max(1, dims)).bit_length() - 1)
    kinds = [kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    width = dims // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(batch: pa.Table) -> pa.RecordBatch:
            lists = batch.column(2).combine_chunks()
            size = lists.value_lengths().to_numpy()
            x = np.zeros((len(size), dims), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            x[row, np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(size)[:-1]) if len(size) else size, size)] = integers(lists.flatten().to_numpy(zero_copy_only=False))
            full = np.concatenate([x, np.repeat(x[:1], padded(len(x)) - len(x), 0)])
            orders, points = [], []
            small = np.int16 if len(x) and -(2**15) <= x.min() and x.max() < 2**15 else np.int64
            for p in range(PARTS):
                part = full[:, p * width : (p + 1) * width]
                order = kd_order(part) if width else np.arange(len(full))
                orders.append(order.astype(np.int32).tobytes())
                points.append(part[order].astype(small).tobytes())
            ids, labels = (batch.column(k).combine_chunks() for k in range(2))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays([one(ids), one(labels), pa.array([np.dtype(small).itemsize], pa.int32()), pa.array([orders], pa.list_(pa.binary())), pa.array([points], pa.list_(pa.binary()))], names=["ids", "labels", "bytes", "orders", "points"])

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= rows:
                t = pa.Table.from_batches(held)
                whole = len(t) // rows * rows
                for at in range(0, whole, rows):
                    yield out(t.slice(at, rows))
                held = t.slice(whole).to_batches()
        t = pa.Table.from_batches(held) if held else None
        if t is not None and len(t):
            yield out(t)

    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, bytes int, orders array<binary>, points array<binary>")


def _trees(batch: pa.RecordBatch, i: int, codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, Tree]]:
    """(order, tree) of each part position of chunk i of a batch."""
    rows = len(batch.column("ids")[i].values)
    kind = np.int16 if batch.column("bytes")[i].as_py() == 2 else np.int64
    for p, c in enumerate(codes):
        order = np.frombuffer(batch.column("orders")[i].values[p].as_py(), np.int32)
        points = np.frombuffer(batch.column("points")[i].values[p].as_py(), kind).reshape(len(order), -1)
        yield order, Tree(points.astype(np.int64), order < rows, c)


def improved(chunks: DataFrame, codes: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all chunks."""
    held = chunks.sparkSession.sparkContext.broadcast(codes)
    width = codes[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = held.value
        sums, counts = np.zeros((PARTS, *z[0].shape), object), np.zeros((PARTS, len(z[0])), np.int64)
        for b in batches:
            for i in range(len(b)):
                for p, (_, tree) in enumerate(_trees(b, i, z)):
                    _, s, n = tree.assigned()
                    sums[p] += s if s.dtype == object else s.astype(np.int64).astype(object)
                    counts[p] += n
        part, entry = np.nonzero(counts)
        lists = pa.array([[Decimal(int(v)) for v in x] for x in sums[part, entry]], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), lists], names=["part", "entry", "n", "s"])

    sums = chunks.mapInArrow(run, "part int, entry int, n bigint, s array<decimal(38,0)>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).cast("decimal(38,0)").alias(f"s{j}") for j in range(width)])
    out = [c.copy() for c in codes]
    for r in sums.collect():  # a row for each entry at most
        out[r["part"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    held.unpersist()
    return out


def coded(chunks: DataFrame, codes: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of all rows of the chunks."""
    held = chunks.sparkSession.sparkContext.broadcast(codes)
    kinds = [chunks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = held.value
        for b in batches:
            for i in range(len(b)):
                ids, labels = b.column("ids")[i].values, b.column("labels")[i].values
                code, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), object)
                for p, (order, tree) in enumerate(_trees(b, i, z)):
                    at, _, _ = tree.assigned()
                    d = ((tree.x - tree.codes[at]) ** 2).sum(1)
                    code[order[tree.weight], p] = at[tree.weight]
                    error[order[tree.weight]] += (d if d.dtype == object else d.astype(np.int64).astype(object))[tree.weight]
                text = [x.hex() for x in map(bytes, code)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(np.minimum(error, LONG).astype(np.int64))], names=["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error) of the kept rows of vectors (vec_id, embedding, label), the final codebooks)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & good)
    dims = -(-(kept.agg(F.max(F.size("embedding"))).first()[0] or 1) // PARTS) * PARTS
    width = dims // PARTS
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    start = np.zeros((len(first), dims), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r[0])] = integers(np.array(r[0], np.float64))
    codes = [start[:, p * width : (p + 1) * width].astype(object) for p in range(PARTS)]
    chunks = cut(_chunks(kept, dims))
    if len(first):
        for _ in range(rounds):
            codes = improved(chunks, codes)
    return cut(coded(chunks, codes)), codes


def digest(codes: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for c in codes for v in c.ravel()).encode()).hexdigest()


def with_label_error(rows: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """rows (label, error, ...) with label_error, the sum of the errors of equal labels; labels that many rows have are joined by broadcast."""
    sums = cut(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("s"), F.count("*").alias("k")))
    sums = sums.select(F.col("label").alias("of"), F.least(F.col("s"), F.lit(Decimal(LONG))).cast("bigint").alias("label_error"), "k")
    same = F.col("label").eqNullSafe(F.col("of"))
    size = sums.agg(F.sum("k"), F.count("*")).first()
    if size[1] <= broadcast_labels:
        return rows.join(F.broadcast(sums), same).drop("of", "k")
    hot = F.broadcast(sums.where(F.col("k") * HOT >= size[0]))
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(sums, same)).drop("of", "k")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codes = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(digest(codes)).alias("codebooks_sha256"))
