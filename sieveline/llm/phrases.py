"""Phrase collocation mining by level-wise Apriori passes (operator 11).

Pass k counts the phrases of k words: a k-gram is emitted only where both (k-1)-grams that overlap in it are frequent, which
each task tests in a broadcast bitmap of the frequent (k-1)-grams' hashes. The bitmap has `BITS_PER_GRAM` bits a gram, from 2**16 to
`2**MAX_LOG_BITS` in all, and is filled by tasks, a block each, so neither it nor what the driver fetches grows beyond that. It prunes
and never decides: a false hit emits a phrase whose exact count then falls short, so results are exact also where it is full; beyond it
only the saving shrinks, and what is shuffled stays linear in the input.

Counts are by the phrase's text, summed within a slice of texts, then within the task, then in the shuffle, so that a
language or word that has most of the rows arrives as one row a task. Every phrase of at least `least` occurrences stands in
the table of its level. All parts of such a phrase are as frequent and stand there too, so the cuts are scored from the level tables alone: a join
of each cut's two parts with them. A part that is very common may belong to many phrases: parts that have a thousandth of all
words are at most 1000 a level and joined by broadcast, and each other part has at most 4 * (N / 1000) / least phrases.

A phrase inside a longer one of the same count is dropped; as counts never rise with length, it is enough to look one word further.

Defined results: null text is empty; null language is `und`, together with rows that say `und`; repeated rows count each; ids and other
columns are not read; ties as in `scored`; an empty table gives an empty result. Scores are exact (decimals of 38 digits)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import cut, free, table
from sieveline.llm.scan import Words, classes, gram_keys
from sieveline.llm.vec import U, buffers, mix, slices

LEAST, LONGEST, TOP = 100, 5, 2000
BITS_PER_GRAM, MAX_LOG_BITS, LOG_BLOCK = 16, 28, 16
#: Parts with at least 1 / HOT of all words are at most HOT a level.
HOT = 1000
STEP = 1 << 21  # bytes of text whose phrases are summed before they leave Python
KIND = classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Frequent:
    """Bitmap of hashes; `__contains__` by two probes."""

    def __init__(self, log_bits: int, bits: np.ndarray):
        self.log_bits, self.bits = log_bits, bits

    @staticmethod
    def places(key: np.ndarray, log_bits: int) -> np.ndarray:
        h = mix(key ^ U(0xA0761D6478BD642F))
        mask = U((1 << log_bits) - 1)
        return np.stack([h & mask, (h >> U(32)) & mask]).astype(np.int64)

    def has(self, key: np.ndarray) -> np.ndarray:
        hit = np.ones(len(key), bool)
        for at in self.places(key, self.log_bits):
            hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return hit


def _seeds(langs: pa.Array) -> np.ndarray:
    """A seed per row."""
    coded = pc.dictionary_encode(langs)
    return np.array([_seed(x) for x in coded.dictionary.to_pylist()], U)[coded.indices.to_numpy(zero_copy_only=False)] if len(langs) else np.zeros(0, U)


def _emitted(docs: DataFrame, k: int, known: Broadcast | None) -> DataFrame:
    """(lang, phrase, n) of each slice of texts; phrase null: the number of its words (with k = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0)
            seeds = _seeds(langs)
            data, offsets = buffers(b.column(1))
            for lo, hi in slices(offsets, STEP):
                t = Words(data, offsets[lo : hi + 1], KIND)
                seed = seeds[lo:hi][t.doc]
                h = t.hashes() ^ seed
                if k == 1:
                    at = np.arange(len(h))
                else:
                    shorter = np.flatnonzero(t.runs(k - 1))
                    frequent = np.zeros(len(h) + 1, bool)
                    frequent[shorter] = known.value.has(gram_keys(h, shorter, k - 1))
                    at = np.flatnonzero(t.runs(k) & frequent[:-1] & frequent[1:])
                _, first, n = np.unique(gram_keys(h, at, k), return_index=True, return_counts=True)
                at = at[first]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lo + t.doc[at])), t.joined(at, k), pa.array(n)], names=["lang", "phrase", "n"])
                if k == 1:
                    rows = np.flatnonzero(t.count)
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(lo + rows)), pa.nulls(len(rows), pa.string()), pa.array(t.count[rows])], names=["lang", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, n bigint")


def _bitmap(level: DataFrame, k: int, grams: int) -> Frequent:
    """Of the phrases of level (lang, phrase, n)."""
    log_bits = min(MAX_LOG_BITS, max(LOG_BLOCK, int(np.ceil(np.log2(max(1, grams * BITS_PER_GRAM))))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Words(*buffers(b.column(1)), KIND)
            key = gram_keys(t.hashes() ^ _seeds(b.column(0))[t.doc], t.first[:-1], k)
            at = np.unique(Frequent.places(key, log_bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> LOG_BLOCK).astype(np.int32)), pa.array((at & ((1 << LOG_BLOCK) - 1)).astype(np.int32))], names=["block", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            block, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for x in np.unique(block).tolist():
                held.setdefault(x, np.zeros(1 << LOG_BLOCK, bool))[at[block == x]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    got = level.select("lang", "phrase").mapInArrow(places, "block int, at int").repartition("block").mapInArrow(fill, "block int, bits binary").toArrow()
    bits = np.zeros(1 << (log_bits - 3), np.uint8)
    size = 1 << (LOG_BLOCK - 3)
    for block, part in zip(got.column("block").to_pylist(), got.column("bits").to_pylist(), strict=True):
        bits[block * size : (block + 1) * size] = np.frombuffer(part, np.uint8)
    return Frequent(log_bits, bits)


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, n) of all phrases of 1 to longest words with n >= least; (lang, total) number of words), from docs (lang, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].alias("text"))
    tables, known = [], None
    for k in range(1, longest + 1):
        counted = _emitted(docs, k, known).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())
        level = cut(counted.withColumn("k", F.lit(k)))
        tables.append(level)
        grams = level.where("phrase is not null").count()
        if known:
            known.unpersist()
        if not grams or k == longest:
            break
        known = spark.sparkContext.broadcast(_bitmap(level.where("phrase is not null"), k, grams))
    every = tables[0]
    for x in tables[1:]:
        every = every.unionByName(x)
    totals = cut(every.where("phrase is null").select("lang", F.col("n").alias("total")))
    grams = cut(every.where("phrase is not null"))
    free(*tables)
    return grams, totals


def _counted(rows: DataFrame, grams: DataFrame, hot: DataFrame, part: str, name: str) -> DataFrame:
    """rows (lang, part, ...) with the count of each part; hot: the grams that many rows may have, few by construction."""
    keys = ["lang", part]
    some = F.broadcast(hot.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)))
    rest = grams.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    return rows.join(some, keys).unionByName(rows.join(some, keys, "left_anti").join(rest, keys))


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer one of the same count contains: its lowest-scoring cut, ties to the first."""
    n_all = totals.agg(F.sum("total")).first()[0] or 0
    hot = cut(grams.where(F.col("n") * HOT >= n_all))
    w = F.split("phrase", " ")
    longer = grams.where("k > 2").select("lang", "n", F.explode(F.array(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1))).alias("w"))
    inside = longer.select("lang", F.array_join("w", " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    open_ = grams.where("k > 1").join(inside, ["lang", "phrase"], "left").where("most is null or most < n")
    cuts = open_.select("lang", "phrase", F.col("n").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("cut"))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = cut(cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("tail")))
    cuts = cut(_counted(cuts, grams, hot, "head", "l"))
    cuts = _counted(cuts, grams, hot, "tail", "r").join(totals, "lang")
    exact = F.expr("cast((cast(1000 * a as decimal(20, 0)) * cast(total as decimal(18, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as bigint)")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def top(found: DataFrame, most: int = TOP) -> DataFrame:
    """The first `most` phrases of each language, ranked from 1; tasks pass on that many of a language at most."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams, totals = levels(table(spark, sf_dir, "documents").select("lang", "text"))
    out = top(scored(grams, totals))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
