"""Language identification with spans (operator 9).

Words are runs of letters and marks, by Unicode category. The Unicode script ranges of a word's letters narrow its candidate languages to those
whose training text uses that script. Each candidate scores the word by smoothed log probabilities of its letter
trigrams (bytes, lower case, word edges included, hashed to a fixed table). Per text, Viterbi over the words with a
penalty for each switch labels spans; the text's language is the one whose spans hold most letters.

Most texts are in one language: prefix sums show when no run of words in another language gains more than half the
penalty, in which case the constant path is optimal and the recursion is left out.

The model is fitted on at most `sample_rows` labelled rows per language (chosen by a hash of the text, so by chance and
alike on each run); counts are summed on the executors and the driver sees one fixed table per language.

Defined results: null text, text without letters, or no language learned give `und`, score 0 and no span; ties go to
the language first in code-point order; null labels teach nothing; all columns are carried through unchanged."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieveline.llm.common import fold, table
from sieveline.llm.vec import buffers, slices

BUCKETS = 1 << 17
SAMPLE_ROWS = 3000
SWITCH, FLOOR, ALPHA = 12.0, -8.0, 0.05
UND = "und"

# First code points of blocks of one script, and a number for it (0: letters of no named script).
BLOCKS = [(0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 7), (0x780, 8), (0x900, 9), (0x980, 10), (0xA00, 11), (0xB80, 12), (0xC00, 13), (0xE00, 14), (0xE80, 15), (0xF00, 16), (0x1000, 17), (0x10A0, 18), (0x1100, 19), (0x1200, 20), (0x1380, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 1), (0x2C80, 0), (0x3005, 23), (0x3040, 21), (0x3100, 22), (0x3130, 19), (0x3190, 0), (0x31F0, 21), (0x3200, 0), (0x3400, 23), (0xA000, 22), (0xA4D0, 0), (0xAC00, 19), (0xD7B0, 0), (0xF900, 23), (0xFB00, 1), (0xFB07, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 1), (0xFF66, 21), (0xFFA0, 19), (0x10000, 0), (0x1D400, 1), (0x1D6A8, 2), (0x1D7CC, 0), (0x20000, 23), (0x40000, 0)]
N_SCRIPTS = 25


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """First code points of runs of one kind, and the kinds: 0 for what belongs to no word, else 1 + script, plus MARK for marks, which
    stand in words but are no letters."""
    starts, kinds = [], []
    of = np.zeros(0x40000, np.uint8)
    for (at, script), (end, _) in zip(BLOCKS, BLOCKS[1:], strict=False):
        of[at:end] = script
    for c in range(0x40000):
        category = unicodedata.category(chr(c))
        kind = int(of[c]) + 1 if category[0] == "L" else MARK + int(of[c]) + 1 if category[0] == "M" else 0
        if not kinds or kinds[-1] != kind:
            starts.append(c)
            kinds.append(kind)
    return np.array([*starts, 0x40000]), np.array([*kinds, 0], np.uint8)


MARK = 32
_STARTS, _CODES = _tables()


class Words:
    """Letter words of consecutive rows (lower-case UTF-8 bytes): start, end, row and script of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        d = data[offsets[0] : offsets[-1]]
        off = offsets - offsets[0]
        n = len(d)
        script = ((d >= 97) & (d <= 122) | (d >= 65) & (d <= 90)).astype(np.uint8) * np.uint8(2)
        lead = np.flatnonzero(d >= 0xC0)
        if len(lead):
            b = np.concatenate([d, np.zeros(3, np.uint8)]).astype(np.int64)
            b0, b1, b2, b3 = (b[lead + k] for k in range(4))
            point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
            code = _CODES[np.searchsorted(_STARTS, point, "right") - 1].astype(np.uint8)
            size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
            for k in range(4):
                at = lead[size > k] + k
                ok = at < n
                script[at[ok]] = code[size > k][ok]
        true = np.append(0, np.cumsum((script > 0) & (script < MARK)))
        self.has_letter = true[off[1:]] > true[off[:-1]]
        letter = script > 0
        script &= np.uint8(MARK - 1)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = letter[:-1], letter[1:]
        self.first = letter & (~before | edge[:n])
        self.last = letter & (~after | edge[1:])
        self.data, self.letter = d, letter
        self.start, self.end = np.flatnonzero(self.first), np.flatnonzero(self.last) + 1
        self.bounds = np.searchsorted(self.start, off)  # of rows, in words
        self.script = np.maximum.reduceat(script, self.start) if len(self.start) else np.zeros(0, np.uint8)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket per letter byte, index among letter bytes of each word's first byte)."""
        d = self.data.astype(np.uint32)
        before, after = np.zeros(len(d), np.uint32), np.zeros(len(d), np.uint32)
        before[1:], after[:-1] = d[:-1], d[1:]
        before[self.first], after[self.last] = 32, 32
        code = (before << np.uint32(16) | d << np.uint32(8) | after)[self.letter]
        bucket = (code * np.uint32(2654435761)) >> np.uint32(15)
        sizes = self.end - self.start
        at = np.zeros(len(sizes), np.int64)
        np.cumsum(sizes[:-1], out=at[1:])
        return bucket, at


class Model:
    """langs, log probabilities (BUCKETS x langs) and the scripts that each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, alpha: float = ALPHA):
        self.langs = langs
        p = (counts + alpha) / (counts.sum(1, keepdims=True) + alpha * BUCKETS) if len(langs) else np.zeros((0, BUCKETS))
        self.table = np.ascontiguousarray(np.log(p).astype(np.float32).T)
        self.uses = scripts >= 0.001 * np.maximum(1, scripts.sum(1, keepdims=True))

    def scores(self, w: Words, floor: float = FLOOR) -> np.ndarray:
        """Per word and language, from 0 for the best candidate down to floor."""
        if not len(w.start) or not self.langs:
            return np.zeros((len(w.start), len(self.langs)), np.float32)
        bucket, at = w.trigrams()
        s = np.add.reduceat(self.table[bucket], at, axis=0)
        ok = self.uses[:, w.script].T
        some = ok.any(1)
        s = np.where(ok, s, -np.inf)
        s -= np.where(some, s.max(1), 0)[:, None]
        s = np.maximum(s, floor)
        s[~some] = 0
        return s


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word on the best path."""
    n, k = s.shape
    total = s.sum(0, dtype=np.float64)
    best = int(total.argmax())
    c = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, k)), c[:-1]]), axis=0)
    if (c - low).max() <= penalty / 2:
        return np.full(n, best, np.int32)
    back: list[list[int]] = []
    v = s[0].tolist()
    for row in s[1:].tolist():
        top = max(v)
        arg = v.index(top)
        top -= penalty
        step = [arg if top > x else j for j, x in enumerate(v)]
        back.append(step)
        v = [(top if top > x else x) + y for x, y in zip(v, row, strict=True)]
    label = v.index(max(v))
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return np.array(out[::-1], np.int32)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from rows (text, lang); at most about sample_rows rows per language are read for it."""
    known = rows.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, N_SCRIPTS)))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample_rows / per[lang])))])
    sample = known.where((F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column(0).to_pylist(), dtype=object)
            data, offsets = buffers(_lower(b.column(1)))
            sums: dict[str, np.ndarray] = {}
            for lo, hi in slices(offsets):
                w = Words(data, offsets[lo : hi + 1])
                bucket, _ = w.trigrams()
                ends = np.zeros(len(w.start) + 1, np.int64)
                np.cumsum(w.end - w.start, out=ends[1:])
                size = ends[w.bounds]
                for i in range(hi - lo):
                    x = sums.setdefault(names[lo + i], np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    np.add.at(x, bucket[size[i] : size[i + 1]], 1)
                    x[BUCKETS:] += np.bincount(w.script[w.bounds[i] : w.bounds[i + 1]], minlength=N_SCRIPTS)
            for name, x in sums.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], names=["lang", "k", "n"])

    got = sample.mapInArrow(count, "lang string, k int, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    counts, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), N_SCRIPTS))
    of = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([of[x] for x in got.column("lang").to_pylist()], np.int64)
    k, n = got.column("k").to_numpy(), got.column("n").to_numpy()
    tri = k < BUCKETS
    counts[lang[tri], k[tri]] = n[tri]
    scripts[lang[~tri], k[~tri] - BUCKETS] = n[~tri]
    return Model(langs, counts, scripts)


def predict(docs: DataFrame, model: Model, penalty: float = SWITCH) -> DataFrame:
    """row struct of all columns of docs, lang_pred, score, spans (lang, first word, last word) and explained per row.

    explained: the part of the text's letters in words of a script that some learned language uses. score: the part of the text's letters in spans of lang_pred, times that language's posterior over the words."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    schema = StructType([rows.schema["row"], *StructType.fromDDL("lang_pred string, score double, spans array<struct<lang:string,first:int,last:int>>, explained double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            data, offsets = buffers(_lower(b.column(1)))
            pred, score, spans, explained = [], [], [], []
            for lo, hi in slices(offsets):
                w = Words(data, offsets[lo : hi + 1])
                s = m.scores(w)
                size = w.end - w.start
                used = np.append(0, np.cumsum(np.where(m.uses.any(0)[w.script], size, 0))) if m.langs else np.zeros(len(size) + 1)
                for i in range(hi - lo):
                    x, y = w.bounds[i], w.bounds[i + 1]
                    if not w.has_letter[i] or not m.langs:
                        pred.append(UND), score.append(0.0), spans.append([]), explained.append(0.0)
                        continue
                    part = s[x:y]
                    path = viterbi(part, penalty)
                    weight = np.bincount(path, weights=size[x:y], minlength=len(m.langs))
                    top = int(weight.argmax())
                    total = part.sum(0, dtype=np.float64)
                    # languages with spans of their own share the text and don't speak against the winner
                    rival = total[weight == 0]
                    odds = 1.0 / (1.0 + np.exp(np.minimum(rival - total[top], 50.0)).sum())
                    cut = np.flatnonzero(np.diff(path)) + 1
                    first, last = [0, *cut.tolist()], [*(cut - 1).tolist(), len(path) - 1]
                    pred.append(m.langs[top]), score.append(float(weight[top] / weight.sum() * odds))
                    explained.append(float((used[y] - used[x]) / size[x:y].sum()))
                    spans.append([{"lang": m.langs[path[a]], "first": a, "last": z} for a, z in zip(first, last, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind), pa.array(explained, pa.float64())], names=["row", "lang_pred", "score", "spans", "explained"])

    return rows.mapInArrow(run, schema)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), 5) != 0).select("text", "lang")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(train_rows(docs)))
    return out.select(F.col("row.doc_id").alias("doc_id"), (fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), "spans")
