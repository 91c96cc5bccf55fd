"""Language-model scoring from a log-frequency Bloom filter (operator 3).

Training counts words and word pairs over all training texts. A count c is quantised to a level q (1, 2, 3, 4, 6, 8, 12,
16, ...: half octaves) and the filter stores the entries (gram, 1) .. (gram, q); a lookup probes levels upwards until
one is missing, so a false positive can only raise a count, and by a level at a time. Every gram is stored. An entry sets MARKS bits in one
word of 64 bits; the first entry of a gram, which tells seen from unseen, does so in STRONG words.

Probability of word w after v: (c(vw) + d(v) * p(w)) / (C(v) + d(v)), where p(w) = (c(w) + 0.1) / (Q + 0.1 * (V + 1)); c are quantised
counts, Q is their sum over all words, C(v) the sum of the quantised counts of v's pairs, d(v) the number of v's distinct followers. Unseen v:
p(w). So each context's probabilities sum up to 1 but for false hits and the error of C(v), which is stored with STEPS
steps in each level (under 1 % off). C and d lie in a second filter of the same kind. The model has no tables beside the filters.

The filters are tables of blocks of bounded size; their number follows the input. A block is built by one task, from sorted rows, one
after another. What is broadcast is a filter of the commonest items of each part of the blocks, at most `filter_mb` in all; if that is all
of them, every lookup ends there. If not, what a window of texts still lacks, each gram once, is sent to its block by a shuffle, probed there beside
the block's bits, and the levels are sent back to the window. So time and traffic are linear in the input, and the driver never holds more than `filter_mb`
of the filter. A very common gram is found in the broadcast filter; one that is not comes once a window.

The base score needs exact counts of all words: those of the `common` commonest are looked up in a broadcast table, the others
meet the count table in a join on the word's hash, whose keys are rare by construction. Both are exact.

`fit` and `score` are for a model that meets other texts. `score_all` is for texts that are scored by a model of their own (op3): what a window
tells a block to count is what it will look up there, so both go in one shuffle. A block is that of the word before, so that a context's sums are made where
its pairs are; contexts that are too common for one block (`wide`) are dealt by pair, and their sums added up. The block's filter is built, probed by each
window's pairs and dropped; the codes go back to the window. Packed rows of (window, block) stand for pairs, words by their rank where they are common.

Hashes have 64 bits.

Defined results: null text is empty and scores its one end token; without training texts N = V = 0 and every token has
probability 1 / (V + 1) = 1; ids may repeat or be null (rows are told apart by a row number)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, fold, table
from sieveline.llm.vec import Tokens, U, buffers, mix, slices

#: MB of the broadcast filters.
FILTER_MB = 16
#: Most training tokens whose grams go to one block; from MAX_TASKS blocks on, a filling task has several.
TOKENS_PER_BLOCK, MAX_TASKS = 400_000, 4096
COMMON = 1 << 19
END, START = U(0x51AFD7ED558CCD25), U(0x2545F4914F6CDD1D)
#: Salts of the keys of a context's sum and of its number of followers.
CONTEXT, FOLLOWERS = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
#: Least count of each level, and how many counts it has; parts of a level in which a fine number is kept.
LEVELS = np.array(sorted({1, *(2**k for k in range(1, 40)), *(3 * 2**k for k in range(40))}), np.int64)
WIDTHS = np.append(np.diff(LEVELS), LEVELS[-1])
STEPS = 32
_SALT = mix(np.arange(1, len(LEVELS) + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_FINE, _PLACE = U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)
#: Bits that an entry sets in a word of 64, words that a strong entry sets, and bits set per bit of the filter.
MARKS, STRONG, LOAD = 5, 4, 0.4
WINDOW = 1_500_000  # tokens whose counts are summed before they leave a task
SCORED = 400_000  # tokens of which each gram is looked up once
PROBED = 1 << 17  # keys probed at a time, so that work arrays stay small
SENT, SENT_PER_BLOCK = 1_000_000, 1_000_000  # tokens of a window of score_all, and of one of its blocks


def sequence(t: Tokens, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token with an end after each row's last, hash of the one before it, row)."""
    n = len(t.count)
    seq = np.empty(len(h) + n, U)
    seq[np.arange(len(h)) + t.doc] = h
    ends = t.first[1:] + np.arange(n)
    seq[ends] = END
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    if n:
        before[0] = START
        before[ends[:-1] + 1] = START
    return seq, before, np.repeat(np.arange(n), t.count + 1)


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) + word)


def _block(key: np.ndarray, blocks: int) -> np.ndarray:
    """The leading bits of the key (blocks is a power of two), so that rows sorted by key are sorted by block."""
    return (key >> U(65 - int(blocks).bit_length())).astype(np.int32)


def _level(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, n, "right") - 1


def _step(n: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Place of n within its level, in STEPS parts (exact while the level has no more counts than that)."""
    over, width = n - LEVELS[level], WIDTHS[level]
    return np.where(width <= STEPS, over, over * STEPS // width)


def value(code: np.ndarray, fine: bool) -> np.ndarray:
    """The number that a code (level + 1) * STEPS + step stands for: the least of its level, or the middle of its step; 0 for code 0."""
    code = code.astype(np.int64)
    level, step = code // STEPS - 1, code % STEPS
    least, width = LEVELS[level].astype(float), WIDTHS[level]
    if fine:
        least = least + np.where(width <= STEPS, step, (step + 0.5) * width / STEPS)
    return np.where(code > 0, least, 0.0)


def _entries(key: np.ndarray, n: np.ndarray, fine: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """(entry keys, whether strong) of all entries of items: a chain up to the level, and for fine ones a chain of steps."""
    last = _level(n)
    at = np.arange(len(key))
    for level in range(int(last.max(initial=-1)) + 1):
        at = at[last[at] >= level]
        strong = fine[at] | (level == 0)
        yield mix(key[at[strong]] ^ _SALT[level]), True
        yield mix(key[at[~strong]] ^ _SALT[level]), False
    at = np.flatnonzero(fine)
    step, base = _step(n[at], last[at]), mix(key[at] ^ _SALT[last[at]] ^ _FINE)
    for i in range(1, int(step.max(initial=0)) + 1):
        base, step = base[step >= i], step[step >= i]
        yield mix(base ^ _SALT[i]), True


def _marks(entry: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """(32 bits that choose a word, mask of MARKS bits in it) of entries."""
    g = mix(entry + U(place) * _PLACE) if place else entry
    mask = U(1) << (g & U(63))
    for i in range(1, MARKS):
        mask |= U(1) << ((g >> U(6 * i)) & U(63))
    return g >> U(32), mask


def _bits(key: np.ndarray, n: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """A filter (words of 64 bits) of items; its size follows what they store."""
    entries = list(_entries(key, n, fine))
    marks = sum(len(e) * (STRONG if strong else 1) for e, strong in entries) * MARKS
    words = np.zeros(int(marks / (64 * LOAD)) + 1, U)
    for e, strong in entries:
        for place in range(STRONG if strong else 1):
            at, mask = _marks(e, place)
            np.bitwise_or.at(words, (at % U(len(words))).astype(np.int64), mask)
    return words


def _cost(n: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """Bits of a filter that each item takes."""
    level = _level(n)
    return (np.where(fine, level + 1 + _step(n, level), 1) * STRONG + np.where(fine, 0, level)) * MARKS / LOAD


def _probe(key: np.ndarray, fine: bool, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Code of each key, by membership probes upwards from the first level; the filter of key i is words[start[i]:][:size[i]]."""
    out = np.zeros(len(key), np.uint16)

    def found(entry: np.ndarray, at: np.ndarray, strong: bool) -> np.ndarray:
        left = np.arange(len(at))
        for place in range(STRONG if strong else 1):
            where, mask = _marks(entry[left], place)
            i = at[left]
            left = left[(words[start[i] + (where % size[i]).astype(np.int64)] & mask) == mask]
        return left

    for lo in range(0, len(key), PROBED):
        at = np.arange(lo, min(lo + PROBED, len(key)))
        for level in range(len(LEVELS)):
            at = at[found(mix(key[at] ^ _SALT[level]), at, fine or level == 0)]
            if not len(at):
                break
            out[at] = (level + 1) * STEPS
        if fine:
            at = lo + np.flatnonzero(out[lo : lo + PROBED])
            base = mix(key[at] ^ _SALT[out[at] // STEPS - 1] ^ _FINE)
            for i in range(1, STEPS):
                left = np.flatnonzero(WIDTHS[out[at] // STEPS - 1] > i)
                at, base = at[left], base[left]
                left = found(mix(base ^ _SALT[i]), at, True)
                at, base = at[left], base[left]
                if not len(at):
                    break
                out[at] += np.uint16(1)
    return out


def _counts(docs: DataFrame, pairs: bool) -> DataFrame:
    """(key, v, n) summed per task window over docs (text): words (v is 0), or pairs with the word v before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        prior: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            key, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            v = np.concatenate(prior)[first].view(np.int64) if pairs else np.zeros(len(key), np.int64)
            held.clear()
            prior.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(v), pa.array(n)], names=["key", "v", "n"])

        for b in batches:
            data, offsets = buffers(b.column(0))
            for lo, hi in slices(offsets):
                t = Tokens(data, offsets[lo : hi + 1])
                seq, before, _ = sequence(t, t.hashes())
                held.append(pair_key(before, seq) if pairs else seq)
                if pairs:
                    prior.append(before)
                if sum(map(len, held)) > WINDOW:
                    yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "key bigint, v bigint, n bigint")


class Filter:
    """A log-frequency filter: a table (block, bits) of all items in blocks, and in memory one of the commonest items (`words`), which has
    all of them if `whole`. Parts are the classes of blocks modulo `parts`."""

    def __init__(self, table: DataFrame, blocks: int, parts: int):
        self.blocks, self.parts = blocks, parts
        self.table = table.where("block >= 0").select("block", "bits")
        hot = table.where("block = -1").select("part", "bits", "whole").toArrow()
        self.whole = all(hot.column("whole").to_pylist())
        bits: list[np.ndarray] = [np.zeros(1, U)] * parts
        for part, b in zip(hot.column("part").to_pylist(), hot.column("bits").to_pylist(), strict=True):
            bits[part] = np.frombuffer(b, U)
        self.size = np.array([len(x) for x in bits], U)
        self.start = np.append(0, np.cumsum([len(x) for x in bits]))[:-1]
        self.words = np.concatenate(bits)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def probe(self, key: np.ndarray, fine: bool) -> np.ndarray:
        part = _block(key, self.blocks) % self.parts
        return _probe(key, fine, self.words, self.start[part], self.size[part])


def _fill(items: DataFrame, blocks: int, quota_bits: int, contexts: bool) -> tuple[DataFrame, int]:
    """(table, parts) of the filter of items (key, v, n): v is the word before for pairs and 0 for words; of contexts' numbers, 1 for fine ones. The table's rows are (part, block, bits), (part, -1, bits of
    the part's commonest items within its share of quota_bits, whole: whether these are all), and (null, -2, v, c, d): quantised counts and number of v's followers."""
    parts = min(blocks, MAX_TASKS)
    quota = quota_bits / parts
    names = ["part", "block", "bits", "whole", "v", "c", "d"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        hot: list[np.ndarray] = []
        now, part, whole = -1, -1, True

        def row(p: int, block: int, bits: np.ndarray, all_of_it: bool | None) -> pa.RecordBatch:
            none = pa.nulls(1, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary()), pa.array([all_of_it], pa.bool_()), none, none, none], names=names)

        def trim() -> None:
            nonlocal hot, whole
            order = np.argsort(-hot[1], kind="stable")
            keep = order[np.cumsum(_cost(hot[1][order], hot[2][order])) <= quota]
            whole &= len(keep) == len(order)
            hot = [x[keep] for x in hot]

        def block_done() -> Iterator[pa.RecordBatch]:
            nonlocal hot
            key, n, fine, pair, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key = key.view(U)
            yield row(part, now, _bits(key, n, fine), None)
            hot = [np.concatenate(x) for x in zip(hot, [key, n, fine], strict=True)] if hot else [key, n, fine]
            if _cost(hot[1], hot[2]).sum() > 2 * quota:
                trim()
            if pair.any():
                u, i = np.unique(v[pair], return_inverse=True)
                c, d = np.bincount(i, LEVELS[_level(n[pair])]).astype(np.int64), np.bincount(i)
                k = len(u)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.array(np.full(k, -2, np.int32)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.bool_()), pa.array(u), pa.array(c), pa.array(d)], names=names)

        def part_done() -> Iterator[pa.RecordBatch]:
            nonlocal hot, whole
            trim()
            yield row(part, -1, _bits(*hot), whole)
            hot, whole = [], True

        for b in batches:
            key, n, v = (b.column(i).to_numpy() for i in range(3))
            block, some = _block(key.view(U), blocks), v != 0
            cols = [key, n, some & contexts, some & (not contexts), v]
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if now >= 0 and block[lo] != now:
                    yield from block_done()
                    if block[lo] % parts != part:
                        yield from part_done()
                now = int(block[lo])
                part = now % parts
                held.append([x[lo:hi] for x in cols])
        if now >= 0:
            yield from block_done()
            yield from part_done()

    part = F.shiftrightunsigned("key", 65 - blocks.bit_length()) % parts
    rows = items.withColumn("part", part.cast("int")).repartition(parts, "part").groupBy("part", "key", "v").agg(F.sum("n").alias("n"))
    rows = rows.sortWithinPartitions("part", "key").select("key", "n", "v")
    return cut(rows.mapInArrow(fill, "part int, block int, bits binary, whole boolean, v bigint, c bigint, d bigint")), parts


def _salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of contexts (key, v, n) with keys that tell fine ones (v is 1) from others."""
    for b in batches:
        k = mix(b.column(0).to_numpy().view(U) ^ np.where(b.column(1).to_numpy() == 1, CONTEXT, FOLLOWERS))
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *b.columns[1:]], names=["key", "v", "n"])


def probability(quantised: int, v: int, word: np.ndarray, pair: np.ndarray, context: np.ndarray, followers: np.ndarray) -> np.ndarray:
    """p(w after v) from the codes of w, their pair, v's sum and v's number of followers; quantised: the sum of all words' quantised counts, v: their number."""
    c = value(word, False)
    pw = (c + 0.1) / (quantised + 0.1 * (v + 1))
    total, d = value(context, True), value(followers, False)
    both = np.minimum(value(pair, False), np.minimum(c, total))  # false hits of the filter
    return np.where(total > 0, (both + d * pw) / np.maximum(total + d, 1), pw)


class LanguageModel:
    """What scoring broadcasts: a few numbers, the common words' exact counts for the base score and the filters' commonest items."""

    def __init__(self, n: int, v: int, quantised: int, grams: Filter, contexts: Filter, common: np.ndarray, common_n: np.ndarray):
        self.n, self.v, self.quantised, self.grams, self.contexts = n, v, quantised, grams, contexts
        self.common, self.common_n = common, common_n

    @property
    def whole(self) -> bool:
        return self.grams.whole and self.contexts.whole

    def probability(self, word: np.ndarray, pair: np.ndarray, context: np.ndarray, followers: np.ndarray) -> np.ndarray:
        return probability(self.quantised, self.v, word, pair, context, followers)

    def exact(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether known) among the common words."""
        if not len(self.common):
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        i = np.minimum(np.searchsorted(self.common, word), len(self.common) - 1)
        known = self.common[i] == word
        return np.where(known, self.common_n[i], 0), known

    def log10(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.n + 0.1 * (self.v + 1)))


def _words(docs: DataFrame, common: int, wide: int = 2**62) -> tuple[DataFrame, int, int, int, np.ndarray, np.ndarray]:
    """(exact word counts (key, n) of docs (text), their sum, number and quantised sum, keys in order and counts of the `common` commonest, of those
    that are found more than `wide` times and of the end)."""
    counts = cut(_counts(docs, False).groupBy("key").agg(F.sum("n").alias("n")))
    octave = F.expr("shiftleft(1L, length(bin(n)) - 1)")
    half = octave + F.shiftright(octave, 1)
    total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("n") >= half, half).otherwise(octave))).first()
    n, v, quantised = total[0] or 0, total[1], total[2] or 0
    # the common words: those from the least count that at most `common` words reach
    steps = counts.groupBy(F.floor(F.log2("n") * 4).alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("s")).collect()
    least, sofar = 2**62, 0
    for r in steps:
        sofar += r["k"]
        least = r["least"] if sofar <= common else least
    top = counts.where((F.col("n") >= least) | (F.col("n") > wide) | (F.col("key") == F.lit(int(END.view(np.int64))))).toArrow()
    key, num = top.column("key").to_numpy().view(U), top.column("n").to_numpy()
    order = np.argsort(key)
    return counts, n, v, quantised, key[order], num[order]


def fit(docs: DataFrame, filter_mb: float = FILTER_MB, tokens_per_block: int = TOKENS_PER_BLOCK, common: int = COMMON) -> tuple[LanguageModel, DataFrame]:
    """(model, exact word counts (key, n)) of the texts of docs (text)."""
    counts, n, v, quantised, key, num = _words(docs, common)
    blocks = 1 << max(4, int(n // tokens_per_block).bit_length())
    zero, one = F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("v")
    items = _counts(docs, True).unionByName(counts.select("key", zero, "n"))
    made, parts = _fill(items, blocks, int(filter_mb * (3 << 21)), False)
    grams = Filter(made, blocks, parts)
    # an item of a context has many entries
    blocks = 1 << max(4, int(8 * v // tokens_per_block).bit_length())
    sums = made.where("block = -2").groupBy(F.col("v").alias("key")).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    both = F.explode(F.array(F.struct(F.col("c").alias("n"), one), F.struct(F.col("d").alias("n"), zero)))
    items = sums.select("key", both.alias("x")).select("key", "x.v", "x.n").mapInArrow(_salted, "key bigint, v bigint, n bigint")
    made, parts = _fill(items, blocks, int(filter_mb * (1 << 21)), True)
    return LanguageModel(n, v, quantised, grams, Filter(made, blocks, parts), key, num), counts


def _answers(keys: DataFrame, model: LanguageModel) -> DataFrame:
    """(wid, seq, data: codes) of keys (wid, seq, data: keys of one block, of one kind). seq is the block, those of contexts after
    those of grams, times two, plus one for fine numbers. A block's bits come before its keys in the same task, one block at a time."""
    shift = model.grams.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = -1, np.zeros(1, U)
        for b in batches:
            block, wid, seq = (b.column(i).to_numpy() for i in range(3))
            i = 0
            while i < len(block):
                if block[i] != now:
                    now, words = int(block[i]), np.zeros(1, U)  # a block without items has no bits
                if wid[i] < 0:
                    words = np.frombuffer(b.column(3)[i].as_py(), U)
                    i += 1
                    continue
                end = i + 1
                while end < len(block) and seq[end] == seq[i] and wid[end] >= 0:
                    end += 1
                held = [np.frombuffer(x.as_py(), U) for x in b.column(3)[i:end]]
                key, back = np.unique(np.concatenate(held), return_inverse=True)
                code = _probe(key, bool(seq[i] % 2), words, np.zeros(len(key), np.int64), np.full(len(key), len(words), U))[back]
                codes = np.split(code, np.cumsum([len(x) for x in held])[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(wid[i:end]), pa.array(seq[i:end]), pa.array([x.tobytes() for x in codes], pa.binary())], names=["wid", "seq", "data"])
                i = end

    first = [F.lit(-1).cast("long").alias("wid"), F.lit(-1).alias("seq"), F.col("bits").alias("data")]
    blocks = model.grams.table.select("block", *first).unionByName(model.contexts.table.select((F.col("block") + shift).alias("block"), *first))
    rows = blocks.unionByName(keys.select(F.shiftright("seq", 1).alias("block"), "wid", "seq", "data"))
    rows = rows.repartition(min(MAX_TASKS, shift + model.contexts.blocks), "block").sortWithinPartitions("block", "seq")
    return rows.mapInArrow(run, "wid bigint, seq int, data binary")


def _open_scores(answers: DataFrame, windows: DataFrame, model: LanguageModel) -> DataFrame:
    """(rid, b): what the tokens left open in each window add to their rows' scores."""
    held = windows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        for b in batches:
            for i, seq in enumerate(b.column(1).to_pylist()):
                if seq < LAST:
                    codes.append(np.frombuffer(b.column(2)[i].as_py(), np.uint16))
                    continue
                rids, refs, toks = (np.frombuffer(b.column(k)[i].as_py(), t) for k, t in ((2, np.int64), (3, np.int32), (4, np.int32)))
                got = np.concatenate(codes)
                codes.clear()
                refs, (row, pair) = refs.reshape(4, -1), toks.reshape(2, -1)
                p = held.value.probability(*[np.where(r >= 0, got[np.maximum(r, 0)], -r - 1) for r in refs])
                total = np.bincount(row, np.log10(p)[pair], len(rids))
                yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(total)], names=["rid", "b"])

    none = F.lit(None).cast("binary")
    rows = answers.select("wid", "seq", "data", none.alias("refs"), none.alias("toks")).unionByName(windows.select("wid", "seq", "data", "refs", "toks"))
    return rows.repartition("wid").sortWithinPartitions("wid", "seq").mapInArrow(run, "rid bigint, b double")


LAST = 2**31 - 1  # seq of a window's own row


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    src = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    fields = {
        "rid": "bigint", "doc_id": kind, "n_tokens": "bigint", "known": "bigint", "base": "double", "score": "double", "rare": "array<bigint>", "times": "array<int>",
        "wid": "bigint", "seq": "int", "data": "binary", "refs": "binary", "toks": "binary",
    }
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = held.value
        window: list[tuple] = []  # (rid, doc_id, tokens of each row, hash of each token, row) of each slice
        wid = TaskContext.get().partitionId() << 33
        id_type = pa.null()

        def batch(n: int, **cols: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols.get(k, pa.nulls(n, id_type if k == "doc_id" else arrow[t])) for k, t in fields.items()], names=list(fields))

        def scored() -> Iterator[pa.RecordBatch]:
            nonlocal wid
            w = np.concatenate([x[3] for x in window])
            sizes = [len(x[0]) for x in window]
            first = np.append(0, np.cumsum(sizes))
            row = np.concatenate([x[4] + at for x, at in zip(window, first[:-1], strict=True)])
            v = np.full_like(w, START)
            np.copyto(v[1:], w[:-1], where=row[1:] == row[:-1])
            pairs, at, ip = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
            words, iw = np.unique(w[at], return_inverse=True)
            befores, iv = np.unique(v[at], return_inverse=True)
            del v
            keys = [words, pairs, mix(befores ^ CONTEXT), mix(befores ^ FOLLOWERS)]
            codes = [m.grams.probe(keys[0], False), m.grams.probe(keys[1], False), m.contexts.probe(keys[2], True), m.contexts.probe(keys[3], False)]
            places = [iw, np.arange(len(pairs)), iv, iv]
            open_pair = np.zeros(len(pairs), bool)
            for code, place, f in zip(codes, places, [m.grams, m.grams, m.contexts, m.contexts], strict=True):
                if not f.whole:
                    open_pair |= code[place] == 0
            logp, closed = np.zeros(len(pairs)), ~open_pair
            logp[closed] = np.log10(m.probability(*[c[i[closed]] for c, i in zip(codes, places, strict=True)]))
            total = np.bincount(row, logp[ip], first[-1])
            for i, piece in enumerate(window):
                yield one(*piece, total[first[i] : first[i + 1]])
            if open_pair.any():
                yield from left_open(row, ip, open_pair, keys, codes, places)
            window.clear()
            wid += 1

        def left_open(row: np.ndarray, ip: np.ndarray, open_pair: np.ndarray, keys: list, codes: list, places: list) -> Iterator[pa.RecordBatch]:
            """The keys that the broadcast filters lack, by block, and the window's row: for each open pair a code (as -code-1) or the place of its answer."""
            refs, ask, seqs, n = [], [], [], 0
            for k, (key, code, place, f) in enumerate(zip(keys, codes, places, [m.grams, m.grams, m.contexts, m.contexts], strict=True)):
                wanted = np.zeros(len(key), bool)
                wanted[place[open_pair]] = True
                wanted &= (code == 0) & (not f.whole)
                ref = -code.astype(np.int32) - 1
                ref[wanted] = np.arange(n, n + wanted.sum())
                n += int(wanted.sum())
                refs.append(ref[place[open_pair]])
                ask.append(key[wanted])
                seqs.append((_block(ask[-1], f.blocks) + (m.grams.blocks if k > 1 else 0)) * 2 + (k == 2))
            key, seq = np.concatenate(ask), np.concatenate(seqs)
            order = np.argsort(seq, kind="stable")
            back = np.empty(n, np.int32)
            back[order] = np.arange(n)
            key, seq = key[order], seq[order]
            cuts = np.flatnonzero(np.diff(seq)) + 1
            refs = np.concatenate([np.where(r >= 0, back[np.maximum(r, 0)], r) for r in refs]).astype(np.int32)
            number = np.cumsum(open_pair) - 1
            tokens = np.flatnonzero(open_pair[ip])
            toks = np.concatenate([row[tokens], number[ip[tokens]]]).astype(np.int32)
            data = pa.array([x.tobytes() for x in np.split(key, cuts)], pa.binary())
            heads = seq[np.append(0, cuts)].astype(np.int32)
            yield batch(len(heads), wid=pa.array(np.full(len(heads), wid)), seq=pa.array(heads), data=data)
            rids = np.concatenate([x[0].to_numpy() for x in window])
            one_of = lambda x: pa.array([x.tobytes()], pa.binary())
            yield batch(1, wid=pa.array([wid]), seq=pa.array([LAST], pa.int32()), data=one_of(rids), refs=one_of(refs), toks=one_of(toks))

        def one(rid: pa.Array, doc_id: pa.Array, count: np.ndarray, w: np.ndarray, row: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            rows = len(rid)
            c, known = m.exact(w)
            add = lambda x: np.bincount(row, weights=x, minlength=rows)
            base, n_known = add(np.where(known, m.log10(c), 0.0)), add(known & (c > 0))
            # what is not common: distinct per row, for the exact join
            rest = np.flatnonzero(~known)
            order = rest[np.lexsort((w[rest], row[rest]))]
            new = np.ones(len(order), bool)
            new[1:] = (w[order][1:] != w[order][:-1]) | (row[order][1:] != row[order][:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(order)))
            ends = np.searchsorted(row[order][at], np.arange(rows + 1))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x))
            return batch(
                rows, rid=rid, doc_id=doc_id, n_tokens=pa.array(count + 1), known=pa.array(n_known.astype(np.int64)), base=pa.array(base), score=pa.array(total),
                rare=lists(w[order][at].view(np.int64)), times=lists(times.astype(np.int32)),
            )

        for b in batches:
            id_type = b.column(1).type
            data, offsets = buffers(b.column(2))
            for lo, hi in slices(offsets):
                t = Tokens(data, offsets[lo : hi + 1])
                w, _, row = sequence(t, t.hashes())
                at = pa.array(np.arange(lo, hi))  # copies, so that the batch and its texts can go
                window.append((b.column(0).take(at), b.column(1).take(at), t.count, w, row.astype(np.int32)))
                if sum(len(x[3]) for x in window) > SCORED:
                    yield from scored()
        if window:
            yield from scored()

    made = cut(src.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in fields.items())))
    part = made.where("rid is not null").select("rid", "doc_id", "n_tokens", "known", "base", "score", "rare", "times")
    rare = part.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    hit = rare.join(counts, "key", "left").select("rid", "times", F.coalesce("n", F.lit(0)).alias("c"))
    norm = float(model.n + 0.1 * (model.v + 1))
    more = hit.groupBy("rid").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + 0.1) / norm)).alias("b"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k")
    )
    more = more.select("rid", "b", "k", F.lit(0.0).alias("s"))
    if not model.whole:
        answers = _answers(made.where(F.col("seq") < LAST).select("wid", "seq", "data"), model)
        rest = _open_scores(answers, made.where(F.col("seq") == LAST), model)
        more = more.unionByName(rest.select("rid", F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("k"), F.col("b").alias("s")))
        more = more.groupBy("rid").agg(F.sum("b").alias("b"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    out = part.drop("rare", "times").join(more, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "n_tokens", plus("known", "k").cast("long").alias("n_known"), plus("base", "b").alias("base_score"), plus("score", "s").alias("score"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes, compressed; the first bytes of all numbers come before the second ones, so that small numbers take little."""
    raw = np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 8 * len(types)
    for n, kind in zip(raw[:at].view(np.int64).tolist(), types, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


class Names:
    """What score_all broadcasts: the model's numbers, the common words with their exact counts, which of them are wide contexts, and the number of blocks.
    A common word's name is its rank, from 1; the start has one too. Name 0 stands for all others, whose hashes are listed."""

    def __init__(self, n: int, v: int, quantised: int, key: np.ndarray, num: np.ndarray, blocks: int, wide: int):
        self.blocks, self.v, self.quantised, self.norm = blocks, v, quantised, n + 0.1 * (v + 1)
        if END not in key:  # no training texts
            key, num = np.append(key, END), np.append(num, 0)
        rank = np.argsort(-num, kind="stable")
        self.key, self.num = np.append(key[rank], START), np.append(num[rank], 0)
        self.wide = (self.num > wide) | (self.key == END) | (self.key == START)
        self.order = np.argsort(self.key).astype(np.uint32)
        self.sorted = self.key[self.order]

    def of(self, word: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.sorted, word), len(self.sorted) - 1)
        return np.where(self.sorted[i] == word, self.order[i] + np.uint32(1), np.uint32(0))

    def words(self, name: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = self.key[np.maximum(name, 1) - 1]
        out[name == 0] = others
        return out


class Window:
    """The distinct pairs of a window of texts (pv, pw: indexes of words; of each token ip), by block, and runs of one word before (heads).
    name, word: those of the window's words and, as the last, of the start; at: index of each token; count: tokens of each row."""

    def __init__(self, names: Names, name: np.ndarray, word: np.ndarray, at: np.ndarray, count: np.ndarray):
        self.name, self.word, self.at = name, word, at
        self.row = np.repeat(np.arange(len(count)), count)
        first = np.cumsum(count, dtype=np.int64) - count
        k = len(word)
        v = np.empty(len(at), np.int64)
        v[1:] = at[:-1]
        v[first] = k - 1
        pair, ip = np.unique(v * k + at, return_inverse=True)
        pv, pw = pair // k, pair % k
        self.wide = names.wide[np.maximum(name, 1) - 1] & (name > 0)
        block = _block(word, names.blocks)[pv]
        some = np.flatnonzero(self.wide[pv])
        block[some] = _block(pair_key(word[pv[some]], word[pw[some]]), names.blocks)
        order = np.argsort(block, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pv, self.pw, self.ip, self.block = pv[order], pw[order], place[ip], block[order]
        self.heads = np.flatnonzero(np.append(True, (np.diff(self.block) != 0) | (np.diff(self.pv) != 0)))


def _windows(docs: DataFrame, names: Names) -> DataFrame:
    """(wid, block, data, ids): for each window of docs (doc_id, text, learn), its own row (block -1), and what it tells and asks each block: words before, and
    of each the words after with the number of times in learnt texts."""
    held = docs.sparkSession.sparkContext.broadcast(names)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Names = held.value
        window: list[tuple] = []  # (doc_ids, learn, tokens of each row, hashes)
        wid = TaskContext.get().partitionId() << 33

        def batch(block: list[int], data: list[bytes], ids: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([wid] * len(block), pa.int64()), pa.array(block, pa.int32()), pa.array(data, pa.binary()), ids], names=["wid", "block", "data", "ids"])

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal wid
            ids, learn, count = pa.concat_arrays([x[0] for x in window]), np.concatenate([x[1] for x in window]), np.concatenate([x[2] for x in window])
            word, at = np.unique(np.concatenate([x[3] for x in window]), return_inverse=True)
            window.clear()
            name = m.of(word)
            order = np.argsort(name - np.uint32(1), kind="stable")  # by rank, then the others
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            name, word, at = name[order], word[order], place[at]
            x = Window(m, np.append(name, m.of(np.array([START]))), np.append(word, START), at, count)
            yield batch([-1], [pack(name, word[name == 0], at, count.astype(np.uint32))], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
            n = np.bincount(x.ip, learn[x.row], len(x.pv)).astype(np.uint32)
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(x.block) != 0)), len(x.block))
            runs = np.searchsorted(x.heads, cuts)
            size = np.diff(np.append(x.heads, len(x.pv))).astype(np.uint32)
            before, after = x.pv[x.heads], x.name[x.pw]
            blocks, data = x.block[cuts[:-1]].tolist(), []
            for lo, hi, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                v, w = x.name[before[a:b]], after[lo:hi]
                data.append(pack(v, x.word[before[a:b][v == 0]], size[a:b], w, x.word[x.pw[lo:hi][w == 0]], n[lo:hi]))
                if len(data) == 256 or hi == cuts[-1]:
                    some, blocks = blocks[: len(data)], blocks[len(data) :]
                    yield batch(some, data, pa.nulls(len(data), pa.list_(ids.type)))
                    data = []
            wid += 1

        for b in batches:
            data, offsets = buffers(b.column(1))
            learn = b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets):
                t = Tokens(data, offsets[lo : hi + 1])
                window.append((b.column(0).take(pa.array(np.arange(lo, hi))), learn[lo:hi], t.count + 1, sequence(t, t.hashes())[0]))
                if sum(len(x[3]) for x in window) > SENT:
                    yield from sent()
        if window:
            yield from sent()

    return docs.select("doc_id", "text", "learn").mapInArrow(run, f"wid bigint, block int, data binary, ids array<{kind}>")


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows of _windows by block; windows' own rows, which only pass, by the hash of their number (its low bits are few)."""
    return rows.repartition(tasks, F.when(F.col("block") < 0, F.col("wid")).otherwise(F.col("block").cast("long"))).sortWithinPartitions("block")


def _probed(rows: DataFrame, names: Names) -> DataFrame:
    """The rows of _windows with a block's answers in place of its questions: codes of the pairs; and of each word before the codes of its count, sum and
    followers (0 for wide ones) and its exact count. Rows of block -2 have the sum c and followers d of wide contexts v in a block. Rows must come by block."""
    held = rows.sparkSession.sparkContext.broadcast(names)
    schema = f"wid bigint, block int, data binary, ids {rows.schema['ids'].dataType.simpleString()}, v bigint, c bigint, d bigint"
    cols = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Names = held.value
        now, asked, ids_type = -1, [], pa.null()

        def batch(n: int, **have: pa.Array) -> pa.RecordBatch:
            types = {"block": pa.int32(), "data": pa.binary(), "ids": ids_type}
            return pa.RecordBatch.from_arrays([have.get(k, pa.nulls(n, types.get(k, pa.int64()))) for k in cols], names=cols)

        def answered() -> Iterator[pa.RecordBatch]:
            vs, sizes, keys, ns = [], [], [], []
            for _, data in asked:
                v, v_others, size, w, w_others, n = unpack(data, np.uint32, U, np.uint32, np.uint32, U, np.uint32)
                vs.append(m.words(v, v_others))
                sizes.append(size)
                keys.append(pair_key(np.repeat(vs[-1], size), m.words(w, w_others)))
                ns.append(n)
            wids = [x[0] for x in asked]
            asked.clear()
            pairs, runs = [len(x) for x in keys], [len(x) for x in vs]
            key, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate(ns), len(key)).astype(np.int64)
            del keys, ns
            v, v_back = np.unique(np.concatenate(vs), return_inverse=True)
            owner = np.repeat(v_back, np.concatenate(sizes))[first]
            seen, own = n > 0, owner[n > 0]
            c = np.bincount(own, LEVELS[_level(n[seen])], len(v)).astype(np.int64)
            d, total = np.bincount(own, minlength=len(v)), np.bincount(own, n[seen], len(v)).astype(np.int64)
            name = m.of(v)
            wide = m.wide[np.maximum(name, 1) - 1] & (name > 0)
            at = np.flatnonzero(~wide & (d > 0))
            context, followers = mix(v ^ CONTEXT), mix(v ^ FOLLOWERS)
            fine = np.repeat([False, False, True, False], [int(seen.sum()), *[len(at)] * 3])
            bits = _bits(np.concatenate([key[seen], v[at], context[at], followers[at]]), np.concatenate([n[seen], total[at], c[at], d[at]]), fine)
            ask = lambda k, fine: _probe(k, fine, bits, np.zeros(len(k), np.int64), np.full(len(k), len(bits), U))
            code = ask(key, False)[back]
            of_v = [np.where(wide, np.uint16(0), ask(k, fine)) for k, fine in ((v, False), (context, True), (followers, False))]
            total[wide] = 0
            cuts, v_cuts = np.append(0, np.cumsum(pairs)), np.append(0, np.cumsum(runs))
            data = []
            for i in range(len(wids)):
                of = v_back[v_cuts[i] : v_cuts[i + 1]]
                data.append(pack(code[cuts[i] : cuts[i + 1]], *[x[of] for x in of_v], total[of]))
            yield batch(len(wids), wid=pa.array(wids, pa.int64()), block=pa.array([now] * len(wids), pa.int32()), data=pa.array(data, pa.binary()))
            at = np.flatnonzero(wide & (d > 0))
            if len(at):
                yield batch(len(at), block=pa.array([-2] * len(at), pa.int32()), v=pa.array(v[at].view(np.int64)), c=pa.array(c[at]), d=pa.array(d[at]))

        for b in batches:
            ids_type = b.column(3).type
            for i, (wid, block) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if block < 0:
                    yield batch(1, **{k: b.column(j).slice(i, 1) for j, k in enumerate(cols[:4])})
                    continue
                if block != now and asked:
                    yield from answered()
                now = block
                asked.append((wid, b.column(2)[i].as_py()))
        if asked:
            yield from answered()

    return rows.mapInArrow(run, schema)


class Wide:
    """The filter of the wide contexts' sums and followers and of their words' counts."""

    def __init__(self, names: Names, v: np.ndarray, c: np.ndarray, d: np.ndarray):
        at = np.flatnonzero(names.wide & (names.num > 0))
        n = np.concatenate([names.num[at], c, d])
        self.bits = _bits(np.concatenate([names.key[at], mix(v ^ CONTEXT), mix(v ^ FOLLOWERS)]), n, np.repeat([False, True, False], [len(at), len(v), len(v)]))

    def codes(self, v: np.ndarray) -> list[np.ndarray]:
        start, size = np.zeros(len(v), np.int64), np.full(len(v), len(self.bits), U)
        return [_probe(k, fine, self.bits, start, size) for k, fine in ((v, False), (mix(v ^ CONTEXT), True), (mix(v ^ FOLLOWERS), False))]


def _summed(rows: DataFrame, names: Names, wide: Wide, fields: dict[str, str]) -> DataFrame:
    """The scores of each window's rows, from its own row and the blocks' answers after it, in the order of blocks."""
    held = rows.sparkSession.sparkContext.broadcast((names, wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = held.value
        own: tuple | None = None
        got: list[bytes] = []

        def scored() -> pa.RecordBatch:
            name, others, at, count = unpack(own[0], np.uint32, U, np.uint32, np.uint32)
            word = m.words(name, others)
            x = Window(m, np.append(name, m.of(np.array([START]))), np.append(word, START), at, count)
            code, *of_v, total = (np.concatenate(y) for y in zip(*[unpack(y, *[np.uint16] * 4, np.int64) for y in got], strict=True))
            before, k = x.pv[x.heads], len(x.word)
            narrow = ~x.wide[before]
            exact = np.where(x.name > 0, m.num[np.maximum(x.name, 1) - 1], 0)
            exact[before[narrow]] = total[narrow]
            codes = [np.zeros(k, np.uint16) for _ in of_v]
            some = np.flatnonzero(x.wide)
            for y, of, of_wide in zip(codes, of_v, w.codes(x.word[some]), strict=True):
                y[before[narrow]] = of[narrow]
                y[some] = of_wide
            p = probability(m.quantised, m.v, codes[0][x.pw], code, codes[1][x.pv], codes[2][x.pv])
            add = lambda of_token: np.bincount(x.row, of_token, len(count))
            base, known = np.log10((exact + 0.1) / m.norm), (exact > 0).astype(float)
            cols = [own[1], pa.array(count.astype(np.int64)), pa.array(add(known[x.at]).astype(np.int64)), pa.array(add(base[x.at])), pa.array(add(np.log10(p)[x.ip]))]
            return pa.RecordBatch.from_arrays(cols, names=list(fields))

        for b in batches:
            for i, block in enumerate(b.column(1).to_pylist()):
                if block < 0:
                    if own:
                        yield scored()
                    own = b.column(2)[i].as_py(), b.column(3)[i].values
                    got.clear()
                else:
                    got.append(b.column(2)[i].as_py())
        if own:
            yield scored()

    return rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in fields.items()))


def score_all(docs: DataFrame, common: int = COMMON, tokens_per_block: int = SENT_PER_BLOCK) -> tuple[DataFrame, int]:
    """(doc_id, n_tokens, n_known, base_score and score of each row of docs (doc_id, text, learn) by a model of the rows that learn is true for; number of training tokens)."""
    _, n, v, quantised, key, num = _words(docs.where("learn"), common, tokens_per_block)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 << max(4, int(max(n, chars // 8) // tokens_per_block).bit_length())
    names = Names(n, v, quantised, key, num, blocks, tokens_per_block)
    rows, tasks = _windows(docs, names), min(MAX_TASKS, blocks)
    made = cut(_probed(_dealt(rows, tasks), names))
    sums = made.where("block = -2").groupBy("v").agg(F.sum("c").alias("c"), F.sum("d").alias("d")).toArrow()
    sums = [sums.column(k).to_numpy() for k in ("v", "c", "d")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = {"doc_id": kind, "n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}
    rows = made.where("block > -2").select("wid", "block", "data", "ids").repartition(tasks, "wid").sortWithinPartitions("wid", "block")
    return _summed(rows, names, Wide(names, sums[0].view(U), *sums[1:]), fields), n


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 10) != 0).alias("learn"))
    out, n = score_all(docs)
    return out.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
