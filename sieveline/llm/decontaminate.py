"""Benchmark decontamination by spaced-seed hashing (operator 10, native).

A spaced seed is a mask over consecutive words; the masked-in words are hashed and the others ignored, so a changed word
spoils only the seeds that look at it. Seeds of the benchmark items and of the texts meet in an equi-join on their hash.
Around each hit the item is laid over the text on the hit's diagonal, and the words that agree are counted (words are compared as
lower-case text without marks at their edges). An item is found if at least `min_words` and `min_share` of all its words agree, or if
in some `local` consecutive words of it at most `local_misses` differ: so substitutions are tolerated, an insertion that moves the
rest to another diagonal too, a long part of an item counts, and chance hits fail. Items shorter than the longest mask use the masks
that fit into them (8 or 9 words: one may differ), below 8 words they are looked for whole.

Plan: texts become word hashes and seeds of all masks inside one scan; a row that leaves it is (text, place, seed), never the text.
The seeds of the benchmark are broadcast where their row count, taken first, is at most `broadcast_rows`, else they meet in
a shuffle join. Places are summed up per text, and only texts with hits are read again, to cut out the windows under
their items. DataFrame functions only.

Defined results: null and empty texts have no seeds; items without words match nothing; equal items each report their hits;
rows equal in id and text report once; a null id is kept; a null item id matches nothing; columns of the caller's tables beside the named ones are
not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import SPACES, cut, table

#: Positions that each mask looks at.
MASKS = ((0, 1, 2, 4, 5, 7), (0, 1, 3, 4, 6, 8), (0, 2, 3, 6, 7, 9))
SPAN = 10
MIN_WORDS, MIN_SHARE = 8, 0.6
#: Consecutive words of an item in which at most so many may differ.
LOCAL, LOCAL_MISSES = 20, 2
BROADCAST_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    """Lower-case words without marks at their edges; words of marks alone go."""
    marks, blank = r"""[.,;:!?"'()\[\]{}*%&$#|<>-]+""", r"\x20\x09-\x0D"
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?<![^{blank}]){marks}|{marks}(?![^{blank}])", "")
    return F.filter(F.split(t, SPACES), lambda w: w != "")


def _let(value: Column, then) -> Column:
    """then(value) with value computed once a row: expressions in lambdas are evaluated where they stand."""
    return F.transform(F.array(value), then)[0]


def _hash_words(text: Column) -> Column:
    return F.transform(plain_words(text), lambda x: F.xxhash64(x))


def _masks(n: int, masks: tuple[tuple[int, ...], ...]) -> tuple[tuple[int, ...], ...]:
    """The masks of items of n words; those of SPAN words and more share all masks."""
    return masks if n >= SPAN else tuple(m for m in masks if m[-1] < n) or (tuple(range(n)),)


def _placed(texts: DataFrame, keys: list[str], words: Column, spans: Column, lengths: list[int], masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """keys, pos, seed of each text: at each place a seed for each mask of each of the lengths that are in `spans`, made in one pass."""

    def of(w: Column, n: int) -> list[Column]:
        def one(k: int, mask: tuple[int, ...]) -> Column:
            last = F.size(w) - n  # a mask stays inside runs of n words
            at = F.when((last >= 0) & F.array_contains(spans, n), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(n), F.lit(k), *[F.get(w, i + p) for p in mask]).alias("seed")))

        return [one(k, mask) for k, mask in enumerate(_masks(n, masks))]

    made = texts.select(*keys, F.explode(_let(words, lambda w: F.flatten(F.array(*[x for n in lengths for x in of(w, n)])))).alias("x"))
    return made.select(*keys, "x.pos", "x.seed")


def find(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, local: int = LOCAL, local_misses: int = LOCAL_MISSES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, rid, item_id, matched, item_words, position): each item found in each text, at its best place.

    docs: (doc_id, text, rid), rid naming the row."""
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    items = benchmark.select("item_id", "text", _hash_words(F.col("text")).alias("iw"))
    items = cut(items.withColumn("item_words", F.size("iw")).where("item_words > 0"))
    lengths = sorted({min(r[0], SPAN) for r in items.select("item_words").distinct().collect()})  # at most SPAN of them
    if not lengths:
        lengths = [SPAN]
    spans = F.array(F.least("item_words", F.lit(SPAN)))
    seeds = cut(_placed(items.select("item_id", "text", "item_words"), ["item_id"], _hash_words(F.col("text")), spans, lengths).withColumnRenamed("pos", "ipos"))
    met = _placed(docs, ["rid"], _hash_words(F.col("text")), F.array(*[F.lit(n) for n in lengths]), lengths).join(small(seeds), "seed")
    hits = met.select("rid", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"))
    places = cut(hits.distinct())
    per = cut(places.groupBy("rid").agg(F.collect_list(F.struct("item_id", "shift")).alias("found")).withColumnRenamed("rid", "r"))

    held = docs.join(small(per), F.col("rid") == F.col("r"))
    size = items.select(F.col("item_id").alias("iid"), "iw", "item_words").dropDuplicates(["iid", "iw"])
    # windows of a text under each of its places; a place that sticks out is cut off at the text's ends
    longest = items.agg(F.max("item_words")).first()[0] or 0
    window = lambda w, x: F.struct(x["item_id"].alias("item_id"), x["shift"].alias("shift"), F.slice(w, F.greatest(x["shift"], F.lit(0)) + 1, F.lit(longest)).alias("piece"))
    cuts = _let(F.struct(_hash_words(F.col("text")).alias("w"), F.col("found").alias("f")), lambda s: F.transform(s["f"], lambda x: window(s["w"], x)))
    rows = held.select("doc_id", "rid", F.explode(cuts).alias("x")).select("doc_id", "rid", "x.item_id", "x.shift", "x.piece")
    rows = rows.join(small(size), F.col("item_id") == F.col("iid"))
    under = F.slice("iw", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("iw"))
    agree = F.transform(F.zip_with(under, "piece", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x.cast("int"))
    rows = rows.select("doc_id", "rid", "item_id", F.col("shift").alias("position"), "item_words", agree.alias("agree"))
    # words that agree in the best run of `local` words
    step = lambda a, i: _let(a["sum"] + F.get("agree", i) - F.coalesce(F.get("agree", i - local), F.lit(0)), lambda n: F.struct(n.alias("sum"), F.greatest(a["top"], n).alias("top")))
    at = F.when(F.size("agree") >= local, F.sequence(F.lit(0), F.size("agree") - 1)).otherwise(F.array().cast("array<int>"))
    run = F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")), step)["top"]
    rows = rows.withColumn("matched", F.aggregate("agree", F.lit(0), lambda a, x: a + x)).withColumn("run", run)
    least = F.when(F.col("item_words").between(min_words, SPAN - 1), F.col("item_words") - 1).otherwise(F.least(F.lit(min_words), F.col("item_words")))
    good = rows.where((F.col("matched") >= least) & (F.col("matched") >= min_share * F.col("item_words")) | (F.col("run") >= local - local_misses))
    best = good.groupBy("doc_id", "rid", "item_id").agg(F.max(F.struct("matched", (-F.col("position")).alias("back"), "item_words")).alias("m"))
    return best.select("doc_id", "rid", "item_id", F.col("m.matched").alias("matched"), F.col("m.item_words").alias("item_words"), (-F.col("m.back")).alias("position"))


def with_rid(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows in which an item is found; columns unchanged."""
    bad = cut(find(with_rid(docs), benchmark, **options).select("rid").distinct().withColumnRenamed("rid", "r"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(docs["doc_id"], docs["text"]).alias("r"))
    return rows.join(bad, "r", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    out = find(with_rid(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("item_words").cast("long").alias("item_words"), F.col("position").cast("long").alias("position"))
