"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 6, native).

Targets: the sources' weights share the words of the whole corpus; a source gets at most `max_repeat` times its
words and the excess is reshared by weight until none is above. A source's words are drawn from its own documents
in passes: whole passes first, then part of one more pass.

Documents fall into `blocks` hash blocks per source, permuted by a seeded hash. The part of the last pass that a
source still owes is a number of whole blocks in permuted order, in the one block where the target falls the documents
in hash order as long as they fit, and then, `CLOSING` times, the one document of those left that comes nearest to what is still owed. All block copies that a source owes are its quota. The
quotas are split among 2**levels output shards by a binary tree: each node draws how many blocks of each source go
left from the multivariate hypergeometric distribution (a fold of seeded inverse-CDF hypergeometric draws over
sources), so shards hold equal numbers of blocks and every source's quota is met exactly. A shard then takes its
share of each source's permuted blocks, disjoint from all other shards', and its rows get a local shuffle key.

Plan: one narrow aggregation to block sums (source x blocks rows, whatever the input), windows over those
block sums, a window inside single blocks, and joins of documents with block tables whose size is bounded by
sources x blocks. No Python runs on the executors.

Defined results: null text has size 0; null source is a source of its own, last in order; documents of size 0 are taken
never; sources without words get target 0; rows equal in id, source and text are separate documents that get one decision; an empty table gives an empty mix. Reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import SPACES, cut, table

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3.0
BLOCKS, LEVELS, SEED, CLOSING = 256, 4, 17, 3


def n_words(text: Column) -> Column:
    """Number of runs of anything but white space."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(t, SPACES))
    edge = F.when(F.trim(F.translate(F.left(t, F.lit(1)), "\t\n\x0b\x0c\r", "     ")) == "", 1).otherwise(0) + F.when(F.trim(F.translate(F.right(t, F.lit(1)), "\t\n\x0b\x0c\r", "     ")) == "", 1).otherwise(0)
    return F.greatest(pieces - edge, F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The final scale: a source is at its cap iff its cap per weight is below the common level; with sources in order of
    cap per weight, the first k are capped for the least k whose level does not exceed the next one's cap per weight."""
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", max_repeat * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    by = every.orderBy("ratio", F.col("source").asc_nulls_last())
    below = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("capped", F.coalesce(F.sum("cap").over(below), F.lit(0.0))).withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level")))
    s = s.withColumn("common", level.over(every)["level"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("common")), F.col("cap")).alias("target"))


def _uniform(*key: Column) -> Column:
    return (F.pmod(F.xxhash64(*key), F.lit(2**53)) + 0.5) / float(2**53)


def _let(value: Column, then) -> Column:
    """then(value) with value computed once: expressions inside lambdas are evaluated where they stand."""
    return F.transform(F.array(value), then)[0]


def _hypergeometric(u: Column, total: Column, good: Column, draws: Column) -> Column:
    """Inverse CDF at u of the number of `good` among `draws` from `total`; exact up to double rounding.

    Probabilities are built by their recurrence from the mode outwards, so that nothing underflows to all zeros."""

    def draw(s: Column) -> Column:
        lo, hi, mode = s["lo"], s["hi"], s["mode"]
        up = lambda k: ((s["good"] - k) * (s["draws"] - k)).cast("double") / ((k + 1) * (s["total"] - s["good"] - s["draws"] + k + 1)).cast("double")  # noqa: E731  p(k+1) / p(k)
        none = F.array().cast("array<bigint>")

        def walk(keys: Column, step) -> Column:
            add = lambda a, k: _let(a["p"] * step(k), lambda p: F.struct(p.alias("p"), F.concat(a["all"], F.array(p)).alias("all")))
            return F.aggregate(keys, F.struct(F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("all")), add)["all"]

        upward = walk(F.when(hi > mode, F.sequence(mode, hi - 1)).otherwise(none), up)
        downward = walk(F.when(mode > lo, F.sequence(mode - 1, lo, F.lit(-1).cast("long"))).otherwise(none), lambda k: 1.0 / up(k))
        # downward starts with the mode itself, which upward has too
        p = _let(downward, lambda d: F.concat(F.reverse(F.slice(d, 2, F.size(d))), upward))

        def pick(t: Column) -> Column:
            step = lambda a, x: F.struct((a["c"] + x).alias("c"), (a["n"] + F.when(a["c"] + x < t["u"], 1).otherwise(0)).alias("n"))
            return F.aggregate(t["p"], F.struct(F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("n")), step)["n"]

        with_sum = _let(p, lambda q: F.struct(q.alias("p"), (s["u"] * F.aggregate(q, F.lit(0.0), lambda a, x: a + x)).alias("u")))
        return F.least(hi, lo + _let(with_sum, pick))

    lo, hi = F.greatest(F.lit(0).cast("long"), draws - (total - good)), F.least(good, draws)
    mode = F.least(hi, F.greatest(lo, F.floor((draws + 1.0) * (good + 1.0) / (total + 2.0)).cast("long")))
    return _let(F.struct(u.alias("u"), total.alias("total"), good.alias("good"), draws.alias("draws"), lo.alias("lo"), hi.alias("hi"), mode.alias("mode")), draw)


def split(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(shard, source, quota) from (source, quota): quotas dealt to 2**levels shards of equal block count (+-1)."""
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("source"), F.col("quota").cast("long").alias("q")))).alias("s")).select(F.lit(0).cast("long").alias("node"), "s")
    for level in range(levels):
        total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["q"])

        def fold(a: Column, x: Column) -> Column:
            draw = _hypergeometric(_uniform(F.lit(seed), F.lit(level), F.col("node"), x["source"]), a["total"], x["q"], a["draws"])  # noqa: B023
            return _let(draw, lambda n: F.struct((a["total"] - x["q"]).alias("total"), (a["draws"] - n).alias("draws"), F.concat(a["out"], F.array(F.struct(x["source"].alias("source"), n.alias("l"), (x["q"] - n).alias("r")))).alias("out")))

        kind = dict(nodes.dtypes)["s"].removeprefix("array<struct<source:").removesuffix(",q:bigint>>")
        start = F.struct(total.alias("total"), F.floor((total + 1) / 2).cast("long").alias("draws"), F.array().cast(f"array<struct<source:{kind},l:bigint,r:bigint>>").alias("out"))
        dealt = nodes.select("node", F.aggregate("s", start, fold)["out"].alias("d"))
        side = lambda bit, f: F.struct((F.col("node") * 2 + bit).alias("node"), F.transform("d", lambda x: F.struct(x["source"].alias("source"), x[f].alias("q"))).alias("s"))
        # a table after each level keeps the plan of the next one small
        nodes = cut(dealt.select(F.explode(F.array(side(0, "l"), side(1, "r"))).alias("n")).select("n.node", "n.s"))
    return nodes.select(F.col("node").alias("shard"), F.explode("s").alias("x")).select("shard", "x.source", F.col("x.q").alias("quota")).where("quota > 0")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, blocks: int = BLOCKS, levels: int = LEVELS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(per document: key columns and copies; deal: (source, blk, copy) -> shard) for docs (doc_id, source, text).

    Documents are named by (doc_id, source, rid): rid is a hash of id and text."""
    d = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("rid"), n_words(F.col("text")).alias("size"))
    d = cut(d.withColumn("blk", F.pmod(F.xxhash64(F.lit(seed), "source", "rid"), F.lit(blocks)).cast("int")))
    sums = cut(d.groupBy("source", "blk").agg(F.sum("size").alias("b")))
    goal = targets(sums.groupBy("source").agg(F.sum("b").alias("source_size")), weights, max_repeat)
    goal = cut(goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")))
    goal = goal.withColumn("owed", F.col("target") - F.col("passes") * F.col("source_size"))
    rank = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "blk"), "blk")
    b = sums.withColumnRenamed("source", "bs").join(goal, F.col("bs").eqNullSafe(F.col("source"))).drop("bs")
    b = b.withColumn("place", F.row_number().over(rank) - 1).withColumn("before", F.sum("b").over(rank.rowsBetween(Window.unboundedPreceding, 0)) - F.col("b"))
    b = cut(b.select("source", "blk", "source_size", "target", "passes", "place", F.greatest(F.lit(0.0), F.col("owed") - F.col("before")).alias("part"), "b"))
    bb = b.select(F.col("source").alias("bs"), F.col("blk").alias("bb"), "source_size", "target", "passes", "place", "part", "b")
    # bounded: sources x blocks rows
    d = d.join(bb, F.col("source").eqNullSafe(F.col("bs")) & (F.col("blk") == F.col("bb"))).drop("bs", "bb")
    inside = Window.partitionBy("source", "blk").orderBy(F.xxhash64(F.lit(seed + 2), "rid"), "rid")
    cum = F.sum("size").over(inside)  # equal rows have one place and one sum
    whole = d.where((F.col("part") >= F.col("b")) | (F.col("part") <= 0)).withColumn("extra", F.when(F.col("part") > 0, 1).otherwise(0))
    cutting = d.where((F.col("part") < F.col("b")) & (F.col("part") > 0)).withColumn("extra", F.when(cum <= F.col("part"), 1).otherwise(0))
    d = cut(whole.unionByName(cutting))
    closed = None
    for _ in range(CLOSING):  # one row a source
        gap = d.groupBy("source").agg((F.first("target") - F.first("passes") * F.first("source_size") - F.sum(F.col("size") * F.col("extra"))).alias("gap")).withColumnRenamed("source", "gs")
        alone = d.where("extra = 0 and size > 0").groupBy("source", "blk", "rid").agg(F.sum("size").alias("s"))
        alone = alone.join(F.broadcast(gap), F.col("source").eqNullSafe(F.col("gs"))).withColumn("off", F.abs(F.col("gap") - F.col("s"))).where("off < gap")
        take = cut(alone.groupBy("source").agg(F.min(F.struct("off", F.xxhash64(F.lit(seed + 5), "rid").alias("lot"), "rid", "blk")).alias("m")).select(F.col("source").alias("cs"), F.col("m.rid").alias("cr"), F.col("m.blk").alias("cb")))
        closed = take if closed is None else closed.unionByName(take)
        hit = F.col("source").eqNullSafe(F.col("cs")) & (F.col("rid") == F.col("cr"))
        d = d.join(F.broadcast(take), hit, "left").withColumn("extra", F.when(F.col("cr").isNotNull(), 1).otherwise(F.col("extra"))).drop("cs", "cr", "cb")
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.least(F.col("passes") + F.col("extra"), F.lit(int(max_repeat)))).otherwise(0).cast("long"))
    d = d.select("doc_id", "source", "rid", "size", "source_size", "target", "copies", "blk")
    # blocks owed per source: every pass over every block, and the blocks of the broken pass
    near = closed.select("cs", "cb").distinct()
    b = b.join(F.broadcast(near), F.col("source").eqNullSafe(F.col("cs")) & (F.col("blk") == F.col("cb")), "left")
    owed = b.select("source", "blk", "place", (F.col("passes") + F.when((F.col("part") > 0) | F.col("cb").isNotNull(), 1).otherwise(0)).alias("n")).where("n > 0").select("source", "blk", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    owed = cut(owed.withColumn("slot", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 3), "source", "blk", "copy"), "blk", "copy"))))
    dealt = split(owed.groupBy("source").agg(F.count("*").alias("quota")), levels, seed)
    dealt = dealt.withColumn("upto", F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))).select(F.col("source").alias("qs"), "shard", "upto", (F.col("upto") - F.col("quota")).alias("from"))
    deal = owed.join(dealt, F.col("source").eqNullSafe(F.col("qs")) & (F.col("slot") > F.col("from")) & (F.col("slot") <= F.col("upto"))).select("source", "blk", "copy", "shard")
    return d, deal


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix: a row of docs for each copy taken, with shard, position key and copy number, shuffled within shards.

    Columns of docs keep their names and values; ours are added unless a column has the name."""
    cols = docs.columns
    chosen, deal = plan(docs, seed=seed, **options)
    rows = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), docs["doc_id"].alias("k1"), docs["source"].alias("k2"), F.xxhash64("doc_id", "text").alias("k3"))
    taken = chosen.where("copies > 0").groupBy("doc_id", "source", "rid", "blk").agg(F.max("copies").alias("copies"))
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    deal = deal.select(F.col("source").alias("ds"), F.col("blk").alias("db"), F.col("copy").alias("dc"), "shard")
    taken = taken.join(deal, F.col("source").eqNullSafe(F.col("ds")) & (F.col("blk") == F.col("db")) & (F.col("copy") == F.col("dc")))
    taken = taken.select(F.col("doc_id").alias("t1"), F.col("source").alias("t2"), F.col("rid").alias("t3"), "copy", "shard")
    out = rows.join(taken, F.col("k1").eqNullSafe(F.col("t1")) & F.col("k2").eqNullSafe(F.col("t2")) & (F.col("k3") == F.col("t3")))
    extra = [e.alias(n) for n, e in (("shard", F.col("shard")), ("copy", F.col("copy")), ("position", F.xxhash64(F.lit(seed + 4), "shard", "k3", "copy"))) if n not in cols]
    return out.select(*[F.col("row")[c].alias(c) for c in cols], *extra)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, deal = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    # shards that hold the document's copies, from the dealt blocks
    where = deal.groupBy("source", "blk").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("dealt")).select(F.col("source").alias("ds"), F.col("blk").alias("db"), "dealt")
    out = chosen.join(where, F.col("source").eqNullSafe(F.col("ds")) & (F.col("blk") == F.col("db")), "left")
    shards = F.transform(F.filter(F.coalesce("dealt", F.array().cast("array<struct<copy:bigint,shard:bigint>>")), lambda x: x["copy"] <= F.col("copies")), lambda x: x["shard"])
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), shards.alias("shards"))
