"""N-gram Jaccard self-join by multiple global orders (operator 7).

Documents are sets of 5-word shingles (64-bit hashes); two link when 100 * |x & y| >= 75 * |x | y|. Under any global
order of the shingles, two linked sets share a shingle among their first n - ceil(75 n / 100) + 1. That holds under every
order at once, so a pair is a candidate only if its prefixes meet under all of them: the first order is
joined in Spark, the others filter its pairs before the exact comparison of the whole sets.

A pair must not only meet: linked sets share at least a number of shingles within their prefixes that follows from their
sizes (`_shared`), and the join counts them.

Orders put frequent shingles last: passages that many texts share stand at the end and leave the prefixes. The frequent
shingles are a bounded table (`hot_shingles`) from counts within tasks, so the choice affects speed alone, never the
result; ties go by a hash seeded per order.

Groups of copies are never expanded into pairs. Equal word sequences are one class from the start, named by a 64-bit hash of
the sequence. The classes of one prefix shingle are a group. Small groups list their pairs. A large group is split around a
pivot, the member that lies in most large groups: each member is compared with it exactly, and members that link to it are
one component without a look at their pairs. Of the others only those pairs can link that share enough of their differences
from the group's centre, which are selective keys: they meet in a join on prefixes of the differences, whose condition bounds what can
still be shared (`_apart`). Pairs across components pass the other orders' filters, then their whole sets are compared.

Defined results: null and empty texts have no shingles, link with nothing and are their own component, also among
themselves; ids may repeat: component_id is the least id among the rows reached; null ids are kept and never named as a
component unless the whole component has no other; an empty table gives an empty result."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import TOKEN, components, cut, free, table
from sieveline.llm.vec import Tokens, U, buffers, mix, shingles, slices

K, PERCENT = 5, 75
ORDERS = 3
HOT_SHINGLES, HOT_IN_TASK = 1 << 20, 2
BROADCAST_NODES = 2_000_000  # of 8 or 16 bytes each
#: Groups of at most SMALL classes list their pairs; larger ones are split around pivots. Tasks that share a pivot with many members.
SMALL, PIVOT_PARTS = 12, 16
#: Longs of marks by which members of a large group are told apart as they meet; how many items before a shared one are looked at for another.
WORDS, BEFORE = 8, 16


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, set size per row; distinct shingles sorted by row; bounds of rows in them)."""
    t = Tokens(data, offsets)
    h = t.hashes()
    s, row = shingles(h, t, k)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    rows = len(t.count)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    return _names(t, h)[0], np.diff(bounds), s, bounds


def _names(t: Tokens, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class, number of words) per row; the class is a sum of token hashes mixed with their places."""
    h = t.hashes() if h is None else h
    place = np.arange(len(h)) - t.first[t.doc]
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h + place.astype(U) * U(0x9E3779B97F4A7C15)), out=sums[1:])
    return mix(sums[t.first[1:]] - sums[t.first[:-1]] + t.count.astype(U)), t.count


def _shared(n: Column, m: Column, percent: int) -> Column:
    """Least number of shingles that the prefixes of two linked sets of n and m share under any one order.

    They share at least `both` shingles in all, so of the p(n) first at most n - both are not shared, counted from
    the side on which the prefix ends first."""
    both = F.ceil((n + m) * percent / (100 + percent) - F.lit(1e-9))
    least = lambda x: both - F.ceil(x * percent / 100 - F.lit(1e-9)) + 1
    return F.least(least(n), least(m))


class Order:
    """The orders' sort keys: frequent shingles (known ones, by rising frequency) after all others, then by hash."""

    def __init__(self, hot: np.ndarray, rank: np.ndarray):
        self.hot, self.rank = hot, rank

    def key(self, s: np.ndarray, which: int) -> np.ndarray:
        h = mix(s ^ mix(np.full(1, which + 1, np.uint64))[0]) >> U(6)
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)
            h |= np.where(self.hot[i] == s, self.rank[i], 0).astype(U) << U(58)
        return h


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """Rows (0, doc_id, class, n) per document and (1, null, shingle, count) of what is frequent within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        names = ["kind", "doc_id", "th", "key", "n"]

        def frequent() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            key, n = key[n >= HOT_IN_TASK], n[n >= HOT_IN_TASK]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), np.int8)), *[pa.nulls(len(key), pa.int64())] * 2, pa.array(key.view(np.int64)), pa.array(n)], names=names)

        for b in batches:
            data, offsets = buffers(b.column(2))
            for lo, hi in slices(offsets):
                name, n, s, bounds = _sets(data, offsets[lo : hi + 1], k)
                fresh = [i for i, x in enumerate(name.tolist()) if n[i] and not (x in seen or seen.add(x))]
                held.extend(s[bounds[i] : bounds[i + 1]] for i in fresh)
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int8)), b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(name.view(np.int64)), pa.array(n)], names=names)
                if sum(map(len, held)) > 3_000_000:
                    yield frequent()
        if held:
            yield frequent()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "kind tinyint, doc_id bigint, th bigint, key bigint, n bigint")


def _prefixes(docs: DataFrame, order, k: int, percent: int) -> DataFrame:
    """(s, hot, node, ix) of the first order's prefixes; copies within a task once. ix: also in the shorter prefix that
    suffices for the smaller set of a pair, which shares 2 percent / (100 + percent) of its items at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Order = order.value
        seen: set[int] = set()
        for b in batches:
            data, offsets = buffers(b.column(0))
            for lo, hi in slices(offsets):
                name, n, s, bounds = _sets(data, offsets[lo : hi + 1], k)
                fresh = np.array([bool(n[i]) and not (x in seen or seen.add(x)) for i, x in enumerate(name.tolist())], bool)
                if len(seen) > 1_000_000:
                    seen.clear()
                row = np.repeat(np.arange(hi - lo), n)
                s, row = s[fresh[row]], row[fresh[row]]
                key = o.key(s, 0)
                by = np.lexsort((key, row))
                first = np.searchsorted(row, np.arange(hi - lo))
                place = np.arange(len(s)) - first[row[by]]
                kept = place < prefix_length(n, percent)[row[by]]
                keep, of = by[kept], row[by][kept]
                ix = place[kept] <= n[of] - -(-2 * percent * n[of] // (100 + percent))
                yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), pa.array((key[keep] >> U(58)) > 0), pa.array(name[of].view(np.int64)), pa.array(ix)], names=["s", "hot", "node", "ix"])

    return docs.select("text").mapInArrow(run, "s bigint, hot boolean, node bigint, ix boolean")


def _found(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): the rows that wanted (node, doc_id, th) names, by id and text hash, so that only those are tokenised; equal rows may come more than once."""
    want = wanted.select("node", F.col("doc_id").alias("wid"), F.col("th").alias("wth"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    return rows.join(_few(want), (F.col("h") == F.col("wth")) & F.col("id").eqNullSafe(F.col("wid"))).select("node", "text")


def _whole(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, items): the set of each class in wanted (node, doc_id, th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            for lo, hi in slices(offsets):
                _, n, s, bounds = _sets(data, offsets[lo : hi + 1], k)
                items = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), items], names=["node", "n", "items"])

    return _found(docs, wanted).mapInArrow(run, "node bigint, n bigint, items array<bigint>").dropDuplicates(["node"])


def _orders(docs: DataFrame, wanted: DataFrame, order, k: int, percent: int, orders: int) -> DataFrame:
    """(node, n, o1, l1, ...): the prefixes of each class in wanted under all orders but the first, as 32-bit hashes; l: how many shingles of the prefix
    share their hash with another of it. Shared shingles show at most that many hashes too few, which the filter adds, so it loses no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Order = order.value
        for b in batches:
            data, offsets = buffers(b.column(1))
            for lo, hi in slices(offsets):
                _, n, s, bounds = _sets(data, offsets[lo : hi + 1], k)
                row = np.repeat(np.arange(hi - lo), n)
                p = np.where(n > 0, prefix_length(n, percent), 0)
                ends = pa.array(np.append(0, np.cumsum(p)).astype(np.int32))
                of = np.repeat(np.arange(hi - lo), p).astype(U)
                out = []
                for which in range(1, orders):
                    by = np.lexsort((o.key(s, which), row))
                    kept = s[by[np.arange(len(s)) - bounds[row] < p[row]]] >> U(32)
                    some = np.unique(of << U(32) | kept) >> U(32)
                    lost = p - np.bincount(some.astype(np.int64), minlength=hi - lo)
                    out += [pa.ListArray.from_arrays(ends, pa.array(kept.astype(np.uint32).view(np.int32))), pa.array(lost.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), *out], names=["node", "n", *[f"{x}{w}" for w in range(1, orders) for x in "ol"]])

    return _found(docs, wanted).mapInArrow(run, "node bigint, n bigint" + "".join(f", o{w} array<int>, l{w} int" for w in range(1, orders))).dropDuplicates(["node"])


def _few(df: DataFrame) -> DataFrame:
    """df (of a few numbers a row, written before), to be broadcast if it has at most BROADCAST_NODES rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def _beside(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """rows (node, p, ...) joined with pivots (p, ...), whose rows are wide; a pivot with many members is dealt to several tasks, a copy in each."""
    count = cut(rows.groupBy("p").agg(F.count("*").alias("members")))
    parts = F.when(F.col("members") > PIVOT_PARTS * SMALL, PIVOT_PARTS).otherwise(1)
    dealt = rows.join(_few(count), "p").withColumn("part", F.pmod("node", parts).cast("int")).drop("members")
    copies = pivots.join(_few(count), "p").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("members")
    return dealt.join(copies, ["p", "part"], "left").drop("part")


def _differences(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, p, n, size, out, d, short, linked, lead) for the members of each pivot p, itself included.

    The centre of a pivot's members is the set of the items that most of them have: p with each item changed in which more than
    half of them differ from it. d: the first items of D = x ^ centre of member x, the `out` ones that the centre lacks before those it has; size: |D|.
    With excess(x) = (100 + percent) |D| - (100 - percent) |x|, two members link for certain if their excesses sum up to 0 or less, as
    |x ^ y| <= |Dx| + |Dy|; so all `linked` members do with `lead`, the one of least excess. Others, as |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|,
    must share half of that sum over (100 + percent). One of the two isn't linked, which bounds its excess, so the linked one's
    first `short` items hold a shared one, and so do those of both if neither is linked. As |Dx - Dy| <= |x ^ y|, d need not be
    longer than size - (100 - percent) |x| / percent allows, whatever the partner."""
    whole = sets.select("node", "n", F.col("items").alias("x"))
    pivots = sets.select(F.col("node").alias("p"), F.col("items").alias("y")).join(star.select("p").distinct(), "p", "left_semi")
    d = _beside(star.join(whole, "node"), pivots)
    d = cut(d.select("node", "p", "n", F.array_except("x", "y").alias("more"), F.array_except("y", "x").alias("less")))
    kinds = d.select("p", F.explode("more").alias("key"), F.lit(True).alias("out")).unionByName(d.select("p", F.explode("less").alias("key"), F.lit(False).alias("out")))
    members = _few(cut(d.groupBy("p").agg(F.count("*").alias("k"))))
    most = kinds.groupBy("p", "key", "out").agg(F.count("*").alias("h")).where("h > 1").join(members, "p").where("2 * h > k")
    # at most twice the mean of |x ^ p| items a pivot
    most = cut(most.groupBy("p").agg(F.collect_list(F.when(F.col("out"), F.col("key"))).alias("add"), F.collect_list(F.when(~F.col("out"), F.col("key"))).alias("take")))
    none = F.array().cast("array<bigint>")
    d = _beside(d, most).withColumn("add", F.coalesce("add", none)).withColumn("take", F.coalesce("take", none))
    more = F.array_sort(F.concat(F.array_except("more", "add"), F.array_except("take", "less")))
    less = F.array_sort(F.concat(F.array_except("less", "take"), F.array_except("add", "more")))
    up, down = 100 + percent, 100 - percent
    d = d.select("node", "p", "n", more.alias("m"), less.alias("l")).select("node", "p", "n", F.concat("m", "l").alias("d"), F.size("m").alias("out")).withColumn("size", F.size("d")).withColumn("excess", up * F.col("size") - down * F.col("n"))
    d = cut(d)
    least = cut(d.groupBy("p").agg(F.min(F.struct("excess", "node")).alias("m")).select("p", F.col("m.excess").alias("least"), F.col("m.node").alias("lead")))
    d = d.join(_few(least), "p").withColumn("linked", (F.col("excess") + F.col("least") <= 0) | (F.col("node") == F.col("lead")))
    any_partner = F.greatest(F.lit(1), F.col("size") - F.floor(down * F.col("n") / percent + F.lit(1e-9)))
    not_linked = F.greatest(any_partner, F.ceil((F.col("excess") + F.greatest(F.col("least"), 1 - F.col("least"))) / F.lit(2 * up) - F.lit(1e-9)))
    return d.select("node", "p", "n", "size", "out", "d", F.when(F.col("linked"), not_linked).otherwise(any_partner).alias("any"), not_linked.alias("both"), "linked", "lead")


def _keys(whole: DataFrame) -> DataFrame:
    """(p, key, node, n, size, own, out, left, pos, before, short, linked, c, cp, marks): the items by which members meet, and what is known of each member.

    An item that a single member of p has is shared with none: it leaves the differences and counts as `own`. The `left` others
    stand in one order for all members of p, those that the centre lacks (`out`) first and rare ones before frequent ones; before: up to BEFORE items that precede one.
    marks: for each bit of WORDS longs, whether the number of differences that fall on it is odd; two members differ in at least as many items as their
    marks differ in bits."""
    items = cut(whole.select("p", "node", F.posexplode("d").alias("at", "key"), "out").select("p", "node", "key", (F.col("at") >= F.col("out")).alias("less")))
    often = items.groupBy("p", "key").agg(F.count("*").alias("h")).where("h > 1")
    items = cut(items.join(often, ["p", "key"]))
    word, bit = F.pmod("key", F.lit(WORDS)), F.pmod(F.shiftright("key", 32), F.lit(64)).cast("int")
    odd = [F.coalesce(F.expr(f"bit_xor(if(word = {w}, shiftleft(1L, bit), 0L))"), F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS)]
    marks = cut(items.withColumn("word", word).withColumn("bit", bit).groupBy("p", "node").agg(F.count("*").alias("left"), F.sum((~F.col("less")).cast("long")).alias("out"), *odd))
    marks = marks.select("p", "node", "left", "out", F.array(*[f"w{w}" for w in range(WORDS)]).alias("marks"))
    facts = cut(whole.drop("d", "out").join(marks, ["p", "node"]).withColumn("own", F.col("size") - F.col("left")))
    order = Window.partitionBy("p", "node").orderBy("less", "h", "key")
    placed = items.withColumn("pos", F.row_number().over(order) - 1).withColumn("before", F.collect_list("key").over(order.rowsBetween(-BEFORE, -1)))
    first = lambda need: F.greatest(F.lit(0), F.col("left") - F.col(need) + 1)
    placed = placed.select("p", "node", "key", "pos", "before").join(facts.withColumn("short", first("both")), ["p", "node"])
    return cut(placed.where(F.col("pos") < first("any")).drop("any", "both", "lead"))


def _bits_apart(a: str, b: str) -> Column:
    """In how many bits two members' marks differ."""
    return functools.reduce(operator.add, [F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w])) for w in range(WORDS)])


def _apart(found: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of members of one pivot in different components that may share enough of their differences from it.

    One of them, a, isn't linked to the lead. Pairs meet in the first item they share, which bounds how many can follow, and only if their marks allow a link. Whatever
    holds in an item holds in the first one they share too, so a pair may be left out where it shares one of the items shortly before."""
    at = cut(_named(_named(found, comp), comp, "lead", "cp"))
    mixed = cut(at.groupBy("p").agg(F.max(F.col("c") != F.col("cp")).alias("mixed")).where("mixed").select("p"))
    keys = _keys(cut(at.join(_few(mixed), "p")))
    facts = ("node", "n", "size", "own", "out", "left", "pos", "before", "c", "marks")
    a = keys.where("c <> cp").select("p", "key", *[F.col(x).alias(f"{x}_a") for x in (*facts, "short")])
    b = keys.where("pos < short").select("p", "key", *[F.col(x).alias(f"{x}_b") for x in (*facts, "linked")], (F.col("c") == F.col("cp")).alias("in_b"))
    up, down = 100 + percent, 100 - percent
    had = F.least(F.col("left_a") - F.greatest("out_a", "pos_a"), F.col("left_b") - F.greatest("out_b", "pos_b"))
    follow = had + F.greatest(F.lit(0), F.least(F.col("out_a") - F.col("pos_a"), F.col("out_b") - F.col("pos_b")))
    enough = 2 * up * follow >= up * (F.col("size_a") + F.col("size_b")) - down * (F.col("n_a") + F.col("n_b"))
    close = up * (F.col("own_a") + F.col("own_b") + _bits_apart("marks_a", "marks_b")) <= down * (F.col("n_a") + F.col("n_b"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    open_b = F.col("linked_b") | ((F.col("pos_a") < F.col("short_a")) & (F.col("in_b") | (F.col("node_a") < F.col("node_b"))))
    met = a.join(b, ["p", "key"]).where((F.col("c_a") != F.col("c_b")) & open_b & near & enough & close & ~F.arrays_overlap("before_a", "before_b"))
    return cut(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())


def _met(pairs: DataFrame, docs: DataFrame, reps: DataFrame, order, k: int, percent: int, orders: int) -> DataFrame:
    """(a, b) of the pairs whose prefixes meet under all other orders, as often as linked sets' do, and whose whole sets link."""
    names = [f"{x}{w}" for w in range(1, orders) for x in "ol"]
    heads = cut(_orders(docs, _ends(pairs, reps), order, k, percent, orders))
    side = lambda x: heads.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), *[F.col(o).alias(f"{o}{x}") for o in names])
    meet = [F.size(F.array_intersect(f"o{w}a", f"o{w}b")) + F.least(f"l{w}a", f"l{w}b") >= _shared(F.col("na"), F.col("nb"), percent) for w in range(1, orders)]
    passed = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(functools.reduce(operator.and_, meet, F.lit(True))).select("a", "b"))
    sets = cut(_whole(docs, _ends(passed, reps), k))
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("items").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    linked = cut(passed.join(a, "a").join(b, "b").where(both * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b"))
    free(heads, passed, sets)
    return linked


def _ends(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of reps (node, ...) that are an end of a pair."""
    return cut(reps.join(_few(cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())), "node", "left_semi"))


def _components(links: DataFrame) -> DataFrame:
    """(node, c) of all ends of links."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return cut(components(ends, links, "node").select(F.col("id").alias("node"), F.col("component").alias("c")))


def _named(m: DataFrame, comp: DataFrame | None, node: str = "node", name: str = "c") -> DataFrame:
    """m with the component of its node so far."""
    if comp is None:
        return m.withColumn(name, F.col(node))
    return m.join(_few(comp.select(F.col("node").alias(node), F.col("c").alias("found"))), node, "left").withColumn(name, F.coalesce("found", node)).drop("found")


def _links(kept: DataFrame, docs: DataFrame, reps: DataFrame, order, k: int, percent: int, orders: int, small: int = SMALL) -> DataFrame:
    """(a, b): enough links between classes to make the components of all, from the members (s, node, ix) of each prefix shingle."""
    def grouped(m: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs of the small groups: at most small / 2 for each member; members of the large ones with their group's size k)."""
        wide = cut(m.groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") > small))
        members = m.join(_few(wide), "s", "left_anti").groupBy("s").agg(F.collect_list(F.struct("node", "ix")).alias("x"))
        two = members.select(F.posexplode("x").alias("i", "p"), "x").select("p", F.explode(F.slice("x", F.lit(1), F.col("i"))).alias("q")).where("p.ix or q.ix")
        pairs = cut(two.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct())
        return pairs, cut(m.join(_few(wide), "s"))

    sized = _few(reps.select("node", "n"))
    pool, large = grouped(kept)
    # sets that link lie in one band of sizes or in two next to each other; a large group is split into such neighbours
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + F.lit(1e-9))
    more, large = grouped(large.join(sized, "node").select(F.explode(F.array(band, band - 1)).alias("band"), "s", "node", "ix").select(F.xxhash64("s", "band").alias("s"), "node", "ix"))
    pool = pool.unionByName(more)
    # the pivot of a group is the member that lies in most of the large ones
    degree = _few(cut(large.groupBy("node").agg(F.sum("k").alias("d"))))
    pivot = large.join(degree, "node").groupBy("s").agg(F.max(F.struct("d", "node")).alias("m")).select("s", F.col("m.node").alias("p"))
    star = cut(large.join(_few(cut(pivot)), "s").select("node", "p").distinct())
    free(large)
    near_pivot = cut(_whole(docs, _ends(star.select(F.col("node").alias("a"), F.col("p").alias("b")), reps), k))
    found = cut(_differences(star, near_pivot, percent))
    free(near_pivot)
    links = cut(found.where("linked and node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    comp = _components(links)
    pool = pool.unionByName(_apart(found, comp, percent)).distinct()
    pool = _named(_named(pool, comp, "a", "ca"), comp, "b", "cb").where("ca <> cb").select("a", "b")
    pool = pool.join(sized.toDF("a", "na"), "a").join(sized.toDF("b", "nb"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return links.unionByName(_met(cut(pool.select("a", "b")), docs, reps, order, k, percent, orders))


def join(docs: DataFrame, k: int = K, percent: int = PERCENT, orders: int = ORDERS, hot_shingles: int = HOT_SHINGLES) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, component) per row of docs (doc_id, text); th: the text's hash; component: a name of the component, null without words."""
    spark = docs.sparkSession
    scan = cut(_scan(docs, k))
    rows = scan.where("kind = 0").select("doc_id", "th", F.col("key").alias("node"), "n")
    least_id = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("m")
    reps = cut(rows.where("n > 0").groupBy("node").agg(least_id, F.first("n").alias("n")).select("node", "m.doc_id", "m.th", "n"))
    often = scan.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(hot_shingles).toArrow()
    hot = often.column("key").to_numpy().view(U)
    by = np.argsort(hot)
    rank = np.minimum(63, np.log2(np.maximum(1, often.column("n").to_numpy())).astype(np.int64) * 2 + 1)
    order = spark.sparkContext.broadcast(Order(hot[by], rank[by]))

    # prefix shingles that more than one class has, in one shuffle; a frequent one is dealt to several tasks, as it needs no test
    salt = F.when(F.col("hot"), F.pmod("node", F.lit(64))).otherwise(0).cast("int")
    bucket = Window.partitionBy("s", "salt")
    dealt = _prefixes(docs, order, k, percent).withColumn("salt", salt).repartition("s", "salt").groupBy("s", "salt", "node").agg(F.max("hot").alias("hot"), F.max("ix").alias("ix"))
    shared = dealt.withColumn("x", F.min("node").over(bucket)).withColumn("y", F.max("node").over(bucket)).withColumn("any", F.max("ix").over(bucket))
    kept = cut(shared.where("hot or any and x <> y").select("s", "node", "ix"))
    some = cut(kept.groupBy("s").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.max("ix").alias("any")).where("any and x <> y").select("s"))
    every, kept = kept, cut(kept.join(_few(some), "s"))
    free(every, some)
    final = _components(_links(kept, docs, reps, order, k, percent, orders))
    free(kept)

    low = cut(_named(reps, final).groupBy("c").agg(F.min("doc_id").alias("component_id")))
    classes = cut(_named(reps, final).join(low, "c").select("node", F.col("c").alias("component"), "component_id"))
    some = rows.where("n > 0").join(classes, "node").select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "component")
    none = rows.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("component"))
    return some.unionByName(none)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: of its least id and, among rows of that id, of the least text hash.

    Rows without words are linked with nothing and all stay. Columns keep their names and values."""
    found = join(docs.select("doc_id", "text"), **options).where("n_shingles > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("m")
    win = cut(found.groupBy("component").agg(best).select(F.col("m.doc_id").alias("wk"), F.col("m.th").alias("wt")).distinct())
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("k"), docs["text"].alias("text"))
    worded = F.coalesce(F.col("text").rlike(TOKEN), F.lit(False))
    kept = rows.where(worded).select("row", "k", F.xxhash64("text").alias("t")).join(win, F.col("k").eqNullSafe(F.col("wk")) & (F.col("t") == F.col("wt"))).groupBy("k", "t").agg(F.first("row").alias("row"))
    return kept.select("row").unionByName(rows.where(~worded).select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
