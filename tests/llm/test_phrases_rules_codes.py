"""Phrases, quality rules and vector codes against brute force, held-out labels and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import codes, phrases, rules_trees
from sieveline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_phrases(rows, least, most):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in count.items():
        many = {p: n for p, n in c.items() if n >= least and len(p) > 1}
        inside = {q[i:j] for q in many for i in range(len(q)) for j in range(i + 1, len(q) + 1) if j - i < len(q) and many[q] >= c[q[i:j]]}
        ranked = []
        for p, a in many.items():
            if p in inside:
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(ranked)[:most], 1)]
    return sorted(out)


def mined(docs, least, most):
    got = phrases.top(phrases.scored(*phrases.levels(docs, least)), most)
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def phrase_rows():
    rng = random.Random(11)
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(["New York", "new\tyork city", "a", "b", "of the", "of the sea", "Ünïcode ÉÉ", "x."]) + rng.choice(["", "", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    return rows + [("en", None), (None, None), ("fr", ""), ("en", "same same " * 3000), ("en", "a b c d e f g " * 500), ("en", "a b c d e f g " * 500)]


@pytest.mark.parametrize(("least", "most"), [(5, 2000), (40, 3)])
def test_phrases_equal_brute_force(spark, least, most):
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, text, "q", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(5)
    want = brute_phrases(rows, least, most)
    assert len(want) > 6 and mined(docs, least, most) == want


def test_phrases_are_the_same_when_the_bitmap_is_full(spark, monkeypatch):
    """All bits set: nothing is pruned, and counts decide alone."""
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "_bitmap", lambda level, k, grams: phrases.Frequent(16, np.full(1 << 13, 255, np.uint8)))
    assert mined(docs, 5, 2000) == brute_phrases(rows, 5, 2000)


def test_the_bitmap_prunes(spark):
    """What a level emits has two frequent parts, but for a few false hits."""
    docs = spark.createDataFrame(phrase_rows(), "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    one = phrases._emitted(docs, 1, None).where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where("n >= 400")
    known = spark.sparkContext.broadcast(phrases._bitmap(one, 1, one.count()))
    frequent = {(r["lang"], r["phrase"]) for r in one.collect()}
    two = phrases._emitted(docs, 2, known).select("lang", "phrase").distinct().collect()
    assert two and all({(r["lang"], w) for w in r["phrase"].split(" ")} <= frequent for r in two)
    assert len(two) < phrases._emitted(docs, 2, spark.sparkContext.broadcast(phrases.Frequent(16, np.full(1 << 13, 255, np.uint8)))).select("lang", "phrase").distinct().count()


def test_phrase_scores_beyond_64_bits(spark):
    big = 3 * 10**15
    grams = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 7), ("en", "a b", 2, big - 9)], "lang string, phrase string, k int, n long")
    got = phrases.scored(grams, spark.createDataFrame([("en", 9 * 10**16)], "lang string, total long")).collect()
    assert [r["score"] for r in got] == [1000 * (big - 9) * 9 * 10**16 // (big * (big - 7))]


def test_phrases_of_an_empty_table(spark):
    assert mined(spark.createDataFrame([], "lang string, text string"), 100, 10) == []


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


TEXTS = [None, "", " \n\t", "one", "a b c", "a b c a b c", "x\nx\nx \nx\r\nx\r", "Ünï çödé 語\n語\n語", "\n\na\n\na\n", "# * $ % & | < >", "same " * 30000, "A a A a A a", "\n".join(["line one two"] * 4), "a\x0bb\x0cc\x1cd e"]


def test_rule_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rules_trees.judge(docs, rules_trees.train(np.zeros((0, 13)), np.zeros(0))).collect()
    assert len(got) == len(text)
    for r in got:
        want = brute_counts(text[r["doc_id"]])
        assert [r[c] for c in rules_trees.COUNTS] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_rules_on_held_out_labels(spark):
    got = QUERIES["op12_quality_rules"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept or n_words < 50").count() >= 0.97 * good.count() and bad.where("not kept").count() >= 0.9 * bad.count()


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    y = ((x[:, 0] - x[:, 1] + np.sin(9 * x[:, 2]) / 2 + rng.normal(0, 0.3, 3000)) > 0).astype(float)
    model = rules_trees.train(x, y, np.array([1, -1, 0]))
    assert ((model.probability(x) > 0.5) == y).mean() > 0.8
    free = rules_trees.train(x, y, np.zeros(3, int))

    def turns(m, f):
        p = np.repeat(x[:200], 50, 0)
        p[:, f] = np.tile(np.linspace(0, 1, 50), 200)
        return np.diff(m.log_odds(p).reshape(200, 50), axis=1)

    assert (turns(model, 0) >= -1e-12).all() and (turns(model, 1) <= 1e-12).all() and (turns(free, 0) < -1e-6).any()

    def walk(row):  # node by node
        total = model.start
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return total

    assert np.allclose(model.log_odds(x[:50]), [walk(r) for r in x[:50]])


def test_rules_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 60, 7), (1, None, 7), (None, "w" * 100000, 7), (3, "good text here " * 30, 7)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    for d, lab in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels.where("doc_id = 1"))):
        got = rules_trees.judge(d, rules_trees.fit(d, lab)).collect()
        assert len(got) == d.count() and all(0 <= r["score"] <= 1 for r in got)


def brute_codes(rows, entries=256, rounds=4, parts=4):
    kept = sorted((i, v) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) for c in v] for _, v in kept], object)
    width = x.shape[1] // parts
    books, at = [], []
    for p in range(parts):
        part = x[:, p * width : (p + 1) * width]
        book = part[:entries].copy()
        for k in range(rounds + 1):
            d = [[int(((v - z) ** 2).sum()) for z in book] for v in part]
            near = [min(range(len(book)), key=lambda j, row=row: (row[j], j)) for row in d]
            if k < rounds:
                for j in set(near):
                    own = part[[i for i, n in enumerate(near) if n == j]]
                    book[j] = [sum(own[:, c]) // len(own) for c in range(width)]
        books.append(book)
        at.append([(n, d[i][n]) for i, n in enumerate(near)])
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted((kept[i][0], "".join(f"{at[p][i][0]:02x}" for p in range(parts)), sum(at[p][i][1] for p in range(parts))) for i in range(len(kept))), sha


def vectors(kind):
    rng = np.random.default_rng(7)
    if kind == "clusters":  # far apart, so that whole subtrees go to one entry
        x = rng.normal(0, 0.02, (900, 8)) + rng.integers(0, 9, (900, 1)) * 3
    elif kind == "ties":
        x = rng.integers(-2, 3, (700, 8)) / 1024
    elif kind == "few":
        x = rng.normal(0, 1, (9, 12))
    else:  # beyond the floats' 53 bits
        x = rng.normal(0, 1, (300, 4)) * 10.0 ** rng.integers(0, 6, (300, 1))
    rows = [(i * 3, [float(np.float32(v)) for v in r], int(i % 3) if i % 7 else None) for i, r in enumerate(x)]
    d = len(rows[0][1])
    return [*rows, (-1, None, 1), (-2, [float("nan")] + [0.0] * (d - 1), 1), (-3, [None] + [0.0] * (d - 1), 1), (-4, [float("inf")] * d, None)]


@pytest.mark.parametrize("kind", ["clusters", "ties", "few", "wide"])
def test_vector_codes_equal_brute_force(spark, kind):
    rows = vectors(kind)
    table = spark.createDataFrame([(*r, "q") for r in rows], "vec_id bigint, embedding array<float>, label int, code string").repartition(3)
    got, books = codes.compress(table)
    want, sha = brute_codes(rows)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got.collect()) == want and codes.digest(books) == sha
    label = {i: y for i, _, y in rows}
    per = Counter()
    for i, _, e in want:
        per[label[i]] += e
    for limit in (100, 0):
        out = codes.with_label_error(got, limit).collect()
        assert len(out) == len(want) and all(r["label_error"] == per[r["label"]] for r in out)


def test_boxes_assign_whole_subtrees():
    x = np.concatenate([np.full((64, 4), 5), np.full((64, 4), 900)]).astype(np.int64)
    tree = codes.Tree(x[codes.kd_order(x)], np.ones(128, bool), np.array([[0] * 4, [10] * 4, [1000] * 4], object))
    whole, leaf, _ = tree.walk()
    assert not len(leaf) and sum(len(n) for _, n, _ in whole) == 2
    assert tree.assigned()[2].tolist() == [64, 0, 64]


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    rows = [(None, [1.0, 2.0], None), (1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [], 2), (3, [3e38] * 3, 2)]
    for table, n in ((spark.createDataFrame(rows, schema), 5), (spark.createDataFrame([], schema), 0), (spark.createDataFrame([(1, None, 1)], schema), 0), (spark.createDataFrame([(1, [], 1)], schema), 1)):
        got, _ = codes.compress(table)
        assert codes.with_label_error(got).count() == n


def test_filters_of_short_hashes_say_what_they_lose(spark):
    """Each prefix tells how many of its shingles share their short hash with another, and the filters pass what links."""
    from sieveline.llm import jaccard_join
    from sieveline.llm.common import cut

    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"b{g}x{i}" for i in range(120)]
        for _ in range(5):
            x = list(base)
            x[rng.randrange(120)] = f"u{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = spark.sparkContext.broadcast(jaccard_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    reps = cut(jaccard_join._scan(docs, 5).where("kind = 0").select(F.col("key").alias("node"), "doc_id", "th", "n"))
    a, b = (reps.select(F.col("node").alias(x), F.col("doc_id").alias(f"i{x}")) for x in "ab")
    pairs = cut(a.join(b, F.floor(F.col("ia") / 5) == F.floor(F.col("ib") / 5)).where("ia < ib").select("a", "b"))
    want = {tuple(r) for r in jaccard_join._met(pairs, docs, reps, order, 5, 75, 3).collect()}
    heads = jaccard_join._orders(docs, reps, order, 5, 75, 3).collect()
    assert want and all(len(h["o1"]) - len(set(h["o1"])) == h["l1"] and len(h["o2"]) - len(set(h["o2"])) == h["l2"] for h in heads)


def test_jaccard_members_that_cannot_link_do_not_meet(spark):
    """Texts made of the same passages share many differences from their centre; of their pairs only those that may link come out of the join."""
    from sieveline.llm import jaccard_join
    from sieveline.llm.common import cut

    rng = random.Random(7)
    passages = [[rng.getrandbits(62) for _ in range(8)] for _ in range(60)]
    sets = {i: {x for p in rng.sample(passages, 25) for x in p} for i in range(80)}
    sets |= {80 + i: {*list(sets[i])[3:], *(rng.getrandbits(62) for _ in range(3 + i))} for i in range(12)}  # copies of some of them
    table = cut(spark.createDataFrame([(k, len(v), sorted(v)) for k, v in sets.items()], "node bigint, n bigint, items array<bigint>"))
    found = cut(jaccard_join._differences(cut(table.select("node", F.lit(79).cast("bigint").alias("p"))), table, 75))
    links = cut(found.where("linked and node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    comp = jaccard_join._components(links)
    of = {r["node"]: r["c"] for r in comp.collect()}
    got = {tuple(r) for r in jaccard_join._apart(found, comp, 75).select("a", "b").collect()}
    linked = {(a, b) for a in sets for b in sets if a < b and of.get(a, a) != of.get(b, b) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(linked) >= 10 and linked <= got and len(got) <= 2 * len(linked)
