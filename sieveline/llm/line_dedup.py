"""Line deduplication on content-defined chunks of lines (operator 2).

Chunks find what texts share, and matches are extended from them line by line:
- a chunk ends after line i if the rolling hash over the hashes of lines i-1 and i is not above that of line i-1 or of line i+1, or if line i
  or i+1 is long. So boundaries depend on neighbours alone. A line of more than a sixth of `run_words` words is a chunk by itself, too;
- a chunk that occurs more than once is extended in both directions to the runs of whole lines around it that have just more than `run_words`
  words: those that end as soon as they have them and those that start as late. A run hangs on one chunk in it, which its own lines alone choose
  (`_anchor`), so equal runs hang on equal chunks, and every run with so many words has one;
- a run, or a chunk of several lines (or one long line), goes everywhere but at its first occurrence, its owner, by (doc_id, row hash, position); a copy
  that overlaps its owner in the same text stays. Matches next to each other that have one owner at one distance are one match. Its bytes are compared with the
  owner's lines, and only lines whose bytes are equal go: digests (BLAKE2b) choose candidates, and what they confuse stays.

Spark plan: digests alone are grouped and joined back. Of the texts, only owners' matched lines travel, once for each match; they meet the documents in
one join on a row hash. The repeated digests are broadcast only below `broadcast_rows`, else joined by shuffle.

Defined results: null and empty texts stay as they are; rows equal in id and text get the same decision;
null ids sort first; pieces of white space are never removed; every other column is carried through
unchanged, whatever its name; an empty table gives an empty table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, table
from sieveline.llm.vec import U, mix

#: Characters from which a line is a chunk of its own and goes alone.
LONG_LINE = 160
#: Shared runs of whole lines with more words than this are removed.
RUN_WORDS = 50
#: A run has a line with more than a WORDY-th of its words, or more than WORDY lines and then a chunk whose ends its own lines choose.
WORDY = 6
BROADCAST_ROWS = 500_000


def _ends(lines: list[str], long_line: int) -> np.ndarray:
    """The last line of each chunk of a text."""
    h = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in lines), U)
    roll = mix(np.append(h[:1], h[:-1]) * U(0x9E3779B97F4A7C15) + h)
    end = np.array([len(x) >= long_line for x in lines])
    end[:-1] |= end[1:]
    end[:-1] |= roll[:-1] <= roll[1:]
    end[1:] |= roll[1:] <= roll[:-1]
    end[-1] = True
    return np.flatnonzero(end)


def _extended(sums: np.ndarray, run_words: int) -> np.ndarray:
    """(first line, last line) of the runs of whole lines with just more than run_words words; sums: words before each line."""
    at = np.arange(len(sums) - 1)
    end = np.searchsorted(sums, sums[:-1] + run_words, "right") - 1  # the least with more words from at on
    start = np.searchsorted(sums, sums[1:] - run_words, "left") - 1  # the greatest with more words up to at
    forth, back = end < len(at), start >= 0
    return np.unique(np.concatenate([np.stack([at[forth], end[forth]], 1), np.stack([start[back], at[back]], 1)]), axis=0)


def _anchor(runs: np.ndarray, first: np.ndarray, last: np.ndarray, wordy: np.ndarray) -> np.ndarray:
    """(first line, last line) of the chunk that each run hangs on: its first wordy line, or its first chunk that starts behind its third line.

    Without a wordy line a run has WORDY + 1 lines at least. A boundary follows from three lines around it and the one before, so all from the third line to the last
    but one are the same wherever the run stands; of two lines in a row one at least is a boundary, so such a chunk ends before the run does."""
    w = np.append(wordy, np.iinfo(np.int64).max)[np.searchsorted(wordy, runs[:, 0])]
    c = np.minimum(np.searchsorted(first, runs[:, 0] + 3), len(first) - 1)
    return np.where((w <= runs[:, 1])[:, None], np.stack([w, w], 1), np.stack([first[c], last[c]], 1))


def _digests(rows: DataFrame, long_line: int, run_words: int, digest_size: int) -> DataFrame:
    """(rid, id, lo, hi, h, g, hangs, alone) of the chunks of the rows' texts and of the runs around them; h and g are the halves of a digest, hangs is h of the
    chunk that a run hangs on and null for chunks; alone: whether a repeated chunk goes without a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            spans: list[np.ndarray] = []
            digest: list[bytes] = []
            hangs: list[bytes] = []
            alone: list[bool] = []
            chunk: list[bool] = []
            for i, text in enumerate(b.column(2).to_pylist()):
                lines = text.split("\n")
                last = _ends(lines, long_line)
                first = np.append(0, last[:-1] + 1)
                words = np.array([len(x.split()) for x in lines])
                sums = np.append(0, np.cumsum(words))
                goes = {(x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True) if (y > x or len(lines[x]) >= long_line) and "".join(lines[x : y + 1]).strip()}
                runs = _extended(sums, run_words) if sums[-1] > run_words else np.zeros((0, 2), np.int64)
                on = list(map(tuple, _anchor(runs, first, last, np.flatnonzero(words * WORDY > run_words)).tolist()))
                chunks = list(goes.union(on))
                of = {(x, y): hashlib.blake2b("\n".join(lines[x : y + 1]).encode(), digest_size=digest_size).digest().ljust(16, b"\0") for x, y in {*chunks, *map(tuple, runs.tolist())}}
                spans += [np.array(chunks, np.int32).reshape(-1, 2), runs]
                at += [i] * (len(chunks) + len(runs))
                digest += [of[x] for x in chunks] + [of[x, y] for x, y in runs.tolist()]
                hangs += [of[x] for x in on]
                alone += [x in goes for x in chunks] + [False] * len(runs)
                chunk += [True] * len(chunks) + [False] * len(runs)
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            lo, hi = np.concatenate([np.zeros((0, 2), np.int64), *spans]).astype(np.int32).T
            none = np.array(chunk, bool)
            on_h = np.zeros(len(at), np.int64)
            on_h[~none] = np.frombuffer(b"".join(hangs), np.int64).reshape(-1, 2)[:, 0]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(lo), pa.array(hi), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(on_h, mask=none), pa.array(alone, pa.bool_())],
                names=["rid", "id", "lo", "hi", "h", "g", "hangs", "alone"],
            )

    src = rows.select("rid", F.col("row.doc_id").alias("id"), F.coalesce("row.text", F.lit("")).alias("text"))
    return src.mapInArrow(run, f"rid bigint, id {src.schema['id'].dataType.simpleString()}, lo int, hi int, h bigint, g bigint, hangs bigint, alone boolean")


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, lo, hi, orid, olo) from (rid, spans): spans that touch or overlap and have one owner at one distance become one match."""
    for b in batches:
        out: list[tuple] = []
        for rid, found in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            new = True
            for s in sorted((x["orid"], x["shift"], x["lo"], x["hi"]) for x in found.as_py()):
                if not new and out[-1][3:5] == s[:2] and s[2] <= out[-1][2] + 1:
                    out[-1] = (rid, out[-1][1], max(out[-1][2], s[3]), *s[:2])
                else:
                    out.append((rid, s[2], s[3], *s[:2]))
                new = False
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array([x - y for x, y in zip(cols[1], cols[4], strict=True)], pa.int32())],
            names=["rid", "lo", "hi", "orid", "olo"],
        )


def _body(lines: Column, lo: Column, hi: Column) -> Column:
    return F.array_join(F.slice(lines, lo + 1, hi - lo + 1), "\n")


def _with_bodies(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """(rid, spans: lo, hi and the owner's lines) of matches (rid, lo, hi, orid, olo)."""
    ohi = (F.col("olo") + F.col("hi") - F.col("lo")).alias("ohi")
    wanted = matches.select("orid", F.struct("olo", ohi).alias("o")).groupBy("orid").agg(F.collect_set("o").alias("os"))
    owners = rows.select(F.col("rid").alias("orid"), F.col("row.text").alias("text")).join(wanted, "orid").dropDuplicates(["orid"])
    both = F.array(F.struct(F.split("text", "\n", -1).alias("l"), F.col("os")))
    bodies = F.transform(both, lambda x: F.transform(x["os"], lambda o: F.struct(o["olo"].alias("olo"), o["ohi"].alias("ohi"), _body(x["l"], o["olo"], o["ohi"]).alias("body"))))
    bodies = owners.select("orid", F.explode(bodies[0]).alias("o")).select("orid", "o.olo", "o.ohi", "o.body")
    return matches.select("rid", "lo", "hi", "orid", "olo", ohi).join(bodies, ["orid", "olo", "ohi"]).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "body")).alias("spans"))


def _left(text: Column, spans: Column) -> Column:
    """struct<text, k>: the text without the lines of the spans whose bytes are the owner's, and how many those are."""

    def equal(x: Column) -> Column:
        same = F.filter(x["spans"], lambda s: _body(x["l"], s["lo"], s["hi"]) == s["body"])
        gone = F.flatten(F.transform(same, lambda s: F.sequence(s["lo"], s["hi"])))
        return F.struct(x["l"].alias("l"), F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), gone).alias("at"))

    def rest(x: Column) -> Column:
        return F.struct(F.array_join(F.transform(x["at"], lambda i: F.get(x["l"], i)), "\n").alias("text"), (F.size(x["l"]) - F.size(x["at"])).alias("k"))

    held = F.array(F.struct(F.split(text, "\n", -1).alias("l"), spans.alias("spans")))
    return F.transform(F.transform(held, equal), rest)[0]


def dedup(docs: DataFrame, long_line: int = LONG_LINE, broadcast_rows: int = BROADCAST_ROWS, drop_emptied: bool = False, run_words: int = RUN_WORDS, digest_size: int = 16) -> DataFrame:
    """docs with repeated pieces taken out of `text`, plus the `n_removed` lines if no column has that name.

    drop_emptied: leave out rows whose text had words and lost all of them. digest_size: bytes of the digests, 16 at most."""
    cols = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), F.xxhash64(docs["doc_id"], docs["text"]).alias("rid"))
    few = lambda t: F.broadcast(t) if t.count() <= broadcast_rows else t
    # no column of the caller's is visible beside ours from here on
    made = cut(_digests(rows, long_line, run_words, digest_size))
    chunks = cut(made.where("hangs is null").groupBy(F.col("h").alias("hangs")).agg(F.count("*").alias("n")).where("n > 1").select("hangs"))
    runs = made.where("hangs is not null").join(few(chunks), "hangs", "left_semi")
    pieces = made.where("alone").select("rid", "id", "lo", "hi", "h", "g").unionByName(runs.select("rid", "id", "lo", "hi", "h", "g"))
    first = F.min(F.struct("id", "rid", "lo", "hi")).alias("o")
    repeated = pieces.groupBy("h", "g").agg(F.count("*").alias("n"), first).where("n > 1")
    repeated = cut(repeated.select("h", "g", F.col("o.rid").alias("orid"), F.col("o.lo").alias("olo"), F.col("o.hi").alias("ohi")))
    found = pieces.join(few(repeated), ["h", "g"]).where("rid <> orid or lo > ohi")
    spans = found.groupBy("rid").agg(F.collect_set(F.struct("orid", (F.col("lo") - F.col("olo")).alias("shift"), "lo", "hi")).alias("spans"))
    matches = cut(spans.mapInArrow(_matches, "rid bigint, lo int, hi int, orid bigint, olo int"))
    out = rows.join(_with_bodies(matches, rows), "rid", "left")
    text = F.col("row.text")
    out = out.select("row", F.when(F.col("spans").isNull(), F.struct(text.alias("text"), F.lit(0).alias("k"))).otherwise(_left(text, F.col("spans"))).alias("o"))
    out = out.select("row", F.col("o.text").alias("t"), F.col("o.k").cast("long").alias("k"))
    if drop_emptied:
        out = out.where((F.col("k") == 0) | F.col("t").rlike(r"\S"))
    extra = [] if "n_removed" in cols else [F.col("k").alias("n_removed")]
    return out.select(*[F.col("t").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in cols], *extra)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated pieces, n_chars of it and n_removed lines, for all documents."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")
