"""Media columns over content-addressed tar shards (operator 5).

Payloads are stored as 8-bit greyscale PNG images (lossless; one sample per payload byte, 576 samples a row)
in tar shards on the shared folder. Each task writes its own shards under fresh names and stores equal payloads
of a shard once, under their digest; a row then carries only (digest, shard, offset, length). The rows are kept
as a table, so a lost executor never re-reads a half-written shard: shards of failed attempts are simply not
referenced. Metadata columns come from ranged reads of the first 33 bytes of a member (signature and IHDR);
features come from a ranged read of the whole member.

The bytes of the payloads never pass a shuffle or the driver.

Defined results: null text is empty; an empty payload is one row of 576 bytes of 255; equal texts give equal
values in every column but the location; ids may repeat or be null; an empty table gives no shard."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, scratch, table

WIDTH = 576
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return raw + b"\xff" * (size - len(raw)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A PNG with one 8-bit grey sample per byte; payload: whole rows of width samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # filter type 0 in front of each row
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits per sample) from the first 33 bytes of a PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode(media: bytes) -> bytes:
    """The samples of a PNG made by encode(); raises on a broken checksum."""
    width, height, _ = read_header(media[:HEADER])
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("row filter")
    return lines[:, 1:].tobytes()


class _Shard:
    """One open tar file on the shared folder; written in a stream, so memory holds a member at a time."""

    def __init__(self, root: str):
        self.path = f"{root}/shard-{uuid.uuid4().hex}.tar"
        store, name = fs.FileSystem.from_uri(self.path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.at, self.held = store.open_output_stream(name), 0, {}

    def put(self, digest: str, media: bytes) -> tuple[int, int]:
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + media + b"\0" * (-len(media) % tarfile.BLOCKSIZE))
            self.held[digest] = (self.at + len(head), len(media))
            self.at += len(head) + -(-len(media) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
        return self.held[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
        self.out.close()


def store(docs: DataFrame, root: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the texts of docs (doc_id, text) into tar shards under root; rows: doc_id, digest, shard, offset, length, n_bytes."""
    schema = "doc_id bigint, digest string, shard string, offset bigint, length bigint, n_bytes bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        try:
            for b in batches:
                rows: list[tuple] = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    payload, n = payload_of(text.as_py())
                    digest = hashlib.sha256(payload).hexdigest()
                    if shard is None or shard.at > shard_bytes:
                        if shard is not None:
                            shard.close()
                        shard = _Shard(root)
                    got = shard.held.get(digest) or shard.put(digest, encode(payload))
                    rows.append((doc_id, digest, shard.path, *got, n))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in schema.split(", ")])
        finally:
            if shard is not None:
                shard.close()

    uri = root if "://" in root else f"file://{root.removeprefix('file:')}"
    root = uri
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _ranged(path: str, opened: dict) -> pa.NativeFile:
    if path not in opened:
        for f in opened.values():
            f.close()
        opened.clear()
        where, name = fs.FileSystem.from_uri(path)
        opened[path] = where.open_input_file(name)
    return opened[path]


def metadata(index: DataFrame) -> DataFrame:
    """index plus width, height, bits, read from the member headers alone."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields) + ", width int, height int, bits int"
    names = [*index.columns, "width", "height", "bits"]
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            heads = [read_header(_ranged(p, opened).read_at(HEADER, o)) for p, o in zip(b.column(at["shard"]).to_pylist(), b.column(at["offset"]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([h[k] for h in heads], pa.int32()) for k in range(3)]], names=names)

    return index.mapInArrow(run, schema)


def spread(index: DataFrame, task_bytes: int = SHARD_BYTES // 4) -> DataFrame:
    """index in partitions of about task_bytes of stored bytes: rows of one stretch of a shard together, for the reads that follow."""
    total = index.agg(F.sum("length")).first()[0] or 0
    return index.repartition(max(1, -(-total // task_bytes)), "shard", F.floor(F.col("offset") / task_bytes))


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean difference of neighbours, as text."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    q = p[p > 0]
    rough = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(q * np.log2(q)).sum():.4f};rough={rough:.4f}"


def features(index: DataFrame) -> DataFrame:
    """doc_id and the columns computed from the stored bytes of each row's member."""
    src = index.select("doc_id", "digest", "shard", "offset", "length", "n_bytes", "width", "height")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, shard string, offset bigint, width int, height int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            rows: list[tuple] = []
            for doc_id, digest, path, offset, length, n, width, height in zip(*[c.to_pylist() for c in b.columns], strict=True):
                media = _ranged(path, opened).read_at(length, offset)
                payload = decode(media)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest or len(payload) != width * height:
                    raise ValueError(f"stored member {digest} reads back as {sha}")
                rows.append((doc_id, n, len(payload), sha, zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload), path, offset, width, height))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return src.mapInArrow(run, schema)


def members(shard: bytes) -> list[str]:
    """Names of a shard's members, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as t:
        return t.getnames()


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cut(store(table(spark, sf_dir, "documents"), scratch(spark)))
    return features(metadata(spread(index)))
