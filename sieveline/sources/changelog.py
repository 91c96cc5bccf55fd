"""The changelog as a Spark data source: `spark.read.format("changelog")` and `spark.readStream.format("changelog")`.

Rows are (name, version, ts, action, serial). A serial is an offset: a batch reads the serials above `since`, or without it every row of a table, whatever its
serial and those without one too; a stream goes from the serials it has committed to the newest and resumes from its checkpoint. Ranges of serials are the partitions, so no task reads
more than `rowsPerPartition` serials and the driver sees the range's ends alone.

Options: `path`, a table of Parquet files anywhere that pyarrow's file systems reach, with columns named as above unless `name`, `version`, `ts`, `action` or `serial`
name others; or `endpoint`, an index's XML-RPC address, whose answers can't be split and are one partition. `since` (none) for batches;
`start` for streams: `latest` (the high-water mark: nothing of the past), `earliest` or a serial. `rowsPerPartition` (1 000 000); `maxPerBatch` (none), the
most serials that a batch of a stream spans.

A feed that can't be reached gives an empty batch and leaves the offset where it is, so that the next one asks for the same serials again. Only a stream
that has just been restarted, and so doesn't know its offset yet, stops instead, which loses nothing either. A batch fails."""

from __future__ import annotations

import xmlrpc.client
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "name string, version string, ts timestamp, action string, serial bigint"
_FIELDS = {"name": pa.string(), "version": pa.string(), "ts": pa.timestamp("us", "UTC"), "action": pa.string(), "serial": pa.int64()}
#: An offset below the serials of an index; a feed without rows is there.
BEFORE = -1
#: What reaching a feed may raise.
UNREACHABLE = (OSError, pa.ArrowException, xmlrpc.client.Error, EOFError)


@dataclass
class Range(InputPartition):
    """Serials above `after`, up to `upto`; blank: the rows without a serial too."""

    after: int
    upto: int
    blank: bool = False


class TableFeed:
    """Parquet files; statistics of their row groups answer most of what is asked."""

    splits = True

    def __init__(self, path: str, columns: dict[str, str]):
        self.path, self.columns = path, columns

    def _table(self) -> ds.Dataset:
        from pyarrow import fs

        if "://" not in self.path:
            return ds.dataset(self.path, format="parquet")
        where, path = fs.FileSystem.from_uri(self.path)
        return ds.dataset(path, format="parquet", filesystem=where)

    def last(self) -> int | None:
        """The newest serial; None without rows."""
        return self.ends()[1]

    def ends(self) -> tuple[int | None, int | None]:
        """The least and the newest serial; None without rows."""
        found, column = [], self.columns["serial"]
        for part in self._table().get_fragments():
            about = part.metadata
            place = about.schema.names.index(column)
            for i in range(about.num_row_groups):
                group = about.row_group(i)
                known = group.column(place).statistics
                if known is not None and known.has_min_max:
                    found += [known.min, known.max]
                elif group.num_rows:  # no statistics: read the column of this group
                    found += pc.min_max(part.subset(row_group_ids=[i]).to_table(columns=[column]).column(0)).as_py().values()
        found = [x for x in found if x is not None]
        return min(found, default=None), max(found, default=None)

    def rows(self, after: int, upto: int, blank: bool = False) -> Iterator[pa.RecordBatch]:
        serial = ds.field(self.columns["serial"])
        table = self._table()
        have = [c for c in self.columns.values() if c in table.schema.names]
        wanted = (serial > after) & (serial <= upto)
        for b in table.to_batches(columns=have, filter=wanted | serial.is_null() if blank else wanted):
            of = lambda k, b=b: b.column(self.columns[k]) if self.columns[k] in have else pa.nulls(len(b))
            out = {k: of(k) for k in _FIELDS}
            if pa.types.is_timestamp(out["ts"].type):
                ts = out["ts"].cast(pa.timestamp("us", out["ts"].type.tz))
                out["ts"] = ts if ts.type.tz else pc.assume_timezone(ts, "UTC")
            yield pa.RecordBatch.from_arrays([x.cast(_FIELDS[k]) for k, x in out.items()], names=list(_FIELDS))


class RpcFeed:
    """The methods changelog_last_serial and changelog_since_serial of an index."""

    splits = False

    def __init__(self, endpoint: str):
        self.endpoint = endpoint

    def last(self) -> int | None:
        return xmlrpc.client.ServerProxy(self.endpoint).changelog_last_serial()

    def ends(self) -> tuple[int | None, int | None]:
        return BEFORE + 1, self.last()

    def rows(self, after: int, upto: int, blank: bool = False) -> Iterator[pa.RecordBatch]:
        rows = [r for r in xmlrpc.client.ServerProxy(self.endpoint, allow_none=True).changelog_since_serial(after) if r[4] <= upto]
        for at in range(0, len(rows), 10_000):
            name, version, ts, action, serial = zip(*rows[at : at + 10_000], strict=True)
            times = pa.array(ts, pa.int64()).cast(pa.timestamp("s", "UTC")).cast(_FIELDS["ts"])
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(version, pa.string()), times, pa.array(action, pa.string()),
                pa.array(serial, pa.int64())], names=list(_FIELDS))


def feed(options: dict[str, str]) -> TableFeed | RpcFeed:
    if "endpoint" in options:
        if not options["endpoint"].lower().startswith(("http://", "https://")):
            raise ValueError("endpoint: only http and https")
        return RpcFeed(options["endpoint"])
    if "path" not in options:
        raise ValueError("changelog: give path or endpoint")
    return TableFeed(options["path"], {k: options.get(k, k) for k in _FIELDS})


def ranges(source: TableFeed | RpcFeed, after: int, upto: int, rows: int) -> list[Range]:
    """At most `rows` serials each; a feed that can't be split is one."""
    if upto <= after:
        return []
    step = rows if source.splits else upto - after
    return [Range(lo, min(lo + step, upto)) for lo in range(after, upto, step)]


class ChangelogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        since = options.get("since")
        self.source, self.since, self.size = feed(options), None if since is None else int(since), int(options.get("rowsPerPartition", 1_000_000))

    def partitions(self) -> list[Range]:
        least, last = self.source.ends()
        if self.since is not None:
            return ranges(self.source, self.since, BEFORE if last is None else last, self.size) or [Range(0, 0)]
        found = [] if last is None else ranges(self.source, least - 1, last, self.size)
        # rows without a serial come with the first range
        return [Range(x.after, x.upto, x is found[0]) for x in found] or [Range(0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.upto > partition.after or partition.blank:
            yield from self.source.rows(partition.after, partition.upto, partition.blank)


class ChangelogStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.source, self.start = feed(options), options.get("start", "latest")
        self.size, self.most = int(options.get("rowsPerPartition", 1_000_000)), int(options.get("maxPerBatch", 0))
        self.known: int | None = None  # the last offset that the engine has named

    def initialOffset(self) -> dict[str, int]:
        if self.start in ("latest", "earliest"):
            least, last = self.source.ends()
            known = last if self.start == "latest" else None if least is None else min(least - 1, BEFORE)
            self.known = BEFORE if known is None else known
        else:
            self.known = int(self.start)
        return {"serial": self.known}

    def latestOffset(self) -> dict[str, int]:
        try:
            last = self.source.last()
            last = BEFORE if last is None else last
        except UNREACHABLE:
            if self.known is None:
                raise
            last = self.known
        if self.known is not None:
            last = max(last, self.known)
            last = min(last, self.known + self.most) if self.most else last
        return {"serial": last}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        self.known = max(start["serial"], end["serial"])
        return ranges(self.source, start["serial"], end["serial"], self.size)

    def commit(self, end: dict[str, int]) -> None:
        self.known = end["serial"] if self.known is None else max(self.known, end["serial"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.source.rows(partition.after, partition.upto)


class ChangelogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChangelogReader:
        return ChangelogReader(self.options)

    def streamReader(self, schema) -> ChangelogStream:
        return ChangelogStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangelogSource)


def high_water(options: dict[str, str]) -> int | None:
    """The newest serial; None where the feed can't be reached or is empty, so that a fresh cursor waits instead of crawling the past."""
    try:
        return feed(options).last()
    except UNREACHABLE:
        return None
