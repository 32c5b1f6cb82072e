"""Streams that go on where they stopped: lines added to files, and rows of a table beyond the largest cursor seen.

Both are Python data sources. The driver finds how far there is to read; partitions of bytes or cursor values are read by tasks. Offsets
are in the stream's checkpoint, so that a restart gives each line or row once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.tables import TIME_NAMES, VALUE_NAMES, parsed_time
from tidemark.streaming.feeds import points_from_json

_HEAD = 256


class _Files:
    """A file, or the files of a folder, wherever pyarrow can read."""

    def __init__(self, path: str):
        if "://" not in path and path.startswith("file:"):
            path = "file://" + path[5:]
        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def sizes(self) -> dict[str, int]:
        info = self.fs.get_file_info(self.root)
        if info.type == fs.FileType.NotFound:
            return {}
        found = [info] if info.type == fs.FileType.File else self.fs.get_file_info(fs.FileSelector(self.root))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}

    def read(self, path: str, start: int, end: int) -> bytes:
        with self.fs.open_input_file(path) as f:
            f.seek(start)
            return f.read(end - start)

    def head(self, path: str, n: int) -> str:
        return hashlib.sha256(self.read(path, 0, n)).hexdigest()[:16]

    def last_line_end(self, path: str, size: int, step: int = 1 << 16) -> int:
        """The place after the last line break; what follows is a line that isn't complete."""
        end = size
        while end > 0:
            start = max(0, end - step)
            found = self.read(path, start, end).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
        return 0


class _Bytes(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: bool):
        self.file, self.start, self.end, self.first = file, start, end, first


def _parts(file: str, start: int, end: int, size: int) -> list[_Bytes]:
    return [_Bytes(file, a, min(a + size, end), a == start) for a in range(start, end, size)]


def _lines(files: _Files, part: _Bytes, ahead: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The lines that begin within the part; the last may reach beyond its end."""
    at = part.start
    with files.fs.open_input_file(part.file) as f:
        if not part.first:
            # a line that began before is the other part's
            at -= 1
            f.seek(at)
            while True:
                block = f.read(ahead)
                found = block.find(b"\n")
                at += len(block) if found < 0 else found + 1
                if found >= 0 or not block:
                    break
        f.seek(at)
        held = b""
        while at < part.end:
            block = f.read(min(ahead, max(part.end - at - len(held), 0)) or ahead)
            held += block
            places, lines = [], []
            while at < part.end and (found := held.find(b"\n")) >= 0:
                places.append(at)
                lines.append(held[:found].rstrip(b"\r").decode("utf-8", "replace"))
                held, at = held[found + 1 :], at + found + 1
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(lines)), pa.array(places), pa.array(lines)], ["file", "at", "line"])
            if not block:
                return


class LineTail(DataSource):
    """``line_tail``: (file, at, line) of the complete lines of a file or of a folder's files, as they grow.

    Options: path; from_start (default true; false: only what is added from now on); split_bytes (of a partition). A file that
    became shorter, or whose first bytes changed, was replaced and is read from its beginning."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailStream(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _TailBatch(dict(self.options))


class _Tail:
    def __init__(self, options: dict[str, str]):
        self.options, self.split = options, int(options.get("split_bytes", 16 << 20))
        self.from_start = options.get("from_start", "true").lower() == "true"

    def files(self) -> _Files:
        return _Files(self.options["path"])

    def places(self) -> dict[str, dict]:
        files, out = self.files(), {}
        for path, size in sorted(files.sizes().items()):
            end = files.last_line_end(path, size)
            n = min(_HEAD, end)
            out[path] = {"place": end, "head": files.head(path, n), "head_bytes": n}
        return out

    def read(self, partition: _Bytes) -> Iterator[pa.RecordBatch]:
        yield from _lines(self.files(), partition)


class _TailBatch(_Tail, DataSourceReader):
    """All complete lines there are: the history before a stream begins."""

    def partitions(self) -> list[_Bytes]:
        return [p for path, x in self.places().items() for p in _parts(path, 0, x["place"], self.split)] or [_Bytes("", 0, 0, True)]

    def read(self, partition: _Bytes) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from super().read(partition)


class _TailStream(_Tail, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": {} if self.from_start else self.places()}

    def latestOffset(self) -> dict:
        return {"files": self.places()}

    def partitions(self, start: dict, end: dict) -> list[_Bytes]:
        files, out = self.files(), []
        for path, x in end["files"].items():
            old = start["files"].get(path)
            kept = old is not None and old["place"] <= x["place"] and files.head(path, old["head_bytes"]) == old["head"]
            out += _parts(path, old["place"] if kept else 0, x["place"], self.split)
        return out


class _Span(InputPartition):
    def __init__(self, low: int | None, high: int):
        self.low, self.high = low, high


def polling_source(name: str, schema: str, newest: Callable[[dict], int | None], fetch: Callable[[int | None, int, dict], Iterator[Any]]) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``: rows whose cursor, an integer, is beyond the largest seen.

    ``newest(options)`` gives the largest cursor there is (None: no rows); ``fetch(low, high, options)`` gives the rows with low < cursor <=
    high as tuples or record batches, low None for all up to high. A batch is fetched in ``parts`` (option) equal ranges of the cursor, each by a task.
    Rows that come later with a cursor already passed are not seen."""

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def initialOffset(self) -> dict:
            return {"cursor": int(self.options["initial_cursor"])} if "initial_cursor" in self.options else {"none": True}

        def latestOffset(self) -> dict:
            at = newest(self.options)
            return self.initialOffset() if at is None else {"cursor": at}

        def partitions(self, start: dict, end: dict) -> list[_Span]:
            if "cursor" not in end or start.get("cursor") == end["cursor"]:
                return []
            low, high, parts = start.get("cursor"), end["cursor"], max(1, int(self.options.get("parts", "4")))
            if low is not None and low > high:
                return []
            begin = low if low is not None else int(self.options.get("least_cursor", high))
            edges = sorted({begin + (high - begin) * k // parts for k in range(1, parts)} | {high})
            return [_Span(a, b) for a, b in zip([low, *edges[:-1]], edges, strict=True) if a is None or a < b]

        def read(self, partition: _Span) -> Iterator[Any]:
            yield from fetch(partition.low, partition.high, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(dict(self.options))

    return Source


def _times(options: dict) -> tuple[dataset.Dataset, str]:
    files = _Files(options["path"])
    return dataset.dataset(files.root, filesystem=files.fs, format="parquet"), options["time"]


def _micros(t: datetime) -> int:
    return round((t.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


def _newest_time(options: dict) -> int | None:
    """The largest time in a Parquet table, from the row groups' statistics where they have them; option ``until`` (microseconds) hides what is later."""
    data, time = _times(options)
    most = None
    for piece in data.get_fragments():
        for group in piece.split_by_row_group():
            found = group.row_groups[0].statistics or {}
            value = found.get(time, {}).get("max")
            if value is None:
                column = group.to_table(columns=[time]).column(0)
                value = max((x for x in column.to_pylist() if x is not None), default=None)
            if value is not None:
                most = max(most, _micros(value)) if most is not None else _micros(value)
    return min(most, int(options["until"])) if most is not None and "until" in options else most


def _rows_between(low: int | None, high: int, options: dict) -> Iterator[pa.RecordBatch]:
    data, time = _times(options)
    kind = data.schema.field(time).type
    at = lambda x: pa.scalar(x, pa.timestamp("us")).cast(pa.timestamp(kind.unit), safe=False).cast(kind)
    chosen = dataset.field(time) <= at(high)
    if low is not None:
        chosen = chosen & (dataset.field(time) > at(low))
    columns = {"series_id": dataset.field(options["series"]).cast(pa.string()), "t": dataset.field(time).cast(pa.timestamp("us", "UTC")), "value": dataset.field(options["value"]).cast(pa.float64())}
    yield from data.to_batches(columns=columns, filter=chosen)


#: ``table_cursor``: points of a Parquet table by time. Options: path, time, series, value (its columns).
TableCursor = polling_source("table_cursor", "series_id string, t timestamp, value double", _newest_time, _rows_between)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineTail)
    spark.dataSource.register(TableCursor)


def csv_points(lines: DataFrame, header: str, series_id: str = "series", time_column: str | None = None, value_column: str | None = None) -> DataFrame:
    """(series_id, t, value, file, at, problem) of CSV ``lines``; header lines, wherever a file begins, and empty ones are left out.

    ``problem`` tells what is wrong with a line that gives no point (its t or value is null), as the stream goes on."""
    names = [c.strip() for c in header.split(",")]
    low = [c.lower() for c in names]
    find = lambda given, wanted, place: low.index(given.lower()) if given else next((low.index(w) for w in wanted if w in low), place if len(low) == 2 else -1)
    at, of = find(time_column, TIME_NAMES, 0), find(value_column, VALUE_NAMES, 1)
    if min(at, of) < 0:
        raise ValueError(f"no column for {'time' if at < 0 else 'value'} among {', '.join(names)}")
    schema = ", ".join(f"c{k} string" for k in range(len(names))) + ", bad string"
    rows = lines.filter((F.trim("line") != "") & (F.trim("line") != header.strip()))
    rows = rows.select("file", "at", F.from_csv("line", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("c")).select("file", "at", "c.*")
    rows = rows.select("file", "at", "bad", F.col(f"c{at}").alias("raw_t"), F.expr(f"try_cast(c{of} AS DOUBLE)").alias("value"))
    rows = rows.withColumn("t", parsed_time("raw_t")).withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))
    problem = F.when(F.col("bad").isNotNull(), "fields").when(F.col("t").isNull(), "time").when(F.col("value").isNull(), "value")
    return rows.select(F.lit(series_id).alias("series_id"), "t", "value", "file", "at", problem.alias("problem"))


def header_of(path: str) -> str:
    """The first line of a file, or of a folder's first file."""
    files = _Files(path)
    for file, size in sorted(files.sizes().items()):
        line = files.read(file, 0, min(size, 1 << 16)).split(b"\n")[0].decode().strip()
        if line:
            return line
    raise ValueError(f"no header in {path}")


def feed(spark: SparkSession, spec: dict) -> DataFrame:
    """A stream of points (series_id, t, value) from a description: ``kind`` csv (tail of CSV files), json (tail of JSON lines), table (Parquet by time) or poll (a registered ``format``), and its options."""
    register(spark)
    kind, options = spec.get("kind"), {k: str(v) for k, v in spec.items() if k not in ("kind", "format", "series_id", "time_column", "value_column")}
    if kind in ("csv", "json"):
        lines = spark.readStream.format("line_tail").options(**options).load()
        points = csv_points(lines, header_of(spec["path"]), spec.get("series_id", "series"), spec.get("time_column"), spec.get("value_column")).filter("problem is null") if kind == "csv" else points_from_json(lines, "line", spec.get("series_id", "default"))
    elif kind in ("table", "poll"):
        points = spark.readStream.format("table_cursor" if kind == "table" else spec["format"]).options(**options).load()
    else:
        raise ValueError(f"no feed {kind!r}; there are csv, json, table and poll")
    return points.select("series_id", "t", "value")


def feed_status(query: StreamingQuery) -> dict:
    """What a feed has done so far: batches, rows read, whether it runs, when the last batch began, and its error."""
    seen = query.recentProgress
    return {"running": query.isActive, "batches": len(seen), "points": sum(p["numInputRows"] for p in seen), "last": seen[-1]["timestamp"] if seen else None, "error": str(query.exception()) if query.exception() else None}
