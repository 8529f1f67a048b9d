"""Query logs as the servers write them: the general log of MySQL and the csvlog of PostgreSQL.

Both are Python data sources, for batch and stream. Files are cut into ranges of bytes, each read by
a task of its own. A task looks for the first record that starts in its range, whatever line the
range begins in, and reads on past the end of the range until its last record is complete, so that
statements over many lines are whole and no record is read twice.

The sequence number of a row is the byte its record starts at, above it the number of its file, so
that rows of one file keep their order. Server banners and records that carry no command are passed over.

Paths are those of pyarrow's file systems: local, or with a scheme such as hdfs or s3.

A stream follows growing files. The last record of a file may still be written to, so it waits until
another one starts, unless `complete` says that files are never added to.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stmtwatch.sources.tables import as_query_log

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20
# No start of a record is longer.
MARGIN = 256
# Bits of a sequence number that hold the place in the file.
PLACE_BITS = 44
SCHEMA = (
    "seq long, event_time timestamp, conn_id string, db_type string, db_name string, db_user string, "
    "user_ip string, command string, query string"
)

# Commands of the general log, and what they are called in a query log.
COMMANDS = {
    "Connect": "login", "Change user": "change_user", "Init DB": "use_db", "Quit": "quit", "Query": "query",
    "Prepare": "prepare", "Execute": "execute", "Field List": "field_list", "Create DB": "create_db",
    "Drop DB": "drop_db", "Processlist": "process_info", "Ping": "ping", "Statistics": "statistics", "Kill": "kill",
}
# Columns of the csvlog that are read, by place.
_TIME, _USER, _DATABASE, _PROCESS, _FROM, _MESSAGE = 0, 1, 2, 3, 4, 13


class GeneralLog:
    """`time <tab> thread command <tab> argument`, the argument over any number of lines."""

    start = re.compile(rb"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\t *\d+ [A-Z][A-Za-z ]*\t|[^\n\t]{1,200}, Version: ")
    _record = re.compile(r"(\S+)\t *(\d+) ([^\t]+)\t(.*)", re.S)
    _login = re.compile(r"(?P<user>.*?)@(?P<host>[^ ]*) on ?(?P<db>\S*)", re.S)

    @classmethod
    def parse(cls, record: str) -> tuple | None:
        found = cls._record.fullmatch(record.rstrip("\r\n"))
        if found is None:
            return None  # a banner of the server
        time, thread, command, text = found.groups()
        command = COMMANDS.get(command, command.lower().replace(" ", "_"))
        user = db = host = ""
        if command in ("login", "change_user"):
            given = cls._login.match(text)
            user, host, db = (given["user"], given["host"], given["db"]) if given else (text, "", "")
            text = ""
        elif command == "use_db":
            db, text = text, ""
        return dt.datetime.fromisoformat(time), thread, "mysql", db, user, host, command, text


class CsvLog:
    """Records of comma-separated columns, quoted where they hold line ends."""

    start = re.compile(rb"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3} [A-Z]{1,5},(?:\"|,)")
    _statement = re.compile(r"(?:duration: [\d.]+ ms  )?(statement|parse [^:]*|execute [^:]*): (.*)", re.S)

    @classmethod
    def parse(cls, record: str) -> tuple | None:
        columns = next(csv.reader(io.StringIO(record, newline="")), [])
        if len(columns) <= _MESSAGE:
            return None
        message = columns[_MESSAGE]
        found = cls._statement.fullmatch(message)
        if found is not None:
            command, text = ("parse" if found[1].startswith("parse") else "query"), found[2]
        elif message.startswith("connection authorized"):
            command, text = "login", ""
        elif message.startswith("disconnection"):
            command, text = "quit", ""
        else:
            return None
        stamp, zone = columns[_TIME].rsplit(" ", 1)
        if zone not in ("UTC", "GMT"):
            raise ValueError(f"log_timezone must be UTC, not {zone}")
        time = dt.datetime.fromisoformat(stamp + "+00:00")
        host = columns[_FROM].rsplit(":", 1)[0]
        return time, columns[_PROCESS], "pgsql", columns[_DATABASE], columns[_USER], host, command, text


def records(stream, start: int, end: int, pattern: re.Pattern, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records that start at `start` or later and before `end`."""
    base = max(start - 1, 0)
    stream.seek(base)
    # A record starts at the start of the file or after a line end.
    starts = re.compile(rb"(?<=\n)(?=" + pattern.pattern + rb")")
    data, scanned, opened, first = b"", 0, None, True
    while True:
        block = stream.read(chunk)
        data += block
        if first and base == 0 and start == 0:
            if not block or len(data) >= MARGIN or len(block) < chunk:
                opened = 0 if pattern.match(data) else None
                first = False
        limit = len(data) - MARGIN if block else len(data)
        if limit > scanned:
            for found in starts.finditer(data, scanned):
                at = found.start()
                if at >= limit:
                    break
                if base + at < start or base + at == opened:
                    continue
                if opened is not None:
                    yield opened, data[opened - base: at]
                opened = None
                if base + at >= end:
                    return
                opened = base + at
            cut = max(opened - base if opened is not None else limit - 1, 0)
            data, base, scanned = data[cut:], base + cut, limit - cut
        if opened is None and base + scanned > end + MARGIN and not first:
            return
        if not block:
            if opened is not None and opened < end:
                yield opened, data[opened - base:]
            return


def last_start(stream, size: int, pattern: re.Pattern, chunk: int = CHUNK) -> int:
    """Where the last record of a file starts; 0 without one."""
    low = size
    while low > 0:
        low = max(low - chunk, 0)
        found = [place for place, _ in records(stream, low, size, pattern, chunk)]
        if found:
            return found[-1]
    return 0


def _files(path: str):
    """The file system of a path, and (path, size) of its files in order of name."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inside)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return system, sorted(names)


@dataclass
class Range(InputPartition):
    name: str
    number: int
    start: int
    end: int


class _Ranges:
    """What batch and stream have in common."""

    def __init__(self, layout: type, options: dict[str, str]):
        self.layout, self.path = layout, options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.chunk = int(options.get("chunkbytes", CHUNK))
        self.complete = options.get("complete", "false").lower() == "true"

    def ranges(self, name: str, number: int, start: int, end: int) -> list[Range]:
        return [Range(name, number, low, min(low + self.split, end)) for low in range(start, end, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = _files(self.path)
        with system.open_input_file(partition.name) as stream:
            for place, record in records(stream, partition.start, partition.end, self.layout.start, self.chunk):
                row = self.layout.parse(record.decode("utf-8", "replace"))
                if row is not None:
                    yield (partition.number << PLACE_BITS | place, *row)


class RawReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        _, files = _files(self.path)
        return [r for i, (name, size) in enumerate(files) for r in self.ranges(name, i, 0, size)]


class RawStreamReader(_Ranges, DataSourceStreamReader):
    """The offset holds, by file, its number and the place up to which it was read."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, files = _files(self.path)
        out = {}
        for name, size in files:
            end = size
            if not self.complete:
                with system.open_input_file(name) as stream:
                    end = last_start(stream, size, self.layout.start, self.chunk)
            out[name] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # Numbers follow the names, so a file keeps its own if names grow, as those of logs do.
        return [
            r for i, name in enumerate(sorted(end)) for r in self.ranges(name, i, start.get(name, 0), end[name])
        ]

    def commit(self, end: dict) -> None:
        pass


class _RawLog(DataSource):
    layout: type

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.layout, self.options)

    def streamReader(self, schema) -> RawStreamReader:
        return RawStreamReader(self.layout, self.options)


class MySqlGeneralLog(_RawLog):
    layout = GeneralLog

    @classmethod
    def name(cls) -> str:
        return "mysql_general_log"


class PgCsvLog(_RawLog):
    layout = CsvLog

    @classmethod
    def name(cls) -> str:
        return "pgsql_csvlog"


FORMATS = {"mysql": MySqlGeneralLog, "pgsql": PgCsvLog}


def _reader(spark: SparkSession, reader, path: str, dialect: str, options: dict):
    spark.dataSource.register(FORMATS[dialect])
    return reader.format(FORMATS[dialect].name()).option("path", path).options(**options)


def read_raw_log(spark: SparkSession, path: str, dialect: str, proxy_id: int | None = None, **options) -> DataFrame:
    """A query log from the files that a server of this dialect wrote. Options: splitbytes, chunkbytes."""
    rows = _reader(spark, spark.read, path, dialect, options).load()
    return as_query_log(rows.withColumn("proxy_id", F.lit(proxy_id).cast("int")))


def stream_raw_log(spark: SparkSession, path: str, dialect: str, proxy_id: int | None = None, **options) -> DataFrame:
    """The same as a stream that follows the files. Further option: complete."""
    rows = _reader(spark, spark.readStream, path, dialect, options).load()
    return as_query_log(rows.withColumn("proxy_id", F.lit(proxy_id).cast("int")))


def render(log: DataFrame, dialect: str) -> Column:
    """A row of a log as the server would have written it: numbers for `conn_id`, times in UTC."""
    at = lambda pattern: F.date_format("event_time", pattern)
    if dialect == "mysql":
        names = F.create_map(*[F.lit(x) for shown, name in COMMANDS.items() for x in (name, shown)])
        user = F.concat(F.col("db_user"), F.lit("@"), F.col("user_ip"), F.lit(" on "), F.col("db_name"), F.lit(" using TCP/IP"))
        text = F.when(F.col("command").isin("login", "change_user"), user).when(
            F.col("command") == "use_db", F.col("db_name")
        ).otherwise(F.col("query"))
        return F.concat(
            at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z\t"), F.lpad("conn_id", 5, " "), F.lit(" "),
            F.coalesce(names[F.col("command")], F.col("command")), F.lit("\t"), text,
        )
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    message = F.when(F.col("command") == "login", F.concat(F.lit("connection authorized: user="), "db_user")).when(
        F.col("command") == "quit", F.lit("disconnection: session time: 0:00:01.000")
    ).when(F.col("command") == "parse", F.concat(F.lit("parse p1: "), "query")).otherwise(F.concat(F.lit("statement: "), "query"))
    empty = F.lit(",")
    return F.concat(
        at("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC,"), quoted(F.col("db_user")), empty, quoted(F.col("db_name")), empty,
        F.col("conn_id"), empty, quoted(F.concat(F.col("user_ip"), F.lit(":5432"))),
        F.lit(',s,1,"",' + "2024-01-01 00:00:00 UTC" + ",,0,LOG,00000,"), quoted(message), F.lit(',,,,,,,,,"app","client backend",,0'),
    )
