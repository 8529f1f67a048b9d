"""WARC archives with a two-level capture index.

Writing: pages of equal payload are found by their SHA-1; one is archived whole, the others as
revisits that refer to it. Each task writes files of its own, with one gzip member per record, and
returns where each record lies. These rows are stored by Spark, so only files of tasks that
succeeded count; a file of a lost task is an orphan that nothing refers to.

Index: captures are sorted by the reversed-host key of their URL over all index files, and written
there in compressed blocks. A sparse directory holds the first key and place of each block: one
beside each index file for look-ups, and one table of all blocks for reading everything.

Reading: a look-up finds the index files by their key ranges, bisects the directory, reads one block
or a few, and reads the record's byte range. Reading everything goes block by block.

Files are reached with pyarrow's file systems, so the folder may be local or in a store they know.

Nulls: a null payload is empty, a null URL has the empty key, a null id is written as an empty id and
read back as null. Payloads under `least_bytes` are always responses. Where rows repeat the largest
id of a group, each of them is a response. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwatch.llm.common import HOT_ROWS, HOT_SHARE, shared_folder

LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 1 << 30
BLOCK_CAPTURES = 1000
OPEN_FILES = 64


class Files:
    """Byte ranges of files; a few files stay open."""

    def __init__(self):
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            system, name = filesystem(path)
            self.open[path] = system.open_input_file(name)
            if len(self.open) > OPEN_FILES:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(path)
        return self.open[path].read_at(length, offset)

    def whole(self, path: str) -> bytes:
        system, name = filesystem(path)
        with system.open_input_file(name) as file:
            return file.read()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


def url_key(url: str | None) -> str:
    """Host reversed by its labels, then port, path and query: org,example,www)/path?query."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").strip("."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    name = ",".join(reversed(host.split(".")))
    plain = port is None or port in (80, 443)
    path = unquote(parts.path).lower() or "/"
    return f"{name}{'' if plain else f':{port}'}){path}" + (f"?{parts.query.lower()}" if parts.query else "")


# --- records --------------------------------------------------------------------------------------


def _line(value: str | None) -> str:
    """A header value: line ends would end the header."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value or "")


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One record, as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page or ''}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        headers += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    headers += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(headers).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(member: bytes) -> dict:
    """A record read back; the payload of a response is checked against its digest."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda name: fields.get(name, "<urn:page:>")[len("<urn:page:"):-1] or None
    return {
        "page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


# --- writing --------------------------------------------------------------------------------------


def with_response(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page, url, payload, and the page that each row's record refers to (its own if it is a response).

    Groups of more than a thousandth of all rows are broadcast; they are fewer than a thousand.
    """
    rows = pages.select(
        F.col(key).alias("page"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.when(F.length("payload") >= least_bytes, F.sha1("payload")))
    groups = rows.filter("digest is not null").groupBy("digest").agg(
        F.max("page").alias("first"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    limit = max(HOT_ROWS, pages.count() // HOT_SHARE)
    hot = groups.filter(F.col("n") > limit).select(F.col("digest").alias("_hot"), F.col("first").alias("_hot_first"))
    cold = groups.filter(F.col("n") <= limit).select(F.col("digest").alias("_cold"), F.col("first").alias("_cold_first"))
    marked = rows.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
    # Rows that need no look-up are spread instead of meeting at one key.
    spread = F.concat(F.lit("-"), F.xxhash64("page", "url").cast("string"))
    probe = F.when(F.col("digest").isNull() | F.col("_hot").isNotNull(), spread).otherwise(F.col("digest"))
    met = marked.withColumn("_probe", probe).join(cold, F.col("_probe") == F.col("_cold"), "left")
    first = F.coalesce("_hot_first", "_cold_first", "page")
    return met.select("page", "url", "payload", first.alias("first"))


def write_records(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records below `folder`/records; one row per record says where it is."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name, at = None, None, 0
        try:
            for batch in batches:
                out = []
                for page, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                    if stream is None or at >= file_bytes:
                        if stream is not None:
                            stream.close()
                        name, at = f"records/{uuid.uuid4().hex}.warc.gz", 0
                        system, path = filesystem(f"{folder}/{name}")
                        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        stream = system.open_output_stream(path, compression=None)
                    data = record(page, url, payload, first, revisit=first != page)
                    stream.write(data)
                    out.append((url_key(url), page, name, at, len(data)))
                    at += len(data)
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
                if out:
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "page", "file", "offset", "length"])
        finally:
            if stream is not None:
                stream.close()

    ready = rows.select(F.col("page").cast("string"), "url", "payload", F.col("first").cast("string"))
    located = ready.mapInArrow(write, "key string, page string, file string, offset long, length long")
    located.write.parquet(f"{folder}/captures")
    return rows.sparkSession.read.parquet(f"{folder}/captures")


def write_index(captures: DataFrame, folder: str, block_captures: int = BLOCK_CAPTURES) -> DataFrame:
    """Write the sorted index; one row per block: its file, first and last key, and place."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, waiting, blocks = f"index/{uuid.uuid4().hex}", None, [], []

        def flush():
            nonlocal stream
            if stream is None:
                system, path = filesystem(f"{folder}/{name}.idx")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                stream = system.open_output_stream(path, compression=None)
            data = zlib.compress("\n".join(json.dumps(c) for c in waiting).encode())
            offset = blocks[-1][3] + blocks[-1][4] if blocks else 0
            stream.write(data)
            blocks.append((name, waiting[0][0], waiting[-1][0], offset, len(data)))
            waiting.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append(row)
                if len(waiting) == block_captures:
                    flush()
        if waiting:
            flush()
        if stream is not None:
            stream.close()
            system, path = filesystem(f"{folder}/{name}.dir")
            with system.open_output_stream(path, compression=None) as directory:
                directory.write(json.dumps([b[1:] for b in blocks]).encode())
            columns = [pa.array(c) for c in zip(*blocks)]
            yield pa.RecordBatch.from_arrays(columns, names=["index", "first_key", "last_key", "offset", "length"])

    order = ["key", "page", "file", "offset"]
    ranged = captures.select("key", "page", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(
        write, "index string, first_key string, last_key string, offset long, length long"
    ).write.parquet(f"{folder}/directory")
    return captures.sparkSession.read.parquet(f"{folder}/directory")


def write_archive(
    pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html",
    least_bytes: int = LEAST_BYTES, block_captures: int = BLOCK_CAPTURES,
) -> str:
    """Write records and index; returns the folder, by default a new one in the shared folder."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_records(with_response(pages, key, url, payload, least_bytes), folder)
    write_index(captures, folder, block_captures)
    return folder


# --- reading --------------------------------------------------------------------------------------


def _batch(rows: list[dict], with_payload: bool, extra: dict | None = None) -> pa.RecordBatch:
    kinds = {"page_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.string()}
    kinds |= {"payload": pa.binary()} if with_payload else {}
    kinds |= extra or {}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds.items()], names=list(kinds))


def _captures(files: Files, folder: str, index: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(files.read(f"{folder}/{index}.idx", offset, length)).split(b"\n")]


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record, by way of the index: block after block, then the byte range of each capture."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            for index, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                rows = _captures(files, folder, index, offset, length)
                rows.sort(key=lambda c: (c[2], c[3]))
                yield _batch([parse(files.read(f"{folder}/{c[2]}", c[3], c[4])) for c in rows], with_payload)

    blocks = spark.read.parquet(f"{folder}/directory").select("index", "offset", "length")
    spread = blocks.repartition(spark.sparkContext.defaultParallelism * 4, "index", "offset")
    return spread.mapInArrow(read, READ + (", payload binary" if with_payload else ""))


def lookup(queries: DataFrame, folder: str, url: str = "url", with_payload: bool = False) -> DataFrame:
    """The records of the URLs in `queries` (column `wanted` holds the URL asked for).

    The driver holds the key range of each index file, one row per file. A query goes to the files
    whose range holds its key; there the directory is bisected and one block or a few are read.
    """
    spark = queries.sparkSession
    ranges = spark.read.parquet(f"{folder}/directory").groupBy("index").agg(
        F.min("first_key").alias("a"), F.max("last_key").alias("b")
    ).orderBy("a", "b").collect()
    firsts, lasts, names = [r.a for r in ranges], [r.b for r in ranges], [r["index"] for r in ranges]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wanted in batch.column(0).to_pylist():
                key = url_key(wanted)
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    out.append((wanted, key, names[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["wanted", "key", "index"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, directories = Files(), {}
        for batch in batches:
            for wanted, key, index in zip(*(c.to_pylist() for c in batch.columns)):
                if index not in directories:
                    directories[index] = json.loads(files.whole(f"{folder}/{index}.dir"))
                blocks = directories[index]
                at = max(0, bisect.bisect_left([b[0] for b in blocks], key) - 1)
                while at < len(blocks) and blocks[at][0] <= key:
                    first, last, offset, length = blocks[at]
                    if last >= key:
                        captures = _captures(files, folder, index, offset, length)
                        low = bisect.bisect_left(captures, key, key=lambda c: c[0])
                        high = bisect.bisect_right(captures, key, key=lambda c: c[0])
                        if low < high:
                            rows = [parse(files.read(f"{folder}/{c[2]}", c[3], c[4])) for c in captures[low:high]]
                            yield _batch([r | {"wanted": wanted} for r in rows], with_payload, {"wanted": pa.string()})
                    at += 1

    routed = queries.select(F.col(url).cast("string").alias("wanted")).filter("wanted is not null").distinct().mapInArrow(
        route, "wanted string, key string, index string"
    )
    schema = READ + (", payload binary" if with_payload else "") + ", wanted string"
    return routed.repartition("index", "key").mapInArrow(find, schema)
