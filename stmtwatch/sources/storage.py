"""Layout of the tables we write: folders that a job or micro-batch owns as a whole.

A job that is repeated after a failure overwrites its own folder, so nothing is stored twice. The
tables that grow (`part=` folders) are folded when read, by operations that do not mind order or
repetition. The one table that is replaced (`version=` folders) is read from its newest complete
version; a path is never overwritten while it is read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def part_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file, or a folder that is not empty?"""
    files, target = _path(spark, path)
    return files.exists(target) and len(files.listStatus(target)) > 0


def new_part(kind: str = "job") -> str:
    return f"{kind}-{uuid.uuid4().hex}"


def stream_part(batch_id: int, stream: str = "direct") -> str:
    return f"stream-{stream}-{batch_id:012d}"


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that a checkpoint belongs to, made up when the checkpoint is new.

    It lives in the checkpoint, so a stream with another or a new checkpoint has another name and
    never writes over parts of this one.
    """
    known = _folders(spark, f"{checkpoint}/stream-name", "")
    if known:
        return min(known)
    name = uuid.uuid4().hex[:12]
    files, target = _path(spark, f"{checkpoint}/stream-name/{name}")
    files.mkdirs(target)
    return name


def streams_of(spark: SparkSession, path: str) -> list[str]:
    return [name.removeprefix("stream=") for name in _folders(spark, path, "stream=")]


def write_part(df: DataFrame, path: str, part: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/part={part}")


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    files, target = _path(spark, path)
    if not files.exists(target):
        return []
    names = [status.getPath().getName() for status in files.listStatus(target)]
    return [name for name in names if name.startswith(prefix)]


def compact(df: DataFrame, path: str, keep: tuple[str, ...] = ()) -> None:
    """Replace all parts of a table by one. `df` is the table's folded content.

    The new part is complete before the old ones go, and reading both gives the same rows, so a
    crash in between does no harm. Parts that appear meanwhile stay. A micro-batch that is being
    repeated must not lose its own part, so `keep` names the parts that stay, e.g. the newest ones
    of running streams.
    """
    spark = df.sparkSession
    old = [name for name in _folders(spark, path, "part=") if name.removeprefix("part=") not in keep]
    write_part(df, path, new_part("compact"))
    files, _ = _path(spark, path)
    for name in old:
        files.delete(_path(spark, f"{path}/{name}")[1], True)


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The newest version of a table that was written to its end."""
    done = [
        int(name.removeprefix("version="))
        for name in _folders(spark, path, "version=")
        if part_exists(spark, f"{path}/{name}/_SUCCESS")
    ]
    return max(done, default=None)


def write_version(df: DataFrame, path: str, version: int | None = None) -> int:
    if version is None:
        version = (latest_version(df.sparkSession, path) or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def drop_versions_before(spark: SparkSession, path: str, version: int) -> None:
    files, _ = _path(spark, path)
    for name in _folders(spark, path, "version="):
        if int(name.removeprefix("version=")) < version:
            files.delete(_path(spark, f"{path}/{name}")[1], True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables, in the shared folder that the cluster names.

    Driver and executors of a cluster see different disks, so there is no fallback to a local one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared.rstrip('/')}/stmtwatch-{uuid.uuid4().hex}"


# --- commits: which parts count ---------------------------------------------------------------------
#
# A micro-batch writes parts of several tables. None of them counts before the stream's mark says so.
# A stream commits its micro-batches in order, so one number per stream is enough: the last one.
# Compaction writes a part and then a manifest, which in one step lets the part count and the parts it
# replaces not. Their files stay until `vacuum`, so that readers that have listed them can go on.


def contents(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """The files of a table with their lengths and times. Files are never changed in place, so a table
    whose contents are the same holds the same rows."""
    files, target = _path(spark, path)
    if not files.exists(target):
        return ()
    found, listed = [], files.listFiles(target, True)
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def commit(spark: SparkSession, commits: str, stream: str, batch_id: int) -> None:
    """From now on the parts of this micro-batch, and of all earlier ones of the stream, count."""
    files, target = _path(spark, f"{commits}/stream={stream}/version={batch_id}")
    files.mkdirs(target)
    for name in _folders(spark, f"{commits}/stream={stream}", "version="):
        if int(name.removeprefix("version=")) < batch_id:
            files.delete(_path(spark, f"{commits}/stream={stream}/{name}")[1], True)


def committed(spark: SparkSession, commits: str) -> dict[str, int]:
    """The last committed micro-batch of each stream."""
    out = {}
    for stream in streams_of(spark, commits):
        marks = [int(n.removeprefix("version=")) for n in _folders(spark, f"{commits}/stream={stream}", "version=")]
        if marks:
            out[stream] = max(marks)
    return out


def _manifests(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """By compacted part, the parts it replaces."""
    files, _ = _path(spark, path)
    out = {}
    for name in _folders(spark, f"{path}/_compacted", "compact-"):
        stream = files.open(_path(spark, f"{path}/_compacted/{name}")[1])
        try:
            out[name] = [x for x in bytes(stream.readAllBytes()).decode().split("\n") if x]
        finally:
            stream.close()
    return out


def live_parts(spark: SparkSession, path: str, commits: str | None = None) -> list[str]:
    """The parts of a table that count, by one look at the folders.

    Parts of jobs count when they are complete, parts of micro-batches when their stream has
    committed them (without `commits`, when complete), compacted parts when they have a manifest.
    """
    manifests = _manifests(spark, path)  # first: a part that goes afterwards is still there
    marks = committed(spark, commits) if commits is not None else {}
    replaced = {part for parts in manifests.values() for part in parts}
    live = []
    for name in _folders(spark, path, "part="):
        part = name.removeprefix("part=")
        if part in replaced or not _complete(spark, f"{path}/{name}"):
            continue
        if part.startswith("compact-") and part not in manifests:
            continue
        if part.startswith("stream-") and commits is not None:
            stream, batch = part.removeprefix("stream-").rsplit("-", 1)
            if marks.get(stream, -1) < int(batch):
                continue
        live.append(part)
    return sorted(live)


def _complete(spark: SparkSession, folder: str) -> bool:
    files, target = _path(spark, f"{folder}/_SUCCESS")
    return files.exists(target)


def drop_part(spark: SparkSession, path: str, part: str) -> None:
    """Remove a part, as a repeated micro-batch does that has nothing to write any more."""
    drop_folder(spark, f"{path}/part={part}")


def drop_folder(spark: SparkSession, path: str) -> None:
    files, target = _path(spark, path)
    if files.exists(target):
        files.delete(target, True)


def compact_parts(df: DataFrame, path: str, parts: list[str], partition_by: tuple[str, ...] = ()) -> str:
    """Replace `parts` by one that holds `df`, their content. A crash before the manifest is written
    leaves the table as it was."""
    spark, part = df.sparkSession, new_part("compact")
    write_part(df, path, part, partition_by)
    files, target = _path(spark, f"{path}/_compacted/{part}")
    out = files.create(_path(spark, f"{path}/_compacted/_{part}")[1])
    try:
        out.write(bytearray("\n".join(parts).encode()))
    finally:
        out.close()
    files.rename(_path(spark, f"{path}/_compacted/_{part}")[1], target)
    return part


def vacuum(spark: SparkSession, path: str, keep_ms: int = 24 * 3600 * 1000) -> list[str]:
    """Delete replaced parts, and compacted ones without manifest, that are older than `keep_ms`.
    No reader or micro-batch may take longer."""
    files, _ = _path(spark, path)
    manifests = _manifests(spark, path)
    replaced = {part for parts in manifests.values() for part in parts}
    gone = []
    for name in _folders(spark, path, "part="):
        part, target = name.removeprefix("part="), _path(spark, f"{path}/{name}")[1]
        stale = part in replaced or part.startswith("compact-") and part not in manifests
        manifest = next((m for m, parts in manifests.items() if part in parts), None)
        since = _path(spark, f"{path}/_compacted/{manifest}")[1] if manifest else target
        if stale and files.getFileStatus(since).getModificationTime() <= time.time() * 1000 - keep_ms:
            files.delete(target, True)
            gone.append(part)
    return gone
