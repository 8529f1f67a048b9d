"""Small tables that a stream looks at in every micro-batch, read and measured once per version.

A version is the set of files that count. While it stays the same a table is neither listed by Spark
nor inferred nor measured again; only the broadcast reads its files. Nothing is kept in executors, so
none of it is lost with one.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stmtwatch.operators.lookup import measured_bytes
from stmtwatch.sources.storage import contents, live_parts


@dataclass(frozen=True)
class Snapshot:
    version: Hashable
    table: DataFrame
    bytes: int


class Snapshots:
    """The last version of each table by name. One per stream, whose micro-batches come in a row."""

    def __init__(self) -> None:
        self._last: dict[str, Snapshot] = {}

    def read(self, name: str, version: Hashable, read: Callable[[], DataFrame]) -> Snapshot:
        """The table at this version. A version that is empty, of a path that holds no files, may be a
        table of another kind and is read each time."""
        last = self._last.get(name)
        if last is None or not version or last.version != version:
            table = read()
            last = self._last[name] = Snapshot(version, table, measured_bytes(table))
        return last


def parts_version(spark: SparkSession, path: str, without: str, commits: str | None) -> Hashable:
    """The version of a table of parts, as a micro-batch sees it that does not read its own part."""
    files = tuple(f for f in contents(spark, path) if f"/part={without}/" not in f[0])
    parts = tuple(p for p in live_parts(spark, path, commits) if p != without)
    return files and (files, parts)
