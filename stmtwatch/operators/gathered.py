"""Rows of a task gathered by key, so that what depends on the key alone is computed once for many.

A stream can run no job of its own in the middle of a plan, and grouping is state there. This takes
neither a job, nor a shuffle, nor state: rows are gathered within each Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBERS = "_members"


def gathered(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and Arrow batch (`spark.sql.execution.arrow.maxRecordsPerBatch` rows), with the
    other columns of all its rows as an array of structs. Null is a key like any other."""
    rest = [f for f in df.schema.fields if f.name not in keys]
    names = [f.name for f in rest]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = pa.Table.from_batches([batch.select(keys)]).append_column("_place", pa.array(np.arange(batch.num_rows)))
            groups = places.group_by(keys, use_threads=False).aggregate([("_place", "list")]).combine_chunks()
            lists = groups["_place_list"].chunk(0)
            rows = batch.select(names).take(lists.flatten())
            members = pa.StructArray.from_arrays(rows.columns, fields=list(rows.schema))
            item = pa.field("element", members.type, nullable=False)
            packed = pa.ListArray.from_arrays(lists.offsets, members, type=pa.list_(item))
            yield pa.RecordBatch.from_arrays([*(groups[k].chunk(0) for k in keys), packed], [*keys, MEMBERS])

    plain = [T.StructField(f.name, f.dataType, f.nullable) for f in rest]
    schema = T.StructType([
        *(T.StructField(k, df.schema[k].dataType, df.schema[k].nullable) for k in keys),
        T.StructField(MEMBERS, T.ArrayType(T.StructType(plain), False), False),
    ])
    return df.select(*keys, *names).mapInArrow(gather, schema)


def spread(groups: DataFrame, like: DataFrame) -> DataFrame:
    """The rows that were gathered, with all columns of their groups. Columns keep the metadata they have in `like`:
    the watermark of a stream is told by it."""
    members = groups.schema[MEMBERS].dataType.elementType.fieldNames()
    kept = [c for c in groups.columns if c != MEMBERS and c not in members]
    rows = groups.select(*kept, F.inline(MEMBERS))
    marked = {f.name: f.metadata for f in like.schema.fields if f.metadata}
    return rows.select(*[F.col(c).alias(c, metadata=marked[c]) if c in marked else F.col(c) for c in rows.columns])
