"""Replies of models from tables of fragments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from marlstone.functions.fragments import FRAGMENT, REPLY, Reply


def fold_fragments(rows: DataFrame, keys: list[str], chunk: int = 1024) -> DataFrame:
    """One row for each reply (``keys``): its texts, calls, end, number of fragments and whether it is ``complete``.

    ``rows`` have ``seq`` (from 0 in each reply), ``kind``, ``piece``, ``index``, ``call_id`` and ``name``; other columns
    are left out. Fragments go in the order of ``seq``; of several with one ``seq`` the least by the other columns counts,
    those without ``seq`` do not. A reply is complete if it has a finish and no place before it is missing; what comes
    after the finish is not read. A key with nulls is a key like any other. An empty table gives no rows.

    Rows are sorted within partitions (which spills) and read as they come, so a task holds the reply it is at and not its fragments.
    """
    schema = StructType([rows.schema[k] for k in keys] + _parse_datatype_string(REPLY).fields)
    arrow = to_arrow_schema(schema)
    ordered = rows.filter(F.col("seq").isNotNull()).select(*keys, *FRAGMENT).repartition(*keys).sortWithinPartitions(*keys, *FRAGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        key = reply = None
        last, whole, closed = -1, True, False

        def done() -> dict:
            return {**dict(zip(keys, key)), **reply.row(), "complete": closed and whole}

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for values in zip(*columns):
                this, (seq, kind, piece, index, call_id, name) = values[: len(keys)], values[len(keys) :]
                if reply is None or this != key:
                    if reply is not None:
                        out.append(done())
                    key, reply, last, whole, closed = this, Reply(), -1, True, False
                if seq == last or closed:
                    continue
                whole, last = whole and seq == last + 1, seq
                reply.add(kind, piece, index, call_id, name)
                closed = kind == "finish"
                if len(out) >= chunk:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if reply is not None:
            out.append(done())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered.mapInArrow(run, schema)
