"""Replies of models from streams of fragments, which may come late, twice or in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from marlstone.functions.fragments import FRAGMENT, REPLY, Reply

_HEAD = "content string, reasoning string, finish string, fragments long, next long, closed boolean, timer long"


def _value(x):
    return None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x


class _Replies(StatefulProcessor):
    """The reply so far is one value; fragments that wait for an earlier one, and calls, are maps."""

    def __init__(self, schema: StructType, keys: list[str], patience_ms: int):
        self.names, self.keys, self.patience = schema.names, keys, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.waiting = handle.getMapState("waiting", "seq long", "kind string, piece string, index int, call_id string, name string")
        self.calls = handle.getMapState("calls", "index int", "id string, name string, arguments string")

    def _load(self) -> tuple[Reply, int, bool, int | None]:
        content, reasoning, finish, fragments, place, closed, timer = self.head.get() if self.head.exists() else ("", "", None, 0, 0, False, None)
        calls = {int(k[0]): tuple(v) for k, v in self.calls.iterator()} if self.calls.exists() else {}
        return Reply(content, reasoning, finish, fragments, calls), place, closed, timer

    def _row(self, key: tuple, reply: Reply, complete: bool) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(self.keys, key)), **reply.row(), "complete": complete}], columns=self.names)

    def _forget(self) -> None:
        self.head.clear()
        self.waiting.clear()
        self.calls.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reply, place, closed, timer = self._load()
        before = set(reply.calls.items())
        for frame in rows:
            frame = frame[frame["seq"].notna()].sort_values(FRAGMENT, kind="stable")
            for values in frame[FRAGMENT].itertuples(index=False, name=None):
                seq, (kind, piece, index, call_id, name) = int(values[0]), map(_value, values[1:])
                if closed or seq < place or self.waiting.containsKey((seq,)):
                    continue
                self.waiting.updateValue((seq,), (kind, piece, None if index is None else int(index), call_id, name))
        was_closed = closed
        while not closed and self.waiting.containsKey((place,)):
            fragment = self.waiting.getValue((place,))
            self.waiting.removeKey((place,))
            kind, piece, index, call_id, name = fragment
            reply.add(kind, piece, index, call_id, name)
            place, closed = place + 1, kind == "finish"
        for i, call in reply.calls.items():
            if (i, call) not in before:
                self.calls.updateValue((i,), call)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.patience
        self.handle.registerTimer(timer)
        if closed:  # what is kept of a finished reply only turns repeated fragments away
            self.waiting.clear()
            self.calls.clear()
            self.head.update(("", "", None, 0, place, True, timer))
        else:
            self.head.update((reply.content, reply.reasoning, reply.finish, reply.fragments, place, False, timer))
        if closed and not was_closed:
            yield self._row(key, reply, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reply, _, closed, _ = self._load()
        if not closed:
            for _, (kind, piece, index, call_id, name) in sorted((int(k[0]), tuple(v)) for k, v in self.waiting.iterator()):
                reply.add(kind, piece, index, call_id, name)
                if kind == "finish":
                    break
        self._forget()
        if not closed:
            yield self._row(key, reply, False)

    def close(self) -> None:
        pass


def folded_replies(fragments: DataFrame, keys: list[str], patience_ms: int = 600_000) -> DataFrame:
    """The stream form of ``operators.replies.fold_fragments``: one row for each reply, once, when it is whole.

    A fragment waits until all before it have come; repeated ones are dropped (the first to come counts; of one batch
    the least). A reply that hears nothing for ``patience_ms`` is given out with ``complete`` false, the gaps skipped,
    and forgotten; a finished one is remembered as long, so late copies of its fragments start nothing.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    schema = StructType([fragments.schema[k] for k in keys] + _parse_datatype_string(REPLY).fields)
    rows = fragments.select(*keys, *FRAGMENT)
    return rows.groupBy(*keys).transformWithStateInPandas(_Replies(schema, keys, patience_ms), schema, "Append", "ProcessingTime")
