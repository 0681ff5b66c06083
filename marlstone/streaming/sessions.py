"""Session locks and folded turns over streams.

State is a few numbers (or the text so far) by key; events of a key within a batch are taken in the
order of their sequence number, not of their arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def lock_states(events: DataFrame, limit: int = 2) -> DataFrame:
    """For each event (``key``, ``seq``, ``kind``) the failures since the last reset, and whether that locks the key.

    ``kind`` is failure, reset or anything else; the batch form is ``operators.state.failure_lock``.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for kind in rows["kind"]:
            failures = 0 if kind == "reset" else failures + (kind == "failure")
            out.append(failures)
        state.update((failures,))
        yield pd.DataFrame({"key": rows["key"].to_numpy(), "seq": rows["seq"].to_numpy(), "failures": out, "locked": [n >= limit for n in out]})

    return events.select("key", "seq", "kind").groupBy("key").applyInPandasWithState(run, "key long, seq long, failures long, locked boolean", "failures long", "append", GroupStateTimeout.NoTimeout)


def folded_turns(pieces: DataFrame) -> DataFrame:
    """The text so far of each key (``key``, ``seq``, ``piece``) after each batch.

    A piece that repeats the text so far and goes on replaces it (a cumulative snapshot); any other is added.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, n = state.get if state.exists else ("", 0)
        for piece in pd.concat(list(frames)).sort_values("seq", kind="stable")["piece"]:
            piece = piece or ""
            text = piece if text and piece.startswith(text) else text + piece
            n += 1
        state.update((text, n))
        yield pd.DataFrame({"key": [key[0]], "content": [text], "pieces": [n]})

    return pieces.select("key", "seq", "piece").groupBy("key").applyInPandasWithState(run, "key long, content string, pieces long", "content string, pieces long", "update", GroupStateTimeout.NoTimeout)
