"""Ledger and timeline over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "entity long, serial long, value string, late boolean"
LAST = "serial long, value string"


def ledger(calls: DataFrame, *, time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Each call id once; a repetition within ``lateness`` of event time is dropped."""
    return calls.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["call_id"])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    serial, value = state.get if state.exists else (-1, None)
    out = []
    for s, v in sorted((int(s), v) for b in batches for s, v in zip(b["serial"], b["value"], strict=True)):
        if s <= serial:
            out.append((key[0], s, v, True))
            continue
        serial = s
        if v is not None and v != value:
            value = v
            out.append((key[0], s, v, False))
    state.update((serial, value))
    yield pd.DataFrame(out, columns=["entity", "serial", "value", "late"])


def changes(facts: DataFrame) -> DataFrame:
    """A row whenever an entity's value changes, in serial order within each trigger.

    Rows with a serial that has been passed already are marked late and change nothing.
    State is one (serial, value) pair an entity.
    """
    return facts.groupBy("entity").applyInPandasWithState(_advance, CHANGES, LAST, "append", GroupStateTimeout.NoTimeout)
