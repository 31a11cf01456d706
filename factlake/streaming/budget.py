"""A budget that stops calls: a running sum of spent micro-dollars for every arm and day, over a stream of calls.

Each call is decided in the order of its time and id within a trigger: it is admitted while
the sum before it is below the limit; the call that reaches it is the last one. A call whose cost is
unknown halts its arm for the day, whatever was spent, for the sum can't be trusted any
more. State is one sum and one flag an arm and day. When the watermark has passed the end of the day
the day is closed: a last row gives its sum, and its state goes, so state doesn't grow with time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = T.StructType([T.StructField("arm", T.StringType()), T.StructField("day", T.DateType()), T.StructField("call_id", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("spent", T.LongType())])
STATE = T.StructType([T.StructField("spent", T.LongType()), T.StructField("halted", T.BooleanType())])
DAY = dt.timedelta(days=1)


class Budget(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sum", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spent, halted = self.state.get() if self.state.exists() else (0, False)
        if not self.state.exists():
            end = dt.datetime.combine(key[1], dt.time(), dt.timezone.utc) + DAY
            self.handle.registerTimer(int(end.timestamp() * 1000))
        calls = sorted((t, c, None if pd.isna(m) else int(m)) for b in rows for t, c, m in zip(b["ts"], b["call_id"], b["micros"], strict=True))
        out = []
        for _, call, micros in calls:
            if halted or spent >= self.limit:
                decision = "halted" if halted else "stopped"
            elif micros is None:
                halted, decision = True, "usage unknown"
            else:
                spent, decision = spent + micros, "admitted"
            out.append((*key, call, decision, spent))
        self.state.update((spent, halted))
        yield pd.DataFrame(out, columns=OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spent, halted = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(*key, None, "closed after a halt" if halted else "closed", spent)], columns=OUT.names)

    def close(self) -> None:
        pass


def budget(calls: DataFrame, limit: int, *, lateness: str = "1 hour") -> DataFrame:
    """(arm, day, call_id, decision, spent) of a stream of (call_id, arm, ts, micros); ``micros`` is null where usage is unknown.

    Needs the RocksDB state store. Calls later than ``lateness`` are dropped by the watermark.
    """
    own = calls.select("call_id", "arm", "ts", "micros", F.to_date("ts").alias("day")).withWatermark("ts", lateness)
    return own.groupBy("arm", "day").transformWithStateInPandas(Budget(limit), OUT, "Append", "EventTime")
