"""Ordered state over a stream: what the scans over tables give, for rows that arrive late and out of order.

A key's rows wait in its state until the watermark has passed them, are then worked through in order of time and id, and give a row each.
Rows behind the watermark when they arrive are dropped, as the watermark says. A key without rows for `idle` of event time forgets what it holds, and its
state goes: so does the state of keys that never come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "us array<long>, ids array<long>, texts array<string>, resets array<boolean>"
_ROWS = "key string, id long, us long, carried string, number int, is_first boolean"
OUTPUT = "key string, id long, ts timestamp, carried string, number int, is_first boolean"


def _due(us: int) -> int:
    """The least watermark, in milliseconds, that has passed a time in microseconds."""
    return -(-us // 1000)


class Ordered(StatefulProcessor):
    """Rows (key, id, us, value, resets) to _ROWS: the last value since a reset, and the number of the row's value among the key's values in
    order of their first row. us is the time in microseconds.

    A call of the store costs far more than a row, so calls go with a key's batches and different values, not with its rows: rows wait in arrays, a
    batch to an entry, under one timer at the earliest of them, and what is held is read once and written once for all rows that are ready.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.held = handle.getValueState("held", "value string, seen long, numbers int")
        self.numbers = handle.getMapState("numbers", "value string", "number int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for some in rows:
            values = some["value"]
            us = some["us"].tolist()
            self.waiting.appendValue((us, some["id"].tolist(), values.astype(object).where(values.notna(), None).tolist(), some["resets"].tolist()))
            earliest = min(us) if earliest is None else min(earliest, *us)
        if earliest is not None:
            self.handle.registerTimer(_due(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed at once; what is left gets a timer at its earliest row, and timers of earlier batches find nothing.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = [r for entry in self.waiting.get() for r in zip(*entry, strict=True)]
        ready = sorted((r for r in rows if _due(r[0]) <= now), key=lambda r: r[:2])
        if ready:
            left = [r for r in rows if _due(r[0]) > now]
            if left:
                self.waiting.put([tuple(list(column) for column in zip(*left, strict=True))])
                self.handle.registerTimer(_due(min(r[0] for r in left)))
            else:
                self.waiting.clear()
            yield pd.DataFrame(self._worked(key[0], ready), columns=[c.split()[0] for c in _ROWS.split(", ")])
        elif not rows:
            held = self.held.get()
            if held and now > held[1] + self.idle_ms:
                self.held.clear()
                self.numbers.clear()

    def _worked(self, key: str, ready: list) -> list[tuple]:
        value_held, seen, count = self.held.get() or (None, ready[0][0] // 1000, 0)
        known, new, anew, out = {}, {}, False, []
        for us, id_, value, resets in ready:
            at = us // 1000
            if at - seen > self.idle_ms:
                value_held, count, known, new, anew = None, 0, {}, {}, True
            seen = at
            value_held = value if value is not None else None if resets else value_held
            first, number = False, None
            if value is not None:
                if value not in known:
                    before = None if anew else self.numbers.getValue((value,))
                    first = before is None
                    count += first
                    known[value] = count if first else before[0]
                    if first:
                        new[value] = count
                number = known[value]
            out.append((key, id_, us, value_held, number, first))
        if anew:
            self.numbers.clear()
        for value, number in new.items():
            self.numbers.updateValue((value,), (number,))
        self.held.update((value_held, seen, count))
        self.handle.registerTimer(seen + self.idle_ms + 1)
        return out

    def close(self) -> None:
        pass


def ordered_values(stream: DataFrame, key: Column, id_: Column, ts: str, value: Column, resets: Column, delay: str, idle_ms: int) -> DataFrame:
    """A row per row of the stream, OUTPUT: `carried` is the last value since a row that resets, `number` that of the row's own value by first
    appearance in its key, is_first whether it is that. A gap of more than idle_ms starts a key anew.

    The stream's session needs the state store STORE. Rows without a key or a time are left out.
    """
    rows = stream.select(F.col(ts).cast("timestamp").alias("ts"), key.cast("string").alias("key"), id_.cast("long").alias("id"), value.cast("string").alias("value"), F.coalesce(resets, F.lit(False)).alias("resets"))
    rows = rows.where("key is not null and ts is not null").withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    found = rows.groupBy("key").transformWithStateInPandas(Ordered(idle_ms), _ROWS, outputMode="Append", timeMode="EventTime")
    return found.select("key", "id", F.timestamp_micros("us").alias("ts"), "carried", "number", "is_first")


def ordered_values_of_table(df: DataFrame, key: str, id_: str, ts: str, value: Column, resets: Column, idle_ms: int) -> DataFrame:
    """What ordered_values() gives once a stream has seen all of a table: the same by scans."""
    from ..operators.scan import carried, running_total
    from ..storage import saved

    ms = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(id_).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"), ms.alias("ms"), value.cast("string").alias("value"), F.coalesce(resets, F.lit(False)).alias("resets")).where("key is not null and ts is not null")
    order = [F.col("ts"), F.col("id")]
    rows = carried(rows, ["key"], order, F.col("ms"), "before", own=False).withColumn("anew", F.coalesce(F.col("ms") - F.col("before") > idle_ms, F.lit(False)))
    rows = running_total(rows, ["key"], order, F.col("anew").cast("int"), "run")
    rows = saved(carried(rows, ["key"], order, F.col("value"), "carried", F.col("anew") | F.col("resets")), "carried")
    firsts = rows.where("value is not null").groupBy("key", "run", "value").agg(F.min_by("id", F.struct("ts", "id")).alias("id"), F.min("ts").alias("ts")).withColumn("one", F.lit(1))
    firsts = running_total(firsts, ["key", "run"], [F.col("ts"), F.col("id")], F.col("one"), "number").select("key", "run", "value", "number", F.col("id").alias("first_id"))
    joined = rows.join(firsts, ["key", "run", "value"], "left")
    return joined.select("key", "id", "ts", "carried", F.col("number").cast("int").alias("number"), F.coalesce(F.col("id") == F.col("first_id"), F.lit(False)).alias("is_first"))
