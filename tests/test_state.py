"""Ordered state over a stream of events, late and out of order, against the batch form and plain Python."""

import datetime
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from claimgraph.streaming import state

rng = random.Random(3)
START = datetime.datetime(2024, 1, 1)
IDLE = 100_000


def event(i, s, key, value, resets=False):
    return i, START + datetime.timedelta(seconds=s, microseconds=250 * (i % 3)), key, value, resets


def plain(rows):
    out, held = [], {}
    for i, ts, key, value, resets in sorted(rows, key=lambda r: (r[1], r[0])):
        if key is None:
            continue
        ms = int((ts - START).total_seconds() * 1000)
        last, seen, numbers = held.get(key, (None, ms, {}))
        if ms - seen > IDLE:
            last, numbers = None, {}
        last = value if value is not None else None if resets else last
        first = value is not None and value not in numbers
        if first:
            numbers[value] = len(numbers) + 1
        held[key] = (last, ms, numbers)
        out.append((key, i, last, numbers.get(value), first))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    out = [event(i, s, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, "x", "y", "z"]), rng.random() < 0.2) for i, s in enumerate(range(0, 600, 5))]
    return [r for r in out if not (r[2] == "b" and 200 < (r[1] - START).total_seconds() < 400)]


def test_stream_equals_batch(spark, rows, tmp_path):
    """Rows of a batch are shuffled and reach back into the batch before, within the delay; a row behind the watermark changes nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    shape = "id long, ts timestamp, key string, value string, resets boolean"
    mixed = sorted(rows, key=lambda r: (r[1] - START).total_seconds() + rng.uniform(0, 30))
    batches = [mixed[i : i + 30] for i in range(0, len(mixed), 30)]
    batches += [[event(9000, 5, "a", "late"), event(9001, 100_000, "end", None)], [event(9002, 200_000, "end", None)]]
    source = tmp_path / "in"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(str(source / f"{n:02}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    found = state.ordered_values(stream, F.col("key"), F.col("id"), "ts", F.col("value"), F.col("resets"), "60 seconds", IDLE)
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("key <> 'end'").select("key", "id", "carried", "number", "is_first").collect())
    assert got == plain(rows)
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept < 20  # the keys a and b are gone, with their values


def test_table_equals_plain(spark, rows):
    df = spark.createDataFrame(rows, "id long, ts timestamp, key string, value string, resets boolean")
    got = state.ordered_values_of_table(df, "key", "id", "ts", F.col("value"), F.col("resets"), IDLE)
    assert sorted(tuple(r) for r in got.select("key", "id", "carried", "number", "is_first").collect()) == plain(rows)
    assert state.ordered_values_of_table(df.limit(0), "key", "id", "ts", F.col("value"), F.col("resets"), IDLE).collect() == []


class Counted:
    """A processor's handle in memory, for one key, that counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def called(self, answer=None):
        self.calls += 1
        return answer

    def getListState(self, name, shape):
        self.entries = []
        return SimpleNamespace(appendValue=lambda v: self.called(self.entries.append(v)), get=lambda: self.called(iter(list(self.entries))), put=lambda v: self.called(self.entries.__setitem__(slice(None), v)), clear=lambda: self.called(self.entries.clear()))

    def getValueState(self, name, shape):
        self.one = []
        return SimpleNamespace(exists=lambda: self.called(bool(self.one)), get=lambda: self.called(self.one[0] if self.one else None), update=lambda v: self.called(self.one.__setitem__(slice(None), [v])), clear=lambda: self.called(self.one.clear()))

    def getMapState(self, name, key, value):
        self.map = {}
        return SimpleNamespace(containsKey=lambda k: self.called(k in self.map), getValue=lambda k: self.called(self.map.get(k)), updateValue=lambda k, v: self.called(self.map.__setitem__(k, v)), keys=lambda: self.called(iter(list(self.map))), clear=lambda: self.called(self.map.clear()))

    def registerTimer(self, ms):
        self.called(self.timers.add(ms))


def test_calls_of_the_store_go_with_batches_not_with_rows():
    """Many rows of a key in three batches, each behind the one before by less than the watermark's delay: what they give, and how often the store is called."""
    made = [event(i, s, "a", rng.choice([None, "x", "y", "z"]), rng.random() < 0.1) for i, s in enumerate(x + (x > 900) * 500 for x in range(1800))]
    handle, processor, got, ms = Counted(), state.Ordered(IDLE), [], lambda ts: -(-(ts - datetime.datetime(1970, 1, 1)) // datetime.timedelta(milliseconds=1))
    processor.init(handle)
    for n in range(3):
        batch = rng.sample(made[600 * n : 600 * n + 600], 600)
        frame = pd.DataFrame([{"key": "a", "id": i, "ts": pd.Timestamp(ts), "us": pd.Timestamp(ts).value // 1000, "value": v, "resets": r} for i, ts, _, v, r in batch])
        list(processor.handleInputRows(("a",), iter([frame]), TimerValues(-1, -1)))
        now = ms(made[600 * n + 599 - (n < 2) * 50][1])
        while due := sorted(t for t in handle.timers if t <= now):
            for t in due:
                got += [tuple(r) for some in processor.handleExpiredTimer(("a",), TimerValues(-1, now), ExpiredTimerInfo(t)) for r in some.itertuples(index=False)]
                handle.timers.discard(t)
    assert [(r[0], r[1], r[3], None if pd.isna(r[4]) else int(r[4]), r[5]) for r in got] == [(k, i, c, n, f) for k, i, c, n, f in plain(made)]
    assert handle.calls < 100
