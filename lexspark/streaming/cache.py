"""A cache with times to live over a log of its calls: as a batch plan, and as a stream whose keyed state expires.

A call (key, ts, seq, op, value, ttl_s) sets a key's value, for ``ttl_s`` seconds or for good (null or 0), or gets it. A get is answered with the value of the last
set before it, in the order of (ts, seq), unless that has expired by then: a value is gone once ``ttl_s`` seconds have passed. A call that is
delivered again (same key, ts and seq) counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.asof import carried

ANSWERS = "key string, ts timestamp, seq long, hit boolean, value string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def answers(calls: DataFrame, segment: str = "1 day") -> DataFrame:
    """ANSWERS to all gets of a table of ``calls``. A hot key is worked off by ``segment`` of time, not in one task."""
    rows = calls.withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["key", "ts", "seq"])
    is_set = F.col("op") == "set"
    held = F.when(is_set, F.struct(F.col("ts").alias("set_at"), "value", "ttl_s"))
    out = carried(rows, "key", ("ts", "seq"), held, F.window("ts", segment)["start"], "held").where("op = 'get'")
    age = F.unix_micros("ts") - F.unix_micros(F.col("held.set_at"))
    endless = F.col("held.ttl_s").isNull() | (F.col("held.ttl_s") == 0)
    hit = F.col("held").isNotNull() & (endless | (age < F.col("held.ttl_s") * 1_000_000))
    return out.select("key", "ts", "seq", hit.alias("hit"), F.when(hit, F.col("held.value")).alias("value"))


class Keyed(StatefulProcessor):
    """State of one key: calls that the watermark has not passed, and the value in force with the time it expires at.

    Calls wait for the watermark, as earlier ones may still arrive, and are then worked off in order, so the answers are those of the batch plan
    however calls are spread over batches. A timer wakes the key when its next call is due, or when its value expires and is dropped from the state.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, seq long", "op string, value string, ttl_us long")
        self.held = handle.getValueState("held", "value string, until_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64")
            for at, seq, op, value, ttl in zip(us.tolist(), part["seq"].tolist(), part["op"].tolist(), part["value"].tolist(), part["ttl_s"].tolist(), strict=True):
                ttl_us = 0 if ttl is None or ttl != ttl else int(round(ttl * 1_000_000))
                self.waiting.updateValue((at, int(seq)), (op, value if isinstance(value, str) else None, ttl_us))
                due.add(at // 1000 + 1)
        for ms in due:
            self.handle.registerTimer(ms)
        yield self.frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((tuple(at), tuple(call)) for at, call in self.waiting.iterator() if at[0] < passed)
        value, until = self.held.get() if self.held.exists() else (None, 0)
        there, out = self.held.exists(), []
        for (at, seq), (op, new, ttl_us) in ready:
            self.waiting.removeKey((at, seq))
            if op == "set":
                value, until, there = new, at + ttl_us if ttl_us else 0, True
            elif op == "get":
                hit = there and (not until or at < until)
                out.append((at, seq, hit, value if hit else None))
        if there and until and until <= passed:
            self.held.clear()
        elif there and ready:
            self.held.update((value, until))
            if until:
                self.handle.registerTimer(until // 1000 + 1)
        yield self.frame(key, out)

    @staticmethod
    def frame(key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["ts", "seq", "hit", "value"])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        out.insert(0, "key", key[0])
        return out.astype({"seq": "int64", "hit": "bool", "value": "object", "key": "object"})

    def close(self) -> None:
        pass


def answer_stream(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """ANSWERS as a stream over a stream of ``calls``. Calls up to ``late`` behind the newest one are put in order; those behind the watermark are dropped.

    State lives in RocksDB on the executors and their checkpoints, one entry for each waiting call and each key in force.
    """
    calls.sparkSession.conf.set(STATE_STORE, ROCKS)
    marked = calls.select("key", "ts", F.col("seq").cast("long").alias("seq"), "op", "value", F.col("ttl_s").cast("double").alias("ttl_s")).withWatermark("ts", late)
    return marked.groupBy("key").transformWithStateInPandas(Keyed(), ANSWERS, "Append", "EventTime")
