"""Small streaming jobs: changed pages, repeats within a day, request rates, review activity,
validation of what arrives. Each takes a stream (or a batch frame, for the same result at rest).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.window import Window as W

from ..functions.names import fresh
from ..operators.rules import Rule, validate

CHANGE = "url string, at timestamp, content_hash string"
#: The state store that timers and lists of state need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Changes(StatefulProcessor):
    """Captures of an address wait until the watermark has passed them, then go by in order of time;
    what is kept of those that went by is the last content, for `live` milliseconds at most."""

    def __init__(self, live: int) -> None:
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at timestamp, content_hash string")
        self.last = handle.getValueState("last", "content_hash string, until long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """The one timer of an address goes off at `at`."""
        if self.timer.exists() and (old := self.timer.get()[0]) != at:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        waits, first = self.waiting.exists(), None
        for frame in rows:
            if len(frame):
                self.waiting.appendList([(at.to_pydatetime(), h) for at, h in zip(frame["at"], frame["content_hash"], strict=True)])
                least = int(frame["at"].min().timestamp() * 1000)
                first = least if first is None else min(first, least)
        if first is not None:
            at = max(first, timerValues.getCurrentWatermarkInMs()) + 1
            if not waits or at < self.timer.get()[0]:  # else the timer is that of an earlier capture
                self._wake(at)
        yield pd.DataFrame({"url": pd.Series(dtype=str), "at": pd.Series(dtype="datetime64[us]"), "content_hash": pd.Series(dtype=str)})

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rows = sorted((pd.Timestamp(at), h) for at, h in self.waiting.get()) if self.waiting.exists() else []
        due = [(at, h) for at, h in rows if at.timestamp() * 1000 < now]
        last, until = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for at, h in due:
            stamp = int(at.timestamp() * 1000)
            if h != last or stamp > until:
                out.append((key[0], at, h))
            last, until = h, stamp + self.live
        rest = rows[len(due) :]
        if due:
            self.last.update((last, until))
            self.waiting.clear()
            if rest:
                self.waiting.appendList([(at.to_pydatetime(), h) for at, h in rest])
        elif not rest and self.last.exists() and now > until:
            self.last.clear()
        if rest:
            self._wake(max(int(rest[0][0].timestamp() * 1000), now) + 1)
        elif self.last.exists():
            self._wake(max(until, now) + 1)
        yield pd.DataFrame(out, columns=["url", "at", "content_hash"]).astype({"url": str, "content_hash": str, "at": "datetime64[us]"})

    def close(self) -> None:
        pass


def page_changes(captures: DataFrame, late: str = "1 day", live: str = "3650 days") -> DataFrame:
    """Captures (url, at, html) whose content differs from the last one of the same address, or whose
    last one is more than `live` back.

    A stream gives them in order of time, once the watermark (`late` behind the newest capture) has
    passed; what comes later still is dropped. It needs the session's state store to be STATE_STORE;
    state is what still waits, and one content for each address seen within `live`."""
    hashed = captures.select("url", "at", F.sha2("html", 256).alias("content_hash"))
    if captures.isStreaming:
        return hashed.withWatermark("at", late).groupBy("url").transformWithStateInPandas(_Changes(_micros(live) // 1000), CHANGE, "Append", "EventTime")
    order = W.partitionBy("url").orderBy("at", "content_hash")
    seen = hashed.withColumns({"last": F.lag("content_hash").over(order), "before": F.lag("at").over(order)})
    old = F.unix_micros("at") - F.unix_micros("before") > _micros(live)
    return seen.filter(F.col("last").isNull() | (F.col("last") != F.col("content_hash")) | old).select("url", "at", "content_hash")


def _micros(span: str) -> int:
    """Microseconds of a time span such as `24 hours`."""
    number, unit = span.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * 1_000_000


def without_repeats(requests: DataFrame, key: str, at: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """Each key once within the time to live: a row goes if one of its key that stayed is no older.

    A stream also drops what comes later than that. In a batch the rows of a key pass in order of
    time, and only the last one that stayed is kept in mind."""
    if requests.isStreaming:
        return requests.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])
    columns = requests.columns
    k_, at_, ttl_ = fresh(columns, "_k", "_at", "_ttl")
    ordered = requests.select(F.xxhash64(key).alias(k_), F.unix_micros(at).alias(at_), F.lit(_micros(ttl)).alias(ttl_), *columns)
    ordered = ordered.repartition(k_).sortWithinPartitions(k_, at_)

    def first_of_each(batches):
        known, until = None, None
        for batch in batches:
            keep = []
            for k, t, live in zip(*(batch.column(c).to_pylist() for c in (k_, at_, ttl_)), strict=True):
                new = k != known or until is None or t is None or t > until
                keep.append(new)
                if new:
                    known, until = k, None if t is None else t + live
            yield batch.filter(pa.array(keep, pa.bool_())).select(columns)

    return ordered.mapInArrow(first_of_each, requests.schema)


def request_rates(requests: DataFrame, client: str, at: str = "ts", size: str = "60 seconds", slide: str | None = "10 seconds", most: int = 100, late: str = "10 minutes") -> DataFrame:
    """Requests of each client in sliding (or, without `slide`, tumbling) windows, and whether
    they reach the limit."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    stream = requests.withWatermark(at, late) if requests.isStreaming else requests
    counted = stream.groupBy(window.alias("w"), client).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), client, "n", (F.col("n") >= most).alias("over_limit"))


def daily_activity(actions: DataFrame, at: str = "ts", kind: str = "action", late: str = "1 day") -> DataFrame:
    stream = actions.withWatermark(at, late) if actions.isStreaming else actions
    days = stream.groupBy(F.window(at, "1 day").alias("w"))
    counted = days.agg(F.count(F.lit(1)).alias("actions"), F.count_if(F.col(kind) == "approve").alias("approved"), F.count_if(F.col(kind) == "reject").alias("rejected"))
    return counted.select(F.to_date("w.start").alias("day"), "actions", "approved", "rejected")


def validate_stream(arriving: DataFrame, issues_path: str, verdict_path: str, checkpoint: str, known_codes: list[str], as_of: str, more: tuple[Rule, ...] = ()):
    """Validate each batch of arriving sets and append its issues and verdicts.

    A batch is written under its number, so that a repeated batch replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        found, verdicts = validate(batch, known_codes, as_of, more)
        found.write.mode("overwrite").parquet(f"{issues_path}/batch={number}")
        verdicts.write.mode("overwrite").parquet(f"{verdict_path}/batch={number}")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
