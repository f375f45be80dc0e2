import pytest
from pyspark.sql import functions as F

from matricula.streaming import jobs
from tests.test_rules import FIELDS


def drain(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_page_changes_match_the_batch_twin(spark, tmp_path):
    """Files that are not in order of time, late rows among them, and an end mark that lets all pass."""
    import random

    rng = random.Random(3)
    rows = [(f"u{rng.randrange(5)}", day * 24 + rng.randrange(24), rng.choice("AB")) for day in range(12) for _ in range(6)]
    frame = lambda x: spark.createDataFrame(x, "url string, h int, html string").selectExpr("url", "timestamp_seconds(1735689600 + h * 3600) AS at", "html")
    for k in range(0, 72, 24):
        part = rows[k : k + 24]
        rng.shuffle(part)
        frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    frame([("end", 24 * 4000, "Z")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set(*jobs.STATE_STORE)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for live in ("3650 days", "1 day"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        want = sorted(map(tuple, jobs.page_changes(frame(rows), live=live).collect()))
        found = drain(jobs.page_changes(stream, "10 days", live), f"changes{live[0]}", spark).filter("url <> 'end'")
        assert sorted(map(tuple, found.select("url", "at", "content_hash").collect())) == want and len(want) > 15
    spark.conf.unset(jobs.STATE_STORE[0])


def test_rates_repeats_and_activity(spark, tmp_path):
    rows = [(f"k{i % 3}", f"2025-01-01 00:00:{i:02d}", "approve" if i % 2 else "reject") for i in range(20)]
    frame = spark.createDataFrame(rows, "key string, ts string, action string").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    assert drain(jobs.without_repeats(stream(), "key"), "once", spark).count() == 3
    got = drain(jobs.request_rates(stream(), "key", most=5), "rates", spark, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.request_rates(frame, "key", most=5).collect()))
    day = drain(jobs.daily_activity(stream()), "days", spark, "complete").first()
    assert (day.actions, day.approved, day.rejected) == (20, 10, 10)


def test_validation_of_what_arrives(spark, tmp_path):
    row = (1, "MS", 2025, 150, None, None, None, None, "unknown", "unknown", "unknown", None, None, None, None, None, None, [])
    frame = spark.createDataFrame([row], FIELDS)
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    q = jobs.validate_stream(stream, f"{tmp_path}/issues", f"{tmp_path}/verdicts", f"{tmp_path}/cp", [], "2025-01-01")
    q.awaitTermination(120)
    assert "toefl_min" in {r.field_name for r in spark.read.parquet(f"{tmp_path}/issues").collect()}
    assert spark.read.parquet(f"{tmp_path}/verdicts").first().status == "needs_review"


def test_repeats_in_a_batch_go_for_the_time_to_live(spark):
    hours = [("a", 0), ("a", 5), ("a", 24), ("a", 25), ("a", 40), ("a", 50), ("b", 3), (None, 1), (None, 2)]
    rows = spark.createDataFrame(hours, "k string, h int").selectExpr("k", "h", "timestamp_seconds(h * 3600) AS ts")
    found = sorted((r.k or "", r.h) for r in jobs.without_repeats(rows, "k").collect())
    assert found == [("", 1), ("a", 0), ("a", 25), ("a", 50), ("b", 3)]


def test_an_address_has_one_timer():
    """However many captures wait; each of them had a timer of its own, which read all that waits."""
    import pandas as pd

    class State:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, x: setattr(self, "value", x)
        clear = lambda self: setattr(self, "value", None)
        appendList = lambda self, x: setattr(self, "value", (self.value or []) + x)

    class Handle:
        def __init__(self):
            self.timers = set()

        getListState = getValueState = lambda self, *_: State()
        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.discard(at)
        listTimers = lambda self: iter([(t,) for t in self.timers])

    class Now:
        getCurrentWatermarkInMs = lambda self: 0

    handle, changes = Handle(), jobs._Changes(1000)
    changes.init(handle)
    for start in (50, 0, 100):
        frame = pd.DataFrame({"at": pd.to_datetime([1000 * (start + k) for k in range(50)], unit="ms"), "content_hash": ["x"] * 50})
        list(changes.handleInputRows(("u",), iter([frame]), Now()))
    assert handle.timers == {1}
