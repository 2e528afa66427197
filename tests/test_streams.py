"""Streams in append mode: closed windows come out once, late rows are dropped, repeated deliveries pass once."""

import time
from datetime import datetime, timedelta

from weftline.streaming.windows import first_deliveries, hourly, read_events

AT = datetime(2026, 1, 1)
TURNS = "request_id bigint, session_id string, turn int, user_message string, received_at timestamp"


def batches(spark, folder, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are taken in the order of their times


def run(df, name, folder):
    df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(folder / name)).start().awaitTermination(120)


def test_closed_hours_come_once_and_late_rows_are_dropped(spark, tmp_path):
    at = lambda h, m=0: AT + timedelta(hours=h, minutes=m)
    parts = [[(1, at(0, 5), "view", 1.0), (2, at(0, 50), "view", 2.0)], [(3, at(5), "view", 4.0)], [(7, at(5, 2), "view", 0.5)], [(4, at(0, 10), "view", 100.0), (5, at(5, 1), "click", 8.0)], [(6, at(9), "view", 16.0)]]
    batches(spark, tmp_path / "events", parts, "event_id bigint, ts timestamp, event_type string, value double")
    run(hourly(read_events(spark, str(tmp_path / "events"), 1), late="1 hour"), "closed", tmp_path)
    got = sorted((r.hour, r.event_type, r.events, r.total) for r in spark.table("closed").collect())
    assert got == [(at(0), "view", 2, 3.0), (at(5), "click", 1, 8.0), (at(5), "view", 2, 4.5)]  # the last hour is still open


def test_repeated_deliveries_pass_once(spark, tmp_path):
    row = lambda i, s: (i, "s", i, f"m{i}", AT + timedelta(seconds=s))
    batches(spark, tmp_path / "turns", [[row(1, 0), row(2, 1), row(1, 2)], [row(2, 30), row(3, 31)]], TURNS)
    source = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "turns"))
    run(first_deliveries(source), "firsts", tmp_path)
    assert sorted(r.request_id for r in spark.table("firsts").collect()) == [1, 2, 3]
