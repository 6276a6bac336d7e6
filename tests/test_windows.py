"""Sliding windows and repeated records as streams, with rows that come late."""

import os
import time
from datetime import datetime

from stagewise.streaming import logs

SCHEMA = "user_id long, event_type string, ts timestamp, value double"


def _at(hour, minute=0):
    return datetime(2024, 1, 1, hour, minute)


def _stream(spark, tmp_path, parts):
    """One file a step, in the order given."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/part{k}")
        (own,) = (tmp_path / f"part{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        target = tmp_path / "in" / f"{k}.parquet"
        os.rename(own, target)
        stamp = time.time() - 100 + 10 * k
        os.utime(target, (stamp, stamp))
    schema = spark.createDataFrame([], SCHEMA).schema
    return logs.table_stream(spark, f"file://{tmp_path}/in", schema, files=1)


def test_late_rows_of_sliding_windows(spark, tmp_path):
    parts = [
        [(1, "a", _at(10), 1.0), (2, "a", _at(12), 2.0)],
        [(9, "a", _at(12, 1), 32.0)],  # a watermark holds from the step after the next
        [(3, "a", _at(10, 5), 4.0), (4, "a", _at(11, 55), 8.0)],  # behind the watermark of 11:50; within it
        [(5, "a", _at(20), 16.0)],
    ]
    stream = logs.sliding(_stream(spark, tmp_path, parts))
    got = {(r.begin.hour, r.begin.minute): (r.n, r.total) for r in logs.run_to_memory(stream, "sliding_found").collect()}
    assert got == {(9, 30): (1, 1.0), (10, 0): (1, 1.0), (11, 0): (1, 8.0), (11, 30): (3, 42.0), (12, 0): (2, 34.0)}
    whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    assert {(r.begin.hour, r.begin.minute): r.n for r in logs.sliding(whole).collect()}[10, 0] == 2


def test_records_repeated_after_a_restart(spark, tmp_path):
    parts = [
        [(1, "a", _at(10), 1.0), (1, "a", _at(10, 1), 1.5), (2, "a", _at(10), 2.0)],
        [(1, "a", _at(10, 5), 3.0), (3, "a", _at(13), 4.0)],  # user 1 again, within the watermark
        [(4, "a", _at(13, 1), 6.0)],
        [(2, "a", _at(13, 5), 5.0)],  # user 2 again, long after its state is gone
    ]
    stream = logs.first_records(_stream(spark, tmp_path, parts), ["user_id"])
    got = sorted((r.user_id, r.ts.hour) for r in logs.run_to_memory(stream, "first_found").collect())
    assert got == [(1, 10), (2, 10), (2, 13), (3, 13), (4, 13)]
    whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    once = logs.first_records(whole, ["user_id"]).collect()
    assert sorted((r.user_id, r.value) for r in once) == [(1, 1.0), (2, 2.0), (3, 4.0), (4, 6.0)]
