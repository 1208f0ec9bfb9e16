"""Open sessions from the state, and late rows over more batches than a query's progress keeps and over a restart."""

import datetime as dt

from pyspark.sql import functions as F

from synthkit.session import scratch_dir
from synthkit.streaming import stream
from synthkit.streaming.late import LateRows

SCHEMA = "id bigint, user string, ts timestamp_ntz"
START = dt.datetime(2024, 1, 1)


def _files(spark, path, hours, first=0):
    """One file for each event; the file source reads them in the order they were written."""
    for i, h in enumerate(hours):
        row = [(first + i, "ab"[i % 2], START + dt.timedelta(hours=h))]
        spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _sessions(spark, path, max_files, **folders):
    src = stream.events_stream(spark, path, SCHEMA, max_files=max_files)
    rows, _ = stream.sessions_so_far(src, "ts", "user", **folders)
    return sorted((r.user, str(r.session_start), str(r.session_end), r.n, r.open) for r in rows.collect())


def test_open_sessions_for_any_batches_and_after_a_restart(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = scratch_dir(spark, "visits")
    _files(spark, path, [0, 0, 3, 3, 50, 90])
    one, many = _sessions(spark, path, None), _sessions(spark, path, 1)
    assert one == many and [(r[0], r[3], r[4]) for r in one] == [("a", 2, False), ("a", 1, False), ("b", 2, False), ("b", 1, True)]
    folders = {"out": scratch_dir(spark, "o"), "checkpoint": scratch_dir(spark, "c")}
    assert _sessions(spark, path, 2, **folders) == one
    _files(spark, path, [200, 94], first=10)  # a new session far ahead, and one that goes on
    rows = _sessions(spark, path, None, **folders)
    assert sum(r[3] for r in rows) == 8 and ("b", "2024-01-04 18:00:00", "2024-01-05 04:00:00", 2, False) in rows


def test_late_rows_of_many_batches_and_a_restart(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")  # progress keeps far fewer batches than run
    try:
        path, folder = scratch_dir(spark, "late"), scratch_dir(spark, "counts")
        folders = {"out": scratch_dir(spark, "o"), "checkpoint": scratch_dir(spark, "c")}
        _files(spark, path, [500, 1, 2, 3, 4, 5, 6, 7, 8, 600, 9, 10])
        src = stream.stream_dedup(stream.events_stream(spark, path, SCHEMA, max_files=1), ["id"], "ts")
        with LateRows(spark, folder) as late:
            rows, q = stream.run_to_table(src, **folders)
            # the engine judges a batch by the watermark before the last one: the event of hour 1 is not late yet
            assert len(q.recentProgress) <= 5 and late.total(q) == 9 == 12 - rows.count()
        _files(spark, path, [601, 11, 12], first=50)
        with LateRows(spark, folder) as late:  # a new listener, as after a lost driver
            rows, q = stream.run_to_table(src, **folders)
            assert late.total(q) == 11 == 15 - rows.count()
        other = stream.run_to_table(stream.stream_dedup(stream.events_stream(spark, path, SCHEMA), ["id"], "ts"))[1]
        assert not spark.read.text(f"{folder}/{q.id}").isEmpty() and other.id != q.id
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
