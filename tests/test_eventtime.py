"""Late rows by the engine's count, state that the watermark bounds, and a watermark that is kept between runs."""

from __future__ import annotations

import datetime

from lorehouse.streaming import eventtime

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp"


def rows(spark, given):
    return spark.createDataFrame([(i, k, START + datetime.timedelta(hours=h), p) for i, (k, h, p) in enumerate(given)], f"{SCHEMA}, part int")


def stream(spark, given, folder):
    return eventtime.parts_stream(spark, eventtime.put_parts(rows(spark, given), "part", f"file://{folder}"), SCHEMA)


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    given = [("a", 0, 0), ("a", 48, 0), ("b", 50, 1), ("c", 1, 2), ("c", 60, 2), ("d", 2, 3), ("d", 61, 3)]
    run = eventtime.counted(eventtime.first_within(stream(spark, given, tmp_path), ["id"], "ts", "10 hours"), f"file://{tmp_path}")
    assert run.late == 2 and {r["id"] for r in run.rows.collect()} == {0, 1, 2, 4, 6}


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    """Forty days of new keys: state holds those of about the last hours."""
    given = [(f"k{h}", h, h // 48) for h in range(0, 960, 2)]
    once = eventtime.counted(eventtime.first_within(stream(spark, given, tmp_path / "a"), ["key"], "ts", "4 hours"), f"file://{tmp_path}")
    assert once.rows.count() == 480 and once.late == 0 and once.most_state <= 2 * 24 + 4 and once.last_state <= 4
    closed = eventtime.counted(eventtime.sessions(stream(spark, given, tmp_path / "b"), "key", "ts", "1 hour", "4 hours"), f"file://{tmp_path}")
    assert closed.most_state <= 2 * 24 + 4 and closed.last_state <= 4 and closed.rows.count() >= 476
    marks = eventtime.counted(eventtime.session_marks(stream(spark, given, tmp_path / "c"), "key", "ts", 1, 3600, "4 hours"), f"file://{tmp_path}")
    assert marks.rows.count() == 480 and marks.most_state <= 2 * 24 + 8


def test_marks_begin_anew_after_idle_time(spark, tmp_path):
    given = [("a", 0, 0), ("a", 1, 0), ("a", 3, 1), ("a", 9, 2), ("b", 40, 3), ("a", 41, 4), ("a", 42, 4)]
    run = eventtime.counted(eventtime.session_marks(stream(spark, given, tmp_path), "key", "ts", 2, 5 * 3600, "1 hour"), f"file://{tmp_path}")
    assert sorted((r["key"], r["mark"], (r["at"] - START).total_seconds() / 3600) for r in run.rows.collect()) == [("a", 2, 1.0), ("a", 2, 42.0)]


def test_watermark_is_kept_between_runs(spark, tmp_path):
    path = eventtime.put_parts(rows(spark, [("a", 0, 0), ("a", 100, 0), ("b", 101, 1)]), "part", f"file://{tmp_path}")
    state = f"file://{tmp_path}/state"
    dedup = lambda: eventtime.first_within(eventtime.parts_stream(spark, path, SCHEMA), ["key"], "ts", "10 hours")
    first = eventtime.counted(dedup(), f"file://{tmp_path}", state=state)
    assert first.late == 0 and {r["key"] for r in first.rows.collect()} == {"a", "b"}
    rows(spark, [("c", 5, 0), ("d", 102, 0), ("b", 103, 0)]).drop("part").coalesce(1).write.parquet(f"{path}/part=00002")
    again = eventtime.counted(dedup(), f"file://{tmp_path}", state=state)
    assert again.late == 1 and {r["key"] for r in again.rows.collect()} == {"d"}  # b is known from the run before
    assert eventtime.counted(dedup(), f"file://{tmp_path}", state=state).rows.count() == 0
