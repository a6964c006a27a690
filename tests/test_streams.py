"""Streams must equal their batch twins, over several files, copies, late rows and replays."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from moundwork import bindings, schemas
from moundwork.streaming import pitch_streams as st

START = dt.datetime(2024, 1, 1, 12)


def event(i, hours, pitcher=1, value=90.0):
    return (i, START + dt.timedelta(hours=hours), pitcher, "click", value, '{"k": %d}' % (i % 50))


def write(spark, folder, name, rows):
    """One more part file of the folder that holds the table."""
    spark.createDataFrame(rows, schemas.PITCH_EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


@pytest.fixture
def inbox(spark, tmp_path):
    folder = str(tmp_path / "inbox")
    write(spark, folder, "a", [event(i, 6 * i, pitcher=1 + i % 2) for i in range(30)])
    write(spark, folder, "b", [event(i, 6 * i, pitcher=1 + i % 2) for i in range(29, 60)])
    return folder


def batch(spark, folder):
    return bindings.shape_events(spark.read.parquet(f"{folder}/events.parquet"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ingest_drops_copies_and_replays_and_keeps_late_rows(spark, inbox, tmp_path):
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    wanted = batch(spark, inbox).dropDuplicates(["event_id"])

    def got():
        return rows(st.read_ingested(spark, out).select(*wanted.columns))

    for _ in range(2):
        st.ingest_to(st.open_events(spark, inbox, per_batch=1), out, cp)
        assert got() == rows(wanted)
    write(spark, inbox, "z", [event(60, 360), event(99, -500), event(3, 18, pitcher=2)])  # new, very late, copy
    st.ingest_to(st.open_events(spark, inbox, per_batch=1), out, cp)
    assert len(got()) == 62 and {60, 99} <= {r.event_id for r in st.read_ingested(spark, out).collect()}


def test_daily_aggregate_equals_batch(spark, inbox, tmp_path):
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    st.run_changes(st.daily_appearances(st.open_events(spark, inbox, per_batch=1)), out, cp)
    got = st.newest_changes(spark, out, ["pitcher_id", "game_date"])
    assert rows(got) == rows(st.daily_appearances(batch(spark, inbox)))


def test_sliding_load_equals_batch(spark, inbox, tmp_path):
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    st.run_changes(st.rolling_load(st.open_events(spark, inbox, per_batch=1)), out, cp)
    got = st.newest_changes(spark, out, ["pitcher_id", "first_day"])
    want = st.rolling_load(batch(spark, inbox)).select(*got.columns)
    assert rows(got) == rows(want)


def test_outings_emit_when_closed(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, "a", [event(0, 0), event(1, 5), event(2, 60), event(3, 200)])
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    st.run_outings(st.open_events(spark, folder), out, cp)
    got = rows(spark.read.parquet(out).select("pitcher_id", "pitches"))
    assert got == [(1, 1), (1, 2)]
    assert st.outings(batch(spark, folder)).count() == 3


def test_late_rows_are_counted(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, "a", [event(i, 24 * i) for i in range(10)])
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    st.run_changes(st.daily_appearances(st.open_events(spark, folder)), out, cp)
    write(spark, folder, "b", [event(99, 1)])
    query = st.run_changes(st.daily_appearances(st.open_events(spark, folder)), out, cp)
    assert st.rows_dropped_late(query) == 1
    first = st.newest_changes(spark, out, ["pitcher_id", "game_date"]).orderBy("game_date").first()
    assert first.pitches_thrown == 1


def test_alerts_equal_batch(spark, inbox, tmp_path):
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    st.run_alerts(spark, st.open_events(spark, inbox, per_batch=1), out, cp, limit=9)
    daily = batch(spark, inbox).groupBy("pitcher_id", "game_date").agg(F.count("*").alias("pitches_thrown"))
    assert rows(st.read_alerts(spark, out).select("pitcher_id", "game_date")) == rows(st.load_crossings(daily, 9).select("pitcher_id", "game_date"))


def test_alert_replay_changes_nothing(spark, inbox, tmp_path):
    out = str(tmp_path / "o")
    handler = st.alert_writer(spark, out, limit=9)
    handler(batch(spark, inbox), 0)
    before = rows(st.read_alerts(spark, out).select("pitcher_id", "game_date", "load"))
    handler(batch(spark, inbox), 0)
    assert rows(st.read_alerts(spark, out).select("pitcher_id", "game_date", "load")) == before


def test_late_pitches_withdraw_an_alert(spark, tmp_path):
    out = str(tmp_path / "o")
    handler = st.alert_writer(spark, out, limit=5)
    first = [(1, f"2024-01-0{d}") for d in (1, 1, 2, 2, 3, 3)]
    late = [(1, "2024-01-02")] * 2

    def frame(pitches):
        return spark.createDataFrame(pitches, "pitcher_id bigint, day string").select("pitcher_id", F.to_date("day").alias("game_date"))

    handler(frame(first), 0)
    assert [str(r.game_date) for r in st.read_alerts(spark, out).collect()] == ["2024-01-03"]
    handler(frame(late), 1)
    daily = frame(first + late).groupBy("pitcher_id", "game_date").agg(F.count("*").alias("pitches_thrown"))
    got = rows(st.read_alerts(spark, out).select("pitcher_id", "game_date", "load"))
    assert got == rows(st.load_crossings(daily, 5)) and [str(r[1]) for r in got] == ["2024-01-02"]


def test_compaction_keeps_the_rows_and_bounds_the_files(spark, inbox, tmp_path, monkeypatch):
    out, cp, keys = str(tmp_path / "o"), str(tmp_path / "c"), ["pitcher_id", "game_date"]

    def run():
        st.run_changes(st.daily_appearances(st.open_events(spark, inbox, per_batch=1)), out, cp)

    def got():
        return rows(st.newest_changes(spark, out, keys))

    run()
    before = got()
    assert before == rows(st.daily_appearances(batch(spark, inbox)))
    with monkeypatch.context() as patch:  # the run dies between the new base and its commit
        patch.setattr(st.Files, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            st.compact(spark, out, keys)
    assert got() == before
    assert st.compact(spark, out, keys) and got() == before and not st.compact(spark, out, keys)
    assert all("/_base/" in f for f in st.newest_changes(spark, out, keys).inputFiles())
    st.drop_compacted(spark, out)
    assert got() == before and not list((tmp_path / "o").glob("epoch=*"))
    write(spark, inbox, "c", [event(i, 6 * i, pitcher=1 + i % 2) for i in range(60, 70)])  # a day in the base goes on
    run()
    after = rows(st.daily_appearances(batch(spark, inbox)))
    assert got() == after != before
    assert st.compact(spark, out, keys) and got() == after
