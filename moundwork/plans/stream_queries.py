"""Streaming queries; each is checked against the batch meaning of the same rows."""

from __future__ import annotations

from moundwork.plans.check_tables import half_even
from moundwork.plans.registry import query
from moundwork.session import shared_folder
from moundwork.streaming import pitch_streams as st

LIMIT = 20


def paths(t, name: str) -> tuple[str, str]:
    return shared_folder(t.spark, name), shared_folder(t.spark, f"{name}-checkpoint")


@query("stream_ingest_pitches", "event_id:n pitcher_id:n game_date:d pitch_type:s release_speed:r release_spin_rate:n",
       "SELECT DISTINCT event_id, pitcher_id, game_date, pitch_type, release_speed, release_spin_rate FROM pitch_events", "pitch_events")
def _(t):
    out, checkpoint = paths(t, "ingested")
    st.ingest_to(st.open_events(t.spark, t.folder), out, checkpoint)
    return st.read_ingested(t.spark, out)


@query("stream_daily_appearances", "pitcher_id:n game_date:d pitches_thrown:n avg_vel:r vel_std:r avg_spin:r", f"""
SELECT pitcher_id, game_date, count(*) AS pitches_thrown, {half_even('avg(release_speed)', 2)} AS avg_vel,
  coalesce({half_even('stddev_samp(release_speed)', 2)}, 0) AS vel_std, {half_even('avg(release_spin_rate)', 2)} AS avg_spin FROM pitch_events GROUP BY 1, 2""", "pitch_events")
def _(t):
    out, checkpoint = paths(t, "daily")
    st.run_changes(st.daily_appearances(st.open_events(t.spark, t.folder)), out, checkpoint)
    return st.newest_changes(t.spark, out, ["pitcher_id", "game_date"])


@query("stream_daily_compacted", "pitcher_id:n game_date:d pitches_thrown:n avg_vel:r vel_std:r avg_spin:r", f"""
SELECT pitcher_id, game_date, count(*) AS pitches_thrown, {half_even('avg(release_speed)', 2)} AS avg_vel,
  coalesce({half_even('stddev_samp(release_speed)', 2)}, 0) AS vel_std, {half_even('avg(release_spin_rate)', 2)} AS avg_spin FROM pitch_events GROUP BY 1, 2""", "pitch_events")
def _(t):
    """The daily stream with its changes compacted and the merged epochs deleted."""
    out, checkpoint = paths(t, "daily-compacted")
    st.run_changes(st.daily_appearances(st.open_events(t.spark, t.folder)), out, checkpoint)
    keys = ["pitcher_id", "game_date"]
    st.compact(t.spark, out, keys)
    st.drop_compacted(t.spark, out)
    return st.newest_changes(t.spark, out, keys)


@query("stream_rolling_workload", "pitcher_id:n first_day:d last_day:d pitches:n avg_vel:r", """
SELECT pitcher_id, first_day, first_day + 6 AS last_day, count(*) AS pitches, avg(release_speed) AS avg_vel FROM (
  SELECT *, game_date - CAST(unnest(range(0, 7)) AS INTEGER) AS first_day FROM pitch_events) GROUP BY 1, 2""", "pitch_events")
def _(t):
    out, checkpoint = paths(t, "rolling")
    st.run_changes(st.rolling_load(st.open_events(t.spark, t.folder)), out, checkpoint)
    return st.newest_changes(t.spark, out, ["pitcher_id", "first_day"])


@query("stream_outings", "pitcher_id:n started:t ended:t pitches:n", """
SELECT pitcher_id, min(ts) AS started, max(ts) + INTERVAL 1 DAY AS ended, count(*) AS pitches FROM (
  SELECT *, sum(brk) OVER (PARTITION BY pitcher_id ORDER BY ts) AS grp FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY pitcher_id ORDER BY ts) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS brk FROM pitch_events))
GROUP BY pitcher_id, grp HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM pitch_events) - INTERVAL 1 DAY""", "pitch_events")
def _(t):
    out, checkpoint = paths(t, "outings")
    st.run_outings(st.open_events(t.spark, t.folder), out, checkpoint)
    return t.spark.read.parquet(out)


@query("stream_alerts", "pitcher_id:n game_date:d load:n", f"""
SELECT pitcher_id, game_date, load FROM (SELECT *, coalesce(lag(load) OVER (PARTITION BY pitcher_id ORDER BY game_date), 0) AS before FROM (
  SELECT pitcher_id, game_date, sum(n) OVER (PARTITION BY pitcher_id ORDER BY game_date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS load
  FROM (SELECT pitcher_id, game_date, count(*) AS n FROM pitch_events GROUP BY 1, 2))) WHERE load >= {LIMIT} AND before < {LIMIT}""", "pitch_events")
def _(t):
    out, checkpoint = paths(t, "alerts")
    st.run_alerts(t.spark, st.open_events(t.spark, t.folder), out, checkpoint, LIMIT)
    return st.read_alerts(t.spark, out)
