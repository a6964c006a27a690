"""Queries for pitch-to-game aggregation."""

from __future__ import annotations

from moundwork.operators import appearances as op
from moundwork.operators import labels
from moundwork.plans.check_tables import half_even
from moundwork.plans.registry import query, sql_table

STATS = "pitcher_id:n game_date:d pitches_thrown:n avg_vel:r vel_std:r avg_spin:r spin_std:r innings_pitched:r"


@query("pitches_to_appearances", STATS + " outs_recorded:n", f"""
SELECT *, CAST(trunc(innings_pitched * 3) AS INTEGER) AS outs_recorded FROM (
  SELECT pitcher_id, game_date, count(pitch_number) AS pitches_thrown, {half_even('avg(release_speed)', 2)} AS avg_vel,
    coalesce({half_even('stddev_samp(release_speed)', 2)}, 0) AS vel_std, {half_even('avg(release_spin_rate)', 2)} AS avg_spin,
    coalesce({half_even('stddev_samp(release_spin_rate)', 2)}, 0) AS spin_std,
    {half_even('count(*) / 15.0::DOUBLE', 1)} AS innings_pitched
  FROM pitches GROUP BY pitcher_id, game_date)""", "pitches")
def _(t):
    return op.pitches_to_appearances(t.pitches)


@query("appearances_with_release", STATS + " season:n release_x_std:r release_z_std:r avg_extension:r outs_recorded:n", f"""
SELECT *, CAST(trunc(innings_pitched * 3) AS INTEGER) AS outs_recorded FROM (
  SELECT pitcher_id, game_date, season, count(pitch_number) AS pitches_thrown, {half_even('avg(release_speed)', 2)} AS avg_vel,
    {half_even('stddev_samp(release_speed)', 2)} AS vel_std, {half_even('avg(release_spin_rate)', 2)} AS avg_spin,
    {half_even('stddev_samp(release_spin_rate)', 2)} AS spin_std, {half_even('stddev_samp(release_pos_x)', 2)} AS release_x_std,
    {half_even('stddev_samp(release_pos_z)', 2)} AS release_z_std, {half_even('avg(release_extension)', 2)} AS avg_extension,
    {half_even('count(*) / 15.0::DOUBLE', 1)} AS innings_pitched
  FROM pitches GROUP BY ALL)""", "pitches")
def _(t):
    return op.appearances_with_release(t.pitches, by_season=True)


@query("appearances_clamped", STATS, f"""
SELECT pitcher_id, game_date, count(*) AS pitches_thrown, {half_even('avg(release_speed)', 1)} AS avg_vel,
  coalesce({half_even('stddev_samp(release_speed)', 1)}, 0) AS vel_std, trunc(avg(release_spin_rate)) AS avg_spin,
  trunc(coalesce(stddev_samp(release_spin_rate), 0)) AS spin_std,
  least(9.0::DOUBLE, greatest(0.1::DOUBLE, {half_even('count(*) / 15.0::DOUBLE', 1)})) AS innings_pitched
FROM pitches GROUP BY ALL""", "pitches")
def _(t):
    return op.appearances_clamped(t.pitches)


@query("appearances_by_last_pitch",
       "pitcher_id:n game_date:d pitches_thrown:n avg_vel:r vel_std:r avg_spin:r spin_std:r at_bats:n", """
SELECT pitcher_id, game_date, max(pitch_number) AS pitches_thrown, avg(release_speed) AS avg_vel,
  stddev_samp(release_speed) AS vel_std, avg(release_spin_rate) AS avg_spin,
  stddev_samp(release_spin_rate) AS spin_std, count(DISTINCT at_bat_id) AS at_bats
FROM pitches GROUP BY ALL""", "pitches")
def _(t):
    return op.appearances_by_last_pitch(t.pitches)


@query("pitch_with_appearance",
       "pitcher_id:n game_date:d at_bat_id:n pitch_number:n pitch_type:s release_speed:r pitches_thrown:n avg_vel:r", """
SELECT p.pitcher_id, p.game_date, at_bat_id, pitch_number, pitch_type, release_speed, pitches_thrown, avg_vel
FROM pitches p LEFT JOIN appearances a ON p.pitcher_id = a.pitcher_id AND p.game_date = a.game_date""", "pitches appearances")
def _(t):
    return op.pitch_with_appearance(t.pitches, t.appearances)


@query("reaggregate_joined", "pitcher_id:n game_date:d pitches_thrown:n avg_vel:r avg_spin:r innings_pitched:r", """
SELECT p.pitcher_id, p.game_date, any_value(pitches_thrown) AS pitches_thrown, avg(avg_vel) AS avg_vel,
  avg(avg_spin) AS avg_spin, any_value(innings_pitched) AS innings_pitched
FROM pitches p LEFT JOIN appearances a ON p.pitcher_id = a.pitcher_id AND p.game_date = a.game_date
GROUP BY p.pitcher_id, p.game_date""", "pitches appearances")
def _(t):
    return op.reaggregate_joined(op.pitch_with_appearance(t.pitches, t.appearances))


@query("daily_totals", "pitcher_id:n game_date:d pitches_thrown:n innings_pitched:r", """
SELECT pitcher_id, game_date, sum(pitches_thrown) AS pitches_thrown, sum(innings_pitched) AS innings_pitched
FROM appearances GROUP BY ALL""", "appearances")
def _(t):
    return op.daily_totals(t.appearances)


sql_table("gap_labels", """
SELECT *, CASE WHEN gap_days > 21 THEN 1 ELSE 0 END AS gap_label FROM (
  SELECT pitcher_id, game_date, pitches_thrown, avg_vel,
    lead(game_date) OVER (PARTITION BY pitcher_id ORDER BY game_date) - game_date AS gap_days FROM appearances)""",
          "appearances")


@query("per_appearance_pitch_stats", "pitcher_id:n game_date:d gap_label:n avg_velocity:r avg_spin_rate:r", """
SELECT g.pitcher_id, g.game_date, gap_label, coalesce(v, 0) AS avg_velocity, coalesce(s, 0) AS avg_spin_rate
FROM gap_labels g LEFT JOIN (SELECT pitcher_id, game_date, avg(release_speed) v, avg(release_spin_rate) s
  FROM pitches GROUP BY ALL) p ON g.pitcher_id = p.pitcher_id AND g.game_date = p.game_date""", "gap_labels pitches")
def _(t):
    return op.pitch_stats_per_appearance(labels.gap_label(t.appearances), t.pitches)


@query("labels_back_to_pitches", "pitcher_id:n game_date:d at_bat_id:n pitch_number:n release_speed:r gap_label:n", """
SELECT p.pitcher_id, p.game_date, at_bat_id, pitch_number, release_speed, coalesce(gap_label, 0) AS gap_label
FROM pitches p LEFT JOIN gap_labels g ON p.pitcher_id = g.pitcher_id AND p.game_date = g.game_date""", "pitches gap_labels")
def _(t):
    return op.labels_back_to_pitches(t.pitches, labels.gap_label(t.appearances), "gap_label")


@query("labels_per_pitcher", "pitcher_id:n gap_label:n last_date:d", """
SELECT pitcher_id, max(gap_label) AS gap_label, max(game_date) AS last_date FROM gap_labels GROUP BY 1""", "gap_labels")
def _(t):
    return op.labels_per_pitcher(labels.gap_label(t.appearances), "gap_label")


@query("release_point_stability", "pitcher_id:n release_x_std:r release_z_std:r extension_slope:r", """
SELECT pitcher_id, stddev_samp(release_pos_x) AS release_x_std, stddev_samp(release_pos_z) AS release_z_std,
  regr_slope(release_extension, CAST(game_date - DATE '1970-01-01' AS DOUBLE)) AS extension_slope
FROM pitches GROUP BY 1""", "pitches")
def _(t):
    return op.release_point_stability(t.pitches)
