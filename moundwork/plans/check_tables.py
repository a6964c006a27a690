"""Check-SQL twins of the bindings."""

from __future__ import annotations

from moundwork.bindings import INJURY_PLACES, REPORT_NOTES, TRANSACTION_LINES
from moundwork.plans.registry import sql_table


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(options, index: str) -> str:
    return "[" + ", ".join(text(o) for o in options) + f"][CAST({index} AS BIGINT) + 1]"


def half_even(expr: str, digits: int) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


sql_table("pitches", """
SELECT CAST(l_suppkey AS INTEGER) AS pitcher_id, CAST(l_shipdate AS DATE) AS game_date,
  l_orderkey AS at_bat_id, l_linenumber AS pitch_number,
  CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'FF' WHEN 'RO' THEN 'SI' WHEN 'AF' THEN 'SL'
    WHEN 'AO' THEN 'CU' WHEN 'NF' THEN 'CH' ELSE 'FC' END AS pitch_type,
  70 + l_quantity * 0.5::DOUBLE AS release_speed,
  CAST(trunc(1500 + l_extendedprice / 100) AS INTEGER) AS release_spin_rate,
  l_discount * 10 - 0.5::DOUBLE AS release_pos_x, 5 + l_tax * 10 AS release_pos_z,
  6 + l_quantity * 0.02::DOUBLE AS release_extension, year(l_shipdate) AS season
FROM lineitem""")

sql_table("box_scores", f"""
SELECT *, CAST(trunc(innings_pitched * 3) AS INTEGER) AS outs_recorded FROM (
  SELECT *, {half_even('pitches_thrown / 15.0::DOUBLE', 1)} AS innings_pitched FROM (
    SELECT pitcher_id, game_date, CAST(sum((release_speed - 70) * 2) AS INTEGER) AS pitches_thrown,
      {half_even('avg(release_speed)', 2)} AS avg_vel,
      coalesce({half_even('stddev_samp(release_speed)', 2)}, 0) AS vel_std,
      {half_even('avg(release_spin_rate)', 2)} AS avg_spin,
      coalesce({half_even('stddev_samp(release_spin_rate)', 2)}, 0) AS spin_std,
      count(*) FILTER (pitch_type = 'CH') AS earned_runs, count(*) FILTER (pitch_number = 1) AS walks,
      count(*) FILTER (pitch_number >= 6) AS strikeouts, count(*) FILTER (pitch_type = 'SL') AS hits_allowed
    FROM pitches GROUP BY pitcher_id, game_date))""", "pitches")

sql_table("appearances", """
SELECT pitcher_id, game_date, pitches_thrown, avg_vel, vel_std, avg_spin, spin_std, innings_pitched,
  outs_recorded FROM box_scores""", "box_scores")

sql_table("pitchers", """
SELECT CAST(s_suppkey AS INTEGER) AS pitcher_id, s_name AS name, n_name AS team,
  CASE WHEN s_acctbal > 4500 THEN 'starter' ELSE 'reliever' END AS role,
  90 + CAST(s_suppkey % 6 AS DOUBLE) AS baseline_velocity,
  CAST(2000 + (s_suppkey % 10) * 50 AS INTEGER) AS baseline_spin_rate
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")

sql_table("injuries", f"""
SELECT pitcher_id, il_start, CASE WHEN NOT open_stint THEN il_start + CAST(stay + 10 AS INTEGER) END AS il_end,
  CASE WHEN line <= 2 THEN '10-day' WHEN line <= 5 THEN '15-day' ELSE '60-day' END AS stint_type,
  {pick(INJURY_PLACES, 'line - 1')} AS injury_location,
  CASE WHEN line <= 3 THEN 'strain' WHEN line <= 5 THEN 'soreness' ELSE 'tear' END AS injury_type,
  CASE WHEN line <= 3 THEN 'mild' WHEN line <= 5 THEN 'moderate' ELSE 'severe' END AS severity,
  0.2::DOUBLE + tax * 10 AS confidence_score
FROM (SELECT CAST(l_suppkey AS INTEGER) AS pitcher_id,
    CAST(l_shipdate AS DATE) + l_linenumber AS il_start, bool_or(l_linestatus = 'O' AND l_tax >= 0.06::DOUBLE) AS open_stint,
    max(l_partkey % 50) AS stay, min(l_linenumber) AS line, min(l_tax) AS tax
  FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.10::DOUBLE GROUP BY 1, 2)""")

sql_table("injury_reports", f"""
SELECT *, notes || ' ' || raw_text AS full_text FROM (
  SELECT doc_id AS report_id, 'Player ' || lang || ' ' || source AS pitcher_name, upper(lang) AS team,
    DATE '2024-03-01' + CAST(doc_id % 9 AS INTEGER) AS injury_date, source,
    {pick(REPORT_NOTES, f'doc_id % {len(REPORT_NOTES)}')} AS notes, text AS raw_text FROM documents)""")

sql_table("statcast_raw", """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS game_date, CASE WHEN l_tax != 0.08::DOUBLE THEN l_suppkey END AS pitcher,
  l_partkey AS batter, CASE WHEN l_discount != 0.05::DOUBLE THEN l_returnflag || '_long_pitch_code' END AS pitch_type,
  CASE WHEN l_discount != 0 THEN 70 + l_quantity * 0.5::DOUBLE END AS release_speed,
  CASE WHEN l_discount != 0.01::DOUBLE THEN 1500 + l_extendedprice / 100 END AS release_spin_rate,
  CASE WHEN l_tax != 0 THEN l_orderkey END AS at_bat_number,
  CASE WHEN l_tax != 0.01::DOUBLE THEN l_linenumber END AS pitch_number FROM lineitem""")

sql_table("transactions", f"""
SELECT o_orderkey AS transaction_id, o_custkey AS player_id, 'Player ' || o_custkey AS player_name,
  strftime(o_orderdate, '%Y-%m-%d') AS date,
  {pick(TRANSACTION_LINES, f'o_orderkey % {len(TRANSACTION_LINES)}')} AS description FROM orders""")

sql_table("roster_rows", f"""
SELECT playerid, name, team, pos FROM (
  SELECT CASE WHEN s_acctbal >= 0 THEN s_suppkey END AS playerid, s_name AS name,
    unnest([n_name, 'CAMP_' || n_name]) AS team, {pick(('SP', 'RP', 'C', 'P'), 's_suppkey % 4')} AS pos
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")

sql_table("pitch_events", """
SELECT event_id, ts, CAST(ts AS DATE) AS game_date, CAST(user_id AS INTEGER) AS pitcher_id,
  event_type AS pitch_type, value AS release_speed,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS release_spin_rate FROM events""")
