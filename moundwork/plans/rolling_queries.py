"""Queries for rolling workload, rest, trend, mix and grid features."""

from __future__ import annotations

from pyspark.sql import functions as F

from moundwork.functions import windows as w
from moundwork.operators import refresh, scoring
from moundwork.operators import rolling as op
from moundwork.plans.registry import query, sql_table
from moundwork.session import shared_folder

AS_OF = "2001-06-30"
FROM, TO = "2000-01-01", "2000-12-31"
MIN_PITCHES = 3
SPANS = (7, 14, 30)


def listed(codes) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


sql_table("line", """
SELECT *, CAST(game_date - DATE '1970-01-01' AS INTEGER) AS dn,
  CAST(game_date - lag(game_date) OVER (PARTITION BY pitcher_id ORDER BY game_date) AS INTEGER) AS gap FROM appearances""",
          "appearances")

W = "PARTITION BY pitcher_id ORDER BY dn"
SOFAR = f"({W} ROWS UNBOUNDED PRECEDING)"


def closed(n: int) -> str:
    return f"({W} RANGE BETWEEN {n} PRECEDING AND CURRENT ROW)"


def games(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def trend_sql(slope: str, spread: str, n: str) -> str:
    return (f"CASE WHEN {n} < 3 THEN 'stable' WHEN {slope} > {spread} * 0.1::DOUBLE THEN 'increasing' "
            f"WHEN {slope} < -({spread} * 0.1::DOUBLE) THEN 'decreasing' ELSE 'stable' END")


sql_table("game_features", f"""
SELECT *, CASE WHEN total_appearances < 3 THEN 'unknown' WHEN recent >= 5 THEN 'starter' WHEN recent >= 1 THEN 'reliever'
    ELSE 'closer' END AS recent_role, roll7d_pitch_count / CAST(roll7d_appearances AS DOUBLE) AS workload_intensity,
  roll7d_pitch_count / CAST(roll7d_appearances AS DOUBLE) * 0.7::DOUBLE AS fatigue_score
FROM (SELECT pitcher_id, game_date, dn, pitches_thrown, avg_vel, avg_spin, innings_pitched, count(*) OVER {SOFAR} AS total_appearances,
    avg(innings_pitched) OVER {SOFAR} AS avg_innings_per_appearance, avg(innings_pitched) OVER {games(10)} AS recent,
    pitches_thrown AS last_game_pitches, sum(pitches_thrown) OVER {games(3)} AS last_3_games_pitches,
    min(game_date) OVER {SOFAR} AS first_game,
    {', '.join(f'''sum(pitches_thrown) OVER {closed(n)} AS roll{n}d_pitch_count, count(*) OVER {closed(n)} AS roll{n}d_appearances,
    avg(pitches_thrown) OVER {closed(n)} AS roll{n}d_avg_pitches_per_appearance''' for n in SPANS)},
    {', '.join(f'''avg(CASE WHEN innings_pitched >= 2 THEN 1.0::DOUBLE ELSE 0 END) OVER {closed(n)} AS multi_inning_rate_{n}d,
    count(*) FILTER (gap = 1) OVER {closed(n - 1)} AS back_to_back_days_{n}d''' for n in (7, 14))},
    coalesce(avg(gap) OVER {SOFAR}, 0) AS avg_rest_days, coalesce(stddev_pop(gap) OVER {SOFAR}, 0) AS std_rest_days,
    coalesce(min(gap) OVER {SOFAR}, 0) AS min_rest_days, coalesce(max(gap) OVER {SOFAR}, 0) AS max_rest_days
  FROM line)""", "line")

WORKLOAD = " ".join(f"roll{n}d_pitch_count:n roll{n}d_appearances:n roll{n}d_avg_pitches_per_appearance:r" for n in SPANS)
LATEST = f"""SELECT * FROM game_features WHERE game_date <= DATE '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date DESC) = 1"""
sql_table("latest_features", LATEST, "game_features")


@query("history_upto", "pitcher_id:n game_date:d pitches_thrown:n", f"""
SELECT * FROM appearances WHERE game_date <= DATE '{AS_OF}'""", "appearances")
def _(t):
    return op.history_upto(t.appearances, AS_OF)


@query("recent_window", "pitcher_id:n game_date:d at_bat_id:n pitch_number:n release_speed:r", """
SELECT p.* FROM pitches p JOIN (SELECT pitcher_id, max(game_date) AS m FROM pitches GROUP BY 1) l
  ON p.pitcher_id = l.pitcher_id AND p.game_date >= l.m - 30""", "pitches")
def _(t):
    return op.recent_window(t.pitches, 30)


@query("rolling_workload", f"pitcher_id:n {WORKLOAD}", "SELECT * FROM latest_features", "latest_features")
def _(t):
    return op.rolling_workload(t.appearances, AS_OF)


@query("rolling_workload_by_game", f"pitcher_id:n game_date:d {WORKLOAD}", "SELECT * FROM game_features", "game_features")
def _(t):
    return op.game_features(t.appearances)


@query("last_game_pitches", "pitcher_id:n game_date:d last_game_pitches:n last_3_games_pitches:n",
       "SELECT * FROM latest_features", "latest_features")
def _(t):
    return op.latest_game(op.game_features(op.history_upto(t.appearances, AS_OF)), AS_OF)


@query("workload_intensity_and_fatigue", "pitcher_id:n game_date:d workload_intensity:r fatigue_score:r",
       "SELECT * FROM game_features", "game_features")
def _(t):
    return op.game_features(t.appearances)


@query("fatigue_with_rest", "pitcher_id:n game_date:d fatigue_score:r", """
SELECT pitcher_id, game_date, workload_intensity * 0.7::DOUBLE
  + (4 - CASE WHEN total_appearances > 1 THEN avg_rest_days ELSE 4 END) * 0.3::DOUBLE AS fatigue_score FROM game_features""", "game_features")
def _(t):
    return op.game_features(t.appearances, rest_in_fatigue=True)


@query("days_since_last_appearance", "pitcher_id:n days_since_last_appearance:n days_of_data:n", f"""
SELECT p.pitcher_id, coalesce(DATE '{AS_OF}' - max(game_date), 999) AS days_since_last_appearance,
  coalesce(DATE '{AS_OF}' - min(game_date), 0) AS days_of_data
FROM pitchers p LEFT JOIN (SELECT * FROM appearances WHERE game_date <= DATE '{AS_OF}') a USING (pitcher_id) GROUP BY 1""", "pitchers appearances")
def _(t):
    return op.days_since_last_appearance(t.pitchers, t.appearances, AS_OF)


@query("rest_days", "pitcher_id:n game_date:d avg_rest_days:r std_rest_days:r min_rest_days:r max_rest_days:r",
       "SELECT * FROM game_features", "game_features")
def _(t):
    return op.rest_days(t.appearances)


@query("back_to_back_days", "pitcher_id:n game_date:d back_to_back_days_7d:n back_to_back_days_14d:n", f"""
SELECT a.pitcher_id, a.game_date,
  {', '.join(f"count(*) FILTER (b.gap = 1 AND b.game_date > a.game_date - {n}) AS back_to_back_days_{n}d" for n in (7, 14))}
FROM line a JOIN line b ON a.pitcher_id = b.pitcher_id AND b.game_date BETWEEN a.game_date - 14 AND a.game_date
GROUP BY 1, 2""", "line")
def _(t):
    return op.game_features(t.appearances)


@query("multi_inning_rate", "pitcher_id:n game_date:d multi_inning_rate_7d:r multi_inning_rate_14d:r",
       "SELECT * FROM game_features", "game_features")
def _(t):
    return op.game_features(t.appearances)


@query("role_from_recent", "pitcher_id:n game_date:d recent_role:s avg_innings_per_appearance:r",
       "SELECT * FROM game_features", "game_features")
def _(t):
    return op.game_features(t.appearances)


sql_table("snapshots", f"""
SELECT *, roll7i * 0.7::DOUBLE + CASE WHEN roll21d_vel_decline > 1 THEN 1.0::DOUBLE ELSE 0 END * 0.3::DOUBLE AS fatigue_score, roll7i AS workload_intensity
FROM (SELECT *, least(roll7d_pitch_count / 150.0::DOUBLE, 2) AS roll7i, -roll21d_vel_decline AS vel_drop_21d,
    0 AS days_since_last_appearance, CASE WHEN games_so_far >= 10 THEN 'medium' ELSE 'low' END AS data_completeness
  FROM (SELECT pitcher_id, game_date AS as_of_date, pitches_thrown, avg_vel, innings_pitched, count(*) OVER {SOFAR} AS games_so_far,
    {', '.join(f'''sum(pitches_thrown) OVER {closed(n)} AS roll{n}d_pitch_count, avg(avg_vel) OVER {closed(n)} AS roll{n}d_avg_vel,
    count(*) OVER {closed(n)} AS roll{n}d_appearances, avg_vel - first(avg_vel) OVER {closed(n)} AS roll{n}d_vel_decline''' for n in (21, 7, 3))},
    coalesce(regr_slope(avg_vel, CAST(-dn AS DOUBLE)) OVER {games(5)}, 0) AS vel_trend_slope FROM line) WHERE games_so_far >= 5)""", "line")

SNAP = ("pitcher_id:n as_of_date:d roll21d_pitch_count:n roll21d_avg_vel:r roll21d_appearances:n roll21d_vel_decline:r "
        "roll7d_pitch_count:n roll7d_avg_vel:r roll7d_appearances:n roll7d_vel_decline:r roll3d_pitch_count:n "
        "vel_trend_slope:r workload_intensity:r fatigue_score:r vel_drop_21d:r data_completeness:s days_since_last_appearance:n")


@query("snapshot_rolling", SNAP, "SELECT * FROM snapshots", "snapshots")
def _(t):
    return op.snapshot_rolling(t.appearances)


sql_table("asof_snapshots", f"""
SELECT *, least(roll7d_pitch_count / 150.0::DOUBLE, 2) AS workload_intensity,
  least(roll7d_pitch_count / 150.0::DOUBLE, 2) * 0.7::DOUBLE + CASE WHEN roll21d_vel_decline > 1 THEN 1.0::DOUBLE ELSE 0 END * 0.3::DOUBLE AS fatigue_score,
  -roll21d_vel_decline AS vel_drop_21d, CASE WHEN games >= 10 THEN 'medium' ELSE 'low' END AS data_completeness
FROM (SELECT pitcher_id, DATE '{AS_OF}' AS as_of_date, count(*) AS games, min(ago) AS days_since_last_appearance,
    {', '.join(f'''coalesce(sum(pitches_thrown) FILTER (ago <= {n}), 0) AS roll{n}d_pitch_count,
    count(*) FILTER (ago <= {n}) AS roll{n}d_appearances,
    coalesce(arg_min(avg_vel, ago) FILTER (ago <= {n}) - arg_max(avg_vel, ago) FILTER (ago <= {n}), 0) AS roll{n}d_vel_decline''' for n in (21, 7))},
    sum(pitches_thrown) FILTER (ago <= 3) AS roll3d_pitch_count,
    coalesce(avg(avg_vel) FILTER (ago <= 21), 0) AS roll21d_avg_vel, avg(avg_vel) FILTER (ago <= 7) AS roll7d_avg_vel,
    coalesce(regr_slope(avg_vel, CAST(ago AS DOUBLE)) FILTER (rk <= 5), 0) AS vel_trend_slope
  FROM (SELECT *, DATE '{AS_OF}' - game_date AS ago, row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date DESC) AS rk
    FROM appearances WHERE game_date <= DATE '{AS_OF}') WHERE rk <= 50 GROUP BY 1) WHERE games >= 5""", "appearances")


@query("snapshot_rolling_asof", SNAP, "SELECT * FROM asof_snapshots", "asof_snapshots")
def _(t):
    return op.snapshot_rolling_asof(t.appearances, AS_OF)


def pregame_sql(n: int) -> str:
    return f"""
  coalesce(count(*) FILTER ({n} >= d), 0) AS pitch_count_{n}d, count(DISTINCT game_date) FILTER (d <= {n}) AS games_pitched_{n}d,
  coalesce(avg(release_speed) FILTER (d <= {n}), 0) AS avg_velocity_{n}d, coalesce(max(release_speed) FILTER (d <= {n}), 0) AS max_velocity_{n}d,
  CASE WHEN count(*) FILTER (d <= {n}) = 0 THEN 0 ELSE stddev_samp(release_speed) FILTER (d <= {n}) END AS velocity_std_{n}d,
  coalesce(avg(release_spin_rate) FILTER (d <= {n}), 0) AS avg_spin_rate_{n}d,
  CASE WHEN count(*) FILTER (d <= {n}) = 0 THEN 0 ELSE stddev_samp(release_spin_rate) FILTER (d <= {n}) END AS spin_rate_std_{n}d,
  coalesce(count(*) FILTER (d <= {n}) / CAST(nullif(count(DISTINCT game_date) FILTER (d <= {n}), 0) AS DOUBLE), 0) AS pitches_per_game_{n}d,
  coalesce(CAST(max(game_date) FILTER (d <= {n}) - min(game_date) FILTER (d <= {n}) AS DOUBLE)
    / nullif(count(DISTINCT game_date) FILTER (d <= {n}) - 1, 0), 0) AS avg_rest_days_{n}d,
  coalesce(min(gap) FILTER (d <= {n} AND d + gap <= {n}), 0) AS min_rest_days_{n}d"""


PREGAME = " ".join(
    f"pitch_count_{n}d:n games_pitched_{n}d:n avg_velocity_{n}d:r max_velocity_{n}d:r velocity_std_{n}d:r "
    f"avg_spin_rate_{n}d:r spin_rate_std_{n}d:r pitches_per_game_{n}d:r avg_rest_days_{n}d:r min_rest_days_{n}d:n"
    for n in (7, 14, 30, 60))


sql_table("pregame_rows", f"""
SELECT *, avg_velocity_7d - avg_velocity_30d AS vel_decline_7d_vs_30d, pitch_count_7d - pitch_count_30d / 4.0::DOUBLE AS workload_increase_7d_vs_30d,
  avg_velocity_14d - avg_velocity_30d AS vel_decline_14d_vs_30d, pitch_count_14d - pitch_count_30d / 2.0::DOUBLE AS workload_increase_14d_vs_30d
FROM (SELECT pitcher_id, day AS game_date, {', '.join(pregame_sql(n) for n in (7, 14, 30, 60))}
  FROM (SELECT g.pitcher_id, g.game_date AS day, p.game_date, p.release_speed, p.release_spin_rate, g.game_date - p.game_date AS d, l.gap
    FROM line g LEFT JOIN pitches p ON p.pitcher_id = g.pitcher_id AND p.game_date BETWEEN g.game_date - 60 AND g.game_date - 1
    LEFT JOIN line l ON l.pitcher_id = p.pitcher_id AND l.game_date = p.game_date) GROUP BY 1, 2)""", "line", "pitches")
EXTRA = "vel_decline_7d_vs_30d:r workload_increase_7d_vs_30d:r vel_decline_14d_vs_30d:r workload_increase_14d_vs_30d:r"


@query("pregame_rolling", f"pitcher_id:n game_date:d {PREGAME} {EXTRA}", "SELECT * FROM pregame_rows", "pregame_rows")
def _(t):
    return op.pregame_rolling(t.pitches)


FIRST_BATCH, LATE_FROM, LATE_TYPE = "2000-06-30", "2000-04-01", "SL"


@query("incremental_rolling_features", f"pitcher_id:n game_date:d last_game_pitches:n {WORKLOAD} {PREGAME} {EXTRA}", f"""
SELECT r.*, l.* EXCLUDE (pitcher_id, game_date) FROM pregame_rows r JOIN (
  SELECT pitcher_id, game_date, n AS last_game_pitches, {', '.join(f"sum(n) OVER {closed(k)} AS roll{k}d_pitch_count, count(*) OVER {closed(k)} AS roll{k}d_appearances, avg(n) OVER {closed(k)} AS roll{k}d_avg_pitches_per_appearance" for k in SPANS)}
  FROM (SELECT pitcher_id, game_date, CAST(game_date - DATE '1970-01-01' AS INTEGER) AS dn, count(*) AS n FROM pitches GROUP BY ALL)) l
  ON r.pitcher_id = l.pitcher_id AND r.game_date = l.game_date""", "pregame_rows pitches")
def _(t):
    """Three batches: old days without some of their pitches, the days after, and the pitches that came late."""
    store = refresh.FeatureStore(t.spark, shared_folder(t.spark, "features"), t.pitches)
    old = F.col("game_date") <= F.lit(FIRST_BATCH).cast("date")
    late = F.col("game_date").between(F.lit(LATE_FROM).cast("date"), F.lit(FIRST_BATCH).cast("date")) & (F.col("pitch_type") == LATE_TYPE)
    store.add(t.pitches.where(old & ~late), "first")
    store.add(t.pitches.where(~old), "second")
    store.add(t.pitches.where(late), "late")
    return store.features.read()


ROWCOUNT = " ".join(f"pitches_{n}d:n innings_{n}d:r strikeouts_{n}d:n walks_{n}d:n" for n in SPANS)


@query("rowcount_rolling", f"pitcher_id:n game_date:d {ROWCOUNT}", f"""
SELECT pitcher_id, game_date, {', '.join(f'''sum({c}) OVER (PARTITION BY pitcher_id ORDER BY game_date ROWS {n - 1} PRECEDING) AS {a}_{n}d'''
  for n in SPANS for c, a in (('pitches_thrown', 'pitches'), ('innings_pitched', 'innings'), ('strikeouts', 'strikeouts'), ('walks', 'walks')))}
FROM box_scores""", "box_scores")
def _(t):
    return op.rowcount_rolling(t.box_scores)


@query("trend_direction", "pitcher_id:n points:n slope:r spread:r trend:s", f"""
SELECT *, {trend_sql('slope', 'spread', 'points')} AS trend FROM (
  SELECT pitcher_id, count(*) AS points, coalesce(regr_slope(pitches_thrown, CAST(i AS DOUBLE)), 0) AS slope, stddev_pop(pitches_thrown) AS spread
  FROM (SELECT *, row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date) - 1 AS i FROM appearances
    WHERE game_date BETWEEN DATE '{FROM}' AND DATE '{TO}') GROUP BY 1)""", "appearances")
def _(t):
    return op.trend_direction(op.workload_timeseries(t.appearances, FROM, TO), "pitches_thrown")


def halfopen(n: int) -> str:
    return f"({W} RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("time_rolling", "pitcher_id:n game_date:d roll3g_pitch_count:n roll3d_pitch_count:n roll7d_pitch_count:n roll14d_pitch_count:n "
       "avg_vel_7d:r avg_vel_30d:r avg_spin_7d:r avg_spin_30d:r vel_drop_vs_30d:r spin_drop_vs_30d:r rest_days:n data_completeness:s", f"""
SELECT *, avg_vel_7d - avg_vel_30d AS vel_drop_vs_30d, avg_spin_7d - avg_spin_30d AS spin_drop_vs_30d,
  CASE WHEN roll7d_pitch_count < 10 OR avg_vel_7d IS NULL THEN 'low' WHEN avg_vel_30d IS NULL THEN 'med' ELSE 'high' END AS data_completeness
FROM (SELECT pitcher_id, game_date, CASE WHEN count(*) OVER {games(3)} = 3 THEN sum(pitches_thrown) OVER {games(3)} END AS roll3g_pitch_count,
  {', '.join(f"sum(pitches_thrown) OVER {halfopen(n)} AS roll{n}d_pitch_count" for n in (3, 7, 14))},
  {', '.join(f"avg(avg_{m}) OVER {halfopen(n)} AS avg_{m}_{n}d" for n in (7, 30) for m in ('vel', 'spin'))},
  coalesce(gap, 0) AS rest_days FROM line)""", "line")
def _(t):
    return op.time_rolling(t.appearances)


METRICS = ("release_speed", "release_spin_rate")


def ewm_sql(m: str, n: int) -> str:
    ok = f"n_{n} >= {MIN_PITCHES}"
    mean = f"sum(w_{n} * x_{m}) / sum(w_{n})"
    return f"""
  CASE WHEN any_value({ok}) THEN {mean} + any_value(mid_{m}) ELSE 0 END AS roll{n}d_{m}_ewm_mean,
  CASE WHEN any_value({ok}) THEN coalesce(sqrt(greatest(sum(w_{n} * x_{m} * x_{m}) / sum(w_{n}) - pow({mean}, 2), 0)
    * pow(sum(w_{n}), 2) / nullif(pow(sum(w_{n}), 2) - sum(w_{n} * w_{n}), 0)), 0) ELSE 0 END AS roll{n}d_{m}_ewm_std,
  CASE WHEN any_value({ok} AND n_30 >= {MIN_PITCHES}) AND {n} < 30 THEN {mean} ELSE 0 END AS roll{n}d_{m}_delta_vs_30d"""


sql_table("window_pitches", f"""
SELECT *, {', '.join(f"CASE WHEN ago <= {n} THEN pow(1 - 2.0::DOUBLE / (least({n}, n_{n}) + 1), k) END AS w_{n}" for n in SPANS)},
  release_speed - mid_release_speed AS x_release_speed, release_spin_rate - mid_release_spin_rate AS x_release_spin_rate
FROM (SELECT *, row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date DESC, pitch_number DESC, at_bat_id DESC, release_speed DESC, release_spin_rate DESC) - 1 AS k,
    {', '.join(f"count(*) FILTER (ago <= {n}) OVER (PARTITION BY pitcher_id) AS n_{n}" for n in SPANS)},
    {', '.join(f"avg({m}) OVER (PARTITION BY pitcher_id) AS mid_{m}" for m in METRICS)}
  FROM (SELECT p.*, anchor - game_date AS ago FROM pitches p JOIN (SELECT pitcher_id, max(game_date) AS anchor FROM pitches
    WHERE game_date <= DATE '{AS_OF}' GROUP BY 1) l USING (pitcher_id) WHERE game_date BETWEEN anchor - 30 AND anchor))""", "pitches")
sql_table("ewm", f"""SELECT pitcher_id, {', '.join(ewm_sql(m, n) for m in METRICS for n in SPANS)} FROM window_pitches GROUP BY 1""",
          "window_pitches")
EWM = " ".join(f"roll{n}d_{m}_{k}:r" for m in METRICS for n in SPANS for k in ("ewm_mean", "ewm_std"))
DELTA = " ".join(f"roll{n}d_{m}_delta_vs_30d:r" for m in METRICS for n in SPANS)


@query("ewm", f"pitcher_id:n {EWM}", "SELECT * FROM ewm", "ewm")
def _(t):
    return op.ewm_features(t.pitches, op.last_pitch_day(t.pitches, AS_OF), min_pitches=MIN_PITCHES)


@query("delta_vs_30d", f"pitcher_id:n {DELTA}", "SELECT * FROM ewm", "ewm")
def _(t):
    return op.ewm_features(t.pitches, op.last_pitch_day(t.pitches, AS_OF), min_pitches=MIN_PITCHES)


sql_table("mix", f"""
SELECT pitcher_id, {', '.join(f'''{', '.join(f"coalesce(avg(CASE WHEN pitch_type IN {listed(codes)} THEN 1.0::DOUBLE ELSE 0 END) FILTER (ago <= {n}), 0) AS roll{n}d_{name}_pct"
    for name, codes in (('breaking_ball', op.BREAKING_CODES), ('fastball', op.FASTBALL_CODES), ('off_speed', op.OFFSPEED_CODES)))},
  count(*) FILTER (ago <= {n}) AS n_{n}''' for n in SPANS)} FROM window_pitches GROUP BY 1""", "window_pitches")
MIX = " ".join(f"roll{n}d_{c}_pct:r" for n in SPANS for c in ("breaking_ball", "fastball", "off_speed"))


@query("breaking_ball_mix", f"pitcher_id:n {MIX} roll7d_breaking_ball_delta_vs_30d:r roll14d_breaking_ball_delta_vs_30d:r", """
SELECT *, roll7d_breaking_ball_pct - roll30d_breaking_ball_pct AS roll7d_breaking_ball_delta_vs_30d,
  roll14d_breaking_ball_pct - roll30d_breaking_ball_pct AS roll14d_breaking_ball_delta_vs_30d FROM mix""", "mix")
def _(t):
    return op.pitch_mix(t.pitches, op.last_pitch_day(t.pitches, AS_OF))


sql_table("engineered", f"""
SELECT f.*, m.* EXCLUDE (pitcher_id), e.* EXCLUDE (pitcher_id), DATE '{AS_OF}' - game_date AS days_since_last_appearance,
  DATE '{AS_OF}' - first_game AS days_of_data, DATE '{AS_OF}' AS as_of_date,
  (2 * CAST(n_7 >= {MIN_PITCHES} AS INTEGER) + 2 * CAST(n_14 >= {MIN_PITCHES} AS INTEGER) + 2 * CAST(n_30 >= {MIN_PITCHES} AS INTEGER)
    + CAST(total_appearances > 0 AS INTEGER) + CAST(total_appearances >= 3 AS INTEGER)) / 8.0::DOUBLE AS data_completeness_score,
  roll7d_release_speed_delta_vs_30d AS vel_decline_7d_vs_30d, roll14d_release_speed_delta_vs_30d AS vel_decline_14d_vs_30d
FROM latest_features f LEFT JOIN mix m USING (pitcher_id) LEFT JOIN ewm e USING (pitcher_id)""", "latest_features", "mix", "ewm")
LEVEL = "CASE WHEN data_completeness_score >= 0.8::DOUBLE THEN 'high' WHEN data_completeness_score >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END"


def engineered(t):
    return op.engineered_features(t.appearances, t.pitches, AS_OF, min_pitches=MIN_PITCHES)


@query("data_completeness", "pitcher_id:n data_completeness_score:r data_completeness:s has_velo_data_7d:b has_spin_data_14d:b "
       "has_velo_data_30d:b has_recent_appearances:b has_multiple_appearances:b", f"""
SELECT pitcher_id, data_completeness_score, {LEVEL} AS data_completeness, n_7 >= {MIN_PITCHES} AS has_velo_data_7d, n_14 >= {MIN_PITCHES} AS has_spin_data_14d,
  n_30 >= {MIN_PITCHES} AS has_velo_data_30d, total_appearances > 0 AS has_recent_appearances, total_appearances >= 3 AS has_multiple_appearances
FROM engineered""", "engineered")
def _(t):
    return engineered(t)


@query("engineered_features", f"pitcher_id:n as_of_date:d total_appearances:n days_since_last_appearance:n days_of_data:n recent_role:s "
       f"{WORKLOAD} {EWM} {DELTA} {MIX} avg_rest_days:r std_rest_days:r min_rest_days:r max_rest_days:r fatigue_score:r "
       "multi_inning_rate_7d:r back_to_back_days_14d:n vel_decline_7d_vs_30d:r vel_decline_14d_vs_30d:r data_completeness_score:r",
       "SELECT * FROM engineered", "engineered")
def _(t):
    return engineered(t)


@query("training_features_on_grid", "pitcher_id:n as_of_date:d last_game:d days_since_last_appearance:n roll7d_pitch_count:n "
       "roll14d_release_speed_ewm_mean:r roll30d_release_spin_rate_ewm_std:r roll30d_breaking_ball_pct:r data_completeness:s")
def _(t):
    grid = op.snapshot_grid(t.appearances, step=14)
    return op.training_features(t.appearances, t.pitches, grid, min_pitches=MIN_PITCHES)


@query("workload_timeseries", "pitcher_id:n game_date:d pitches_thrown:n avg_vel:r rest_days:n innings_pitched:r", f"""
SELECT pitcher_id, game_date, pitches_thrown, avg_vel, innings_pitched,
  coalesce(game_date - lag(game_date) OVER (PARTITION BY pitcher_id ORDER BY game_date) - 1, 0) AS rest_days
FROM appearances WHERE game_date BETWEEN DATE '{FROM}' AND DATE '{TO}'""", "appearances")
def _(t):
    return op.workload_timeseries(t.appearances, FROM, TO)


sql_table("series_summary", f"""
SELECT pitcher_id, count(*) AS games, sum(pitches_thrown) AS total_pitches, avg(pitches_thrown) AS avg_pitches_per_game,
  avg(avg_vel) AS avg_velocity, coalesce(avg(rest_days) FILTER (i > 0), 0) AS avg_rest_days,
  {trend_sql('regr_slope(pitches_thrown, CAST(i AS DOUBLE))', 'stddev_pop(pitches_thrown)', 'count(*)')} AS pitch_count_trend,
  {trend_sql('regr_slope(avg_vel, CAST(i AS DOUBLE))', 'stddev_pop(avg_vel)', 'count(*)')} AS velocity_trend,
  string_agg(strftime(game_date, '%Y-%m-%d') || '=' || pitches_thrown, ',' ORDER BY game_date) AS points
FROM (SELECT *, row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date) - 1 AS i,
    coalesce(game_date - lag(game_date) OVER (PARTITION BY pitcher_id ORDER BY game_date) - 1, 0) AS rest_days
  FROM appearances WHERE game_date BETWEEN DATE '{FROM}' AND DATE '{TO}') GROUP BY 1""", "appearances")


@query("workload_series_summary", "pitcher_id:n games:n total_pitches:n avg_pitches_per_game:r avg_velocity:r avg_rest_days:r "
       "pitch_count_trend:s velocity_trend:s points:s", "SELECT * FROM series_summary", "series_summary")
def _(t):
    out = op.workload_series_summary(op.workload_timeseries(t.appearances, FROM, TO))
    points = F.transform("data_points", lambda p: F.concat_ws("=", p["game_date"].cast("string"), p["pitches_thrown"].cast("string")))
    return out.withColumn("points", F.concat_ws(",", points))


SPEC_NEED = {7: 2, 14: 3, 30: 5}
SPEC_COLS = ("pitch_count_7d:n pitch_count_14d:n pitch_count_30d:n avg_pitches_per_appearance:r rest_days:n avg_rest_days:r "
             "short_rest_appearances:n workload_intensity_7d:r workload_intensity_14d:r high_workload_days:n avg_velocity_7d:r "
             "avg_velocity_14d:r velocity_decline_7d:r velocity_decline_14d:r velocity_std_7d:r velocity_std_14d:r velocity_trend:r "
             "avg_spin_rate_7d:r avg_spin_rate_14d:r spin_rate_decline_7d:r spin_rate_std_7d:r spin_rate_trend:r spin_velocity_ratio:r "
             "fastball_pct:r breaking_pct:r off_speed_pct:r pitch_mix_change_7d:r pitch_mix_change_14d:r pitch_mix_volatility:r "
             "vel_7d_missing:b vel_14d_missing:b vel_trend_missing:b")


def share(codes, n: int) -> str:
    return f"avg(CASE WHEN pitch_type IN {listed(codes)} THEN 1.0::DOUBLE ELSE 0 END) FILTER (d <= {n})"


def mix_change_sql(n: int) -> str:
    return f"CASE WHEN fast_30 = 0 THEN 0 ELSE (fast_{n} - fast_30) / fast_30 * 100 END AS pitch_mix_change_{n}d"


@query("spec_v2_features", f"pitcher_id:n game_date:d {SPEC_COLS}", f"""
SELECT l.*, p.*, {mix_change_sql(7)}, {mix_change_sql(14)}, avg_velocity_7d - avg_velocity_14d AS velocity_decline_7d,
  avg_velocity_14d - vel_30 AS velocity_decline_14d, avg_spin_rate_7d - avg_spin_rate_14d AS spin_rate_decline_7d,
  avg_spin_rate_14d / avg_velocity_14d AS spin_velocity_ratio
FROM (SELECT pitcher_id, game_date, coalesce(gap, 0) AS rest_days,
    {', '.join(f"sum(pitches_thrown) OVER {closed(n)} AS pitch_count_{n}d" for n in SPANS)},
    avg(pitches_thrown) OVER {closed(30)} AS avg_pitches_per_appearance, avg(gap) OVER {closed(30)} AS avg_rest_days,
    count(*) FILTER (gap < 3) OVER {closed(30)} AS short_rest_appearances,
    count(*) FILTER (pitches_thrown > 100) OVER {closed(30)} AS high_workload_days,
    {', '.join(f"avg(pitches_thrown) OVER {closed(n)} * 0.7::DOUBLE + count(*) OVER {closed(n)} / {n}.0::DOUBLE * 30 * 0.3::DOUBLE AS workload_intensity_{n}d" for n in (7, 14))},
    CASE WHEN count(*) OVER {closed(30)} < 2 THEN 0 ELSE regr_slope(avg_vel, no) OVER {closed(30)} END AS velocity_trend,
    CASE WHEN count(*) OVER {closed(30)} < 2 THEN 0 ELSE regr_slope(avg_spin, no) OVER {closed(30)} END AS spin_rate_trend,
    stddev_samp(fast) OVER {closed(30)} AS pitch_mix_volatility
  FROM (SELECT *, CAST(row_number() OVER ({W}) AS DOUBLE) AS no FROM line) x JOIN (SELECT pitcher_id AS fid, game_date AS fday,
    avg(CASE WHEN pitch_type IN {listed(op.FASTBALL_CODES)} THEN 1.0::DOUBLE ELSE 0 END) AS fast FROM pitches GROUP BY 1, 2) f
    ON x.pitcher_id = fid AND x.game_date = fday) l
JOIN (SELECT pitcher_id AS pid, day, {', '.join(f"avg(release_speed) FILTER (d <= {n}) AS avg_velocity_{n}d, stddev_samp(release_speed) FILTER (d <= {n}) AS velocity_std_{n}d, avg(release_spin_rate) FILTER (d <= {n}) AS avg_spin_rate_{n}d" for n in (7, 14))},
    avg(release_speed) AS vel_30, stddev_samp(release_spin_rate) FILTER (d <= 7) AS spin_rate_std_7d,
    {', '.join(f"{share(op.FASTBALL_CODES, n)} AS fast_{n}" for n in SPANS)}, 100 * {share(op.FASTBALL_CODES, 30)} AS fastball_pct,
    100 * {share(op.BREAKING_CODES, 30)} AS breaking_pct, 100 * {share(op.OFFSPEED_CODES, 30)} AS off_speed_pct,
    count(*) FILTER (d <= 7) < {SPEC_NEED[7]} AS vel_7d_missing, count(*) FILTER (d <= 14) < {SPEC_NEED[14]} AS vel_14d_missing,
    count(*) < {SPEC_NEED[30]} AS vel_trend_missing
  FROM (SELECT g.pitcher_id, g.game_date AS day, q.release_speed, q.release_spin_rate, q.pitch_type, g.game_date - q.game_date AS d
    FROM line g JOIN pitches q ON q.pitcher_id = g.pitcher_id AND q.game_date BETWEEN g.game_date - 30 AND g.game_date) GROUP BY 1, 2) p
  ON l.pitcher_id = p.pid AND l.game_date = p.day""", "line pitches")
def _(t):
    return op.spec_features(t.pitches, t.appearances, SPEC_NEED)


@query("high_workload_streak", "pitcher_id:n game_date:d streak:n", f"""
SELECT pitcher_id, game_date, count(*) FILTER (pitches_thrown > 45) OVER (PARTITION BY pitcher_id, br ORDER BY dn ROWS UNBOUNDED PRECEDING) AS streak
FROM (SELECT *, sum(CASE WHEN pitches_thrown > 45 THEN 0 ELSE 1 END) OVER {SOFAR} AS br FROM line)""", "line")
def _(t):
    return op.high_workload_streak(t.appearances, 45)


@query("history_features", "pitcher_id:n game_date:d prior_il_2y:n innings_ytd:r innings_last_ytd:r innings_ytd_change:r load_7d_lag7:n load_7d_lag14:n", """
SELECT *, innings_ytd - innings_last_ytd AS innings_ytd_change FROM (
  SELECT a.pitcher_id, a.game_date,
    (SELECT count(*) FROM injuries i WHERE i.pitcher_id = a.pitcher_id AND i.il_start BETWEEN a.game_date - 730 AND a.game_date) AS prior_il_2y,
    coalesce((SELECT sum(innings_pitched) FROM appearances b WHERE b.pitcher_id = a.pitcher_id AND year(b.game_date) = year(a.game_date) AND b.game_date <= a.game_date), 0) AS innings_ytd,
    coalesce((SELECT sum(innings_pitched) FROM appearances b WHERE b.pitcher_id = a.pitcher_id AND year(b.game_date) = year(a.game_date) - 1
      AND strftime(b.game_date, '%m%d') <= strftime(a.game_date, '%m%d')), 0) AS innings_last_ytd,
    coalesce((SELECT sum(pitches_thrown) FROM appearances b WHERE b.pitcher_id = a.pitcher_id AND b.game_date BETWEEN a.game_date - 14 AND a.game_date - 7), 0) AS load_7d_lag7,
    coalesce((SELECT sum(pitches_thrown) FROM appearances b WHERE b.pitcher_id = a.pitcher_id AND b.game_date BETWEEN a.game_date - 21 AND a.game_date - 14), 0) AS load_7d_lag14
  FROM appearances a)""", "appearances injuries")
def _(t):
    return op.history_features(t.appearances, t.injuries)


@query("volatility_5g", "pitcher_id:n game_date:d vel_volatility:r spin_volatility:r", f"""
SELECT pitcher_id, game_date, stddev_samp(avg_vel) OVER {games(5)} AS vel_volatility, stddev_samp(avg_spin) OVER {games(5)} AS spin_volatility FROM line""", "line")
def _(t):
    return op.volatility(t.appearances)


sql_table("grid", """
SELECT g.pitcher_id, g.as_of_date, max(a.game_date) AS last_game, count(*) AS past_appearances,
  coalesce(sum(pitches_thrown) FILTER (a.game_date >= g.as_of_date - 30), 0) AS pitches_30d
FROM (SELECT pitcher_id, CAST(unnest(generate_series(CAST(f + 14 AS TIMESTAMP), CAST(l AS TIMESTAMP), INTERVAL 14 DAY)) AS DATE) AS as_of_date
  FROM (SELECT pitcher_id, min(game_date) AS f, max(game_date) AS l FROM appearances GROUP BY 1 HAVING count(*) >= 10)) g
JOIN appearances a ON a.pitcher_id = g.pitcher_id AND a.game_date <= g.as_of_date GROUP BY 1, 2 HAVING count(*) >= 5""", "appearances")


@query("snapshot_grid", "pitcher_id:n as_of_date:d past_appearances:n", "SELECT * FROM grid", "grid")
def _(t):
    return op.snapshot_grid(t.appearances, step=14)


@query("grid_with_history", "pitcher_id:n as_of_date:d last_game:d past_appearances:n pitches_30d:n", "SELECT * FROM grid", "grid")
def _(t):
    return op.snapshot_grid(t.appearances, step=14)


@query("quarter_blocks", "block:s games:n pitchers:n", """
SELECT year(game_date) || 'Q' || quarter(game_date) AS block, count(*) AS games, count(DISTINCT pitcher_id) AS pitchers
FROM appearances WHERE game_date <= DATE '2001-06-30' GROUP BY 1""", "appearances")
def _(t):
    inside = op.history_upto(t.appearances, AS_OF).withColumn("block", op.quarter_block())
    return inside.groupBy("block").agg(F.count("*").alias("games"), F.countDistinct("pitcher_id").alias("pitchers"))


@query("workload_with_risk", "pitcher_id:n game_date:d pitches_thrown:n rest_days:n score:r", f"""
SELECT s.*, r.score FROM (SELECT pitcher_id, game_date, pitches_thrown,
  coalesce(game_date - lag(game_date) OVER (PARTITION BY pitcher_id ORDER BY game_date) - 1, 0) AS rest_days
  FROM appearances WHERE game_date BETWEEN DATE '{FROM}' AND DATE '{TO}') s
LEFT JOIN scores r ON r.pitcher_id = s.pitcher_id AND r.as_of_date = s.game_date""", "appearances scores")
def _(t):
    series = op.workload_timeseries(t.appearances, FROM, TO)
    scores = scoring.heuristic_score(op.snapshot_rolling(t.appearances))
    return series.join(
        scores.select("pitcher_id", F.col("as_of_date").alias("game_date"), "score"), ["pitcher_id", "game_date"], "left"
    )


@query("days_of_data", "pitcher_id:n days_of_data:n", f"""
SELECT pitcher_id, DATE '{AS_OF}' - min(game_date) AS days_of_data FROM appearances WHERE game_date <= DATE '{AS_OF}' GROUP BY 1""", "appearances")
def _(t):
    return op.days_of_data(t.appearances, AS_OF)


sql_table("scores", """
SELECT *, round(least(0.9::DOUBLE, greatest(0.1::DOUBLE, 0.3::DOUBLE + CASE WHEN roll21d_pitch_count > 250 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN roll21d_vel_decline > 1 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN fatigue_score > 0.7::DOUBLE THEN 0.2::DOUBLE ELSE 0 END)), 6) AS score
FROM snapshots""", "snapshots")
