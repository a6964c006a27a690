"""Queries for season, team, role and feature roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from moundwork.operators import aggregates as op
from moundwork.operators import labels, lookups, rolling, scoring
from moundwork.plans.label_queries import labelled, scores_of
from moundwork.plans.registry import query, sql_table
from moundwork.plans.rolling_queries import AS_OF, trend_sql

SEASON = 2001
FEATURES = ("roll21d_pitch_count", "roll7d_pitch_count", "roll21d_vel_decline", "workload_intensity", "fatigue_score", "vel_trend_slope")
SERVICE = "CASE WHEN score < 0.3::DOUBLE THEN 'low' WHEN score < 0.6::DOUBLE THEN 'medium' WHEN score IS NOT NULL THEN 'high' END"
sql_table("latest_levels", f"SELECT *, {SERVICE} AS risk_bucket FROM newest_scores", "newest_scores")
sql_table("long_features", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, y FROM labelled_snapshots" for f in FEATURES), "labelled_snapshots")


def levels(t):
    newest = lookups.latest_snapshot(t.pitchers, scores_of(t, AS_OF), AS_OF)
    return newest.withColumn("risk_bucket", scoring.risk_bucket(F.col("score"), "service"))


for _name in ("pitches", "appearances"):
    @query(f"season_counts_{_name}", "season:n rows:n pitchers:n", f"""
SELECT year(game_date) AS season, count(*) AS rows, count(DISTINCT pitcher_id) AS pitchers FROM {_name} GROUP BY 1""", _name)
    def _(t, table=_name):
        return op.season_counts(getattr(t, table))


@query("season_summary", "season:n pitch_count:n unique_pitchers:n avg_velocity:r avg_spin:r", """
SELECT year(game_date) AS season, count(*) AS pitch_count, count(DISTINCT pitcher_id) AS unique_pitchers,
  avg(release_speed) AS avg_velocity, avg(release_spin_rate) AS avg_spin FROM pitches GROUP BY 1""", "pitches")
def _(t):
    return op.season_summary(t.pitches)


@query("distribution_stats", "metric:s min:r max:r avg:r std:r count:n", " UNION ALL ".join(f"""
SELECT '{c}' AS metric, min({c}) AS min, max({c}) AS max, avg({c}) AS avg, stddev_pop({c}) AS std, count({c}) AS count FROM pitches"""
    for c in ("release_speed", "release_spin_rate")), "pitches")
def _(t):
    return op.distribution_stats(t.pitches, ["release_speed", "release_spin_rate"])


@query("pitcher_season_stats", "pitcher_id:n season:n appearances:n total_pitches:n avg_velocity:r total_innings:r", """
SELECT pitcher_id, year(game_date) AS season, count(*) AS appearances, sum(pitches_thrown) AS total_pitches,
  avg(avg_vel) AS avg_velocity, sum(innings_pitched) AS total_innings FROM appearances GROUP BY 1, 2""", "appearances")
def _(t):
    return op.pitcher_season_stats(t.appearances)


@query("pitcher_list_enriched", "pitcher_id:n name:s team:s role:s last_appearance:d season_appearances:n latest_velocity:r score:r velocity_trend:s", f"""
SELECT p.*, last_appearance, coalesce(season_appearances, 0) AS season_appearances, latest_velocity, score, coalesce(velocity_trend, 'stable') AS velocity_trend
FROM pitchers p
LEFT JOIN (SELECT pitcher_id, max(game_date) AS last_appearance, count(*) FILTER (year(game_date) = {SEASON}) AS season_appearances,
  arg_max(avg_vel, game_date) AS latest_velocity FROM appearances GROUP BY 1) a ON p.pitcher_id = a.pitcher_id
LEFT JOIN (SELECT pitcher_id, arg_max(score, as_of_date) AS score FROM scores GROUP BY 1) s ON p.pitcher_id = s.pitcher_id
LEFT JOIN (SELECT pitcher_id, {trend_sql('coalesce(regr_slope(avg_vel, CAST(i AS DOUBLE)), 0)', 'stddev_pop(avg_vel)', 'count(*)')} AS velocity_trend
  FROM (SELECT *, row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date) - 1 AS i FROM appearances WHERE year(game_date) = {SEASON}) GROUP BY 1) v
  ON p.pitcher_id = v.pitcher_id""", "pitchers appearances scores")
def _(t):
    return op.pitcher_list_enriched(t.pitchers, t.appearances, scores_of(t), SEASON)


@query("pitcher_detail", "pitcher_id:n name:s appearances:n total_pitches:n avg_velocity:r total_innings:r games:s stints:s", """
SELECT p.pitcher_id, name, appearances, total_pitches, avg_velocity, total_innings, games, coalesce(stints, '') AS stints FROM pitchers p
LEFT JOIN (SELECT pitcher_id, count(*) AS appearances, sum(pitches_thrown) AS total_pitches, avg(avg_vel) AS avg_velocity,
  sum(innings_pitched) AS total_innings FROM appearances GROUP BY 1) a ON p.pitcher_id = a.pitcher_id
LEFT JOIN (SELECT pitcher_id, string_agg(game_date || '=' || pitches_thrown, ',' ORDER BY game_date DESC) AS games FROM (SELECT * FROM appearances
  QUALIFY row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date DESC) <= 20) GROUP BY 1) g ON p.pitcher_id = g.pitcher_id
LEFT JOIN (SELECT pitcher_id, string_agg(il_start || '=' || stint_type, ',' ORDER BY il_start DESC) AS stints FROM injuries GROUP BY 1) i ON p.pitcher_id = i.pitcher_id""",
       "pitchers appearances injuries")
def _(t):
    def joined(array, *fields):
        return F.concat_ws(",", F.transform(array, lambda g: F.concat_ws("=", *[g[f].cast("string") for f in fields])))

    return op.pitcher_detail(t.pitchers, t.appearances, t.injuries).withColumns({
        "games": joined("recent_games", "game_date", "pitches_thrown"), "stints": joined("injury_history", "il_start", "stint_type"),
    })


def summary_sql(days: int) -> str:
    return f"""
SELECT pitcher_id, count(*) AS appearances, sum(pitches_thrown) AS total_pitches, avg(pitches_thrown) AS avg_pitches_per_game,
  max(pitches_thrown) AS max_pitches_in_game, avg(avg_vel) AS avg_velocity, sum(innings_pitched) AS total_innings,
  sum(pitches_thrown) / {days}.0::DOUBLE AS pitches_per_day, {days}.0::DOUBLE / greatest(1, count(*)) - 1 AS rest_days_avg
FROM appearances WHERE game_date BETWEEN DATE '{AS_OF}' - {days} AND DATE '{AS_OF}' GROUP BY 1"""


sql_table("summary21", summary_sql(21), "appearances")
sql_table("summary7", summary_sql(7), "appearances")


@query("workload_summary", "pitcher_id:n appearances:n total_pitches:n avg_pitches_per_game:r max_pitches_in_game:n avg_velocity:r "
       "total_innings:r pitches_per_day:r rest_days_avg:r", "SELECT * FROM summary21", "summary21")
def _(t):
    return op.workload_summary(t.appearances, AS_OF)


@query("team_workload_pitchers", "team:s pitcher_id:n name:s role:s appearances:n pitches:n avg_velocity:r team_rank:n", """
SELECT team, p.pitcher_id, name, role, appearances, total_pitches AS pitches, avg_velocity,
  rank() OVER (PARTITION BY team ORDER BY total_pitches DESC) AS team_rank FROM pitchers p JOIN summary7 s ON p.pitcher_id = s.pitcher_id""", "pitchers summary7")
def _(t):
    return op.team_workload_pitchers(t.pitchers, t.appearances, AS_OF)


@query("team_workload_summary", "team:s total_appearances:n total_pitches:n avg_pitches_per_game:r active_pitchers:n total_pitchers:n", """
SELECT team, coalesce(sum(appearances), 0) AS total_appearances, coalesce(sum(total_pitches), 0) AS total_pitches,
  coalesce(sum(total_pitches) / CAST(sum(appearances) AS DOUBLE), 0) AS avg_pitches_per_game, count(appearances) AS active_pitchers, count(*) AS total_pitchers
FROM pitchers p LEFT JOIN summary7 s ON p.pitcher_id = s.pitcher_id GROUP BY 1""", "pitchers summary7")
def _(t):
    return op.team_workload_summary(t.pitchers, t.appearances, AS_OF)


@query("team_overview", "team:s roster_size:n total_pitches:n avg_pitches_per_game:r total_appearances:n recent_appearances:n high_risk:n medium_risk:n low_risk:n", f"""
SELECT p.team, count(*) AS roster_size, coalesce(sum(tp), 0) AS total_pitches, coalesce(sum(tp) / CAST(sum(g) AS DOUBLE), 0) AS avg_pitches_per_game,
  coalesce(sum(g), 0) AS total_appearances, coalesce(sum(r), 0) AS recent_appearances, count(*) FILTER (risk_bucket = 'high') AS high_risk,
  count(*) FILTER (risk_bucket = 'medium') AS medium_risk, count(*) FILTER (risk_bucket = 'low') AS low_risk
FROM pitchers p LEFT JOIN (SELECT pitcher_id, sum(pitches_thrown) AS tp, count(*) AS g, count(*) FILTER (game_date >= DATE '{AS_OF}' - 7) AS r
  FROM appearances WHERE game_date <= DATE '{AS_OF}' GROUP BY 1) a ON p.pitcher_id = a.pitcher_id
LEFT JOIN latest_levels l ON p.pitcher_id = l.pitcher_id GROUP BY 1""", "pitchers appearances latest_levels")
def _(t):
    return op.team_overview(t.pitchers, t.appearances, levels(t), AS_OF)


@query("team_risk_members", "team:s bucket:s pitcher_id:n score:r bucket_rank:n", """
SELECT team, coalesce(risk_bucket, 'no_data') AS bucket, pitcher_id, score,
  rank() OVER (PARTITION BY team, coalesce(risk_bucket, 'no_data') ORDER BY coalesce(score, -1) DESC) AS bucket_rank FROM latest_levels""", "latest_levels")
def _(t):
    return op.team_risk_members(levels(t))


@query("team_risk_summary", "team:s high:n medium:n low:n no_data:n mean_score:r top_score:r", f"""
SELECT team, {', '.join(f"count(*) FILTER (coalesce(risk_bucket, 'no_data') = '{b}') AS {b}" for b in ('high', 'medium', 'low', 'no_data'))},
  avg(score) AS mean_score, max(score) AS top_score FROM latest_levels GROUP BY 1""", "latest_levels")
def _(t):
    return op.team_risk_summary(levels(t))


@query("risk_level_counts", "risk_bucket:s pitchers:n", "SELECT risk_bucket, count(*) AS pitchers FROM latest_levels GROUP BY 1", "latest_levels")
def _(t):
    return op.level_counts(levels(t))


sql_table("cohort", """
SELECT b.pitcher_id, b.game_date, year(b.game_date) AS season, role, injury_within_21d AS y FROM blackout b JOIN pitchers p ON b.pitcher_id = p.pitcher_id
WHERE injury_within_21d IS NOT NULL""", "blackout", "pitchers")


def cohort(t):
    games = lookups.appearance_with_profile(t.appearances, t.pitchers, 1900, 2100)
    return labels.label_with_blackout(games, t.injuries).withColumnRenamed("injury_within_21d", "y")


@query("risk_summary_rollup", "season:s role:s samples:n positives:n positive_rate:r", """
SELECT CASE WHEN grouping(season) = 1 THEN 'all' ELSE CAST(season AS VARCHAR) END AS season, CASE WHEN grouping(role) = 1 THEN 'all' ELSE role END AS role,
  count(*) AS samples, sum(y) AS positives, avg(y) AS positive_rate FROM cohort GROUP BY CUBE (season, role)""", "cohort")
def _(t):
    return op.positive_rates(cohort(t), "y")


@query("season_label_report", "season:s samples:n positives:n positive_rate:r", """
SELECT coalesce(CAST(season AS VARCHAR), 'all') AS season, count(*) AS samples, sum(y) AS positives, avg(y) AS positive_rate FROM cohort GROUP BY ROLLUP (season)""", "cohort")
def _(t):
    return op.season_label_report(cohort(t), "y")


sql_table("role_marks", f"""
SELECT role, avg(total_pitches) AS role_average_pitches, avg(appearances) AS role_average_appearances,
  {', '.join(f"quantile_cont(total_pitches, {p / 100}) AS p{p}" for p in (25, 50, 75, 90))}
FROM pitchers p JOIN summary21 s ON p.pitcher_id = s.pitcher_id GROUP BY 1""", "pitchers", "summary21")
MARKS = "role_average_pitches:r role_average_appearances:r p25:r p50:r p75:r p90:r"


@query("role_workload_percentiles", f"role:s {MARKS}", "SELECT * FROM role_marks", "role_marks")
def _(t):
    return op.role_workload_percentiles(t.pitchers, t.appearances, AS_OF)


@query("compare_to_role", "pitcher_id:n role:s total_pitches:n appearances:n role_average_pitches:r percentile:n comparison:s", """
SELECT *, CASE WHEN percentile >= 90 THEN 'very high' WHEN percentile >= 75 THEN 'high' WHEN percentile >= 25 THEN 'average' ELSE 'low' END AS comparison
FROM (SELECT p.pitcher_id, p.role, total_pitches, appearances, role_average_pitches, CASE WHEN total_pitches >= p90 THEN 90 WHEN total_pitches >= p75 THEN 75
  WHEN total_pitches >= p50 THEN 50 WHEN total_pitches >= p25 THEN 25 ELSE 10 END AS percentile
  FROM pitchers p JOIN summary21 s ON p.pitcher_id = s.pitcher_id JOIN role_marks r ON p.role = r.role)""", "pitchers summary21 role_marks")
def _(t):
    return op.compare_to_role(t.pitchers, t.appearances, AS_OF)


CATEGORIES = ("injury_type", "injury_location", "severity", "stint_type")


@query("category_counts", "category:s value:s records:n share_pct:r", """
SELECT *, records * 100.0::DOUBLE / sum(records) OVER (PARTITION BY category) AS share_pct FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, {c} AS value, count(*) AS records FROM injuries GROUP BY 2" for c in CATEGORIES) + ")", "injuries")
def _(t):
    return op.category_counts(t.injuries, CATEGORIES)


@query("confidence_distribution", "confidence_level:s records:n", """
SELECT CASE WHEN confidence_score >= 0.8::DOUBLE THEN 'high' WHEN confidence_score >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS confidence_level,
  count(*) AS records FROM injuries GROUP BY 1""", "injuries")
def _(t):
    return op.confidence_distribution(t.injuries)


@query("confidence_bins", "confidence_level:s records:n", """
SELECT * FROM (SELECT CASE WHEN c >= 0 AND c < 0.3::DOUBLE THEN 'Low' WHEN c >= 0.3::DOUBLE AND c < 0.6::DOUBLE THEN 'Medium' WHEN c >= 0.6::DOUBLE AND c < 0.8::DOUBLE THEN 'High'
  WHEN c >= 0.8::DOUBLE AND c < 1 THEN 'Very High' END AS confidence_level, count(*) AS records FROM (SELECT confidence_score AS c FROM injuries) GROUP BY 1)
WHERE confidence_level IS NOT NULL""", "injuries")
def _(t):
    return op.confidence_distribution(t.injuries, "four")


@query("injury_date_range", "first_date:d last_date:d", "SELECT min(il_start) AS first_date, max(il_start) AS last_date FROM injuries", "injuries")
def _(t):
    return op.date_range(t.injuries, "il_start")


@query("feature_means_by_class", "feature:s pos_mean:r neg_mean:r difference:r signal_strength:r", """
SELECT *, p - n AS difference, p AS pos_mean, n AS neg_mean, abs(p - n) / (abs(p) + abs(n) + 1e-8) AS signal_strength
FROM (SELECT feature, avg(value) FILTER (y = 1) AS p, avg(value) FILTER (y = 0) AS n FROM long_features GROUP BY 1)""", "long_features")
def _(t):
    return op.feature_means_by_class(labelled(t), "y", FEATURES)


@query("feature_variance", "feature:s variance:r level:s", """
SELECT *, CASE WHEN variance = 0 THEN 'zero' WHEN variance < 0.01::DOUBLE THEN 'low' ELSE 'ok' END AS level
FROM (SELECT feature, var_samp(value) AS variance FROM long_features GROUP BY 1)""", "long_features")
def _(t):
    return op.feature_variance(labelled(t), FEATURES)


FEED = ("pitcher", "batter", "pitch_type", "release_speed", "release_spin_rate", "at_bat_number", "pitch_number")


@query("feature_completeness", "feature:s null_pct:r family:s family_completeness:r", """
SELECT *, avg(1 - null_pct / 100) OVER (PARTITION BY family) AS family_completeness FROM (
  SELECT feature, null_pct, CASE WHEN contains(feature, 'pitch_count') THEN 'workload' WHEN contains(feature, 'vel') THEN 'velocity'
    WHEN contains(feature, 'fatigue') THEN 'fatigue' ELSE 'other' END AS family FROM (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, 100 * avg(CASE WHEN {f} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS null_pct FROM statcast_raw" for f in FEED) + "))", "statcast_raw")
def _(t):
    return op.feature_completeness(t.statcast_raw, FEED)


@query("iqr_outliers", "feature:s outliers:n rows:n outlier_pct:r", """
SELECT *, outliers * 100.0::DOUBLE / rows AS outlier_pct FROM (
  SELECT l.feature, count(*) FILTER (value < q1 - (q3 - q1) * 1.5::DOUBLE OR value > q3 + (q3 - q1) * 1.5::DOUBLE) AS outliers, count(*) AS rows
  FROM long_features l JOIN (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long_features GROUP BY 1) q
    ON l.feature = q.feature GROUP BY 1)""", "long_features")
def _(t):
    return op.iqr_outliers(labelled(t), FEATURES)


@query("feature_coverage", "season:n feature:s coverage_pct:r flag:s", """
SELECT *, CASE WHEN coverage_pct < 70 THEN 'fail' WHEN coverage_pct < 80 THEN 'warn' ELSE 'ok' END AS flag FROM (""" + " UNION ALL ".join(
    f"SELECT CAST(left(game_date, 4) AS BIGINT) AS season, '{f}' AS feature, 100 * avg(CASE WHEN {f} IS NULL THEN 0 ELSE 1.0::DOUBLE END) AS coverage_pct FROM statcast_raw GROUP BY 1"
    for f in FEED) + ")", "statcast_raw")
def _(t):
    return op.feature_coverage(t.statcast_raw.withColumn("season", F.year(F.to_date("game_date"))), FEED)


@query("team_risk_trend", "team:s days:n mean_score:r latest_mean:r trend:s", f"""
SELECT team, count(*) AS days, avg(m) AS mean_score, arg_max(m, as_of_date) AS latest_mean,
  {trend_sql('coalesce(regr_slope(m, CAST(i AS DOUBLE)), 0)', 'stddev_pop(m)', 'count(*)')} AS trend
FROM (SELECT team, as_of_date, avg(score) AS m, row_number() OVER (PARTITION BY team ORDER BY as_of_date) - 1 AS i
  FROM scores s JOIN pitchers p ON s.pitcher_id = p.pitcher_id GROUP BY 1, 2) GROUP BY 1""", "scores pitchers")
def _(t):
    return op.team_risk_trend(scores_of(t), t.pitchers)
