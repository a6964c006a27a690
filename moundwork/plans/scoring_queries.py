"""Queries for scores, payload parts and listing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from moundwork.operators import aggregates, lookups, rolling, selection
from moundwork.operators import scoring as op
from moundwork.plans.aggregate_queries import FEATURES
from moundwork.plans.label_queries import CUT, scores_of, stored_labelled, stored_scores
from moundwork.plans.registry import OFF_TIE, query, sql_table
from moundwork.plans.rolling_queries import AS_OF, engineered
from moundwork.session import written_once

# Importances of a fitted model stand here as fixed inputs of the ranking rule.
IMPORTANCES = {
    "roll7d_pitch_count": 0.31, "avg_rest_days": 0.22, "vel_decline_7d_vs_30d": 0.19, "roll7d_breaking_ball_pct": 0.11,
    "back_to_back_days_7d": 0.05,
}
SNAP = "pitcher_id:n as_of_date:d"


def present_sql(*cases: str) -> str:
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


@query("list_pitchers", "pitcher_id:n name:s team:s role:s", "SELECT * FROM pitchers WHERE role = 'starter' ORDER BY pitcher_id LIMIT 20 OFFSET 10", "pitchers")
def _(t):
    return op.list_pitchers(t.pitchers, role="Starter", limit=20, offset=10)


@query("search_pitchers", "pitcher_id:n name:s team:s role:s", """
SELECT * FROM pitchers WHERE (contains(lower(name), '7') OR contains(lower(team), '7')) AND role = 'reliever'""", "pitchers")
def _(t):
    return op.search_pitchers(t.pitchers, "7", role="reliever")


@query("facet_values", "team:s", "SELECT DISTINCT team FROM pitchers", "pitchers")
def _(t):
    return op.facet_values(t.pitchers, "team")


@query("safe_divide_rates", "pitcher_id:n game_date:d pitches_per_inning:r strikeout_rate:r walk_rate:r hit_rate:r era:r", """
SELECT pitcher_id, game_date, pitches_thrown / i AS pitches_per_inning, strikeouts / p AS strikeout_rate, walks / p AS walk_rate, hits_allowed / i AS hit_rate, earned_runs * 9 / i AS era
FROM (SELECT *, CASE WHEN innings_pitched = 0 THEN 1 ELSE innings_pitched END AS i, CASE WHEN pitches_thrown = 0 THEN 1.0::DOUBLE ELSE pitches_thrown END AS p FROM box_scores)""", "box_scores")
def _(t):
    return op.rate_columns(t.box_scores)


@query("fill_defaults", "game_date:s pitcher:n release_speed:r release_spin_rate:r at_bat_number:n", """
SELECT game_date, coalesce(pitcher, 0) AS pitcher, coalesce(release_speed, 90) AS release_speed, coalesce(release_spin_rate, 0) AS release_spin_rate,
  coalesce(at_bat_number, 0) AS at_bat_number FROM statcast_raw""", "statcast_raw")
def _(t):
    return op.fill_defaults(t.statcast_raw, {"release_speed": 90.0})


@query("median_impute", "batter:n release_speed:r release_spin_rate:r", f"""
SELECT batter, coalesce(release_speed, m1) AS release_speed, coalesce(release_spin_rate, m2) AS release_spin_rate FROM statcast_raw,
  (SELECT quantile_cont(release_speed, 0.5) AS m1, quantile_cont(release_spin_rate, 0.5) AS m2 FROM statcast_raw WHERE game_date <= '{CUT}')""", "statcast_raw")
def _(t):
    train = t.statcast_raw.where(F.col("game_date") <= CUT)
    return op.median_impute(train, t.statcast_raw, ["release_speed", "release_spin_rate"])


@query("missing_flags", "game_date:s batter:n release_speed_missing:n release_spin_rate_missing:n pitch_type_missing:n", """
SELECT game_date, batter, CAST(release_speed IS NULL AS INTEGER) AS release_speed_missing, CAST(release_spin_rate IS NULL AS INTEGER) AS release_spin_rate_missing,
  CAST(pitch_type IS NULL AS INTEGER) AS pitch_type_missing FROM statcast_raw""", "statcast_raw")
def _(t):
    return op.missing_flags(t.statcast_raw, ["release_speed", "release_spin_rate", "pitch_type"])


def bucket_sql(score: str, low: float, medium: float) -> str:
    return f"CASE WHEN {score} < {low}::DOUBLE THEN 'low' WHEN {score} < {medium}::DOUBLE THEN 'medium' ELSE 'high' END"


@query("risk_bucket", f"{SNAP} score:r calibrated:s service:s served:s", f"""
SELECT *, {bucket_sql('score', 0.1, 0.3)} AS calibrated, {bucket_sql('score', 0.3, 0.6)} AS service, {bucket_sql('score', 0.2, 0.5)} AS served FROM scores""", "scores")
def _(t):
    return scores_of(t).withColumns({s: op.risk_bucket(F.col("score"), s) for s in ("calibrated", "service", "served")})


@query("confidence_level", "pitcher_id:n level:s value:r", """
SELECT pitcher_id, level, CASE level WHEN 'high' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.6 ELSE 0.3 END AS value FROM (SELECT pitcher_id,
  CASE WHEN data_completeness_score >= 0.8::DOUBLE THEN 'high' WHEN data_completeness_score >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS level FROM engineered)""", "engineered")
def _(t):
    levelled = engineered(t).withColumn("level", op.confidence_level(F.col("data_completeness_score")))
    return levelled.withColumn("value", op.confidence_value(F.col("level")))


PRESENT = " + ".join(f"CASE WHEN coalesce({c}, 0) != 0 THEN 1 ELSE 0 END" for c in op.SCORE_INPUTS)


@query("prediction_confidence", f"{SNAP} confidence:r", f"SELECT *, CASE WHEN {PRESENT} >= 5 THEN 0.8::DOUBLE ELSE 0.6 END AS confidence FROM scores", "scores")
def _(t):
    return scores_of(t).withColumn("confidence", op.prediction_confidence())


DIRECTION_FEATURES = ("roll7d_pitch_count", "avg_rest_days", "vel_decline_7d_vs_30d", "roll7d_breaking_ball_pct", "fatigue_score")
DIRECTION = """CASE WHEN contains(feature, 'vel_decline') OR contains(feature, 'pitch_count') OR contains(feature, 'breaking_ball') THEN CASE WHEN value > 0 THEN 'increases' ELSE 'decreases' END
  WHEN contains(feature, 'rest_days') THEN CASE WHEN value > 0 THEN 'decreases' ELSE 'increases' END ELSE 'neutral' END"""
sql_table("long_engineered", " UNION ALL ".join(f"SELECT pitcher_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM engineered" for f in DIRECTION_FEATURES), "engineered")


@query("feature_direction", "pitcher_id:n feature:s value:r direction:s", f"SELECT *, {DIRECTION} AS direction FROM long_engineered", "long_engineered")
def _(t):
    long = aggregates.unpivot(engineered(t), ["pitcher_id"], DIRECTION_FEATURES)
    return long.withColumn("direction", op.feature_direction(F.col("feature"), F.col("value")))


FACTORS = [
    ("roll21d_pitch_count > 300", "High 21-day pitch count"), ("roll21d_vel_decline > 1", "Velocity decline"),
    ("days_since_last_appearance < 2 AND days_since_last_appearance != 0", "Insufficient rest"), ("fatigue_score > 0.7::DOUBLE", "High fatigue score"),
]
IMPORTANCE_ORDER = [FACTORS[1], FACTORS[0], FACTORS[3], FACTORS[2]]


def factor_list(rules) -> str:
    return present_sql(*[f"CASE WHEN {c} THEN '{n}' END" for c, n in rules])


FACTOR_TEXT = present_sql(
    "CASE WHEN roll21d_pitch_count > 300 THEN printf('Thrown %d pitches in last 21 days', CAST(roll21d_pitch_count AS BIGINT)) END",
    "CASE WHEN roll21d_vel_decline > 1 THEN 'Velocity down' END",
    "CASE WHEN days_since_last_appearance < 2 AND days_since_last_appearance != 0 THEN printf('Only %d days since last appearance', days_since_last_appearance) END",
    "CASE WHEN fatigue_score > 0.7::DOUBLE THEN 'Fatigue score' END")
sql_table("concerns", f"SELECT *, list_slice({factor_list(IMPORTANCE_ORDER)}, 1, 3) AS concerns, {bucket_sql('score', 0.3, 0.6)} AS risk_level FROM scores", "scores")
RECOMMEND = present_sql(
    "CASE WHEN risk_level = 'high' THEN 'Consider rest day or reduced workload' END", "CASE WHEN risk_level = 'high' THEN 'Monitor velocity closely in next appearance' END",
    "CASE WHEN risk_level = 'high' AND list_contains(concerns, 'High 21-day pitch count') THEN 'Limit pitch count in next outing' END",
    "CASE WHEN risk_level = 'medium' THEN 'Continue monitoring workload patterns' END",
    "CASE WHEN risk_level = 'medium' AND list_contains(concerns, 'Velocity decline') THEN 'Track velocity trend over next few outings' END",
    "CASE WHEN risk_level = 'low' THEN 'Maintain current workload management' END")


def with_factors(t):
    return scores_of(t).withColumn("risk_factors", op.risk_factors())


@query("risk_factor_rules", f"{SNAP} factors:s texts:s total_importance:r", f"""
SELECT *, array_to_string({factor_list(FACTORS)}, '|') AS factors, array_to_string({FACTOR_TEXT}, '|') AS texts,
  CASE WHEN roll21d_pitch_count > 300 THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN roll21d_vel_decline > 1 THEN 0.9::DOUBLE ELSE 0 END
  + CASE WHEN days_since_last_appearance < 2 AND days_since_last_appearance != 0 THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN fatigue_score > 0.7::DOUBLE THEN 0.8::DOUBLE ELSE 0 END AS total_importance FROM scores""", "scores")
def _(t):
    # numbers printed with decimals are cut off: formatting of halves differs between engines
    shown = F.transform("risk_factors", lambda f: F.regexp_replace(f["description"], r"^(Velocity down|Fatigue score) .*$", "$1"))
    total = F.aggregate("risk_factors", F.lit(0.0), lambda a, f: a + f["importance"])
    names = F.transform("risk_factors", lambda f: f["factor"])
    return with_factors(t).withColumns({"factors": F.concat_ws("|", names), "texts": F.concat_ws("|", shown), "total_importance": total})


@query("primary_concerns", f"{SNAP} concerns:s", "SELECT pitcher_id, as_of_date, array_to_string(concerns, '|') AS concerns FROM concerns", "concerns")
def _(t):
    return with_factors(t).withColumn("concerns", F.concat_ws("|", op.primary_concerns()))


@query("recommendations", f"{SNAP} risk_level:s advice:s", f"SELECT *, array_to_string({RECOMMEND}, '|') AS advice FROM concerns", "concerns")
def _(t):
    staged = with_factors(t).withColumns({"primary_concerns": op.primary_concerns(), "risk_level": op.risk_bucket(F.col("score"), "service")})
    return staged.withColumn("advice", F.concat_ws("|", op.recommendations()))


ACTIONS = present_sql(
    "CASE WHEN last_game_pitches > 100 THEN 'Consider reduced pitch count in next outing' END",
    "CASE WHEN roll7d_pitch_count > 300 THEN 'Monitor cumulative workload - consider extra rest day' END",
    "CASE WHEN coalesce(vel_decline_7d_vs_30d, 0) < -2 THEN 'Velocity decline detected - consider mechanical review' END",
    "CASE WHEN avg_rest_days < 3 THEN 'Consider increasing rest between appearances' END",
    "CASE WHEN coalesce(roll7d_breaking_ball_pct, 0) > 0.6::DOUBLE THEN 'High breaking ball usage - consider pitch mix adjustment' END")


@query("recommended_actions", "pitcher_id:n score:r actions:s", f"""
SELECT pitcher_id, score, array_to_string(list_slice(CASE WHEN len(a) = 0 AND score > 0.3::DOUBLE THEN ['Elevated risk signals - monitor closely and consider workload reduction'] ELSE a END, 1, 3), '|') AS actions
FROM (SELECT e.pitcher_id, s.score, {ACTIONS} AS a FROM (SELECT * EXCLUDE (fatigue_score) FROM engineered) e JOIN (SELECT pitcher_id, score FROM newest_scores) s ON e.pitcher_id = s.pitcher_id)""", "engineered newest_scores")
def _(t):
    newest = lookups.newest_row(scores_of(t, AS_OF).select("pitcher_id", "as_of_date", "score"), "as_of_date", AS_OF).select("pitcher_id", "score")
    return engineered(t).join(newest, "pitcher_id").withColumn("actions", F.concat_ws("|", op.recommended_actions()))


sql_table("role_load", f"""
SELECT p.pitcher_id, role, s.total_pitches, s.appearances, w.avg_rest_days FROM pitchers p JOIN summary21 s ON p.pitcher_id = s.pitcher_id
JOIN (SELECT pitcher_id, coalesce(avg(rest_days) FILTER (i > 0), 0) AS avg_rest_days FROM (
    SELECT pitcher_id, row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date) - 1 AS i,
      game_date - lag(game_date) OVER (PARTITION BY pitcher_id ORDER BY game_date) - 1 AS rest_days
    FROM appearances WHERE game_date BETWEEN DATE '{AS_OF}' - 21 AND DATE '{AS_OF}') GROUP BY 1) w ON p.pitcher_id = w.pitcher_id""", "pitchers", "summary21", "appearances")
BASE = {i: f"CASE WHEN role = 'reliever' THEN {op.ROLE_BASELINES['reliever'][i]}::DOUBLE ELSE {op.ROLE_BASELINES['starter'][i]}::DOUBLE END" for i in range(3)}


def role_load(t):
    per = aggregates.workload_summary(t.appearances, AS_OF).select("pitcher_id", "appearances", "total_pitches")
    first = (dt.date.fromisoformat(AS_OF) - dt.timedelta(days=21)).isoformat()
    rest = rolling.workload_series_summary(rolling.workload_timeseries(t.appearances, first, AS_OF)).select("pitcher_id", "avg_rest_days")
    return t.pitchers.select("pitcher_id", "role").join(per, "pitcher_id").join(rest, "pitcher_id")


LOAD_ADVICE = present_sql(
    f"CASE WHEN total_pitches > {BASE[2]} THEN printf('High 21-day pitch count (%d). Consider reducing workload.', CAST(total_pitches AS BIGINT)) END",
    f"CASE WHEN avg_rest_days < {BASE[1]} * 0.7::DOUBLE THEN 'Below average rest' END",
    "CASE WHEN role = 'starter' AND appearances > 5 THEN 'High start frequency. Monitor for fatigue.' END",
    "CASE WHEN role != 'starter' AND appearances > 10 THEN 'High appearance frequency. Consider limiting usage.' END")


@query("workload_recommendations", "pitcher_id:n role:s advice:s", f"""
SELECT pitcher_id, role, array_to_string(CASE WHEN len(a) = 0 THEN ['Workload within normal parameters. Continue current management.'] ELSE a END, '|') AS advice
FROM (SELECT *, {LOAD_ADVICE} AS a FROM role_load)""", "role_load")
def _(t):
    out = op.workload_recommendations(role_load(t))
    cut = F.transform("recommendations", lambda a: F.regexp_replace(a, r"^(Below average rest) .*$", "$1"))
    return out.withColumn("advice", F.concat_ws("|", cut))


@query("workload_intensity_label", "pitcher_id:n role:s intensity_score:r workload_intensity:s", f"""
SELECT *, CASE WHEN intensity_score > 1.5::DOUBLE THEN 'high' WHEN intensity_score > 1.2::DOUBLE THEN 'elevated' ELSE 'normal' END AS workload_intensity FROM (
  SELECT pitcher_id, role, total_pitches / ({BASE[0]}) / 7 * 0.7::DOUBLE + ({BASE[1]}) / greatest(avg_rest_days, 0.5::DOUBLE) * 0.3::DOUBLE AS intensity_score FROM role_load)""", "role_load")
def _(t):
    return op.workload_intensity_label(role_load(t))


@query("workload_score", "pitcher_id:n pitch_volume:r rest_deficit:r frequency:r composite_score:r category:s color:s", """
SELECT *, CASE WHEN c >= 0.8::DOUBLE THEN 'very high' WHEN c >= 0.6::DOUBLE THEN 'high' WHEN c >= 0.4::DOUBLE THEN 'moderate' ELSE 'low' END AS category,
  CASE WHEN c >= 0.8::DOUBLE THEN 'red' WHEN c >= 0.6::DOUBLE THEN 'orange' WHEN c >= 0.4::DOUBLE THEN 'yellow' ELSE 'green' END AS color, c AS composite_score
FROM (SELECT *, pitch_volume * 0.5::DOUBLE + rest_deficit * 0.3::DOUBLE + frequency * 0.2::DOUBLE AS c FROM (""" + f"""
  SELECT pitcher_id, least(total_pitches / ({BASE[2]}), 1) AS pitch_volume, greatest(0, 1 - avg_rest_days / ({BASE[1]})) AS rest_deficit,
    least(appearances / (21.0::DOUBLE / ({BASE[1]})), 1) AS frequency FROM role_load))""", "role_load")
def _(t):
    return op.workload_score(role_load(t))


@query("completeness_map", "pitcher_id:n velocity_data:b spin_data:b workload_data:b rest_data:b pitch_mix_data:b families:n", """
SELECT pitcher_id, roll7d_release_speed_ewm_mean IS NOT NULL AS velocity_data, roll7d_release_spin_rate_ewm_mean IS NOT NULL AS spin_data,
  true AS workload_data, true AS rest_data, roll7d_breaking_ball_pct IS NOT NULL AS pitch_mix_data, 5 AS families FROM engineered""", "engineered")
def _(t):
    features = engineered(t)
    mapped = features.withColumn("m", op.completeness_map(features.columns))
    return mapped.withColumns({**{k: F.col("m")[k] for k in op.FEATURE_FAMILIES}, "families": F.size("m")})


@query("paginate", "pitcher_id:n name:s total:n has_more:b", """
SELECT pitcher_id, name, count(*) OVER () AS total, count(*) OVER () > 50 AS has_more FROM pitchers ORDER BY name, pitcher_id LIMIT 25 OFFSET 25""", "pitchers")
def _(t):
    return op.page(t.pitchers, ["name", "pitcher_id"], 25, 25)


@query("default_window", "pitcher_id:n il_start:d window_start:d window_end:d", f"""
SELECT pitcher_id, il_start, coalesce(CASE WHEN stint_type = '60-day' THEN il_start END, coalesce(il_end, DATE '{AS_OF}') - 30) AS window_start,
  coalesce(il_end, DATE '{AS_OF}') AS window_end FROM injuries""", "injuries")
def _(t):
    asked = t.injuries.select("pitcher_id", "il_start", F.when(F.col("stint_type") == "60-day", F.col("il_start")).alias("window_start"), F.col("il_end").alias("window_end"))
    return op.default_window(asked, "window_start", "window_end", AS_OF)


@query("top_contributors", "pitcher_id:n contributors:s", """
SELECT pitcher_id, 'roll7d_pitch_count=' || CASE WHEN roll7d_pitch_count > 0 THEN 'increases' ELSE 'decreases' END || '|avg_rest_days='
  || CASE WHEN avg_rest_days > 0 THEN 'decreases' ELSE 'increases' END || '|vel_decline_7d_vs_30d=' || CASE WHEN vel_decline_7d_vs_30d > 0 THEN 'increases' ELSE 'decreases' END AS contributors
FROM engineered""", "engineered")
def _(t):
    features = engineered(t)
    shown = F.transform("c", lambda x: F.concat_ws("=", x["name"], x["direction"]))
    return features.withColumn("c", op.top_contributors(features, IMPORTANCES)).withColumn("contributors", F.concat_ws("|", shown))


@query("heuristic_score", f"{SNAP} roll21d_pitch_count:n roll21d_vel_decline:r fatigue_score:r score:r", "SELECT * FROM scores", "scores")
def _(t):
    return scores_of(t)


@query("risk_history", f"{SNAP} score:r risk_level:s", f"""
SELECT *, {bucket_sql('score', 0.3, 0.6)} AS risk_level FROM scores WHERE as_of_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'""", "scores")
def _(t):
    return op.risk_history(scores_of(t, "2000-06-30"), "2000-01-01", "2000-06-30")


def assessed_sql(day: str) -> str:
    """Check SQL of the assessment on one day."""
    snapshots = f"""
SELECT pitcher_id, count(*) AS games, sum(pitches_thrown) FILTER (ago <= 21) AS p21, sum(pitches_thrown) FILTER (ago <= 7) AS p7,
  min(ago) AS days_since, arg_min(avg_vel, ago) FILTER (ago <= 21) - arg_max(avg_vel, ago) FILTER (ago <= 21) AS d21,
  max(game_date) AS last_appearance, max(ago) AS days_of_data FROM (SELECT *, DATE '{day}' - game_date AS ago FROM appearances WHERE game_date <= DATE '{day}') GROUP BY 1"""
    return f"""
SELECT p.pitcher_id, p.team, coalesce(score, 0.5::DOUBLE) AS risk_score, CASE WHEN score IS NULL THEN 'medium' ELSE {bucket_sql('score', 0.3, 0.6)} END AS risk_level,
  CASE WHEN score IS NULL THEN 'low' WHEN games >= 10 THEN 'medium' ELSE 'low' END AS data_completeness, CASE WHEN score IS NULL THEN 0 ELSE days_of_data END AS days_of_data,
  last_appearance, CASE WHEN score IS NULL THEN 'Insufficient data for assessment' ELSE array_to_string(list_slice({present_sql(
      "CASE WHEN d21 > 1 THEN 'Velocity decline' END", "CASE WHEN p21 > 300 THEN 'High 21-day pitch count' END",
      "CASE WHEN fatigue > 0.7::DOUBLE THEN 'High fatigue score' END", "CASE WHEN days_since < 2 AND days_since != 0 THEN 'Insufficient rest' END")}, 1, 3), '|') END AS concerns
FROM pitchers p LEFT JOIN (SELECT *, CASE WHEN games >= 5 THEN round(least(0.9::DOUBLE, 0.3::DOUBLE + CASE WHEN p21 > 250 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN d21 > 1 THEN 0.3::DOUBLE ELSE 0 END
    + CASE WHEN fatigue > 0.7::DOUBLE THEN 0.2::DOUBLE ELSE 0 END), 6) END AS score
  FROM (SELECT *, least(coalesce(p7, 0) / 150.0::DOUBLE, 2) * 0.7::DOUBLE + CASE WHEN d21 > 1 THEN 0.3::DOUBLE ELSE 0 END AS fatigue FROM ({snapshots}))) e ON p.pitcher_id = e.pitcher_id"""
# Early on most pitchers have too few games; late, all branches of the assessment are taken.
EARLY, LATE = "1995-01-25", "2001-06-30"
ASSESSMENT = "pitcher_id:n team:s risk_score:r risk_level:s data_completeness:s days_of_data:n last_appearance:d concerns:s"


def assessments(suffix: str, day: str):
    sql_table(f"assessed{suffix}", assessed_sql(day), "pitchers", "appearances")

    @query(f"risk_assessment{suffix}", ASSESSMENT, f"SELECT * FROM assessed{suffix}", f"assessed{suffix}")
    def _(t):
        return op.risk_assessment(t.pitchers, t.appearances, day).withColumn("concerns", F.concat_ws("|", "primary_concerns"))

    @query(f"risk_distribution{suffix}", "risk_level:s pitchers:n", f"SELECT risk_level, count(*) AS pitchers FROM assessed{suffix} GROUP BY 1", f"assessed{suffix}")
    def _(t):
        return op.risk_distribution(op.risk_assessment(t.pitchers, t.appearances, day))


assessments("", LATE)
assessments("_early", EARLY)


sql_table("team_scores", "SELECT s.*, role, team FROM scores s JOIN pitchers p ON s.pitcher_id = p.pitcher_id", "scores", "pitchers")


def team_scores(t):
    return written_once(
        scores_of(t).select("pitcher_id", "as_of_date", "score").join(t.pitchers.select("pitcher_id", "team", "role"), "pitcher_id"), "team-scores")


@query("dynamic_risk_bucket", f"{SNAP} team:s score:r risk_bucket:s", """
SELECT *, CASE WHEN percent_rank() OVER (PARTITION BY team, as_of_date ORDER BY score) >= 0.9::DOUBLE THEN 'high' WHEN score >= 0.3::DOUBLE THEN 'medium' ELSE 'low' END AS risk_bucket FROM team_scores""", "team_scores")
def _(t):
    return op.dynamic_risk_bucket(team_scores(t))


@query("cohort_percentile", f"{SNAP} role:s score:r cohort_percentile:r", """
SELECT *, percent_rank() OVER (PARTITION BY role ORDER BY score) AS cohort_percentile FROM team_scores""", "team_scores")
def _(t):
    return op.cohort_percentile(team_scores(t))


@query("feature_percentile", f"{SNAP} feature:s value:r percentile:r", " UNION ALL ".join(f"""
SELECT pitcher_id, as_of_date, '{f}' AS feature, value, percent_rank() OVER (ORDER BY value) AS percentile
FROM (SELECT pitcher_id, as_of_date, round(CAST({f} AS DOUBLE) + {OFF_TIE}::DOUBLE, 6) AS value FROM scores)""" for f in FEATURES), "scores")
def _(t):
    # Ranked as shown: the last digits of a slope depend on the order of a sum.
    shown = {f: F.round(F.col(f).cast("double") + float(OFF_TIE), 6) for f in FEATURES}
    return op.feature_percentiles(stored_scores(t, *FEATURES).withColumns(shown), ["pitcher_id", "as_of_date"], FEATURES)


@query("error_sample", f"{SNAP} kind:s score:r", """
SELECT * FROM (SELECT pitcher_id, as_of_date, 'false_positive' AS kind, score FROM labelled_snapshots WHERE y = 0 AND score >= 0.5::DOUBLE ORDER BY md5(concat_ws('|', pitcher_id, as_of_date, 42)) LIMIT 20)
UNION ALL SELECT * FROM (SELECT pitcher_id, as_of_date, 'false_negative', score FROM labelled_snapshots WHERE y = 1 AND score < 0.5::DOUBLE ORDER BY md5(concat_ws('|', pitcher_id, as_of_date, 42)) LIMIT 20)""", "labelled_snapshots")
def _(t):
    return selection.error_sample(stored_labelled(t))
