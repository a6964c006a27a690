"""Queries for gates, constraints and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from moundwork.operators import gate_states, rolling
from moundwork.operators import quality as op
from moundwork.plans.label_queries import scores_of
from moundwork.plans.registry import query, sql_table
from moundwork.session import shared_folder

GATE = "gate:s check:s season:n observed:r threshold:r severity:s passed:b"
AS_OF = "2001-06-30"
MIN_PITCHES, MIN_GAMES = 8600, 7600


def row(check: str, observed: str, threshold: float, passed: str, severity: str = "error") -> str:
    return f"('{check}', CAST({observed} AS DOUBLE), {threshold}::DOUBLE, '{severity}', coalesce({passed}, true))"


def low(check, observed, bound, severity="error"):
    return row(check, observed, bound, f"{observed} >= {bound}", severity)


def high(check, observed, bound, severity="error"):
    return row(check, observed, bound, f"{observed} <= {bound}", severity)


def some(check, observed, bound, severity="error"):
    return row(check, observed, bound, f"coalesce({observed}, 0) > {bound}", severity)


def gate_sql(gate: str, source: str, rows, season: str = "NULL") -> str:
    return f"""
SELECT '{gate}' AS gate, c."check", season, c.observed, c.threshold, c.severity, c.passed FROM (
  SELECT {season} AS season, unnest([{', '.join('{' + ', '.join(f"'{k}': {v}" for k, v in zip(('check', 'observed', 'threshold', 'severity', 'passed'), split(r))) + '}' for r in rows)}]) AS c FROM ({source}))"""


def split(r: str):
    inner, parts, depth, start = r[1:-1], [], 0, 0
    for i, ch in enumerate(inner):
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            parts.append(inner[start:i])
            start = i + 1
    return [*parts, inner[start:]]


GATES = {
    "row_counts": (" UNION ALL ".join([
        *[gate_sql("row_counts", f"SELECT count(*) AS n FROM {t}", [some(f"total_{t}", "n", 0)]) for t in ("pitches", "appearances", "pitchers")],
        gate_sql("row_counts", "SELECT year(game_date) AS y, count(*) AS rows, count(DISTINCT pitcher_id) AS p FROM pitches GROUP BY 1",
                 [low("season_pitches", "rows", MIN_PITCHES), low("season_pitchers", "p", 100, "warning")], "y"),
        gate_sql("row_counts", "SELECT year(game_date) AS y, count(*) AS rows FROM appearances GROUP BY 1", [low("season_appearances", "rows", MIN_GAMES)], "y"),
    ]), "pitches appearances pitchers"),
    "missing_data": (gate_sql("missing_data", "SELECT " + ", ".join(
        f"100 * avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS n{i}" for i, c in enumerate(("release_speed", "release_spin_rate", "pitch_type", "game_date"))) + " FROM statcast_raw",
        [high("null_velocity_pct", "n0", 3), high("null_spin_pct", "n1", 5), high("null_pitch_type_pct", "n2", 1, "warning"), high("null_date_pct", "n3", 0.1, "warning")]), "statcast_raw"),
    "data_ranges": (gate_sql("data_ranges", "SELECT min(release_speed) AS v0, max(release_speed) AS v1, avg(release_speed) AS v2, min(release_spin_rate) AS s0, max(release_spin_rate) AS s1, avg(release_spin_rate) AS s2 FROM pitches",
        [low("min_velocity", "v0", 60), high("max_velocity", "v1", 110), low("avg_velocity_low", "v2", 80, "warning"), high("avg_velocity_high", "v2", 95, "warning"),
         low("min_spin", "s0", 500), high("max_spin", "s1", 3500), low("avg_spin_low", "s2", 1800, "warning"), high("avg_spin_high", "s2", 2500, "warning")]), "pitches"),
    "duplicates": (gate_sql("duplicates", "SELECT (sum(n) - count(*)) * 100.0::DOUBLE / sum(n) AS pct, count(*) FILTER (n > 1) AS g FROM (SELECT at_bat_id, pitch_number, count(*) AS n FROM pitches GROUP BY 1, 2)",
        [high("duplicate_pct", "pct", 0.1), high("duplicate_groups", "g", 0, "warning")]), "pitches"),
    "temporal": (gate_sql("temporal", f"SELECT count(DISTINCT game_date) AS d, count(*) FILTER (game_date > DATE '{AS_OF}') AS f, count(*) FILTER (game_date < DATE '2015-01-01') AS o, (SELECT 100.0::DOUBLE * count(*) FILTER (dayofweek(game_date) IN (0, 6)) / count(*) FROM (SELECT DISTINCT game_date FROM pitches)) AS w FROM pitches",
        [some("valid_dates", "d", 0), high("future_pitches", "f", 0), high("pitches_before_2015", "o", 0, "warning"), low("weekend_pct_low", "w", 20, "warning"), high("weekend_pct_high", "w", 50, "warning")]), "pitches"),
    "pitcher_consistency": (gate_sql("pitcher_consistency", "SELECT (SELECT count(DISTINCT pitcher_id) FROM pitch_events) AS p, (SELECT count(DISTINCT pitcher_id) FROM appearances) AS a, (SELECT count(DISTINCT pitcher_id) FROM appearances WHERE pitcher_id NOT IN (SELECT pitcher_id FROM pitch_events)) AS oa, (SELECT count(DISTINCT pitcher_id) FROM pitch_events WHERE pitcher_id NOT IN (SELECT pitcher_id FROM appearances)) AS op",
        [some("pitchers_with_pitches", "p", 0), some("pitchers_with_appearances", "a", 0), high("appearances_without_pitches", "oa", 0, "warning"),
         high("pitches_without_appearances", "op", 0, "warning"), low("enough_pitchers", "p", 100, "warning")]), "pitch_events appearances"),
    "monotonic": (gate_sql("monotonic", "SELECT count(*) AS n, corr(release_speed, CAST(release_spin_rate AS DOUBLE)) AS c FROM pitches",
        [some("valid_pairs", "n", 0), row("speed_spin_corr", "c", 0.0, "c > 0", "warning")]) + " UNION ALL " + gate_sql("monotonic",
        "SELECT avg(pitches_thrown) AS m, max(pitches_thrown) AS x FROM appearances",
        [low("mean_pitches_low", "m", 10, "warning"), high("mean_pitches_high", "m", 50, "warning"), high("max_pitches", "x", 200, "warning")]), "pitches appearances"),
}
BUILDERS = {
    "row_counts": lambda t: op.gate_row_counts(t.pitches, t.appearances, t.pitchers, MIN_PITCHES, MIN_GAMES),
    "missing_data": lambda t: op.gate_missing_data(t.statcast_raw),
    "data_ranges": lambda t: op.gate_data_ranges(t.pitches),
    "duplicates": lambda t: op.gate_duplicates(t.pitches, ("at_bat_id", "pitch_number")),
    "temporal": lambda t: op.gate_temporal(t.pitches, AS_OF),
    "pitcher_consistency": lambda t: op.gate_pitcher_consistency(t.pitch_events, t.appearances),
    "monotonic": lambda t: op.gate_monotonic(t.pitches, t.appearances),
}
for _name, (_sql, _needs) in GATES.items():
    query(f"gate_{_name}", GATE, _sql, _needs)(BUILDERS[_name])
    sql_table(f"gate_{_name}", _sql, *_needs.split())


@query("gate_score_monotonic", GATE, gate_sql("score_monotonic", """SELECT regr_slope(score, CAST(roll21d_pitch_count AS DOUBLE)) AS l, regr_slope(score, CAST(rest AS DOUBLE)) AS r
  FROM (SELECT s.*, coalesce(gap, 0) AS rest FROM scores s JOIN line l ON s.pitcher_id = l.pitcher_id AND s.as_of_date = l.game_date)""",
    [row("score_rises_with_load", "l", 0.0, "l >= 0", "warning"), row("score_falls_with_rest", "r", 0.0, "r <= 0", "warning")]), "scores line")
def _(t):
    rest = rolling.time_rolling(t.appearances).select("pitcher_id", F.col("game_date").alias("as_of_date"), "rest_days")
    return op.gate_score_monotonic(scores_of(t).join(rest, ["pitcher_id", "as_of_date"]))


@query("quality_report", "gate:s checks:n errors:n warnings:n passed:b", """
SELECT gate, count(*) AS checks, count(*) FILTER (NOT passed AND severity = 'error') AS errors, count(*) FILTER (NOT passed AND severity = 'warning') AS warnings,
  count(*) FILTER (NOT passed AND severity = 'error') = 0 AS passed FROM (""" + " UNION ALL ".join(f"SELECT * FROM gate_{n}" for n in GATES) + ") GROUP BY 1",
       " ".join(f"gate_{n}" for n in GATES))
def _(t):
    frames = [build(t) for build in BUILDERS.values()]
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return op.quality_report(merged)


STORED = " UNION ALL ".join([
    """SELECT * FROM gate_row_counts WHERE "check" <> 'total_pitchers'""", "SELECT * FROM gate_data_ranges", "SELECT * FROM gate_temporal", "SELECT * FROM gate_monotonic",
    gate_sql("missing_data", "SELECT " + ", ".join(
        f"100 * avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS n{i}" for i, c in enumerate(("release_speed", "release_spin_rate", "pitch_type"))) + " FROM pitches",
        [high("null_velocity_pct", "n0", 3), high("null_spin_pct", "n1", 5), high("null_pitch_type_pct", "n2", 1, "warning")]),
    gate_sql("duplicates", "SELECT (sum(n) - count(*)) * 100.0::DOUBLE / sum(n) AS pct, count(*) FILTER (n > 1) AS g FROM (SELECT count(*) AS n FROM pitches GROUP BY pitcher_id, game_date, at_bat_id, pitch_number)",
        [high("duplicate_pct", "pct", 0.1), high("duplicate_groups", "g", 0, "warning")])])


@query("quality_report_incremental", GATE, STORED, "gate_row_counts gate_data_ranges gate_temporal gate_monotonic pitches")
def _(t):
    """Gates from states of three batches: the older days, the newer ones, and a month that was sent half and comes again."""
    states = gate_states.GateStates(t.spark, shared_folder(t.spark, "gate-states"), t.pitches, t.appearances)

    def days(low, high):
        return [df.where(F.col("game_date").between(F.lit(low).cast("date"), F.lit(high).cast("date"))) for df in (t.pitches, t.appearances)]

    pitches, games = days("1900-01-01", "2000-06-30")
    states.put(pitches.where((F.col("game_date") < F.lit("2000-06-01").cast("date")) | (F.col("pitch_number") <= 3)), games, "first")
    states.put(*days("2000-07-01", "2999-12-31"), "second")
    states.put(*days("2000-06-01", "2000-06-30"), "again")
    return states.gates(AS_OF, MIN_PITCHES, MIN_GAMES)


def rules_sql(table: str, rules) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT ({c})) AS violations, count(*) AS rows FROM {table}" for n, c in rules.items())


PITCH_RULES = {
    "chk_release_speed": "release_speed BETWEEN 50 AND 110", "chk_release_spin": "release_spin_rate BETWEEN 0 AND 3500",
    "chk_pitch_number": "pitch_number > 0", "chk_game_date": "game_date >= DATE '2015-01-01'",
}
GAME_RULES = {
    "chk_pitches_thrown": "pitches_thrown > 0", "chk_avg_vel": "avg_vel BETWEEN 50 AND 110", "chk_avg_spin": "avg_spin BETWEEN 0 AND 3500",
    "chk_innings_pitched": "innings_pitched >= 0",
}


@query("check_constraints", "rule:s violations:n rows:n", " UNION ALL ".join([
    rules_sql("pitches", PITCH_RULES), rules_sql("appearances", GAME_RULES), rules_sql("injuries", {"chk_injury_dates": "il_start <= il_end"})]),
       "pitches appearances injuries")
def _(t):
    parts = [op.check_constraints(getattr(t, n), op.constraints(n)) for n in ("pitches", "appearances", "injuries")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("violating_rows", "pitcher_id:n game_date:d pitch_number:n rule:s", " UNION ALL ".join(
    f"SELECT pitcher_id, game_date, pitch_number, '{n}' AS rule FROM pitches WHERE NOT ({c})" for n, c in PITCH_RULES.items()), "pitches")
def _(t):
    return op.violating_rows(t.pitches, op.constraints("pitches"))


@query("split_valid_pitches", "pitcher_id:n game_date:d release_speed:r release_spin_rate:n", """
SELECT * FROM pitches WHERE release_speed BETWEEN 85 AND 105 AND release_spin_rate BETWEEN 1800 AND 3200""", "pitches")
def _(t):
    rules = {"speed": F.col("release_speed").between(85, 105), "spin": F.col("release_spin_rate").between(1800, 3200)}
    return op.split_valid(t.pitches, rules)[0]


@query("check_unique", "rule:s violations:n surplus_rows:n", " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (n > 1) AS violations, sum(n - 1) AS surplus_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
    for n, t, k in (("unique_game", "appearances", "pitcher_id, game_date"), ("unique_pitch", "pitches", "at_bat_id, pitch_number"))), "appearances pitches")
def _(t):
    games = op.check_unique(t.appearances, ["pitcher_id", "game_date"], "unique_game")
    return games.unionByName(op.check_unique(t.pitches, ["at_bat_id", "pitch_number"], "unique_pitch"))


@query("check_foreign_keys", "rule:s violations:n surplus_rows:n", """
SELECT 'fk_pitches_pitcher' AS rule, count(DISTINCT pitcher_id) AS violations, count(*) AS surplus_rows FROM pitch_events WHERE pitcher_id NOT IN (SELECT pitcher_id FROM pitchers)
UNION ALL SELECT 'fk_injuries_pitcher', count(DISTINCT pitcher_id), count(*) FROM injuries WHERE pitcher_id NOT IN (SELECT pitcher_id FROM pitchers)""", "pitch_events injuries pitchers")
def _(t):
    first = op.check_foreign_key(t.pitch_events, t.pitchers, "pitcher_id", "fk_pitches_pitcher")
    return first.unionByName(op.check_foreign_key(t.injuries, t.pitchers, "pitcher_id", "fk_injuries_pitcher"))


@query("validate_pitches", "valid:b invalid_velocities:n invalid_spin_rates:n missing_values:n total_pitches:n unique_pitchers:n", """
SELECT *, invalid_velocities + invalid_spin_rates + missing_values = 0 AS valid FROM (SELECT count(*) FILTER (release_speed NOT BETWEEN 85 AND 105) AS invalid_velocities,
  count(*) FILTER (release_spin_rate NOT BETWEEN 1800 AND 3200) AS invalid_spin_rates, 0 AS missing_values, count(*) AS total_pitches, count(DISTINCT pitcher_id) AS unique_pitchers FROM pitches)""", "pitches")
def _(t):
    return op.validate_pitches(t.pitches)


@query("validate_appearances", "valid:b invalid_pitch_counts:n invalid_velocities:n total_appearances:n unique_pitchers:n", """
SELECT *, invalid_pitch_counts + invalid_velocities = 0 AS valid FROM (SELECT count(*) FILTER (pitches_thrown NOT BETWEEN 1 AND 150) AS invalid_pitch_counts,
  count(*) FILTER (avg_vel NOT BETWEEN 85 AND 105) AS invalid_velocities, count(*) AS total_appearances, count(DISTINCT pitcher_id) AS unique_pitchers FROM appearances)""", "appearances")
def _(t):
    return op.validate_appearances(t.appearances)


@query("validate_injuries", "valid:b total_injuries:n invalid_dates:n end_not_after_start:n", """
SELECT *, invalid_dates + end_not_after_start = 0 AS valid FROM (SELECT count(*) AS total_injuries,
  count(*) FILTER (e IS NOT NULL AND try_cast(e AS DATE) IS NULL) AS invalid_dates, count(*) FILTER (try_cast(e AS DATE) <= s) AS end_not_after_start
  FROM (SELECT il_start AS s, CASE WHEN stint_type = '60-day' THEN 'season' ELSE CAST(CASE WHEN stint_type = '15-day' THEN il_start ELSE il_end END AS VARCHAR) END AS e FROM injuries))""", "injuries")
def _(t):
    stint = F.col("stint_type")
    text = F.when(stint == "60-day", "season").when(stint == "15-day", F.col("il_start").cast("string")).otherwise(F.col("il_end").cast("string"))
    return op.validate_injuries(t.injuries.withColumn("il_end", text))


LEVEL = "CASE WHEN release_speed > 120 THEN 'high' WHEN release_speed > 60 THEN 'medium' ELSE 'low' END"


@query("prediction_volume", "window_start:t level:s assessments:n", f"""
SELECT date_trunc('hour', ts) AS window_start, {LEVEL} AS level, count(*) AS assessments FROM pitch_events GROUP BY 1, 2""", "pitch_events")
def _(t):
    value = F.col("release_speed")
    level = F.when(value > 120, "high").when(value > 60, "medium").otherwise("low")
    return op.prediction_volume(t.pitch_events.withColumn("level", level), "level")


@query("freshness", "last_update:t hours_old:r stale:b", """
SELECT max(ts) AS last_update, (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts)))) / 3600.0::DOUBLE AS hours_old,
  (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts)))) / 3600.0::DOUBLE > 24 AS stale FROM pitch_events""", "pitch_events")
def _(t):
    return op.freshness(t.pitch_events, "ts", "2024-02-01 00:00:00")


@query("weekly_metrics", "week:d snapshots:n mean_score:r mean_load:r prior_mean_score:r score_change:r", """
SELECT *, lag(mean_score) OVER (ORDER BY week) AS prior_mean_score, mean_score - lag(mean_score) OVER (ORDER BY week) AS score_change FROM (
  SELECT CAST(date_trunc('week', as_of_date) AS DATE) AS week, count(*) AS snapshots, avg(score) AS mean_score, avg(roll7d_pitch_count) AS mean_load FROM scores GROUP BY 1)""", "scores")
def _(t):
    return op.weekly_metrics(scores_of(t))
