"""Risk scores and the payload built around them, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundwork.functions import ranking
from moundwork.operators import rolling
from moundwork.operators.rolling import as_day

# Fixed values: (upper bound of low, upper bound of medium) per scheme.
BUCKET_SCHEMES = {"calibrated": (0.1, 0.3), "service": (0.3, 0.6), "served": (0.2, 0.5)}
CONFIDENCE_VALUES = {"high": 0.9, "medium": 0.6, "low": 0.3}
# Role baselines (pitches per game, rest days, safe 21-day pitches).
ROLE_BASELINES = {"starter": (95.0, 4.0, 350.0), "reliever": (25.0, 2.0, 200.0)}
SCORE_INPUTS = (
    "roll21d_pitch_count", "roll21d_avg_vel", "roll21d_vel_decline", "roll7d_pitch_count",
    "roll7d_vel_decline", "vel_trend_slope", "days_since_last_appearance", "workload_intensity",
    "fatigue_score",
)
FEATURE_FAMILIES = {
    "velocity_data": ("roll7d_release_speed_ewm_mean", "roll14d_release_speed_ewm_mean"),
    "spin_data": ("roll7d_release_spin_rate_ewm_mean", "roll14d_release_spin_rate_ewm_mean"),
    "workload_data": ("roll7d_pitch_count", "roll14d_pitch_count", "roll30d_pitch_count"),
    "rest_data": ("avg_rest_days", "std_rest_days"),
    "pitch_mix_data": ("roll7d_breaking_ball_pct", "roll14d_breaking_ball_pct"),
}


def heuristic_score(features: DataFrame, name: str = "score") -> DataFrame:
    """Deterministic score from 21-day load, speed decline and fatigue, held within 0.1 and 0.9."""
    def add(condition: Column, points: float) -> Column:
        return F.when(condition, points).otherwise(0.0)

    raw = (
        F.lit(0.3)
        + add(F.col("roll21d_pitch_count") > 250, 0.2)
        + add(F.col("roll21d_vel_decline") > 1.0, 0.3)
        + add(F.col("fatigue_score") > 0.7, 0.2)
    )
    return features.withColumn(name, F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.1), raw)), 6))


def risk_bucket(score: Column, scheme: str = "calibrated") -> Column:
    low, medium = BUCKET_SCHEMES[scheme]
    return F.when(score < low, "low").when(score < medium, "medium").when(score.isNotNull(), "high")


def dynamic_risk_bucket(scored: DataFrame, share: float = 0.1, score: str = "score") -> DataFrame:
    """High for the top share of each team and day; the rest by the fixed medium bound."""
    ranked = ranking.percent_rank(scored, score, ["team", "as_of_date"], "_pct")
    bucket = (
        F.when(F.col("_pct") >= 1 - share, "high").when(F.col(score) >= 0.3, "medium").otherwise("low")
    )
    return ranked.withColumn("risk_bucket", bucket).drop("_pct")


def confidence_level(completeness: Column) -> Column:
    return F.when(completeness >= 0.8, "high").when(completeness >= 0.5, "medium").otherwise("low")


def confidence_value(level: Column) -> Column:
    out = F.lit(CONFIDENCE_VALUES["low"])
    for name in ("medium", "high"):
        out = F.when(level == name, CONFIDENCE_VALUES[name]).otherwise(out)
    return out


def prediction_confidence(inputs: Sequence[str] = SCORE_INPUTS) -> Column:
    """0.8 with at least five non-zero inputs, else 0.6."""
    present = sum((F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0, 1).otherwise(0) for c in inputs), F.lit(0))
    return F.when(present >= 5, 0.8).otherwise(0.6)


def feature_direction(name: Column, value: Column) -> Column:
    up = F.when(value > 0, "increases").otherwise("decreases")
    down = F.when(value > 0, "decreases").otherwise("increases")
    return (
        F.when(name.contains("vel_decline") | name.contains("pitch_count"), up)
        .when(name.contains("rest_days"), down).when(name.contains("breaking_ball"), up).otherwise("neutral")
    )


def _present(options: Sequence[Column]) -> Column:
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def risk_factors() -> Column:
    """Array of (factor, value, importance, description) from four threshold rules; a zero or
    missing input never fires."""
    def rule(column: str, condition: Column, factor: str, importance: float, description: Column) -> Column:
        c = F.col(column)
        fires = c.isNotNull() & (c != 0) & condition
        return F.when(fires, F.struct(
            F.lit(factor).alias("factor"), c.cast("double").alias("value"), F.lit(importance).alias("importance"),
            description.alias("description"),
        ))

    load, decline = F.col("roll21d_pitch_count"), F.col("roll21d_vel_decline")
    rest, fatigue = F.col("days_since_last_appearance"), F.col("fatigue_score")
    return _present([
        rule("roll21d_pitch_count", load > 300, "High 21-day pitch count", 0.8,
             F.format_string("Thrown %d pitches in last 21 days", load.cast("bigint"))),
        rule("roll21d_vel_decline", decline > 1.0, "Velocity decline", 0.9,
             F.format_string("Velocity down %.1f MPH over 21 days", decline)),
        rule("days_since_last_appearance", rest < 2, "Insufficient rest", 0.7,
             F.format_string("Only %d days since last appearance", rest.cast("bigint"))),
        rule("fatigue_score", fatigue > 0.7, "High fatigue score", 0.8,
             F.format_string("Fatigue score of %.2f indicates high stress", fatigue)),
    ])


def primary_concerns(factors: str = "risk_factors", most: int = 3) -> Column:
    """Factor names by falling importance; equal importance keeps rule order."""
    placed = F.transform(factors, lambda f, i: F.struct((-f["importance"]).alias("a"), i.alias("b"), f["factor"].alias("c")))
    return F.slice(F.transform(F.array_sort(placed), lambda f: f["c"]), 1, most)


def recommendations(level: str = "risk_level", concerns: str = "primary_concerns") -> Column:
    has = lambda name: F.array_contains(concerns, name)
    lv = F.col(level)
    return _present([
        F.when(lv == "high", "Consider rest day or reduced workload"),
        F.when(lv == "high", "Monitor velocity closely in next appearance"),
        F.when((lv == "high") & has("High 21-day pitch count"), "Limit pitch count in next outing"),
        F.when(lv == "medium", "Continue monitoring workload patterns"),
        F.when((lv == "medium") & has("Velocity decline"), "Track velocity trend over next few outings"),
        F.when(~lv.isin("high", "medium"), "Maintain current workload management"),
    ])


def recommended_actions(score: str = "score", most: int = 3) -> Column:
    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    rules = [
        F.when(value("last_game_pitches") > 100, "Consider reduced pitch count in next outing"),
        F.when(value("roll7d_pitch_count") > 300, "Monitor cumulative workload - consider extra rest day"),
        F.when(value("vel_decline_7d_vs_30d") < -2.0, "Velocity decline detected - consider mechanical review"),
        F.when(value("avg_rest_days") < 3.0, "Consider increasing rest between appearances"),
        F.when(value("roll7d_breaking_ball_pct") > 0.6, "High breaking ball usage - consider pitch mix adjustment"),
    ]
    found = _present(rules)
    fallback = F.array(F.lit("Elevated risk signals - monitor closely and consider workload reduction"))
    return F.slice(F.when((F.size(found) == 0) & (F.col(score) > 0.3), fallback).otherwise(found), 1, most)


def completeness_map(columns: Sequence[str], by_presence: bool = False) -> Column:
    """Family to availability: any non-null value, or (``by_presence``) any existing column."""
    pairs = []
    for family, names in FEATURE_FAMILIES.items():
        kept = [n for n in names if n in columns]
        if by_presence:
            value = F.lit(bool(kept))
        else:
            value = F.lit(False)
            for n in kept:
                value = value | F.col(n).isNotNull()
        pairs += [F.lit(family), value]
    return F.create_map(*pairs)


def baseline(role: Column, index: int) -> Column:
    """One role baseline as a literal choice (two roles, so no join); unknown roles use starter."""
    starter, reliever = ROLE_BASELINES["starter"][index], ROLE_BASELINES["reliever"][index]
    return F.when(F.lower(role) == "reliever", reliever).otherwise(starter)


def workload_recommendations(df: DataFrame) -> DataFrame:
    """Rule texts from role, total_pitches, appearances and avg_rest_days."""
    role, pitches, rest = F.col("role"), F.col("total_pitches"), F.col("avg_rest_days")
    games = F.col("appearances")
    found = _present([
        F.when(pitches > baseline(role, 2), F.format_string(
            "High 21-day pitch count (%d). Consider reducing workload.", pitches.cast("bigint"))),
        F.when(rest < baseline(role, 1) * 0.7, F.format_string(
            "Below average rest (%.1f days). Schedule additional rest.", rest)),
        F.when((role == "starter") & (games > 5), "High start frequency. Monitor for fatigue."),
        F.when((role != "starter") & (games > 10), "High appearance frequency. Consider limiting usage."),
    ])
    fallback = F.array(F.lit("Workload within normal parameters. Continue current management."))
    return df.withColumn("recommendations", F.when(F.size(found) == 0, fallback).otherwise(found))


def workload_intensity_label(df: DataFrame, pitches: str = "total_pitches", rest: str = "avg_rest_days") -> DataFrame:
    role = F.col("role")
    score = (F.col(pitches) / baseline(role, 0) / 7.0) * 0.7 + (
        baseline(role, 1) / F.greatest(F.col(rest).cast("double"), F.lit(0.5))
    ) * 0.3
    label = F.when(score > 1.5, "high").when(score > 1.2, "elevated").otherwise("normal")
    return df.withColumns({"intensity_score": score, "workload_intensity": F.when(role.isNull(), "normal").otherwise(label)})


def workload_score(df: DataFrame) -> DataFrame:
    """Volume, rest and frequency components in [0, 1], their weighted sum, category and colour."""
    role = F.col("role")
    rest = baseline(role, 1)
    volume = F.least(F.col("total_pitches") / baseline(role, 2), F.lit(1.0))
    deficit = F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(F.col("avg_rest_days"), rest) / rest)
    frequency = F.least(F.col("appearances") / (F.lit(21.0) / rest), F.lit(1.0))
    out = df.withColumns({"pitch_volume": volume, "rest_deficit": deficit, "frequency": frequency}).withColumn(
        "composite_score", F.col("pitch_volume") * 0.5 + F.col("rest_deficit") * 0.3 + F.col("frequency") * 0.2
    )
    c = F.col("composite_score")
    def pick(*names: str) -> Column:
        return F.when(c >= 0.8, names[0]).when(c >= 0.6, names[1]).when(c >= 0.4, names[2]).otherwise(names[3])

    return out.withColumns({
        "category": pick("very high", "high", "moderate", "low"), "color": pick("red", "orange", "yellow", "green"),
    })


def top_contributors(df: DataFrame, importances: Mapping[str, float], most: int = 3) -> Column:
    """Array of the most important features with value and direction.

    Importances come from the fitted model (a fixed number per feature), so the order is known
    before the job runs: only the chosen features are read, and no row is unpivoted or sorted.
    """
    order = sorted((n for n in importances if n in df.columns), key=lambda n: -importances[n])[:most]
    return F.array(*[
        F.struct(
            F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), F.lit(float(importances[n])).alias("importance"),
            feature_direction(F.lit(n), F.col(n).cast("double")).alias("direction"),
        )
        for n in order
    ])


def cohort_percentile(scored: DataFrame, keys: Sequence[str] = ("role",), score: str = "score") -> DataFrame:
    return ranking.percent_rank(scored, score, keys, "cohort_percentile")


def feature_percentiles(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form (ids, feature, value, percentile) with each value's place in its feature."""
    from moundwork.operators.aggregates import unpivot

    return ranking.percent_rank(unpivot(df, ids, features), "value", ["feature"], "percentile")


def risk_history(scored: DataFrame, start: str, end: str) -> DataFrame:
    return scored.where(F.col("as_of_date").between(as_day(start), as_day(end))).withColumn(
        "risk_level", risk_bucket(F.col("score"), "service")
    )


def risk_assessment(pitchers: DataFrame, appearances: DataFrame, as_of: str) -> DataFrame:
    """The assessment of every pitcher for one date; too little history gives the default one."""
    snapshot = heuristic_score(rolling.snapshot_rolling_asof(appearances, as_of))
    history = rolling.history_upto(appearances, as_of).groupBy("pitcher_id").agg(
        F.max("game_date").alias("last_appearance"), F.min("game_date").alias("_first")
    )
    joined = (
        pitchers.select("pitcher_id", "name", "team", "role").join(history, "pitcher_id", "left")
        .join(snapshot, "pitcher_id", "left")
    )
    known = F.col("score").isNotNull()
    staged = joined.withColumns({
        "risk_factors": F.when(known, risk_factors()).otherwise(F.slice(risk_factors(), 1, 0)),
        "risk_level": F.when(known, risk_bucket(F.col("score"), "service")).otherwise("medium"),
        "confidence": F.when(known, prediction_confidence()).otherwise(0.3),
        "days_of_data": F.when(known, F.datediff(as_day(as_of), "_first")).otherwise(0),
        "data_completeness": F.coalesce("data_completeness", F.lit("low")),
    })
    staged = staged.withColumn(
        "primary_concerns",
        F.when(known, primary_concerns()).otherwise(F.array(F.lit("Insufficient data for assessment"))),
    )
    return staged.withColumns({
        "recommendations": F.when(known, recommendations()).otherwise(
            F.array(F.lit("Need more appearance data for accurate assessment"))),
        "risk_score": F.coalesce("score", F.lit(0.5)),
        "as_of_date": as_day(as_of),
    }).drop("_first", "score")


def risk_distribution(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy("risk_level").agg(F.count(F.lit(1)).alias("pitchers"))


def page(df: DataFrame, order: Sequence[str], limit: int, offset: int) -> DataFrame:
    """One page with the total and whether more rows follow.

    The page itself is a bounded top-n; the total is a separate count, so nothing is numbered.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)
    return rows.withColumn("has_more", F.col("total") > offset + limit)


def list_pitchers(pitchers: DataFrame, team: str | None = None, role: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    out = pitchers
    if team is not None:
        out = out.where(F.col("team") == team.upper())
    if role is not None:
        out = out.where(F.col("role") == role.lower())
    return out.orderBy("pitcher_id").offset(offset).limit(limit)


def search_pitchers(pitchers: DataFrame, term: str = "", team: str | None = None, role: str | None = None) -> DataFrame:
    low = term.lower()
    out = pitchers.where(F.lower("name").contains(low) | F.lower("team").contains(low))
    for column, value in (("team", team), ("role", role)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def rate_columns(box: DataFrame) -> DataFrame:
    """Per-game ratios; a zero denominator counts as one."""
    def over(d: str) -> Column:
        return F.when(F.col(d) == 0, 1).otherwise(F.col(d))

    return box.withColumns({
        "pitches_per_inning": F.col("pitches_thrown") / over("innings_pitched"),
        "strikeout_rate": F.col("strikeouts") / over("pitches_thrown"),
        "walk_rate": F.col("walks") / over("pitches_thrown"),
        "hit_rate": F.col("hits_allowed") / over("innings_pitched"),
        "era": F.col("earned_runs") * 9 / over("innings_pitched"),
    })


def fill_defaults(df: DataFrame, defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Null numbers to their default (0 unless given)."""
    numeric = {c: 0 for c, kind in df.dtypes if kind in ("int", "bigint", "double", "float", "smallint")}
    return df.fillna({**numeric, **(defaults or {})})


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def median_impute(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact medians of ``train``.

    Medians come from value counts of the long form (one job for all columns) and enter as
    one-row scalars, so no column is collected into a single aggregation buffer.
    """
    from moundwork.operators.aggregates import unpivot

    marks = ranking.percentiles(unpivot(train, [], columns), "value", {"median": 0.5}, ["feature"])
    wide = marks.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in columns])
    one_row = wide.select(F.struct(*columns)).scalar()
    return df.withColumn("_m", one_row).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m.{c}")) for c in columns}
    ).drop("_m")


def default_window(df: DataFrame, start: str, end: str, as_of: str, days: int = 30) -> DataFrame:
    """Missing end becomes ``as_of``, missing start ``days`` before the end."""
    last = F.coalesce(F.col(end), as_day(as_of))
    return df.withColumn(end, last).withColumn(start, F.coalesce(F.col(start), F.date_sub(F.col(end), days)))


def score_payload(scored: DataFrame, importances: Mapping[str, float], version: str = "v1") -> DataFrame:
    """Serving payload of calibrated scores: bucket, confidence, contributors, actions, map."""
    return scored.withColumns({
        "model_version": F.lit(version),
        "risk_bucket": risk_bucket(F.col("risk_score_calibrated")),
        "confidence": confidence_level(F.col("data_completeness_score")),
        "contributors": top_contributors(scored, importances),
        "recommended_actions": recommended_actions("risk_score_calibrated"),
        "data_completeness_map": completeness_map(scored.columns),
    })
