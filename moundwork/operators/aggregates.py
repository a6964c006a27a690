"""Season, team, role and quality roll-ups.

League- and team-level lists are returned as rows with a rank, never as one array per team: a
team or a role may hold any share of the pitchers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundwork.functions import ranking
from moundwork.functions import windows as w
from moundwork.operators import lookups, rolling
from moundwork.operators.rolling import as_day
from moundwork.session import written_once


def season_counts(df: DataFrame, day: str = "game_date") -> DataFrame:
    """Rows and distinct pitchers per year; (year, pitcher) is collapsed first."""
    per = df.where(F.col(day).isNotNull()).groupBy(F.year(day).alias("season"), "pitcher_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return per.groupBy("season").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("pitchers"))


def season_summary(pitches: DataFrame) -> DataFrame:
    per = pitches.groupBy(F.year("game_date").alias("season"), "pitcher_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("release_speed").alias("_v"), F.count("release_speed").alias("_nv"),
        F.sum("release_spin_rate").alias("_s"), F.count("release_spin_rate").alias("_ns"),
    )
    return per.groupBy("season").agg(
        F.sum("_n").alias("pitch_count"), F.count(F.lit(1)).alias("unique_pitchers"),
        (F.sum("_v") / F.nullif(F.sum("_nv"), F.lit(0))).alias("avg_velocity"), (F.sum("_s") / F.nullif(F.sum("_ns"), F.lit(0))).alias("avg_spin"),
    )


def distribution_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, mean and population deviation of several columns in one pass."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(F.struct(
            F.lit(c).alias("metric"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"),
            F.stddev_pop(x).alias("std"), F.count(x).alias("count"),
        ))
    return df.agg(F.array(*parts).alias("m")).select(F.inline("m"))


def pitcher_season_stats(appearances: DataFrame) -> DataFrame:
    return appearances.groupBy("pitcher_id", F.year("game_date").alias("season")).agg(
        F.count(F.lit(1)).alias("appearances"), F.sum("pitches_thrown").alias("total_pitches"),
        F.avg("avg_vel").alias("avg_velocity"), F.sum("innings_pitched").alias("total_innings"),
    )


def pitcher_list_enriched(pitchers: DataFrame, appearances: DataFrame, scores: DataFrame, season: int) -> DataFrame:
    """Profile with newest game, games this season, newest speed, risk and the speed trend."""
    per = appearances.groupBy("pitcher_id").agg(
        F.max("game_date").alias("last_appearance"),
        F.count_if(F.year("game_date") == season).alias("season_appearances"),
        F.max_by("avg_vel", "game_date").alias("latest_velocity"),
    )
    this_season = appearances.where(F.year("game_date") == season)
    trend = rolling.trend_direction(this_season, "avg_vel").select("pitcher_id", F.col("trend").alias("velocity_trend"))
    newest = lookups.newest_row(scores.select("pitcher_id", "as_of_date", "score"), "as_of_date")
    return (
        pitchers.select("pitcher_id", "name", "team", "role")
        .join(per, "pitcher_id", "left").join(newest, "pitcher_id", "left").join(trend, "pitcher_id", "left")
        .fillna({"season_appearances": 0, "velocity_trend": "stable"})
    )


def pitcher_detail(pitchers: DataFrame, appearances: DataFrame, injuries: DataFrame, last: int = 20) -> DataFrame:
    """Season totals plus the newest games and the stints as arrays (both bounded per pitcher:
    ``last`` games, and one stint per day at most)."""
    totals = appearances.groupBy("pitcher_id").agg(
        F.count(F.lit(1)).alias("appearances"), F.sum("pitches_thrown").alias("total_pitches"),
        F.avg("avg_vel").alias("avg_velocity"), F.sum("innings_pitched").alias("total_innings"),
    )
    rank = F.row_number().over(Window.partitionBy("pitcher_id").orderBy(F.desc("game_date")))
    games = appearances.withColumn("_r", rank).where(F.col("_r") <= last).groupBy("pitcher_id").agg(
        F.sort_array(F.collect_list(F.struct("game_date", "pitches_thrown", "avg_vel")), asc=False).alias("recent_games")
    )
    stints = injuries.groupBy("pitcher_id").agg(
        F.sort_array(F.collect_list(F.struct("il_start", "il_end", "stint_type")), asc=False).alias("injury_history")
    )
    out = pitchers.select("pitcher_id", "name", "team", "role")
    for part in (totals, games, stints):
        out = out.join(part, "pitcher_id", "left")
    return out


def workload_summary(appearances: DataFrame, as_of: str, days: int = 21) -> DataFrame:
    """Counts and means of every pitcher over [as_of - days, as_of]."""
    inside = appearances.where(F.col("game_date").between(F.date_sub(as_day(as_of), days), as_day(as_of)))
    n = F.count(F.lit(1))
    return inside.groupBy("pitcher_id").agg(
        n.alias("appearances"), F.sum("pitches_thrown").alias("total_pitches"),
        F.avg("pitches_thrown").alias("avg_pitches_per_game"), F.max("pitches_thrown").alias("max_pitches_in_game"),
        F.avg("avg_vel").alias("avg_velocity"), F.sum("innings_pitched").alias("total_innings"),
        (F.sum("pitches_thrown") / F.lit(float(days))).alias("pitches_per_day"),
        (F.lit(float(days)) / F.greatest(F.lit(1), n) - 1).alias("rest_days_avg"),
    )


def team_workload_pitchers(pitchers: DataFrame, appearances: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Active pitchers of every team over the window with their rank by pitches in the team."""
    per = workload_summary(appearances, as_of, days).select(
        "pitcher_id", "appearances", F.col("total_pitches").alias("pitches"), "avg_velocity"
    )
    listed = pitchers.select("pitcher_id", "name", "team", "role").join(per, "pitcher_id")
    ranked = ranking.with_positions(listed, "pitches", ["team"])
    place = F.col("n_total") - F.col("n_before") - F.col("n") + 1
    return ranked.withColumn("team_rank", place).drop("n", "n_before", "n_total")


def team_workload_summary(pitchers: DataFrame, appearances: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    per = workload_summary(appearances, as_of, days)
    return pitchers.select("pitcher_id", "team").join(per, "pitcher_id", "left").groupBy("team").agg(
        F.coalesce(F.sum("appearances"), F.lit(0)).alias("total_appearances"),
        F.coalesce(F.sum("total_pitches"), F.lit(0)).alias("total_pitches"),
        F.coalesce(F.sum("total_pitches") / F.sum("appearances"), F.lit(0.0)).alias("avg_pitches_per_game"),
        F.count("appearances").alias("active_pitchers"), F.count(F.lit(1)).alias("total_pitchers"),
    )


def team_overview(
    pitchers: DataFrame, appearances: DataFrame, bucketed: DataFrame, as_of: str, recent_days: int = 7
) -> DataFrame:
    """Roster size, season totals, recent games and risk-level counts per team."""
    per = rolling.history_upto(appearances, as_of).groupBy("pitcher_id").agg(
        F.sum("pitches_thrown").alias("_p"), F.count(F.lit(1)).alias("_g"),
        F.count_if(F.col("game_date") >= F.date_sub(as_day(as_of), recent_days)).alias("_r"),
    )
    level = bucketed.select("pitcher_id", "risk_bucket")
    return (
        pitchers.select("pitcher_id", "team").join(per, "pitcher_id", "left").join(level, "pitcher_id", "left")
        .groupBy("team")
        .agg(
            F.count(F.lit(1)).alias("roster_size"),
            F.coalesce(F.sum("_p"), F.lit(0)).alias("total_pitches"),
            F.coalesce(F.sum("_p") / F.sum("_g"), F.lit(0.0)).alias("avg_pitches_per_game"),
            F.coalesce(F.sum("_g"), F.lit(0)).alias("total_appearances"),
            F.coalesce(F.sum("_r"), F.lit(0)).alias("recent_appearances"),
            *[F.count_if(F.col("risk_bucket") == b).alias(f"{b}_risk") for b in ("high", "medium", "low")],
        )
    )


def team_risk_members(latest: DataFrame) -> DataFrame:
    """Every pitcher with team, bucket (``no_data`` without a score) and rank by score inside both."""
    bucketed = latest.withColumn("bucket", F.coalesce("risk_bucket", F.lit("no_data")))
    ranked = ranking.with_positions(
        bucketed.withColumn("_score", F.coalesce("score", F.lit(-1.0))), "_score", ["team", "bucket"]
    )
    place = F.col("n_total") - F.col("n_before") - F.col("n") + 1
    return ranked.withColumn("bucket_rank", place).drop("n", "n_before", "n_total", "_score")


def team_risk_summary(latest: DataFrame) -> DataFrame:
    bucket = F.coalesce("risk_bucket", F.lit("no_data"))
    return latest.groupBy("team").agg(
        *[F.count_if(bucket == b).alias(b) for b in ("high", "medium", "low", "no_data")],
        F.avg("score").alias("mean_score"), F.max("score").alias("top_score"),
    )


def level_counts(df: DataFrame, level: str = "risk_bucket") -> DataFrame:
    return df.groupBy(level).agg(F.count(F.lit(1)).alias("pitchers"))


def positive_rates(df: DataFrame, label: str, keys: Sequence[str] = ("season", "role")) -> DataFrame:
    """Positive rate for every combination of the keys, with 'all' for the rolled-up levels."""
    cube = df.cube(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(label).alias("positives"), F.avg(label).alias("positive_rate"),
        *[F.grouping(k).alias(f"_g_{k}") for k in keys],
    )
    return cube.select(
        *[F.when(F.col(f"_g_{k}") == 1, "all").otherwise(F.col(k).cast("string")).alias(k) for k in keys],
        "samples", "positives", "positive_rate",
    )


def season_label_report(df: DataFrame, label: str) -> DataFrame:
    return df.rollup("season").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(label).alias("positives"), F.avg(label).alias("positive_rate")
    ).withColumn("season", F.coalesce(F.col("season").cast("string"), F.lit("all")))


def role_workload_percentiles(pitchers: DataFrame, appearances: DataFrame, as_of: str, days: int = 21) -> DataFrame:
    """Role means and exact quartiles of the pitchers' window totals."""
    per = _window_totals(pitchers, appearances, as_of, days)
    means = per.groupBy("role").agg(
        F.avg("total_pitches").alias("role_average_pitches"), F.avg("appearances").alias("role_average_appearances")
    )
    marks = ranking.percentiles(per, "total_pitches", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}, ["role"])
    return means.join(marks, "role")


def _window_totals(pitchers: DataFrame, appearances: DataFrame, as_of: str, days: int) -> DataFrame:
    per = workload_summary(appearances, as_of, days).select("pitcher_id", "appearances", "total_pitches")
    return pitchers.select("pitcher_id", "role").join(per, "pitcher_id")


def percentile_band(value: Column) -> Column:
    return (
        F.when(value >= F.col("p90"), 90).when(value >= F.col("p75"), 75).when(value >= F.col("p50"), 50)
        .when(value >= F.col("p25"), 25).otherwise(10)
    )


def compare_to_role(pitchers: DataFrame, appearances: DataFrame, as_of: str, days: int = 21) -> DataFrame:
    """Each pitcher's window load against the role: percentile band and its wording."""
    per = _window_totals(pitchers, appearances, as_of, days)
    marks = role_workload_percentiles(pitchers, appearances, as_of, days)
    band = F.col("percentile")
    return per.join(marks, "role").withColumn("percentile", percentile_band(F.col("total_pitches"))).withColumn(
        "comparison",
        F.when(band >= 90, "very high").when(band >= 75, "high").when(band >= 25, "average").otherwise("low"),
    )


def category_counts(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts and percentage share per value of several columns in one pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    counts = records.select(pairs.alias("p")).groupBy("p.category", "p.value").agg(F.count(F.lit(1)).alias("records"))
    share = F.col("records") * 100.0 / F.sum("records").over(Window.partitionBy("category"))
    return counts.withColumn("share_pct", share)


def confidence_distribution(records: DataFrame, scheme: str = "three", score: str = "confidence_score") -> DataFrame:
    """Counts per confidence bin; the four-bin scheme leaves a score of exactly 1 outside."""
    s = F.col(score)
    if scheme == "three":
        level = F.when(s >= 0.8, "high").when(s >= 0.6, "medium").otherwise("low")
    else:
        level = (
            F.when((s >= 0.0) & (s < 0.3), "Low").when((s >= 0.3) & (s < 0.6), "Medium")
            .when((s >= 0.6) & (s < 0.8), "High").when((s >= 0.8) & (s < 1.0), "Very High")
        )
    return records.withColumn("confidence_level", level).where(F.col("confidence_level").isNotNull()).groupBy(
        "confidence_level"
    ).agg(F.count(F.lit(1)).alias("records"))


def classification_rates(records: DataFrame) -> DataFrame:
    def known(c: str) -> Column:
        return F.avg((F.col(c) != "unknown").cast("double")) * 100

    return records.agg(
        F.count(F.lit(1)).alias("records"), known("injury_type").alias("type_rate"),
        known("injury_location").alias("location_rate"), known("severity").alias("severity_rate"),
        F.avg("confidence_score").alias("mean_confidence"),
    )


def date_range(records: DataFrame, day: str) -> DataFrame:
    return records.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def feature_means_by_class(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Class means, their difference and a normalised signal per feature, in one pass."""
    parts = []
    for f in features:
        p = F.avg(F.when(F.col(label) == 1, F.col(f).cast("double")))
        n = F.avg(F.when(F.col(label) == 0, F.col(f).cast("double")))
        parts.append(F.struct(
            F.lit(f).alias("feature"), p.alias("pos_mean"), n.alias("neg_mean"), (p - n).alias("difference"),
            (F.abs(p - n) / (F.abs(p) + F.abs(n) + 1e-8)).alias("signal_strength"),
        ))
    return df.agg(F.array(*parts).alias("m")).select(F.inline("m"))


def feature_variance(df: DataFrame, features: Sequence[str], low: float = 0.01) -> DataFrame:
    parts = [F.struct(F.lit(f).alias("feature"), F.var_samp(F.col(f).cast("double")).alias("variance")) for f in features]
    v = F.col("variance")
    level = F.when(v == 0, "zero").when(v < low, "low").otherwise("ok")
    return df.agg(F.array(*parts).alias("m")).select(F.inline("m")).withColumn("level", level)


def feature_family(name: Column) -> Column:
    return (
        F.when(name.contains("pitch_count"), "workload").when(name.contains("vel"), "velocity")
        .when(name.contains("fatigue"), "fatigue").otherwise("other")
    )


def feature_completeness(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null percentage per feature and the family's mean completeness."""
    parts = [
        F.struct(F.lit(f).alias("feature"), (F.avg(F.col(f).isNull().cast("double")) * 100).alias("null_pct"))
        for f in features
    ]
    flat = df.agg(F.array(*parts).alias("m")).select(F.inline("m")).withColumn("family", feature_family(F.col("feature")))
    mean = F.avg(F.lit(1.0) - F.col("null_pct") / 100).over(Window.partitionBy("family"))
    return flat.withColumn("family_completeness", mean)


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form (ids, feature, value) without nulls."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(ids), list(features), "feature", "value"
    ).where(F.col("value").isNotNull())


def iqr_outliers(df: DataFrame, features: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Rows outside [Q1 - reach * IQR, Q3 + reach * IQR] per feature.

    Quartiles and counts both come from per-feature value counts, so no feature column is
    gathered into one buffer.
    """
    long = unpivot(df, [], features)
    counted = written_once(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n")), "feature-counts")
    marks = _weighted_quartiles(counted)
    joined = counted.withColumn("_marks", ranking.lookup(marks, "feature")[F.col("feature")])
    q1, q3 = F.col("_marks.q1"), F.col("_marks.q3")
    outside = (F.col("value") < q1 - (q3 - q1) * reach) | (F.col("value") > q3 + (q3 - q1) * reach)
    return joined.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(outside, F.col("_n"))), F.lit(0)).alias("outliers"), F.sum("_n").alias("rows")
    ).withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("rows"))


def _weighted_quartiles(counted: DataFrame) -> DataFrame:
    return ranking.percentiles(counted, "value", {"q1": 0.25, "q3": 0.75}, ["feature"], weight="_n")


def feature_coverage(df: DataFrame, features: Sequence[str], need: float = 80.0, warn: float = 70.0) -> DataFrame:
    """Non-null share per feature and season with a flag below the two thresholds."""
    shares = df.groupBy("season").agg(
        *[(F.avg(F.col(f).isNotNull().cast("double")) * 100).alias(f) for f in features]
    )
    pct = F.col("coverage_pct")
    return shares.unpivot(["season"], list(features), "feature", "coverage_pct").withColumn(
        "flag", F.when(pct < warn, "fail").when(pct < need, "warn").otherwise("ok")
    )


def team_risk_trend(scores: DataFrame, pitchers: DataFrame) -> DataFrame:
    """Mean score per team and date, and the trend of the daily means per team."""
    daily = scores.select("pitcher_id", "as_of_date", "score").join(
        pitchers.select("pitcher_id", "team"), "pitcher_id"
    ).groupBy("team", "as_of_date").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("pitchers"))
    placed = daily.withColumn("_i", F.row_number().over(Window.partitionBy("team").orderBy("as_of_date")) - 1)
    x = F.col("_i").cast("double")
    return placed.groupBy("team").agg(
        F.count(F.lit(1)).alias("days"), F.avg("mean_score").alias("mean_score"),
        F.max_by("mean_score", "as_of_date").alias("latest_mean"),
        w.trend_label(F.coalesce(F.regr_slope("mean_score", x), F.lit(0.0)), F.stddev_pop("mean_score"), F.count(F.lit(1))).alias("trend"),
    )
