"""Properties that must hold on any data: no leakage, partition independence, skew."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from moundwork.operators import evaluation, labels, rolling, scoring
from moundwork.operators.appearances import pitches_to_appearances
from moundwork.plans.registry import Tables

AS_OF = "2000-06-30"


@pytest.fixture(scope="module")
def t(spark, folder):
    return Tables(spark, folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_windows_grow_with_length(t):
    f = rolling.game_features(t.appearances)
    wrong = f.where("roll7d_pitch_count > roll14d_pitch_count or roll14d_pitch_count > roll30d_pitch_count")
    assert wrong.count() == 0


def test_shares_stay_in_unit_interval(t):
    mix = rolling.pitch_mix(t.pitches, rolling.last_pitch_day(t.pitches, AS_OF))
    share = F.col("roll30d_breaking_ball_pct") + F.col("roll30d_fastball_pct") + F.col("roll30d_off_speed_pct")
    assert mix.where((share < 0.999) | (share > 1.001)).count() == 0


def test_features_ignore_the_future(t):
    """Changing everything after the as-of date leaves the features alone."""
    later = F.col("game_date") > F.lit(AS_OF).cast("date")
    games = t.appearances.withColumn("pitches_thrown", F.when(later, 9999).otherwise(F.col("pitches_thrown")))
    pitches = t.pitches.withColumn("release_speed", F.when(later, 1.0).otherwise(F.col("release_speed")))
    before = rolling.engineered_features(t.appearances, t.pitches, AS_OF, 3)
    after = rolling.engineered_features(games, pitches, AS_OF, 3)
    assert rows(before) == rows(after)
    assert rows(rolling.snapshot_rolling_asof(t.appearances, AS_OF)) == rows(rolling.snapshot_rolling_asof(games, AS_OF))


def test_asof_and_series_snapshots_agree(t):
    """On a game day the two forms of the snapshot are the same numbers."""
    series = scoring.heuristic_score(rolling.snapshot_rolling(t.appearances))
    day = series.groupBy("as_of_date").count().orderBy(F.desc("count"), "as_of_date").first()["as_of_date"]
    single = scoring.heuristic_score(rolling.snapshot_rolling_asof(t.appearances, day.isoformat()))
    both = series.where(F.col("as_of_date") == F.lit(day)).select("pitcher_id", F.col("score").alias("a"), F.col("roll21d_pitch_count").alias("b")).join(
        single.select("pitcher_id", "score", "roll21d_pitch_count"), "pitcher_id")
    assert both.count() > 0
    assert both.where("a != score or b != roll21d_pitch_count").count() == 0


def test_grid_features_agree_with_single_dates(t):
    grid = rolling.snapshot_grid(t.appearances, step=14)
    every = rolling.training_features(t.appearances, t.pitches, grid, 3)
    picked = every.groupBy("as_of_date").count().orderBy(F.desc("count"), "as_of_date").first()["as_of_date"]
    one = rolling.engineered_features(t.appearances, t.pitches, picked.isoformat(), 3)
    names = ["pitcher_id", "roll7d_pitch_count", "roll14d_release_speed_ewm_mean", "roll30d_breaking_ball_pct", "days_since_last_appearance"]
    left = rows(every.where(F.col("as_of_date") == F.lit(picked)).select(*names))
    right = {r[0]: r for r in rows(one.select(*names))}
    assert left
    for row in left:
        assert row == pytest.approx(right[row[0]])


def test_results_do_not_depend_on_partitions(t, spark):
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            labelled = labels.label_forward(rolling.snapshot_rolling(t.appearances), t.injuries, day="as_of_date")
            scored = scoring.heuristic_score(labelled).withColumnRenamed("label_21d", "y")
            return rows(evaluation.topk_fraction_metrics(scored)) + rows(scoring.cohort_percentile(scored.withColumn("role", F.lit("x"))).select("pitcher_id", "as_of_date", "cohort_percentile"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert run("1") == run("7")


def test_label_counts_ignore_row_order(t):
    base = labels.label_with_blackout(t.appearances, t.injuries)
    shuffled = labels.label_with_blackout(t.appearances.orderBy(F.xxhash64("pitcher_id", "game_date")), t.injuries)
    assert rows(base.groupBy("injury_within_21d").count()) == rows(shuffled.groupBy("injury_within_21d").count())


def test_one_pitcher_with_a_third_of_all_rows(spark):
    """A hot pitcher and a hot score value give the same numbers as plain arithmetic."""
    n = 30_000
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 200 + 2)).cast("int").alias("pitcher_id"),
        F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 1000).cast("int")).alias("game_date"),
        F.lit("FF").alias("pitch_type"), (F.lit(90.0) + F.col("id") % 8).alias("release_speed"),
        F.lit(2200).alias("release_spin_rate"), (F.col("id") % 5 + 1).cast("int").alias("pitch_number"), F.col("id").alias("at_bat_id"))
    games = pitches_to_appearances(base)
    hot = games.where("pitcher_id = 1").agg(F.sum("pitches_thrown")).first()[0]
    assert hot == n // 3
    anchors = rolling.last_pitch_day(base, "2010-01-01")
    ewm = rolling.ewm_features(base, anchors, metrics=("release_speed",)).where("pitcher_id = 1").first()
    local = base.where("pitcher_id = 1 and game_date >= date'2002-08-27'").toPandas().sort_values(["game_date", "pitch_number", "at_bat_id"])
    last = local.game_date.max()
    week = local[local.game_date >= last - dt.timedelta(days=7)].release_speed
    assert ewm.roll7d_release_speed_ewm_mean == pytest.approx(week.ewm(span=7).mean().iloc[-1])
    assert ewm.roll7d_release_speed_ewm_std == pytest.approx(week.ewm(span=7).std().iloc[-1])
    scored = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / n).alias("score"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    auc = evaluation.ranking_metrics(scored).first()["roc_auc"]
    local = scored.toPandas()
    ranks = local.score.rank()
    p = local.y.sum()
    assert auc == pytest.approx((ranks[local.y == 1].sum() - p * (p + 1) / 2) / (p * (n - p)))
