"""What keeps time and memory of a task down, read off the plans, and results worked out by hand."""

from __future__ import annotations

import datetime
import random
import re

from pyspark.sql import functions as F

from moundwork.functions import ranking
from moundwork.operators import aggregates, appearances, evaluation, rolling
from moundwork.plans import catalog
from tests.days import day


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def steps_of(df) -> list[str]:
    """Names of the operators of the physical plan, as they would run first."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line.lstrip(" :+-*(0123456789)").split("(")[0].split(" ")[0] for line in text.splitlines()]


def test_pregame_gaps_come_without_lambdas(spark):
    days = ["2024-03-01", "2024-03-02", "2024-03-20", "2024-03-25", "2024-03-30", "2024-06-30"]
    pitches = spark.createDataFrame(
        [(1, day(d), 90.0, 2200, "FF") for d in days],
        "pitcher_id int, game_date date, release_speed double, release_spin_rate int, pitch_type string")
    out = rolling.pregame_rolling(pitches)
    assert "lambdafunction" not in plan_of(out)
    rows = {r["game_date"]: r for r in out.collect()}
    last = rows[day("2024-03-30")]
    # 14 days: games of the 20th and 25th; the gap of 18 days before the 20th begins outside
    assert (last["min_rest_days_14d"], last["min_rest_days_30d"], last["min_rest_days_7d"]) == (5, 1, 0)
    assert rows[day("2024-06-30")]["min_rest_days_60d"] == 0 and rows[day("2024-03-01")]["min_rest_days_60d"] == 0


def test_queries_ask_for_methods_that_the_jvm_compiles(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    catalog.load()["daily_totals"].run(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def history_input(spark):
    random.seed(5)
    start = datetime.date(2019, 12, 1)
    days = sorted({start + datetime.timedelta(days=random.randrange(1900)) for _ in range(250)} - {
        datetime.date(2022, 1, 1) + datetime.timedelta(days=i) for i in range(365)} | {day("2020-02-29"), day("2024-02-29"), day("2023-02-28")})
    rows = [(p, d, 10, None if i % 9 == p else round(i % 7 + 0.3, 1)) for p in (1, 2) for i, d in enumerate(days)] + [(2, None, 10, 5.0)]
    games = spark.createDataFrame(rows, "pitcher_id int, game_date date, pitches_thrown int, innings_pitched double")
    return rows, games, spark.createDataFrame([(1, day("2020-05-01"))], "pitcher_id int, il_start date")


def test_history_sorts_once_and_matches_plain_sums(spark):
    rows, games, stints = history_input(spark)
    out = rolling.history_features(games, stints)
    assert steps_of(out).count("Sort") == 1
    for r in out.where("game_date IS NOT NULL").collect():
        d, own = r["game_date"], [(g, x) for p, g, _, x in rows if p == r["pitcher_id"] and g is not None and x is not None]
        ytd = [x for g, x in own if g.year == d.year and g <= d]
        before = [x for g, x in own if g.year == d.year - 1 and (g.month, g.day) <= (d.month, d.day)]
        assert (r["innings_ytd"] is None) == (not ytd)
        assert not ytd or abs(r["innings_ytd"] - sum(ytd)) < 1e-9
        assert abs(r["innings_last_ytd"] - sum(before)) < 1e-9
    undated = out.where("game_date IS NULL").first()
    assert (undated["innings_ytd"], undated["innings_last_ytd"]) == (5.0, 0.0)


def test_reaggregation_holds_no_table_of_games(spark):
    schema = "pitcher_id int, game_date date, pitches_thrown int, avg_vel double, avg_spin double, innings_pitched double"
    joined = spark.createDataFrame(
        [(1, day("2024-04-01"), 30, 91.0, 2200.0, 2.0)] * 3 + [(1, day("2024-04-05"), None, None, None, None)], schema)
    out = appearances.reaggregate_joined(joined)
    assert "HashAggregate" not in steps_of(out)
    assert out.columns == schema.replace(" int", "").replace(" date", "").replace(" double", "").split(", ")
    assert sorted(map(tuple, out.collect())) == [
        (1, day("2024-04-01"), 30, 91.0, 2200.0, 2.0), (1, day("2024-04-05"), None, None, None, None)]


def test_buckets_count_edges_without_lambdas(spark):
    edges = [2.0, 3.0, 5.0, 8.0, 13.0]
    for held in (edges, edges[:1], []):
        lit = F.array(*[F.lit(e) for e in held]) if held else F.array().cast("array<double>")
        out = ranking._with_bucket(spark.range(16).select(F.col("id").cast("double").alias("v")), "v", lit, len(held))
        assert "lambda" not in plan_of(out)
        assert all(r["_bucket"] == sum(e <= r["v"] for e in held) for r in out.collect())


def test_positions_with_values_shared_by_many_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking, "VALUES_PER_BUCKET", 3)
    df = spark.range(40).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("v"))
    rows = ranking.value_positions(df, "v", ["k"]).collect()
    assert len(rows) == 40 and all((r["n"], r["n_before"], r["n_total"]) == (1, r["v"], 20) for r in rows)


def test_marks_per_feature_are_looked_up_not_joined(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(9)] + [(100.0, None)], "a double, b double")
    out = aggregates.iqr_outliers(df, ["a", "b"])
    assert {(r["feature"], r["outliers"], r["rows"]) for r in out.collect()} == {("a", 1, 10), ("b", 0, 9)}
    empty = df.select("a", F.lit(None).cast("double").alias("b"))
    psi = evaluation.drift_psi(empty, df, ["a", "b"])  # b has no reference and so no edges
    assert {(r["feature"], r["drift"]) for r in psi.collect()} == {("a", False)}
    by_feature = re.compile(r"Join Inner, \(feature#\d+ = feature#\d+\)")
    assert not by_feature.search(plan_of(psi)) and not by_feature.search(plan_of(out))
