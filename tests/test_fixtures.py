"""Hand-computed cases for every convention that is easy to get wrong."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from days import day
from pyspark.sql import functions as F

from moundwork.functions import ranking, text
from moundwork.operators import appearances, evaluation, labels, quality, reports, rolling, scoring, selection
from moundwork.sources import landing, loading, tables

UNIT = [
    (12345, "2024-04-01", "FF", 94.5, 2450, 1, 123456789),
    (12345, "2024-04-01", "SL", 88.2, 2600, 2, 123456789),
    (12345, "2024-04-01", "CH", 85.1, 1800, 3, 123456790),
]
GAMES = [
    (12345, "2024-04-01", 85, 93.2, 2350, 5.0), (12345, "2024-04-05", 95, 94.1, 2400, 6.0), (12345, "2024-04-10", 90, 92.8, 2300, 5.5),
]


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_unit_pitches_to_appearance(make):
    row = only(appearances.pitches_to_appearances(make.pitches(UNIT)))
    assert (row.pitches_thrown, row.avg_vel, row.avg_spin, row.innings_pitched, row.outs_recorded) == (3, 89.27, 2283.33, 0.2, 0)


def test_single_pitch_deviation_is_zero_or_null(make):
    one = make.pitches(UNIT[:1])
    assert only(appearances.pitches_to_appearances(one)).vel_std == 0.0
    assert only(appearances.appearances_with_release(one.withColumns({c: F.lit(1.0) for c in ("release_pos_x", "release_pos_z", "release_extension")}))).vel_std is None


def test_last_pitch_variant_counts_at_bats(make):
    row = only(appearances.appearances_by_last_pitch(make.pitches(UNIT)))
    assert (row.pitches_thrown, row.at_bats) == (3, 2)
    assert row.vel_std == pytest.approx(4.7899, abs=1e-3)


def test_fan_out_is_not_counted(make):
    pitches = make.pitches(UNIT)
    games = appearances.pitches_to_appearances(pitches)
    assert only(appearances.reaggregate_joined(appearances.pitch_with_appearance(pitches, games))).pitches_thrown == 3


def test_rest_and_windows(make):
    games = make.games(GAMES)
    last = by(rolling.rest_days(games), "game_date")[day("2024-04-10")]
    assert (last.avg_rest_days, last.std_rest_days, last.min_rest_days, last.max_rest_days) == (4.5, 0.5, 4.0, 5.0)
    row = only(rolling.rolling_workload(games, "2024-04-30"))
    assert (row.roll7d_pitch_count, row.roll7d_appearances, row.roll30d_pitch_count) == (185, 2, 270)
    assert by(rolling.game_features(games), "game_date")[day("2024-04-10")].last_3_games_pitches == 270


def test_anchored_window_is_closed_and_half_open_is_not(make):
    games = make.games([(1, "2024-04-01", 10, 90, 2000, 1), (1, "2024-04-08", 20, 90, 2000, 1)])
    closed = by(rolling.game_features(games), "game_date")[day("2024-04-08")]
    half_open = by(rolling.time_rolling(games), "game_date")[day("2024-04-08")]
    assert (closed.roll7d_pitch_count, half_open.roll7d_pitch_count) == (30, 20)


def test_three_game_sum_needs_three_games(make):
    rows = [(1, d, n, 90, 2000, 5) for d, n in zip(("2024-04-01", "2024-04-05", "2024-04-10", "2024-04-15", "2024-04-20"), (85, 95, 90, 100, 88))]
    out = by(rolling.time_rolling(make.games(rows)), "game_date")
    assert out[day("2024-04-20")].roll3g_pitch_count == 278
    assert out[day("2024-04-05")].roll3g_pitch_count is None


def test_velocity_decline(make):
    rows = [(1, f"2024-04-{i + 1:02d}", 90, 95.0 - 0.5 * i, 2000, 5) for i in range(10)]
    games = make.games(rows)
    last = by(rolling.time_rolling(games), "game_date")[day("2024-04-10")]
    assert (last.avg_vel_7d, last.avg_vel_30d, last.vel_drop_vs_30d) == (92.0, 92.75, -0.75)
    trend = only(rolling.trend_direction(games, "avg_vel"))
    assert trend.slope == pytest.approx(-0.5)
    assert trend.trend == "decreasing"
    snap = by(rolling.snapshot_rolling(games), "as_of_date")[day("2024-04-10")]
    assert snap.roll21d_vel_decline == -4.5 and snap.vel_drop_21d == 4.5
    assert snap.vel_trend_slope == pytest.approx(0.5)


def test_back_to_back_week(make):
    rows = [(99999, f"2024-04-{i + 1:02d}", 120, 95.0, 2400, 8) for i in range(7)]
    last = by(rolling.game_features(make.games(rows)), "game_date")[day("2024-04-07")]
    assert (last.back_to_back_days_7d, last.roll7d_pitch_count) == (6, 840)


def test_gap_just_outside_the_window_is_not_back_to_back(make):
    rows = [(1, d, 10, 90, 2000, 1) for d in ("2024-04-01", "2024-04-02", "2024-04-09")]
    last = by(rolling.game_features(make.games(rows)), "game_date")[day("2024-04-09")]
    assert last.back_to_back_days_7d == 0


def test_roles(make):
    few = make.games([(1, "2024-04-01", 90, 90, 2000, 6), (1, "2024-04-06", 90, 90, 2000, 6)])
    assert {r.recent_role for r in rolling.game_features(few).collect()} == {"unknown"}
    long = make.games([(1, f"2024-04-{d:02d}", 90, 90, 2000, 6) for d in (1, 6, 11)])
    assert by(rolling.game_features(long), "game_date")[day("2024-04-11")].recent_role == "starter"


def test_gap_labels(make):
    start = day("2024-01-01")
    rows = [(1, (start + dt.timedelta(days=d)).isoformat(), 90, 90, 2000, 6) for d in (0, 21, 43)]
    out = labels.gap_label(make.games(rows)).orderBy("game_date").collect()
    assert [(r.gap_days, r.gap_label) for r in out] == [(21, 0), (22, 1), (None, 0)]


def test_forward_label_is_open_at_the_injury_day(make):
    days = ["2024-03-24", "2024-03-25", "2024-04-14", "2024-04-15", "2024-04-20"]
    games = make.games([(12345, d, 90, 90, 2000, 6) for d in days])
    hurt = make.injuries([(12345, "2024-04-15", "2024-05-30"), (7, "2024-03-25", None)])
    out = by(labels.label_forward(games, hurt), "game_date")
    assert [out[day(d)].label_21d for d in days] == [0, 1, 1, 0, 0]


def test_blackout_wins(make):
    hurt = make.injuries([(1, "2024-05-10", None)])
    games = make.games([(1, (day("2024-05-10") - dt.timedelta(days=d)).isoformat(), 90, 90, 2000, 6) for d in (0, 3, 4, 21, 22)])
    kept = labels.label_with_blackout(games, hurt, keep=True)
    out = {(day("2024-05-10") - r.game_date).days: r.injury_within_21d for r in kept.collect()}
    assert out == {0: None, 3: None, 4: 1, 21: 1, 22: 0}
    assert labels.label_with_blackout(games, hurt).count() == 3


def test_pre_injury_rows_repeat_per_stint(make):
    games = make.games([(1, "2024-05-01", 90, 90, 2000, 6)])
    hurt = make.injuries([(1, "2024-05-05", None), (1, "2024-05-10", None)])
    assert labels.pre_injury_appearances(games, hurt).count() == 2
    assert labels.pre_injury_appearances(games, hurt, distinct=True).count() == 1
    assert labels.last_n_before_injury(games, hurt, 5).count() == 2


def test_ewm_closed_form(make, spark):
    def window(values):
        rows = [(1, "2024-04-01", "FF", float(v), 2000, i + 1, 1) for i, v in enumerate(values)]
        pitches = make.pitches(rows)
        return only(rolling.ewm_features(pitches, rolling.last_pitch_day(pitches, "2024-04-30"), metrics=("release_speed",)))

    flat = window([95.0] * 20)
    assert flat.roll7d_release_speed_ewm_mean == 95.0 and flat.roll7d_release_speed_ewm_std == 0.0
    short = window([95.0] * 19)
    assert short.roll7d_release_speed_ewm_mean == 0.0
    weights = [0.75 ** (20 - k) for k in range(1, 21)]
    expected = sum(wt * k for wt, k in zip(weights, range(1, 21))) / sum(weights)
    ramp = window(range(1, 21))
    assert ramp.roll7d_release_speed_ewm_mean == pytest.approx(expected)
    mean_square = sum(wt * k * k for wt, k in zip(weights, range(1, 21))) / sum(weights) - expected**2
    unbias = sum(weights) ** 2 / (sum(weights) ** 2 - sum(wt * wt for wt in weights))
    assert ramp.roll7d_release_speed_ewm_std == pytest.approx(math.sqrt(mean_square * unbias))
    assert ramp.roll7d_release_speed_delta_vs_30d == pytest.approx(expected - 10.5)
    assert ramp.roll30d_release_speed_delta_vs_30d == 0.0


def test_injury_texts(spark):
    rows = [
        (1, "Right forearm tightness"), (2, "Torn labrum, out for season"), (3, "Tommy John recovery"),
        (4, "10-day IL, left hamstring strain"), (5, ""),
    ]
    parsed = by(reports.parse_injury_text(spark.createDataFrame(rows, "i int, note string"), "note"), "i")
    got = {i: (r.injury_location, r.injury_type, r.severity) for i, r in parsed.items()}
    assert got[1] == ("elbow", "soreness", "mild")
    assert got[2] == ("shoulder", "tear", "severe")
    assert got[3][0] == "elbow" and parsed[3].parsing_method == "none+medical"
    assert got[4] == ("hamstring", "strain", "mild")
    assert got[5] == ("unknown", "unknown", "unknown") and parsed[5].confidence_score == 0.0


def test_injury_dates(spark):
    ref = day("2024-06-01")
    cases = {
        "on 04/15/2024": day("2024-04-15"), "4/15": day("2024-04-15"), "2024-04-15": ref, "April 15, 2024": ref,
        "yesterday": day("2024-05-31"), "last week": day("2024-05-25"), "13/45/2024": ref,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    out = df.select("t", text.extract_injury_date(F.col("t"), F.lit(ref)).alias("d")).collect()
    assert {r.t: r.d for r in out} == cases


def test_dates_in_many_formats(spark):
    ref = day("2024-06-01")
    cases = {
        "04/15/2024": day("2024-04-15"), "2024-04-15": day("2024-04-15"), "4/15/24": day("2024-04-15"), "4/15/99": day("1999-04-15"),
        "April 15, 2024": day("2024-04-15"), "2024-04-15T10:00:00Z": day("2024-04-15"), "04-15-2024": day("2024-04-15"),
        "25/12/2023": day("2023-12-25"), "TBD": ref, "soon": ref,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    out = df.select("t", text.parse_date_multi(F.col("t"), F.lit(ref)).alias("d")).collect()
    assert {r.t: r.d for r in out} == cases


def test_names_and_transactions(spark):
    names = spark.createDataFrame([("John Smith",), ("Mary-Jones",), ("john smith",), ("Al",), ("J. Smith",)], "n string")
    assert [r[0] for r in names.select(text.looks_like_name(F.col("n"))).collect()] == [True, True, False, False, False]
    moves = spark.createDataFrame([(1, "A", "2024-04-01", "Filed for arbitration"), (2, "B", "2024-04-01", "Signed")],
                                  "player_id int, player_name string, date string, description string")
    assert [r.pitcher_id for r in landing.il_transactions(moves).collect()] == [1]


def test_element_parsing(spark):
    df = spark.createDataFrame([("x\nJohn Stout\nout with strain\nJohn Stout",), ("no name\nout",), ("Al Moe\nfine",)], "content string")
    out = landing.parse_element(df).collect()
    assert [(r.player_name, r.injury_info) for r in out] == [("John Stout", "John Stout")]


def test_html_rows_without_closing_tags(spark):
    html = "<table><tr><th>h</table><TABLE class=x><tr><th>a<th>b<th>c<th>d<tr><td>Al &amp; Bo<td>P<td>elbow<td><b>out</b><tr><td>1<td>2</table>"
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    assert [r.cells for r in landing.injury_table_rows(df).collect()] == [["Al & Bo", "P", "elbow", "out"]]


def test_duplicates_and_replay(make):
    twice = make.pitches(UNIT + UNIT)
    gate = by(quality.gate_duplicates(twice), "check")
    assert gate["duplicate_pct"].observed == 50.0 and gate["duplicate_groups"].observed == 3.0
    base = make.pitches(UNIT)
    assert loading.idempotent_load(base, base, loading.PITCH_KEY).count() == 0
    assert loading.idempotent_load(twice, base.limit(0), loading.PITCH_KEY).count() == 3
    assert loading.idempotent_load(twice, base.limit(0), loading.PITCH_KEY, dedup_batch=False).count() == 6


def test_bounds(make):
    speeds = [50.0, 95.5, 110.0, 49.9, 110.1, -5.0]
    rows = [(1, "2024-04-15", "FF", v, 2000, i + 1, 1) for i, v in enumerate(speeds)]
    rows += [(1, "2024-04-15", "FF", 95.0, s, 9, 2 + i) for i, s in enumerate((0, 2000, 3500, -1, 3501, 5000))]
    rows += [(1, "2014-12-31", "FF", 95.0, 2000, 1, 20)]
    out = by(quality.check_constraints(make.pitches(rows), quality.constraints("pitches")), "rule")
    assert {k: v.violations for k, v in out.items()} == {
        "chk_release_speed": 3, "chk_release_spin": 3, "chk_pitch_number": 0, "chk_game_date": 1}
    good, bad = quality.split_valid(make.pitches(rows), quality.constraints("pitches"))
    assert (good.count(), bad.count()) == (6, 7)


def test_training_stops_on_failed_error_gate(make):
    gates = quality.gate_duplicates(make.pitches(UNIT))
    assert quality.may_train(gates)
    assert not quality.may_train(quality.gate_duplicates(make.pitches(UNIT + UNIT)))


def test_ranking_metrics_with_ties(make):
    scored = make.scored([1, 0, 1, 0], [0.9, 0.8, 0.4, 0.4])
    row = only(evaluation.all_metrics(scored))
    assert row.roc_auc == pytest.approx(0.625)
    assert row.brier == pytest.approx(0.2925)
    assert row.average_precision == pytest.approx(0.5 * 1 + 0.5 * 0.5)


def test_time_split_keeps_dates_whole(spark):
    start = day("2024-01-01")
    rows = [(p, start + dt.timedelta(days=i), int(i >= 95)) for i in range(100) for p in (1, 2)]
    out = selection.time_split(spark.createDataFrame(rows, "pitcher_id int, as_of_date date, y int"))
    spans = {r.split: (r.a, r.b) for r in out.groupBy("split").agg(F.min("as_of_date").alias("a"), F.max("as_of_date").alias("b")).collect()}
    assert spans["train"][1] < spans["validation"][0]
    assert out.where("split = 'train'").count() == 160


def test_percentiles_match_linear_interpolation(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=301).round(1), "b": np.repeat(7.0, 50), "c": np.array([1.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, x double")
    out = by(ranking.percentiles(df, "x", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, ["k"]), "k")
    for k, v in values.items():
        assert [out[k].p10, out[k].p50, out[k].p95] == pytest.approx(list(np.percentile(v, [10, 50, 95])))


def test_row_numbers_are_a_permutation(spark):
    rows = [(s / 4, p, day("2024-01-01") + dt.timedelta(days=i)) for s in range(3) for p in range(5) for i in range(7)]
    df = spark.createDataFrame(rows, "score double, pitcher_id int, as_of_date date")
    out = ranking.global_row_number(df, "score", "pitcher_id", "as_of_date").orderBy("rn").collect()
    assert [r.rn for r in out] == list(range(1, len(rows) + 1))
    expected = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    assert [(r.score, r.pitcher_id, r.as_of_date) for r in out] == expected
    tiles = spark.range(1, 24).select(ranking.ntile(F.col("id"), F.lit(23), 5).alias("t")).groupBy("t").count().orderBy("t").collect()
    assert [r["count"] for r in tiles] == [5, 5, 5, 4, 4]


def test_payload_rules(spark):
    df = spark.createDataFrame([(350, 1.5, 1, 0.9), (10, 0.0, 0, 0.0)], "roll21d_pitch_count int, roll21d_vel_decline double, days_since_last_appearance int, fatigue_score double")
    out = df.withColumn("risk_factors", scoring.risk_factors()).withColumn("primary_concerns", scoring.primary_concerns()).collect()
    assert out[0].primary_concerns == ["Velocity decline", "High 21-day pitch count", "High fatigue score"]
    assert [f.factor for f in out[0].risk_factors] == ["High 21-day pitch count", "Velocity decline", "Insufficient rest", "High fatigue score"]
    assert out[1].risk_factors == [] and out[1].primary_concerns == []


def test_no_history_gives_the_default_assessment(make, spark):
    pitchers = spark.createDataFrame([(12345, "A", "NYM", "starter"), (5, "B", "NYM", "reliever")], "pitcher_id int, name string, team string, role string")
    out = by(scoring.risk_assessment(pitchers, make.games(GAMES), "2024-04-30"), "pitcher_id")
    assert out[5].risk_score == 0.5 and out[5].risk_level == "medium" and out[5].last_appearance is None
    assert out[12345].primary_concerns == ["Insufficient data for assessment"] and out[12345].last_appearance == day("2024-04-10")


def test_fuzzy_names_take_the_smallest_id(spark):
    pitchers = spark.createDataFrame([(3, "Ann Stone", "BOS"), (9, "Bob Stonewall", "NYM")], "pitcher_id int, name string, team string")
    seen = spark.createDataFrame([("Ann Stone", "BOS"), ("Q. Stone", "X"), ("wall", "X"), ("Zed Kay", "X")], "player_name string, team string")
    out = by(reports.resolve_pitcher_ids(seen, pitchers), "player_name")
    assert {k: (v.pitcher_id, v.match) for k, v in out.items()} == {
        "Ann Stone": ("3", "exact"), "Q. Stone": ("3", "fuzzy"), "wall": ("9", "fuzzy"),
        "Zed Kay": (out["Zed Kay"].pitcher_id, "surrogate")}
    assert out["Zed Kay"].pitcher_id.startswith("temp_")


def test_round_trip_keeps_types(spark, make, tmp_path):
    pitches = make.pitches(UNIT)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        tables.write_table(pitches, path, fmt)
        back = tables.read_table(spark, path, "pitches", fmt)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pitches.collect()))


def test_loaded_period_is_skipped(make):
    pitches = make.pitches(UNIT)
    assert loading.is_loaded(pitches, "2024-04-01", "2024-04-30")
    assert not loading.is_loaded(pitches, "2024-05-01", "2024-05-31")


def test_metrics_without_positives_are_null(make):
    row = only(evaluation.all_metrics(make.scored([0, 0, 0], [0.9, 0.8, 0.4])))
    assert row.roc_auc is None and row.average_precision is None and row.recall_top_10 is None
    assert row.lift_top_10 == 0.0 and row.brier == pytest.approx((0.81 + 0.64 + 0.16) / 3)


def test_windows_without_any_speed(make):
    """Missing speeds give nulls or defaults, never a failed division."""
    pitches = make.pitches([(1, d, "FF", None, None, 1, i) for i, d in enumerate(("2024-04-01", "2024-04-03"))])
    later = by(rolling.pregame_rolling(pitches), "game_date")[day("2024-04-03")]
    assert later.pitch_count_7d == 1 and later.avg_velocity_7d is None
    ewm = only(rolling.ewm_features(pitches, rolling.last_pitch_day(pitches, "2024-05-01"), min_pitches=1))
    assert ewm.roll7d_release_speed_ewm_mean is None
    assert only(appearances.appearances_by_last_pitch(pitches).where("game_date = '2024-04-01'")).avg_vel is None
