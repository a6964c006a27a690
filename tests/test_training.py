from __future__ import annotations

import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from moundwork.operators import evaluation, isotonic, scoring, selection, training


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(400).select(
        (F.col("id") % 20).cast("int").alias("pitcher_id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") / 20).cast("int")).alias("as_of_date"),
        (F.col("id") % 10).cast("double").alias("load"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("noise"),
        (F.col("id") % 10 >= 7).cast("int").alias("y"), F.when(F.col("id") % 2 == 0, "starter").otherwise("reliever").alias("role"))


def test_models_learn_and_reload(rows, spark, tmp_path):
    data = training.assemble_features(rows, ["load", "noise"])
    split = data.withColumn("held", F.col("as_of_date") > F.lit(dt.date(2024, 1, 16)))
    model = training.fit_gbt(split, depth=3, trees=8, held_out="held")
    scored = training.raw_scores(model, data)
    metrics = evaluation.all_metrics(scored, "risk_score_raw").first()
    assert metrics.roc_auc > 0.99
    weights = training.importances(model, ["load", "noise"])
    assert weights["load"] > weights["noise"]
    training.save_model(model, str(tmp_path / "m"))
    again = training.raw_scores(training.load_model(str(tmp_path / "m")), data)
    key = ["pitcher_id", "as_of_date"]
    assert scored.join(again.select(*key, F.col("risk_score_raw").alias("b")), key).where("abs(risk_score_raw - b) > 1e-12").count() == 0
    assert scored.where("risk_score_raw < 0 or risk_score_raw > 1").count() == 0
    linear = training.raw_scores(training.fit_logistic_balanced(data), data)
    assert evaluation.all_metrics(linear, "risk_score_raw").first().roc_auc > 0.95


def test_selection_of_features(rows):
    assert training.select_k_best(rows, ["noise", "load"], 1) == ["load"]
    f = {r.feature: r.f_value for r in evaluation.anova_f(rows, "y", ["noise", "load"]).collect()}
    assert f["load"] > f["noise"]


def test_role_calibration_falls_back(rows):
    raw = rows.withColumn("risk_score_raw", F.col("load") / 20)
    few = raw.where("role = 'starter' or (role = 'reliever' and pitcher_id = 1 and as_of_date < date'2024-01-05')")
    calibration = training.fit_isotonic(few)
    assert set(calibration.by_role) == {"starter"}
    out = training.apply_calibration(calibration, raw)
    assert out.where("risk_score_calibrated < 0 or risk_score_calibrated > 1").count() == 0
    assert out.where("role = 'starter' and load >= 8").agg(F.min("risk_score_calibrated")).first()[0] > 0.5


def max_min(points):
    """Value at every score by the formula, points as score -> (n, hits)."""
    order = sorted(points)

    def mean(a, b):
        n, hits = map(sum, zip(*(points[s] for s in order[a:b + 1])))
        return Fraction(hits, n)

    return {s: max(min(mean(a, b) for b in range(i, len(order))) for a in range(i + 1)) for i, s in enumerate(order)}


@pytest.mark.parametrize("block,fan", [(5, 2), (40, 3), (10_000, 64)])
def test_isotonic_pools_equal_the_formula(spark, block, fan):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice([0.5, round(rng.random(), 2)]), 0) for _ in range(700)]
    rows = [(k, s, int(rng.random() < 0.2 + 0.5 * s)) for k, s, _ in rows] + [("a", None, 1), ("b", 0.3, None), ("a", 0.4, None)]
    scored = spark.createDataFrame(rows, "role string, risk_score_raw double, y int").withColumns({"low": F.lit("x"), "block": F.lit("y"), "n": F.lit(1)})
    curve = isotonic.isotonic_curve(scored, keys=("role",), block=block, fan=fan).collect()
    assert {r.role for r in curve} == {"a", None}
    for role in ("a", None):
        points = {}
        for k, s, y in rows:
            if k == role and s is not None and y is not None:
                n, hits = points.get(s, (0, 0))
                points[s] = (n + 1, hits + y)
        want = {}
        for s, value in max_min(points).items():
            low, high, n, hits = want.get(value, (s, s, 0, 0))
            want[value] = (min(low, s), max(high, s), n + points[s][0], hits + points[s][1])
        assert sorted((r.low, r.high, r.n, r.hits) for r in curve if r.role == role) == sorted(want.values())
        assert all(r.value == r.hits / r.n for r in curve)
    assert isotonic.isotonic_curve(scored.where("false")).count() == 0


def test_oversampling_reaches_the_ratio(rows):
    skewed = rows.where("y = 0 or load = 9")
    out = {r.y: r["count"] for r in selection.oversample(skewed, "y", 0.5).groupBy("y").count().collect()}
    assert out[0] == 280 and abs(out[1] - 140) < 25


def test_payload(rows):
    scored = rows.withColumns({
        "risk_score_calibrated": F.col("load") / 10, "data_completeness_score": F.lit(0.9), "last_game_pitches": F.lit(120), "roll7d_pitch_count": F.lit(10),
        "vel_decline_7d_vs_30d": F.lit(-3.0), "avg_rest_days": F.lit(2.0), "roll7d_breaking_ball_pct": F.lit(0.9)})
    row = scoring.score_payload(scored, {"roll7d_pitch_count": 0.5, "load": 0.2}).first()
    assert len(row.recommended_actions) == 3 and [c.name for c in row.contributors] == ["roll7d_pitch_count", "load"]
    assert row.data_completeness_map["workload_data"] is True and row.data_completeness_map["spin_data"] is False
