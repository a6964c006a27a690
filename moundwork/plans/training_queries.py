"""Model fitting and scoring queries (fitted numbers have no check SQL)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from moundwork.operators import evaluation, isotonic, labels, rolling, scoring, training
from moundwork.plans.aggregate_queries import FEATURES
from moundwork.plans.label_queries import labelled
from moundwork.plans.registry import query, sql_table
from moundwork.session import written_once

TRAIN_END, CALIBRATION_END = "1999-06-30", "2000-06-30"
TREES, DEPTH = 100, 6


def grid_rows(t):
    """Labelled feature rows on the as-of grid, with the profile's role: the columns that models and payload read.

    Label and role join the narrow grid, so the wide rows are not moved for them.
    """
    grid = rolling.snapshot_grid(t.appearances, step=14).select("pitcher_id", "as_of_date", "last_game")
    flagged = labels.label_forward(grid, t.injuries, (21,), day="as_of_date").withColumnRenamed("label_21d", "y")
    flagged = flagged.join(t.pitchers.select("pitcher_id", "role"), "pitcher_id")
    features = rolling.training_features(t.appearances, t.pitches, flagged, min_pitches=3, keep=("y", "role"))
    return features.select("pitcher_id", "as_of_date", "y", "role", *training.model_columns(features))


def snapshot_rows(t):
    return written_once(labelled(t), "labelled-snapshots")


def three_blocks(df):
    return (
        evaluation.in_range(df, end=TRAIN_END),
        evaluation.in_range(df, TRAIN_END, CALIBRATION_END).where(F.col("as_of_date") > F.lit(TRAIN_END).cast("date")),
        df.where(F.col("as_of_date") > F.lit(CALIBRATION_END).cast("date")),
    )


@query("assemble_features", "pitcher_id:n as_of_date:d y:n size:n first_value:r")
def _(t):
    rows = grid_rows(t)
    columns = training.model_columns(rows)
    vector = vector_to_array("features")
    return training.assemble_features(rows, columns).withColumns({"size": F.size(vector), "first_value": vector[0]})


@query("scale_features", "pitcher_id:n as_of_date:d scaled_load:r scaled_fatigue:r", f"""
SELECT pitcher_id, as_of_date, (coalesce({FEATURES[0]}, 0) - m0) / s0 AS scaled_load, (coalesce({FEATURES[4]}, 0) - m4) / s4 AS scaled_fatigue
FROM labelled_snapshots, (SELECT avg(coalesce({FEATURES[0]}, 0)) AS m0, stddev_samp(coalesce({FEATURES[0]}, 0)) AS s0,
    avg(coalesce({FEATURES[4]}, 0)) AS m4, stddev_samp(coalesce({FEATURES[4]}, 0)) AS s4 FROM labelled_snapshots WHERE as_of_date <= DATE '{TRAIN_END}')
WHERE as_of_date > DATE '{CALIBRATION_END}'""", "labelled_snapshots")
def _(t):
    rows = training.assemble_features(snapshot_rows(t), FEATURES)
    train, _, test = three_blocks(rows)
    scaled = vector_to_array("scaled")
    return training.scaler().fit(train).transform(test).withColumns({"scaled_load": scaled[0], "scaled_fatigue": scaled[4]})


@query("select_k_best", "place:n feature:s", f"""
SELECT row_number() OVER (ORDER BY list_position([{', '.join(repr(f) for f in FEATURES)}], feature)) AS place, feature
FROM (SELECT feature FROM anova ORDER BY f_value DESC LIMIT 3)""", "anova")
def _(t):
    best = training.select_k_best(snapshot_rows(t), list(FEATURES), 3)
    in_order = sorted(best, key=FEATURES.index)  # the selector's own order is not documented
    return t.spark.createDataFrame(list(enumerate(in_order, 1)), "place int, feature string")


def payload(t, fit):
    """Scores of the newest block by a model that ``fit(train, held)`` learns from the older two."""
    rows = written_once(grid_rows(t), "training-rows")
    columns = training.model_columns(rows)
    train, held, test = three_blocks(training.assemble_features(rows, columns))
    model = fit(train, held)
    calibration = training.fit_isotonic(training.raw_scores(model, held))
    scored = training.apply_calibration(calibration, training.raw_scores(model, test))
    return scoring.score_payload(scored, training.importances(model, columns))


PAYLOAD = ("pitcher_id:n as_of_date:d role:s risk_score_raw:r risk_score_calibrated:r risk_bucket:s confidence:s top_feature:s actions:s "
           "has_velocity:b y:n")


def flat(df):
    return df.withColumns({
        "top_feature": F.get("contributors", 0)["name"], "actions": F.concat_ws("|", "recommended_actions"),
        "has_velocity": F.col("data_completeness_map")["velocity_data"],
    })


@query("fit_gbt_score_batch", PAYLOAD)
def _(t):
    def fit(train, held):
        # The held-out block ends the boosting once more trees no longer help on it.
        marked = train.withColumn("held_out", F.lit(False)).unionByName(held.withColumn("held_out", F.lit(True)))
        return training.fit_gbt(marked, depth=DEPTH, trees=TREES, held_out="held_out")

    return flat(payload(t, fit))


@query("fit_logistic_score_batch", PAYLOAD)
def _(t):
    return flat(payload(t, lambda train, held: training.fit_logistic_balanced(train)))


# The max-min formula: the value at a score is the largest, over all beginnings at or below it, of the smallest mean
# up to an end at or above it.
sql_table("calibration_rows", f"""
SELECT p.role, l.score AS s, l.y, l.as_of_date FROM labelled_snapshots l JOIN pitchers p ON l.pitcher_id = p.pitcher_id
WHERE l.as_of_date > DATE '{TRAIN_END}'""", "labelled_snapshots", "pitchers")
sql_table("isotonic_points", f"""
SELECT curve, s, row_number() OVER w AS i, n, h, sum(n) OVER w AS cn, sum(h) OVER w AS ch
FROM (SELECT curve, s, count(*) AS n, sum(y) AS h
  FROM (SELECT s, y, unnest(CASE WHEN role IN ('starter', 'reliever') THEN ['all', role] ELSE ['all'] END) AS curve
    FROM calibration_rows WHERE as_of_date <= DATE '{CALIBRATION_END}') GROUP BY ALL)
WINDOW w AS (PARTITION BY curve ORDER BY s)""", "calibration_rows")
sql_table("isotonic_values", """
SELECT curve, i, max(least_mean) AS value
FROM (SELECT a.curve, b.i, min((b.ch - a.ch + a.h)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE)
    OVER (PARTITION BY a.curve, a.i ORDER BY b.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least_mean
  FROM isotonic_points a JOIN isotonic_points b ON a.curve = b.curve AND b.i >= a.i) GROUP BY 1, 2""", "isotonic_points")
sql_table("isotonic_fit", """
SELECT p.curve, p.s, p.n, p.h, v.value FROM isotonic_points p JOIN isotonic_values v ON p.curve = v.curve AND p.i = v.i""",
          "isotonic_points", "isotonic_values")


def calibration_blocks(t):
    rows = snapshot_rows(t).join(t.pitchers.select("pitcher_id", "role"), "pitcher_id").withColumn("risk_score_raw", F.col("score"))
    return three_blocks(rows)


@query("isotonic_curve", "curve:s low:r high:r n:n hits:n value:r", """
SELECT curve, min(s) AS low, max(s) AS high, sum(n) AS n, sum(h) AS hits, value FROM isotonic_fit GROUP BY curve, value""", "isotonic_fit")
def _(t):
    _, held, _ = calibration_blocks(t)
    curves = F.when(F.col("role").isin("starter", "reliever"), F.array(F.lit("all"), F.col("role"))).otherwise(F.array(F.lit("all")))
    return isotonic.isotonic_curve(held.withColumn("curve", F.explode(curves)), keys=("curve",))


@query("isotonic_calibration", "role:s samples:n raw_brier:r calibrated_brier:r", f"""
WITH known AS (SELECT curve FROM isotonic_fit GROUP BY 1 HAVING curve = 'all' OR sum(n) > 10),
ends AS (SELECT curve, s, value, lead(s) OVER w AS next_s, lead(value) OVER w AS next_value FROM isotonic_fit
  WINDOW w AS (PARTITION BY curve ORDER BY s)),
test AS (SELECT role, s, y, CASE WHEN role IN (SELECT curve FROM known) THEN role ELSE 'all' END AS curve
  FROM calibration_rows WHERE as_of_date > DATE '{CALIBRATION_END}'),
least_ends AS (SELECT curve, arg_min(value, s) AS value FROM ends GROUP BY 1),
judged AS (SELECT t.role, t.s, t.y, CASE WHEN e.s IS NULL THEN f.value WHEN e.next_s IS NULL OR t.s = e.s THEN e.value
    ELSE e.value + (e.next_value - e.value) * (t.s - e.s) / (e.next_s - e.s) END AS p
  FROM test t ASOF LEFT JOIN ends e ON t.curve = e.curve AND t.s >= e.s JOIN least_ends f ON t.curve = f.curve)
SELECT role, count(*) AS samples, avg((s - y) * (s - y)) AS raw_brier, avg((p - y) * (p - y)) AS calibrated_brier FROM judged GROUP BY 1""",
       "isotonic_fit calibration_rows")
def _(t):
    _, held, test = calibration_blocks(t)
    out = training.apply_calibration(training.fit_isotonic(held), test)
    error = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    return out.groupBy("role").agg(
        F.count("*").alias("samples"), error("risk_score_raw").alias("raw_brier"), error("risk_score_calibrated").alias("calibrated_brier"))


@query("backtest_with_model", "block:s samples:n positives:n roc_auc:r average_precision:r brier:r ece:r")
def _(t):
    """Logistic baseline refitted per season on all earlier seasons."""
    rows = training.assemble_features(snapshot_rows(t), FEATURES).withColumn("block", F.year("as_of_date").cast("string"))
    span = rows.agg(F.min("block").alias("a"), F.max("block").alias("b")).first()
    blocks = [str(year) for year in range(int(span["a"]), int(span["b"]) + 1)]

    def fit(train):
        model = training.fit_logistic_balanced(train)
        return lambda test: training.raw_scores(model, test).select(
            "pitcher_id", "as_of_date", "y", "block", F.col("risk_score_raw").alias("score"))

    return evaluation.backtest_with_model(rows, blocks, fit)
