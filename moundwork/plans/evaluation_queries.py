"""Queries for metrics, backtests and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from moundwork.operators import evaluation as op
from moundwork.operators import rolling
from moundwork.plans.aggregate_queries import FEATURES
from moundwork.plans.label_queries import CUT, labelled, scores_of, stored_labelled, stored_scores
from moundwork.plans.registry import query, sql_table
from moundwork.session import written_once

EDGES = [repr(i * 0.1) for i in range(1, 10)]
BIN = " + ".join(f"CAST(score > {e}::DOUBLE AS INTEGER)" for e in EDGES)

sql_table("y0", """SELECT l.*, 1 AS grp, year(as_of_date) || 'Q' || quarter(as_of_date) AS block, least(workload_intensity / 2, 1) AS load_score, role
FROM labelled_snapshots l JOIN pitchers p ON l.pitcher_id = p.pitcher_id""", "labelled_snapshots", "pitchers")


def y0(t):
    base = labelled(t).withColumns({
        "block": rolling.quarter_block("as_of_date"), "load_score": F.least(F.col("workload_intensity") / 2, F.lit(1.0)),
    })
    return base.join(t.pitchers.select("pitcher_id", "role"), "pitcher_id")


def stored(t):
    """``y0`` written once, for metrics with more than one pass over the rows."""
    return written_once(y0(t).select("pitcher_id", "as_of_date", "score", "y"), "scored-labels")


def ranking_sql(key: str, score: str = "score", source: str = "y0") -> str:
    """Rank-sum AUC with average ranks, average precision and trapezoid area, straight from rows."""
    return f"""
SELECT k, any_value(samples) AS samples, any_value(positives) AS positives,
  (sum(pos * (rank_low + (n + 1) / 2.0::DOUBLE)) - any_value(positives) * (any_value(positives) + 1) / 2.0::DOUBLE) / nullif(any_value(positives) * (any_value(samples) - any_value(positives)), 0) AS roc_auc,
  sum(pos / CAST(nullif(positives, 0) AS DOUBLE) * tp / f) AS average_precision,
  sum(pos / CAST(nullif(positives, 0) AS DOUBLE) * (tp / f + CASE WHEN f > n THEN (tp - pos) / (f - n) ELSE 1 END) / 2) AS pr_auc_trapezoid
FROM (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s) - n AS rank_low, CAST(sum(n) OVER (PARTITION BY k ORDER BY s DESC) AS DOUBLE) AS f,
    CAST(sum(pos) OVER (PARTITION BY k ORDER BY s DESC) AS DOUBLE) AS tp, sum(n) OVER (PARTITION BY k) AS samples, sum(pos) OVER (PARTITION BY k) AS positives
  FROM (SELECT {key} AS k, {score} AS s, count(*) AS n, sum(y) AS pos FROM {source} GROUP BY 1, 2)) GROUP BY 1"""


def ece_sql(key: str, score: str = "score", source: str = "y0") -> str:
    return f"""
SELECT k, avg(g) AS ece, sum(g * n) / sum(n) AS ece_weighted FROM (SELECT {key} AS k, {BIN.replace('score', score)} AS bin, count(*) AS n, abs(avg(y) - avg({score})) AS g
  FROM {source} GROUP BY 1, 2) GROUP BY 1"""


def topk_sql(key: str, ks=(5, 10, 20), score: str = "score", source: str = "y0") -> str:
    return " UNION ALL ".join(f"""
SELECT k, {p} AS k_pct, any_value(t) AS threshold, count(*) FILTER (s >= t) AS flagged, avg(y) FILTER (s >= t) AS precision,
  sum(y) FILTER (s >= t) / CAST(nullif(sum(y), 0) AS DOUBLE) AS recall, CASE WHEN sum(y) > 0 THEN avg(y) FILTER (s >= t) / avg(y) ELSE 0 END AS lift
FROM (SELECT {key} AS k, {score} AS s, y, quantile_cont({score}, {1 - p / 100}) OVER (PARTITION BY {key}) AS t FROM {source}) GROUP BY 1""" for p in ks)


def metrics_sql(key: str, score: str = "score", source: str = "y0") -> str:
    return f"""
SELECT r.*, positives / CAST(samples AS DOUBLE) AS positive_rate, brier, ece, ece_weighted, precision AS precision_top_10, recall AS recall_top_10, lift AS lift_top_10
FROM ({ranking_sql(key, score, source)}) r JOIN (SELECT {key} AS k, avg(pow({score} - y, 2)) AS brier FROM {source} GROUP BY 1) b ON r.k = b.k
JOIN ({ece_sql(key, score, source)}) e ON r.k = e.k JOIN ({topk_sql(key, (10,), score, source)}) t ON r.k = t.k"""


METRICS = ("roc_auc:r average_precision:r pr_auc_trapezoid:r samples:n positives:n positive_rate:r brier:r ece:r ece_weighted:r "
           "precision_top_10:r recall_top_10:r lift_top_10:r")
sql_table("metrics_all", metrics_sql("grp"), "y0")
sql_table("metrics_load", metrics_sql("grp", "load_score"), "y0")
sql_table("metrics_block", metrics_sql("block"), "y0")


@query("roc_auc", "roc_auc:r samples:n positives:n", ranking_sql("grp"), "y0")
def _(t):
    return op.ranking_metrics(y0(t))


@query("roc_auc_continuous", "roc_auc:r average_precision:r pr_auc_trapezoid:r", ranking_sql("grp", "load_score"), "y0")
def _(t):
    return op.ranking_metrics(y0(t), "load_score")


@query("average_precision", "average_precision:r pr_auc_trapezoid:r", ranking_sql("grp"), "y0")
def _(t):
    return op.ranking_metrics(y0(t))


@query("brier", "brier:r", "SELECT avg(pow(score - y, 2)) AS brier FROM y0", "y0")
def _(t):
    return op.brier(y0(t))


@query("calibration_curve", "bin:n samples:n fraction_positive:r mean_predicted:r", f"""
SELECT {BIN.replace('score', 'load_score')} AS bin, count(*) AS samples, avg(y) AS fraction_positive, avg(load_score) AS mean_predicted FROM y0 GROUP BY 1""", "y0")
def _(t):
    return op.calibration_curve(y0(t), "load_score")


@query("calibration_error", "ece:r ece_weighted:r", ece_sql("grp"), "y0")
def _(t):
    return op.calibration_error(y0(t))


@query("decile_table", "decile:n samples:n predicted:r observed:r", """
SELECT decile, count(*) AS samples, avg(score) AS predicted, avg(y) AS observed FROM (SELECT *, ntile(10) OVER (ORDER BY score, pitcher_id, as_of_date) AS decile FROM y0) GROUP BY 1""", "y0")
def _(t):
    return op.decile_table(stored(t))


CONFUSION = "tp:n fp:n fn:n tn:n accuracy:r precision:r recall:r specificity:r f1:r"


@query("confusion_metrics", CONFUSION, """
SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM (SELECT *, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
  CAST(tp AS DOUBLE) / (tp + fn) AS recall, CAST(tn AS DOUBLE) / (tn + fp) AS specificity FROM (SELECT count(*) FILTER (p AND y = 1) AS tp, count(*) FILTER (p AND y = 0) AS fp,
  count(*) FILTER (NOT p AND y = 1) AS fn, count(*) FILTER (NOT p AND y = 0) AS tn FROM (SELECT y, score >= 0.5::DOUBLE AS p FROM y0)))""", "y0")
def _(t):
    return op.confusion_metrics(y0(t))


@query("topk_fraction_metrics", "k_pct:n threshold:r flagged:n precision:r recall:r lift:r", topk_sql("grp"), "y0")
def _(t):
    return op.topk_fraction_metrics(y0(t))


@query("topk_fraction_continuous", "k_pct:n threshold:r flagged:n precision:r recall:r lift:r", topk_sql("grp", score="load_score"), "y0")
def _(t):
    return op.topk_fraction_metrics(y0(t), "load_score")


@query("topk_count_metrics", "k:n precision:r recall:r", " UNION ALL ".join(f"""
SELECT {k} AS k, sum(y) / {k}.0::DOUBLE AS precision, sum(y) / CAST((SELECT sum(y) FROM y0) AS DOUBLE) AS recall FROM (SELECT y FROM y0 ORDER BY score DESC, pitcher_id, as_of_date LIMIT {k})""" for k in op.TOP_COUNTS), "y0")
def _(t):
    return op.topk_count_metrics(stored(t))


@query("lift_at_top10", "top_rows:n precision_top:r base_rate:r lift_top:r", """
SELECT count(*) FILTER (rn <= k) AS top_rows, avg(y) FILTER (rn <= k) AS precision_top, avg(y) AS base_rate, avg(y) FILTER (rn <= k) / avg(y) AS lift_top
FROM (SELECT y, row_number() OVER (ORDER BY score DESC, pitcher_id, as_of_date) AS rn, floor(count(*) OVER () * 0.1::DOUBLE + 1e-9) AS k FROM y0)""", "y0")
def _(t):
    return op.top_share_lift(stored(t))


@query("lead_days", "pitcher_id:n as_of_date:d lead_days:n", """
SELECT pitcher_id, as_of_date, (SELECT min(il_start) FROM injuries i WHERE i.pitcher_id = s.pitcher_id AND il_start BETWEEN as_of_date + 1 AND as_of_date + 21) - as_of_date AS lead_days FROM scores s""", "scores injuries")
def _(t):
    return op.with_lead_days(scores_of(t), t.injuries)


@query("alert_budget", "k_pct:n alerts:n hits:n median_lead_days:r precision:r recall:r alerts_per_day:r hits_per_100:r", " UNION ALL ".join(f"""
SELECT {k} AS k_pct, count(*) AS alerts, sum(y) AS hits, median(lead) FILTER (y = 1) AS median_lead_days, avg(y) AS precision, sum(y) / CAST((SELECT sum(y) FROM y0) AS DOUBLE) AS recall,
  count(*) / CAST((SELECT count(DISTINCT as_of_date) FROM y0) AS DOUBLE) AS alerts_per_day, 100 * avg(y) AS hits_per_100
FROM (SELECT *, (SELECT min(il_start) FROM injuries i WHERE i.pitcher_id = s.pitcher_id AND il_start BETWEEN as_of_date + 1 AND as_of_date + 21) - as_of_date AS lead FROM y0 s
  WHERE load_score >= (SELECT quantile_cont(load_score, {1 - k / 100}) FROM y0))""" for k in op.TOP_PERCENTS), "y0 injuries")
def _(t):
    return op.alert_budget(op.with_lead_days(y0(t), t.injuries), "load_score")


@query("rolling_origin_backtest", f"block:s fold:n train_rows:n {METRICS}", """
SELECT * FROM (SELECT *, k AS block, row_number() OVER (ORDER BY k) - 1 AS fold, sum(samples) OVER (ORDER BY k) - samples AS train_rows FROM metrics_block) WHERE fold >= 3""", "metrics_block")
def _(t):
    return op.rolling_origin_backtest(y0(t))


POOLED = ("average_precision", "roc_auc", "brier", "ece", "recall_top_10", "lift_top_10")


@query("pooled_backtest", "blocks:n " + " ".join(f"avg_{c}:r" for c in POOLED), f"""
SELECT count(*) AS blocks, {', '.join(f'avg({c}) AS avg_{c}' for c in POOLED)} FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS fold FROM metrics_block) WHERE fold >= 3""", "metrics_block")
def _(t):
    return op.pooled_metrics(op.rolling_origin_backtest(y0(t)))


@query("time_series_cv", "fold:n train_rows:n test_rows:n train_positive_rate:r test_positive_rate:r test_start:d test_end:d", """
SELECT c - 1 AS fold, n AS test_rows, p / CAST(n AS DOUBLE) AS test_positive_rate, a AS test_start, b AS test_end, tn AS train_rows, tp / CAST(tn AS DOUBLE) AS train_positive_rate FROM (
  SELECT *, sum(n) OVER (ORDER BY c) - n AS tn, sum(p) OVER (ORDER BY c) - p AS tp FROM (SELECT c, count(*) AS n, sum(y) AS p, min(as_of_date) AS a, max(as_of_date) AS b
    FROM (SELECT *, ntile(6) OVER (ORDER BY as_of_date, pitcher_id) AS c FROM y0) GROUP BY 1)) WHERE c > 1""", "y0")
def _(t):
    return op.time_series_folds(stored(t))


@query("subgroup_metrics", f"role:s {METRICS}", f"SELECT *, k AS role FROM ({metrics_sql('role')})", "y0")
def _(t):
    return op.all_metrics(y0(t), keys=["role"])


@query("promotion_gate", "new_average_precision:r new_roc_auc:r pr_auc_up:b recall_up:b brier_ok:b ece_ok:b meets_targets:b promote:b", """
SELECT *, pr_auc_up AND recall_up AND brier_ok AND ece_ok AS promote FROM (SELECT n.average_precision AS new_average_precision, n.roc_auc AS new_roc_auc,
  n.average_precision > o.average_precision AS pr_auc_up, n.recall_top_10 > o.recall_top_10 AS recall_up, n.brier <= o.brier AS brier_ok, n.ece <= o.ece AS ece_ok,
  n.roc_auc > 0.75 AND n.precision_top_10 > 0.6 AND n.recall_top_10 > 0.7 AND n.brier < 0.15 AND n.ece < 0.05 AS meets_targets FROM metrics_all n, metrics_load o)""", "metrics_all metrics_load")
def _(t):
    return op.promotion_gate(op.model_metrics(y0(t), {"new": "score", "old": "load_score"}))


@query("rate_metrics", "roc_auc:r average_precision:r brier:r roc_rating:s pr_rating:s calibration_rating:s", """
SELECT *, CASE WHEN roc_auc >= 0.9 THEN 'Excellent' WHEN roc_auc >= 0.8 THEN 'Good' WHEN roc_auc >= 0.7 THEN 'Fair' WHEN roc_auc >= 0.6 THEN 'Poor' ELSE 'Very Poor' END AS roc_rating,
  CASE WHEN average_precision >= 0.8 THEN 'Excellent' WHEN average_precision >= 0.6 THEN 'Good' WHEN average_precision >= 0.4 THEN 'Fair' ELSE 'Poor' END AS pr_rating,
  CASE WHEN brier <= 0.1 THEN 'Excellent' WHEN brier <= 0.2 THEN 'Good' WHEN brier <= 0.3 THEN 'Fair' ELSE 'Poor' END AS calibration_rating FROM metrics_all""", "metrics_all")
def _(t):
    return op.rate_metrics(op.all_metrics(y0(t)))


@query("impact_summary", "analyzed:n predicted_high_risk:n actual:n caught:n prevention_rate:r", """
SELECT *, caught / CAST(actual AS DOUBLE) AS prevention_rate FROM (SELECT count(*) AS analyzed, count(*) FILTER (score >= 0.5::DOUBLE) AS predicted_high_risk, sum(y) AS actual,
  sum(y) FILTER (score >= 0.5::DOUBLE) AS caught FROM y0)""", "y0")
def _(t):
    return op.impact_summary(y0(t))


@query("class_weights", "positives:n negatives:n weight_positive:r weight_negative:r scale_pos_weight:r", """
SELECT p AS positives, n AS negatives, (p + n) / (2.0::DOUBLE * p) AS weight_positive, (p + n) / (2.0::DOUBLE * n) AS weight_negative, n / CAST(p AS DOUBLE) AS scale_pos_weight
FROM (SELECT sum(y) AS p, count(*) - sum(y) AS n FROM y0)""", "y0")
def _(t):
    return op.class_weights(y0(t))


sql_table("held_out", f"SELECT * FROM y0 WHERE as_of_date > DATE '{CUT}'", "y0")
sql_table("held_out_metrics", metrics_sql("grp", source="held_out"), "held_out")


@query("metrics_panel", f"train_start:d train_end:d train_pos_rate:r val_start:d val_end:d val_pos_rate:r scale_pos_weight:r advice:s {METRICS}", f"""
SELECT m.*, t.*, v.*, array_to_string(list_filter([CASE WHEN roc_auc < 0.7 THEN 'Consider feature engineering improvements to boost AUC above 0.7' END,
  CASE WHEN val_pos_rate < 0.05 THEN 'Increase injury data generation for better class balance' END,
  CASE WHEN brier > 0.25 THEN 'Model calibration needs improvement - consider recalibration' END], lambda x: x IS NOT NULL), '|') AS advice
FROM held_out_metrics m, (SELECT min(as_of_date) AS train_start, max(as_of_date) AS train_end, avg(y) AS train_pos_rate FROM y0 WHERE as_of_date <= DATE '{CUT}') t,
  (SELECT min(as_of_date) AS val_start, max(as_of_date) AS val_end, avg(y) AS val_pos_rate, (count(*) - sum(y)) / CAST(sum(y) AS DOUBLE) AS scale_pos_weight FROM held_out) v""", "held_out_metrics held_out y0")
def _(t):
    base = stored(t)
    day = F.lit(CUT).cast("date")
    panel = op.metrics_panel(base.where(F.col("as_of_date") <= day), base.where(F.col("as_of_date") > day))
    return panel.withColumn("advice", F.concat_ws("|", "advice"))


@query("risk_by_injury_location", "injury_location:s injuries:n mean_score:r", """
SELECT injury_location, count(*) AS injuries, avg(s) AS mean_score FROM (SELECT injury_location,
  (SELECT arg_max(score, as_of_date) FROM scores x WHERE x.pitcher_id = i.pitcher_id AND x.as_of_date < i.il_start) AS s FROM injuries i) GROUP BY 1""", "scores injuries")
def _(t):
    return op.risk_by_injury_location(t.injuries, scores_of(t))


sql_table("anova", """
SELECT feature, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(v * (n - 1)) / (sum(n) - count(*))) AS f_value FROM (
  SELECT feature, y, count(*) AS n, avg(value) AS m, var_samp(value) AS v, (SELECT avg(value) FROM long_features b WHERE b.feature = a.feature) AS g FROM long_features a GROUP BY 1, 2) GROUP BY 1""", "long_features")


@query("anova_f", "feature:s f_value:r", "SELECT * FROM anova", "anova")
def _(t):
    return op.anova_f(stored_labelled(t, *FEATURES), "y", FEATURES)


DRIFT = FEATURES
sql_table("drift_rows", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, CASE WHEN as_of_date <= DATE '{CUT}' THEN 1 ELSE 0 END AS ref FROM scores" for f in DRIFT), "scores")


def halves(t):
    base = stored_scores(t, *DRIFT)
    day = F.lit(CUT).cast("date")
    return base.where(F.col("as_of_date") <= day), base.where(F.col("as_of_date") > day)


@query("drift_psi", "feature:s psi:r drift:b", f"""
SELECT feature, sum((q - p) * ln(q / p)) AS psi, sum((q - p) * ln(q / p)) > 0.2 AS drift FROM (
  SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-6) AS p, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-6) AS q FROM (
    SELECT d.feature, {' + '.join(f'CAST(value > e[{i}] AS INTEGER)' for i in range(1, 10))} AS bin, CAST(sum(ref) AS DOUBLE) AS r, CAST(sum(1 - ref) AS DOUBLE) AS c
    FROM drift_rows d JOIN (SELECT feature, quantile_cont(value, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM drift_rows WHERE ref = 1 GROUP BY 1) x ON d.feature = x.feature
    GROUP BY 1, 2)) GROUP BY 1""", "drift_rows")
def _(t):
    return op.drift_psi(*halves(t), DRIFT)


@query("drift_ks", "feature:s statistic:r ref_rows:n cur_rows:n p_value:r drift_detected:b", """
SELECT *, p_value < 0.05 AS drift_detected FROM (SELECT *, CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, list_sum([CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * lam * lam) for k in range(1, 101)]))) END AS p_value
FROM (SELECT *, (sqrt(en) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(en)) * statistic AS lam FROM (SELECT *, ref_rows * cur_rows / CAST(ref_rows + cur_rows AS DOUBLE) AS en FROM (
  SELECT feature, max(abs(cr / CAST(r AS DOUBLE) - cc / CAST(c AS DOUBLE))) AS statistic, any_value(r) AS ref_rows, any_value(c) AS cur_rows FROM (
    SELECT feature, sum(ref) OVER (PARTITION BY feature ORDER BY value) AS cr, sum(1 - ref) OVER (PARTITION BY feature ORDER BY value) AS cc,
      sum(ref) OVER (PARTITION BY feature) AS r, sum(1 - ref) OVER (PARTITION BY feature) AS c FROM drift_rows) GROUP BY 1))))""", "drift_rows")
def _(t):
    return op.drift_ks(*halves(t), DRIFT)


@query("mean_risk_shift", "current_mean:r reference_mean:r relative_shift:r shifted:b", f"""
SELECT *, current_mean / reference_mean - 1 AS relative_shift, abs(current_mean / reference_mean - 1) >= 0.2 AS shifted FROM (SELECT avg(score) FILTER (as_of_date > DATE '{CUT}') AS current_mean,
  avg(score) FILTER (as_of_date <= DATE '{CUT}') AS reference_mean FROM scores)""", "scores")
def _(t):
    return op.mean_risk_shift(*halves(t))
