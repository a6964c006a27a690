"""Metrics of scored labels.

Ranking metrics are computed from one row per distinct score (``functions.ranking``): counts of
positives and of all rows at, below and above each score. Ties therefore get average ranks and no
task sorts all rows. Every metric takes grouping keys, so folds and subgroups cost one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundwork.functions import ranking
from moundwork.functions import windows as w
from moundwork.operators.rolling import as_day
from moundwork.session import written_once

TOP_PERCENTS = (5, 10, 20)
TOP_COUNTS = (5, 10, 20, 50)
# Lower bounds of the rating words (upper bounds for Brier).
ROC_BANDS = ((0.9, "Excellent"), (0.8, "Good"), (0.7, "Fair"), (0.6, "Poor"))
PR_BANDS = ((0.8, "Excellent"), (0.6, "Good"), (0.4, "Fair"))
BRIER_BANDS = ((0.1, "Excellent"), (0.2, "Good"), (0.3, "Fair"))

def score_curve(scored: DataFrame, score: str = "score", label: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Per key and distinct score: rows and positives at it, below it, and in total.

    This is the only pass over the rows; every ranking metric is an aggregate of it.
    """
    counted = scored.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos"))
    return ranking.value_positions(counted, score, keys, {"pos": F.sum("_pos")}, weight="_n")


def _ranking_aggregates() -> dict[str, Column]:
    """Areas and sizes from the columns of ``score_curve``."""
    n, pos, total, positives = F.col("n"), F.col("pos"), F.col("n_total"), F.col("pos_total")
    neg = n - pos
    neg_below = F.col("n_before") - F.col("pos_before")
    auc = F.sum(pos * neg_below + pos * neg * 0.5) / F.nullif(F.max(positives * (total - positives)), F.lit(0))
    flagged = total - F.col("n_before")
    hits = positives - F.col("pos_before")
    precision = hits / flagged
    above_flagged, above_hits = flagged - n, hits - pos
    above_precision = F.when(above_flagged > 0, above_hits / above_flagged).otherwise(1.0)
    step = pos / F.nullif(positives, F.lit(0))
    return {
        "roc_auc": auc, "average_precision": F.sum(step * precision),
        "pr_auc_trapezoid": F.sum(step * (precision + above_precision) * 0.5),
        "samples": F.max(total), "positives": F.max(positives),
    }


def _top_share_aggregates(score: str, percents: Sequence[int]) -> dict[str, Column]:
    """Flagged rows, their positives and the score threshold at percentile 100 - k.

    A score is at or above the interpolated percentile exactly when its last row stands at or
    behind the percentile's upper neighbour.
    """
    out = {}
    for k in percents:
        place = F.lit(1 - k / 100) * (F.col("n_total") - 1)
        flag = F.col("n_before") + F.col("n") > F.ceil(place)
        at = lambda slot: F.max(F.when((F.col("n_before") <= slot) & (slot < F.col("n_before") + F.col("n")), F.col(score)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out |= {
            f"flagged_{k}": F.sum(F.when(flag, F.col("n")).otherwise(0)), f"hits_{k}": F.sum(F.when(flag, F.col("pos")).otherwise(0)),
            f"threshold_{k}": low + (high - low) * F.max(place - F.floor(place)),
        }
    return out


def _calibration_aggregates(score: str, bins: int = 10) -> dict[str, Column]:
    p, n, pos = F.col(score), F.col("n"), F.col("pos")
    out = {"brier": F.sum(n * p * p - p * pos * 2 + pos) / F.max("n_total")}
    place = uniform_bin(p, bins)
    for b in range(bins):
        here = place == b
        for name, x in (("n", n), ("p", n * p), ("y", pos)):
            out[f"_{name}{b}"] = F.sum(F.when(here, x))
    return out


def _ece_columns(bins: int = 10) -> dict[str, Column]:
    n = [F.coalesce(F.col(f"_n{b}"), F.lit(0)) for b in range(bins)]
    gap = [F.coalesce(F.abs(F.col(f"_y{b}") - F.col(f"_p{b}")), F.lit(0.0)) for b in range(bins)]
    filled = reduce(lambda a, x: a + (x > 0).cast("int"), n, F.lit(0))
    mean = reduce(lambda a, i: a + F.when(n[i] > 0, gap[i] / n[i]).otherwise(0.0), range(bins), F.lit(0.0))
    return {"ece": mean / filled, "ece_weighted": reduce(lambda a, x: a + x, gap, F.lit(0.0)) / reduce(lambda a, x: a + x, n, F.lit(0))}


def ranking_metrics(scored: DataFrame, score: str = "score", label: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """roc_auc, average_precision and the trapezoid PR area per key."""
    curve = score_curve(scored, score, label, keys)
    return curve.groupBy(*keys).agg(*[c.alias(n) for n, c in _ranking_aggregates().items()])


def brier(scored: DataFrame, score: str = "score", label: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    p = F.col(score)
    return scored.groupBy(*keys).agg(F.avg((p - F.col(label)) * (p - F.col(label))).alias("brier"))


def uniform_bin(score: Column, bins: int = 10) -> Column:
    """Bin number of evenly spaced, right-closed bins on [0, 1]."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return reduce(lambda a, e: a + (score > e).cast("int"), edges, F.lit(0))


def calibration_curve(scored: DataFrame, score: str = "score", label: str = "y", keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    return scored.groupBy(*keys, uniform_bin(F.col(score), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(label).alias("fraction_positive"), F.avg(score).alias("mean_predicted")
    )


def calibration_error(scored: DataFrame, score: str = "score", label: str = "y", keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean gap over non-empty bins, and the gap weighted by bin size."""
    curve = calibration_curve(scored, score, label, keys, bins)
    gap = F.abs(F.col("fraction_positive") - F.col("mean_predicted"))
    return curve.groupBy(*keys).agg(
        F.avg(gap).alias("ece"), (F.sum(gap * F.col("samples")) / F.sum("samples")).alias("ece_weighted")
    )


def decile_table(scored: DataFrame, score: str = "score", label: str = "y", parts: int = 10) -> DataFrame:
    ranked = ranking.global_row_number(scored, score, "pitcher_id", "as_of_date", descending=False)
    tile = ranking.ntile(F.col("rn"), F.col("row_total"), parts)
    return ranked.groupBy(tile.alias("decile")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(score).alias("predicted"), F.avg(label).alias("observed")
    )


def confusion_metrics(scored: DataFrame, score: str = "score", label: str = "y", keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    flag, hit = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.groupBy(*keys).agg(
        F.count_if(flag & hit).alias("tp"), F.count_if(flag & ~hit).alias("fp"),
        F.count_if(~flag & hit).alias("fn"), F.count_if(~flag & ~hit).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return counts.withColumns({
        "accuracy": share(tp + tn, tp + fp + fn + tn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn),
        "specificity": share(tn, tn + fp),
    }).withColumn("f1", share(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))


def topk_fraction_metrics(
    scored: DataFrame, score: str = "score", label: str = "y", keys: Sequence[str] = (), percents: Sequence[int] = TOP_PERCENTS
) -> DataFrame:
    """precision, recall and lift at the score percentile 100 - k, for each k; rows per (key, k)."""
    curve = score_curve(scored, score, label, keys)
    sums = curve.groupBy(*keys).agg(
        F.max("n_total").alias("n"), F.max("pos_total").alias("pos"),
        *[c.alias(n) for n, c in _top_share_aggregates(score, percents).items()],
    )
    return sums.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(k).alias("k_pct"), F.col(f"threshold_{k}").alias("threshold"), F.col(f"flagged_{k}").alias("flagged"), *_top_ratios(k))
        for k in percents
    ])))


def _top_ratios(k: int) -> list[Column]:
    hits, flagged = F.col(f"hits_{k}"), F.col(f"flagged_{k}")
    base = F.col("pos") / F.col("n")
    return [
        (hits / flagged).alias("precision"), (hits / F.nullif(F.col("pos"), F.lit(0))).alias("recall"),
        F.when(F.col("pos") > 0, hits / flagged / base).otherwise(0.0).alias("lift"),
    ]


def topk_count_metrics(scored: DataFrame, score: str = "score", label: str = "y", counts: Sequence[int] = TOP_COUNTS) -> DataFrame:
    """Precision and recall of the k highest scores (a bounded top-n, ties by pitcher and date)."""
    top = scored.select("pitcher_id", "as_of_date", score, label).orderBy(
        F.desc(score), "pitcher_id", "as_of_date"
    ).limit(max(counts))
    place = F.row_number().over(Window.orderBy(F.desc(score), "pitcher_id", "as_of_date"))
    positives = scored.agg(F.sum(label)).scalar()
    ranked = top.withColumn("_p", place)
    sums = ranked.agg(*[F.sum(F.when(F.col("_p") <= k, F.col(label))).alias(f"h{k}") for k in counts]).withColumn("_pos", positives)
    rows = F.inline(F.array(*[
        F.struct(F.lit(k).alias("k"), (F.col(f"h{k}") / float(k)).alias("precision"), (F.col(f"h{k}") / F.nullif(F.col("_pos"), F.lit(0))).alias("recall"))
        for k in counts
    ]))
    return sums.select(rows)


def top_share_lift(scored: DataFrame, score: str = "score", label: str = "y", share: float = 0.1) -> DataFrame:
    """Positive rate of exactly the top share of rows, and its ratio to the base rate."""
    ranked = ranking.global_row_number(scored, score, "pitcher_id", "as_of_date")
    k = F.greatest(F.lit(1), F.floor(F.col("row_total") * share + 1e-9))
    top = F.when(F.col("rn") <= k, F.col(label))
    return ranked.agg(F.count(top).alias("top_rows"), F.avg(top).alias("precision_top"), F.avg(label).alias("base_rate")).withColumn(
        "lift_top", F.when(F.col("base_rate") > 0, F.col("precision_top") / F.col("base_rate")).otherwise(0.0)
    )


def with_lead_days(scored: DataFrame, injuries: DataFrame, horizon: int = 21, day: str = "as_of_date") -> DataFrame:
    """Days to the pitcher's next injury within the horizon (null when there is none)."""
    rows = scored.withColumns({w.DAY_NUMBER: F.unix_date(day), "_hurt": F.lit(None).cast("int")})
    marks = injuries.select("pitcher_id", F.unix_date("il_start").alias(w.DAY_NUMBER)).distinct().withColumn("_hurt", F.col(w.DAY_NUMBER))
    line = rows.unionByName(marks, allowMissingColumns=True)
    following = F.min("_hurt").over(w.pitcher_days().rangeBetween(1, horizon))
    return line.withColumn("lead_days", following - F.col(w.DAY_NUMBER)).where(F.col("_hurt").isNull()).drop("_hurt", w.DAY_NUMBER)


def alert_budget(scored: DataFrame, score: str = "score", label: str = "y", percents: Sequence[int] = TOP_PERCENTS) -> DataFrame:
    """Per budget: precision, recall, alerts per day, hits per 100 alerts, median lead of hits.

    ``scored`` carries ``lead_days``. Rows are counted once per (score, date, lead); thresholds,
    totals and alerts all come from those counts, and the median has one counter per lead day.
    """
    counted = written_once(scored.groupBy(score, "as_of_date", "lead_days").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos")
    ), "alert-counts")
    marks = ranking.percentiles(counted, score, {f"t{k}": 1 - k / 100 for k in percents}, weight="_n")
    row = marks.select(F.struct(*[f"t{k}" for k in percents])).scalar()
    totals = counted.agg(F.struct(F.countDistinct("as_of_date").alias("days"), F.sum("_pos").alias("pos"))).scalar()
    budgets = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_t.t{k}").alias("t")) for k in percents]))
    alerts = counted.withColumn("_t", row).select(score, "lead_days", "_n", "_pos", budgets.alias("b")).where(F.col(score) >= F.col("b.t"))
    out = alerts.groupBy(F.col("b.k").alias("k_pct")).agg(
        F.sum("_n").alias("alerts"), F.sum("_pos").alias("hits"),
        F.percentile(F.when(F.col("_pos") > 0, F.col("lead_days")), F.lit(0.5), F.greatest(F.col("_pos"), F.lit(1))).alias("median_lead_days"),
    ).withColumn("_tot", totals)
    return out.withColumns({
        "precision": F.col("hits") / F.col("alerts"), "recall": F.col("hits") / F.nullif(F.col("_tot.pos"), F.lit(0)),
        "alerts_per_day": F.col("alerts") / F.col("_tot.days"), "hits_per_100": F.col("hits") * 100.0 / F.col("alerts"),
    }).drop("_tot")


def all_metrics(scored: DataFrame, score: str = "score", label: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with ranking, calibration and threshold metrics, from one score curve."""
    curve = score_curve(scored, score, label, keys)
    aggregates = {**_ranking_aggregates(), **_top_share_aggregates(score, (10,)), **_calibration_aggregates(score)}
    sums = curve.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]).withColumns(
        {"n": F.col("samples"), "pos": F.col("positives")}
    )
    precision, recall, lift = _top_ratios(10)
    return sums.select(
        *keys, "roc_auc", "average_precision", "pr_auc_trapezoid", "samples", "positives",
        (F.col("positives") / F.col("samples")).alias("positive_rate"), "brier",
        *[c.alias(n) for n, c in _ece_columns().items()],
        precision.alias("precision_top_10"), recall.alias("recall_top_10"), lift.alias("lift_top_10"),
    )


def rolling_origin_backtest(scored: DataFrame, block: str = "block", first: int = 3, score: str = "score", label: str = "y") -> DataFrame:
    """Metrics of each block from the fourth on, with the rows of all earlier blocks behind it.

    For scores that need no fitting all folds are one grouped job. Blocks are few (quarters), so
    the running count of earlier rows is a window over that short list.
    """
    per_block = all_metrics(scored, score, label, [block])
    order = Window.orderBy(block)
    earlier = F.sum("samples").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return per_block.withColumns({"fold": F.row_number().over(order) - 1, "train_rows": earlier}).where(F.col("fold") >= first)


def backtest_with_model(labelled: DataFrame, blocks: Sequence[str], fit, first: int = 3, block: str = "block") -> DataFrame:
    """Refit on all earlier blocks for every tested one; ``fit(train)`` returns a scoring function.

    The loop is over the short list of blocks; each turn is a distributed fit and transform.
    """
    parts = []
    for i in range(first, len(blocks)):
        score_with = fit(labelled.where(F.col(block) < blocks[i]))
        parts.append(score_with(labelled.where(F.col(block) == blocks[i])))
    return all_metrics(reduce(DataFrame.unionByName, parts), keys=[block])


def pooled_metrics(folds: DataFrame) -> DataFrame:
    return folds.agg(
        F.count(F.lit(1)).alias("blocks"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("average_precision", "roc_auc", "brier", "ece", "recall_top_10", "lift_top_10")],
    )


def with_time_chunks(df: DataFrame, splits: int = 5, day: str = "as_of_date") -> DataFrame:
    """Number 1..splits+1 of the equal slices by (date, pitcher); fold k trains on chunks <= k and
    tests on k + 1."""
    dated = df.withColumn("_t", F.unix_date(day))
    ranked = ranking.global_row_number(dated, "_t", "pitcher_id", "pitcher_id", descending=False)
    return ranked.withColumn("chunk", ranking.ntile(F.col("rn"), F.col("row_total"), splits + 1)).drop("_t", "rn", "row_total")


def time_series_folds(df: DataFrame, splits: int = 5, day: str = "as_of_date", label: str = "y") -> DataFrame:
    """Per expanding fold: training and test rows, positive rates and the date boundary."""
    chunks = with_time_chunks(df, splits, day).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"), F.min(day).alias("test_start"), F.max(day).alias("test_end")
    )
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumns({
        "train_rows": F.sum("_n").over(before), "train_positive_rate": F.sum("_p").over(before) / F.sum("_n").over(before),
        "fold": F.col("chunk") - 1,
    }).where(F.col("fold") >= 1).select(
        "fold", "train_rows", F.col("_n").alias("test_rows"), "train_positive_rate",
        (F.col("_p") / F.col("_n")).alias("test_positive_rate"), "test_start", "test_end",
    )


def model_metrics(scored: DataFrame, scores: dict[str, str], label: str = "y") -> DataFrame:
    """``all_metrics`` of several score columns in one pass, a row per model name."""
    both = F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("_score")) for name, c in scores.items()
    ]))
    return all_metrics(scored.select(label, both), "_score", label, ["model"])


def promotion_gate(metrics: DataFrame, new: str = "new", old: str = "old") -> DataFrame:
    """Promote when ranking improves and calibration does not get worse (``model_metrics`` rows)."""
    picked = ("average_precision", "recall_top_10", "brier", "ece", "roc_auc", "precision_top_10")
    row = metrics.agg(*[
        F.max(F.when(F.col("model") == model, F.col(c))).alias(f"{side}_{c}")
        for side, model in (("new", new), ("old", old)) for c in picked
    ])
    n = lambda c: F.col(f"new_{c}")
    o = lambda c: F.col(f"old_{c}")
    checks = {
        "pr_auc_up": n("average_precision") > o("average_precision"), "recall_up": n("recall_top_10") > o("recall_top_10"),
        "brier_ok": n("brier") <= o("brier"), "ece_ok": n("ece") <= o("ece"),
        "meets_targets": (n("roc_auc") > 0.75) & (n("precision_top_10") > 0.6) & (n("recall_top_10") > 0.7) & (n("brier") < 0.15) & (n("ece") < 0.05),
    }
    return row.withColumns(checks).withColumn(
        "promote", F.col("pr_auc_up") & F.col("recall_up") & F.col("brier_ok") & F.col("ece_ok")
    )


def band(value: Column, bands, otherwise: str, upper: bool = False) -> Column:
    out = None
    for edge, word in bands:
        hit = value <= edge if upper else value >= edge
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return out.otherwise(otherwise)


def rate_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({
        "roc_rating": band(F.col("roc_auc"), ROC_BANDS, "Very Poor"), "pr_rating": band(F.col("average_precision"), PR_BANDS, "Poor"),
        "calibration_rating": band(F.col("brier"), BRIER_BANDS, "Poor", upper=True),
    })


def impact_summary(scored: DataFrame, score: str = "score", label: str = "y", threshold: float = 0.5) -> DataFrame:
    flag, hit = F.col(score) >= threshold, F.col(label) == 1
    return scored.agg(
        F.count(F.lit(1)).alias("analyzed"), F.count_if(flag).alias("predicted_high_risk"), F.count_if(hit).alias("actual"),
        F.count_if(flag & hit).alias("caught"),
    ).withColumn("prevention_rate", F.when(F.col("actual") > 0, F.col("caught") / F.col("actual")).otherwise(0.0))


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    p, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    total = F.count(F.lit(1)).cast("double")
    one = F.lit(1)
    return df.agg(
        p.alias("positives"), n.alias("negatives"),
        (total / (F.greatest(p, one) * 2)).alias("weight_positive"), (total / (F.greatest(n, one) * 2)).alias("weight_negative"),
        (n / F.greatest(p, one)).alias("scale_pos_weight"),
    )


def metrics_panel(train: DataFrame, validation: DataFrame, score: str = "score", label: str = "y", day: str = "as_of_date") -> DataFrame:
    """One row: windows, positive rates, weight, validation metrics, and advice from thresholds."""
    window = train.agg(F.struct(
        F.min(day).alias("start"), F.max(day).alias("end"), F.avg(label).alias("rate"),
    )).scalar()
    held = validation.agg(F.struct(
        F.min(day).alias("start"), F.max(day).alias("end"), F.avg(label).alias("rate"),
        (F.count_if(F.col(label) == 0) / F.nullif(F.count_if(F.col(label) == 1), F.lit(0))).alias("weight"),
    )).scalar()
    row = all_metrics(validation, score, label).withColumns({"_t": window, "_v": held})
    advice = F.filter(F.array(
        F.when(F.col("roc_auc") < 0.7, "Consider feature engineering improvements to boost AUC above 0.7"),
        F.when(F.col("_v.rate") < 0.05, "Increase injury data generation for better class balance"),
        F.when(F.col("brier") > 0.25, "Model calibration needs improvement - consider recalibration"),
    ), lambda x: x.isNotNull())
    fine = F.array(F.lit("All systems performing well - ready for production testing"))
    return row.withColumns({
        "train_start": F.col("_t.start"), "train_end": F.col("_t.end"), "train_pos_rate": F.col("_t.rate"),
        "val_start": F.col("_v.start"), "val_end": F.col("_v.end"), "val_pos_rate": F.col("_v.rate"),
        "scale_pos_weight": F.col("_v.weight"), "advice": F.when(F.size(advice) == 0, fine).otherwise(advice),
    }).drop("_t", "_v")


def risk_by_injury_location(injuries: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean score of the snapshot before each injury, per location.

    The last score before a stint is carried along the pitcher's daily line.
    """
    games = scored.select("pitcher_id", F.unix_date("as_of_date").alias(w.DAY_NUMBER), "score")
    stints = injuries.select("pitcher_id", F.unix_date("il_start").alias(w.DAY_NUMBER), "injury_location")
    before = w.pitcher_days().rangeBetween(Window.unboundedPreceding, -1)
    line = games.unionByName(stints, allowMissingColumns=True).withColumn(
        "_last", F.max(F.when(F.col("score").isNotNull(), F.struct(w.DAY_NUMBER, "score"))).over(before)
    )
    return line.where(F.col("injury_location").isNotNull()).groupBy("injury_location").agg(
        F.count(F.lit(1)).alias("injuries"), F.avg("_last.score").alias("mean_score")
    )


def anova_f(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """One-way ANOVA F value per feature, from class sums around the overall mean."""
    means = df.agg(F.struct(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])).scalar()
    x = {f: F.col(f).cast("double") - F.col(f"_m.{f}") for f in features}
    per_class = df.withColumn("_m", means).groupBy(label).agg(*[
        a for f in features
        for a in (F.count(x[f]).alias(f"n_{f}"), F.sum(x[f]).alias(f"s_{f}"), F.sum(x[f] * x[f]).alias(f"q_{f}"))
    ])
    rows = []
    for f in features:
        n, s, q = F.col(f"n_{f}"), F.col(f"s_{f}"), F.col(f"q_{f}")
        total = F.sum(n)
        between = F.sum(s * s / n) - F.sum(s) * F.sum(s) / total
        within = F.sum(q) - F.sum(s * s / n)
        classes = F.count(F.lit(1))
        rows.append(F.struct(
            F.lit(f).alias("feature"),
            (
                between / F.nullif(classes - 1, F.lit(0)) / F.nullif(within / F.nullif(total - classes, F.lit(0)), F.lit(0.0))
            ).alias("f_value"),
        ))
    return per_class.agg(F.array(*rows).alias("m")).select(F.inline("m"))


def drift_psi(reference: DataFrame, current: DataFrame, features: Sequence[str], parts: int = 10, trigger: float = 0.2) -> DataFrame:
    """Population stability index over the reference's deciles, per feature."""
    ref = written_once(_counted(reference, features, "ref"), "reference-counts")
    probs = {f"e{i}": i / parts for i in range(1, parts)}
    edges = ranking.percentiles(ref, "value", probs, ["feature"], weight="ref")
    both = ref.unionByName(_counted(current, features, "cur"), allowMissingColumns=True)
    # The edges are one row per feature: looked up where the counts lie, which a join would gather by feature.
    marked = both.withColumn("_edges", ranking.lookup(edges, "feature")[F.col("feature")]).where(F.col("_edges").isNotNull())
    place = reduce(lambda a, e: a + (F.col("value") > F.col(f"_edges.{e}")).cast("int"), probs, F.lit(0))
    bins = marked.groupBy("feature", place.alias("bin")).agg(
        F.coalesce(F.sum("ref"), F.lit(0)).alias("r"), F.coalesce(F.sum("cur"), F.lit(0)).alias("c")
    )
    whole = Window.partitionBy("feature")
    p = F.greatest(F.col("r") / F.nullif(F.sum("r").over(whole), F.lit(0)), F.lit(1e-6))
    q = F.greatest(F.col("c") / F.nullif(F.sum("c").over(whole), F.lit(0)), F.lit(1e-6))
    terms = bins.withColumns({"_p": p, "_q": q})
    return terms.groupBy("feature").agg(
        F.sum((F.col("_q") - F.col("_p")) * F.log(F.col("_q") / F.col("_p"))).alias("psi")
    ).withColumn("drift", F.col("psi") > trigger)


def _counted(df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    from moundwork.operators.aggregates import unpivot

    return unpivot(df, [], features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias(name))


def drift_ks(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature and its asymptotic p-value."""
    both = _counted(reference, features, "ref").unionByName(_counted(current, features, "cur"), allowMissingColumns=True)
    line = ranking.value_positions(both, "value", ["feature"], {
        "ref": F.coalesce(F.sum("ref"), F.lit(0)), "cur": F.coalesce(F.sum("cur"), F.lit(0)),
    })
    gap = F.abs(
        (F.col("ref_before") + F.col("ref")) / F.nullif(F.col("ref_total"), F.lit(0))
        - (F.col("cur_before") + F.col("cur")) / F.nullif(F.col("cur_total"), F.lit(0))
    )
    out = line.groupBy("feature").agg(
        F.max(gap).alias("statistic"), F.max("ref_total").alias("ref_rows"), F.max("cur_total").alias("cur_rows")
    )
    en = F.sqrt(F.col("ref_rows") * F.col("cur_rows") / (F.col("ref_rows") + F.col("cur_rows")))
    lam = (en + 0.12 + F.lit(0.11) / F.nullif(en, F.lit(0.0))) * F.col("statistic")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(k * k * lam * lam * -2.0),
    )
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return out.withColumn("p_value", p).withColumn("drift_detected", F.col("p_value") < 0.05)


def mean_risk_shift(reference: DataFrame, current: DataFrame, score: str = "score", trigger: float = 0.2) -> DataFrame:
    before = reference.agg(F.avg(score)).scalar()
    return current.agg(F.avg(score).alias("current_mean")).withColumn("reference_mean", before).withColumn(
        "relative_shift", F.col("current_mean") / F.nullif(F.col("reference_mean"), F.lit(0.0)) - 1
    ).withColumn("shifted", F.abs("relative_shift") >= trigger)


def in_range(scored: DataFrame, start: str | None = None, end: str | None = None, day: str = "as_of_date") -> DataFrame:
    if start is not None:
        scored = scored.where(F.col(day) >= as_day(start))
    if end is not None:
        scored = scored.where(F.col(day) <= as_day(end))
    return scored
