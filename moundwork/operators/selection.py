"""Ordering, top-k, splitting, sampling and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundwork.functions import ranking
from moundwork.operators.labels import hash_order


def recent_appearances(appearances: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` games per pitcher (a per-pitcher daily series is short)."""
    newest = Window.partitionBy("pitcher_id").orderBy(F.desc("game_date"))
    return appearances.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def top_k_percent(scored: DataFrame, score: str = "score", share: float = 0.1) -> DataFrame:
    """Rows in the top ``max(1, int(share * n))`` by score; ties go to the smaller (pitcher, date)."""
    ranked = ranking.global_row_number(scored, score, "pitcher_id", "as_of_date")
    k = F.greatest(F.lit(1), F.floor(F.col("row_total") * share + 1e-9))
    return ranked.where(F.col("rn") <= k).drop("row_total").withColumnRenamed("rn", "position")


def latest_records(records: DataFrame, n: int = 20, day: str = "injury_date", key: str = "report_id") -> DataFrame:
    return records.orderBy(F.desc(day), key).limit(n)


def confidence_samples(records: DataFrame, high: float = 0.6, low: float = 0.3, n: int = 10, key: str = "report_id") -> DataFrame:
    """The first ``n`` records of high and of low confidence, by key."""
    score = F.col("confidence_score")
    good = records.where(score >= high).orderBy(key).limit(n).withColumn("sample", F.lit("high"))
    poor = records.where(score < low).orderBy(key).limit(n).withColumn("sample", F.lit("low"))
    return good.unionByName(poor)


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Mark an exact ``test_share`` of each class as test, in hash order.

    The hash prefix orders the class by value counts (see ``functions.ranking``), so neither class
    is sorted in one task.
    """
    hashed = df.withColumn("_h", hash_order(seed, *keys))
    placed = ranking.with_positions(hashed, "_h", [label])
    cut = F.floor(F.col("n_total") * test_share + 1e-9)
    side = F.when(F.col("n_before") < cut, "test").otherwise("train")
    return placed.withColumn("split", side).drop("_h", "n", "n_before", "n_total")


def time_split(df: DataFrame, day: str = "as_of_date", train_share: float = 0.8) -> DataFrame:
    """Train on the first share of rows by date; a date is never on both sides.

    The cut is the first date at which the running row count passes the share; counting per date
    leaves at most one row per calendar day to order.
    """
    per_day = df.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = (
        per_day.withColumns({"_upto": F.sum("_n").over(running), "_all": F.sum("_n").over(everything)})
        .where(F.col("_upto") > F.col("_all") * train_share)
        .agg(F.min(day))
    ).scalar()
    side = F.when(F.col(day) < F.col("_cut"), "train").otherwise("validation")
    return df.withColumn("_cut", cut).withColumn("split", side).drop("_cut")


def split_by_bounds(df: DataFrame, train_end: str, day: str = "as_of_date") -> DataFrame:
    side = F.when(F.col(day) <= F.lit(train_end).cast("date"), "train").otherwise("validation")
    return df.withColumn("split", side)


def union_samples(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def training_blocks(df: DataFrame, test_block: str, block: str = "block") -> DataFrame:
    """All rows of blocks before ``test_block`` ("2000Q3" sorts as text)."""
    return df.where(F.col(block) < test_block)


def distinct_game_dates(pitches: DataFrame) -> DataFrame:
    days = pitches.select("game_date").where(F.col("game_date").isNotNull()).distinct()
    weekend = F.dayofweek("game_date").isin(1, 7)
    return days.agg(F.count(F.lit(1)).alias("dates"), F.count_if(weekend).alias("weekend_dates"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def oversample(df: DataFrame, label: str, ratio: float = 0.3, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Repeat minority rows until they are ``ratio`` of the majority, by a fixed copy count.

    Each row is exploded where it lies; only the two class counts are aggregated. The fractional
    part of the factor is met by a hash of ``keys`` (all columns but the label), not by random draws.
    """
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")
    ).agg(F.max(F.greatest(F.lit(1.0), F.col("q") * ratio / F.nullif(F.col("p"), F.lit(0))))).scalar()
    digest = hash_order(seed, *(keys or [c for c in df.columns if c != label]))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    wanted = F.floor(F.col("_f")) + F.when(unit < F.col("_f") - F.floor("_f"), 1).otherwise(0)
    copies = F.when(F.col(label) == 1, F.coalesce(wanted, F.lit(1))).otherwise(1).cast("int")
    return (
        df.withColumn("_f", counts).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("_f")
    )


def error_sample(scored: DataFrame, label: str = "y", score: str = "score", threshold: float = 0.5, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` false positives and ``n`` false negatives in hash order."""
    order = hash_order(seed, "pitcher_id", "as_of_date")
    flagged = F.col(score) >= threshold
    fp = scored.where(flagged & (F.col(label) == 0)).orderBy(order).limit(n).withColumn("kind", F.lit("false_positive"))
    fn = scored.where(~flagged & (F.col(label) == 1)).orderBy(order).limit(n).withColumn("kind", F.lit("false_negative"))
    return fp.unionByName(fn)
