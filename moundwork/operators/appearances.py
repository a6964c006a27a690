"""Pitch rows to one row per pitcher and game day.

Every variant is a single hash aggregate on (pitcher_id, game_date): partial sums are combined
before the shuffle, so a pitcher with a third of all pitches still reaches the reducers as at
most one row per map task and day. The daily grain is what all later windows run on; a pitcher
has at most one row per calendar day there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundwork.bindings import half_even

KEYS = ("pitcher_id", "game_date")
PITCHES_PER_INNING = 15.0


def filled(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def _innings(count: Column) -> Column:
    return half_even(count / PITCHES_PER_INNING, 1)


def pitches_to_appearances(pitches: DataFrame) -> DataFrame:
    """Counts, means and sample deviations per game; a single pitch has deviation 0."""
    speed, spin = "release_speed", "release_spin_rate"
    return (
        pitches.groupBy(*KEYS)
        .agg(
            F.count("pitch_number").alias("pitches_thrown"),
            half_even(F.avg(speed), 2).alias("avg_vel"),
            filled(half_even(F.stddev_samp(speed), 2)).alias("vel_std"),
            half_even(F.avg(spin), 2).alias("avg_spin"),
            filled(half_even(F.stddev_samp(spin), 2)).alias("spin_std"),
        )
        .withColumn("innings_pitched", _innings(F.col("pitches_thrown")))
        .withColumn("outs_recorded", (F.col("innings_pitched") * 3).cast("int"))
    )


def appearances_with_release(pitches: DataFrame, by_season: bool = False) -> DataFrame:
    """Adds release-point spread and extension; deviations of one pitch stay null."""
    keys = [*KEYS, "season"] if by_season else list(KEYS)
    return (
        pitches.groupBy(*keys)
        .agg(
            F.count("pitch_number").alias("pitches_thrown"),
            half_even(F.avg("release_speed"), 2).alias("avg_vel"),
            half_even(F.stddev_samp("release_speed"), 2).alias("vel_std"),
            half_even(F.avg("release_spin_rate"), 2).alias("avg_spin"),
            half_even(F.stddev_samp("release_spin_rate"), 2).alias("spin_std"),
            half_even(F.stddev_samp("release_pos_x"), 2).alias("release_x_std"),
            half_even(F.stddev_samp("release_pos_z"), 2).alias("release_z_std"),
            half_even(F.avg("release_extension"), 2).alias("avg_extension"),
        )
        .withColumn("innings_pitched", _innings(F.col("pitches_thrown")))
        .withColumn("outs_recorded", (F.col("innings_pitched") * 3).cast("int"))
    )


def appearances_clamped(pitches: DataFrame) -> DataFrame:
    """One-decimal speeds, truncated spins, innings held within 0.1 and 9."""
    count = F.count(F.lit(1))
    return pitches.groupBy(*KEYS).agg(
        count.alias("pitches_thrown"),
        half_even(F.avg("release_speed"), 1).alias("avg_vel"),
        F.avg("release_spin_rate").cast("int").alias("avg_spin"),
        filled(half_even(F.stddev_samp("release_speed"), 1)).alias("vel_std"),
        filled(F.stddev_samp("release_spin_rate")).cast("int").alias("spin_std"),
        F.least(F.lit(9.0), F.greatest(F.lit(0.1), _innings(count))).alias("innings_pitched"),
    )


def appearances_by_last_pitch(pitches: DataFrame) -> DataFrame:
    """Pitch total read from the highest pitch number, with distinct at-bats.

    At-bats are first collapsed on (pitcher, day, at-bat), which a distinct count would otherwise
    do with an expanded shuffle.
    """
    per_at_bat = pitches.groupBy(*KEYS, "at_bat_id").agg(
        F.max("pitch_number").alias("last_pitch"),
        F.count("release_speed").alias("n_speed"),
        F.sum("release_speed").alias("s_speed"),
        F.sum(F.col("release_speed") * F.col("release_speed")).alias("q_speed"),
        F.count("release_spin_rate").alias("n_spin"),
        F.sum(F.col("release_spin_rate").cast("double")).alias("s_spin"),
        F.sum(F.col("release_spin_rate").cast("double") * F.col("release_spin_rate")).alias("q_spin"),
    )
    sums = {c: F.sum(c) for c in ("n_speed", "s_speed", "q_speed", "n_spin", "s_spin", "q_spin")}

    def spread(metric: str) -> Column:
        n, s, q = sums[f"n_{metric}"], sums[f"s_{metric}"], sums[f"q_{metric}"]
        return F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))

    return per_at_bat.groupBy(*KEYS).agg(
        F.max("last_pitch").alias("pitches_thrown"),
        (sums["s_speed"] / F.nullif(sums["n_speed"], F.lit(0))).alias("avg_vel"),
        spread("speed").alias("vel_std"),
        (sums["s_spin"] / F.nullif(sums["n_spin"], F.lit(0))).alias("avg_spin"),
        spread("spin").alias("spin_std"),
        F.count(F.lit(1)).alias("at_bats"),
    )


def pitch_with_appearance(pitches: DataFrame, appearances: DataFrame) -> DataFrame:
    """Each pitch with its game's aggregates (left join on pitcher and day)."""
    return pitches.join(appearances, list(KEYS), "left")


def reaggregate_joined(joined: DataFrame) -> DataFrame:
    """Back to one row per game, taking each game's aggregates once despite the join's fan-out."""
    # First as one struct: such an aggregate streams over the order the join leaves and holds no table of all games.
    return joined.groupBy(*KEYS).agg(
        F.first(F.struct("pitches_thrown", "innings_pitched")).alias("_game"),
        F.avg("avg_vel").alias("avg_vel"),
        F.avg("avg_spin").alias("avg_spin"),
    ).select(*KEYS, "_game.pitches_thrown", "avg_vel", "avg_spin", "_game.innings_pitched")


def daily_totals(appearances: DataFrame) -> DataFrame:
    return appearances.groupBy(*KEYS).agg(
        F.sum("pitches_thrown").alias("pitches_thrown"),
        F.sum("innings_pitched").alias("innings_pitched"),
    )


def pitch_stats_per_appearance(labelled: DataFrame, pitches: DataFrame) -> DataFrame:
    """Mean speed and spin of the game's pitches on each labelled appearance; none gives 0."""
    stats = pitches.groupBy(*KEYS).agg(
        F.avg("release_speed").alias("avg_velocity"), F.avg("release_spin_rate").alias("avg_spin_rate")
    )
    return labelled.join(stats, list(KEYS), "left").fillna(0.0, ["avg_velocity", "avg_spin_rate"])


def labels_back_to_pitches(pitches: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Game labels on every pitch of the game; games without a label count as 0."""
    return pitches.join(labels.select(*KEYS, label), list(KEYS), "left").fillna(0, [label])


def labels_per_pitcher(labels: DataFrame, label: str, day: str = "game_date") -> DataFrame:
    return labels.groupBy("pitcher_id").agg(F.max(label).alias(label), F.max(day).alias("last_date"))


def release_point_stability(pitches: DataFrame) -> DataFrame:
    """Spread of the release point and the per-day slope of the extension, per pitcher."""
    day = F.unix_date("game_date").cast("double")
    return pitches.groupBy("pitcher_id").agg(
        F.stddev_samp("release_pos_x").alias("release_x_std"),
        F.stddev_samp("release_pos_z").alias("release_z_std"),
        F.regr_slope("release_extension", day).alias("extension_slope"),
    )
