"""Replay-safe loads. Each returns the rows to append, or the table after the load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundwork.sources.partitions import PartitionedTable

PITCH_KEY = ("pitcher_id", "game_date", "at_bat_id", "pitch_number")
GAME_KEY = ("pitcher_id", "game_date")
PITCHER_KEY = ("pitcher_id",)


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest row of each key; a hash aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def idempotent_load(
    new: DataFrame, existing: DataFrame, keys: Sequence[str], dedup_batch: bool = True
) -> DataFrame:
    """Rows of ``new`` whose key is not loaded yet; running it twice adds nothing."""
    batch = one_per_key(new, keys) if dedup_batch else new
    return batch.join(existing.select(*keys), list(keys), "left_anti")


def upsert_records(new: DataFrame, existing: DataFrame, keys: Sequence[str], stamp: str = "updated_at") -> DataFrame:
    """The table after an upsert: newest stamp wins, the incoming row on equal stamps."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    order = F.struct(F.col(stamp), F.col("_new"), F.struct(*rest))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


def upsert_batch(table: PartitionedTable, new: DataFrame, keys: Sequence[str], batch: str, stamp: str = "updated_at") -> None:
    """Upsert into the partitions that hold the batch's keys; no other file is read or written.

    The partition must follow from the keys, so a key's old row is in the partition of its new one.
    """
    if table.has(batch):
        return
    touched = table.parts_of(new)
    merged = upsert_records(new, table.read(touched), keys, stamp)
    table.replace(merged, touched, batch, spread=keys[0])


def missing_pitcher_profiles(pitches: DataFrame, pitchers: DataFrame, above_id: int = 500_000, starter_pitches: int = 50) -> DataFrame:
    """Profiles for pitch ids without one. Ids are aggregated before the anti join."""
    per = pitches.where(F.col("pitcher_id") > above_id).groupBy("pitcher_id").agg(
        F.count(F.lit(1)).alias("total_pitches"), F.min("game_date").alias("first_game"),
        F.max("game_date").alias("last_game"), F.avg("release_speed").alias("baseline_velocity"),
    )
    return per.join(pitchers.select("pitcher_id"), "pitcher_id", "left_anti").withColumns({
        "name": F.concat(F.lit("MLB Pitcher "), F.col("pitcher_id")), "team": F.lit("MLB"),
        "role": F.when(F.col("total_pitches") > starter_pitches, "starter").otherwise("reliever"),
        "baseline_spin_rate": F.lit(2200),
    })


def role_from_load(appearances: DataFrame, starter_pitches: float = 50.0) -> DataFrame:
    per = appearances.groupBy("pitcher_id").agg(F.avg("pitches_thrown").alias("mean_pitches"))
    return per.withColumn("role", F.when(F.col("mean_pitches") > starter_pitches, "starter").otherwise("reliever"))


def season_spans(pitches: DataFrame) -> DataFrame:
    """First and last pitch day per season."""
    return pitches.groupBy(F.year("game_date").alias("season")).agg(
        F.min("game_date").alias("start"), F.max("game_date").alias("end")
    )


def month_batches(seasons: DataFrame) -> DataFrame:
    """Calendar-month ranges of each season, clipped to the season's own span."""
    month = F.explode(F.sequence(F.trunc("start", "MM"), F.col("end"), F.expr("interval 1 month")))
    return seasons.withColumn("_m", month).select(
        "season", F.greatest("_m", "start").alias("start_date"), F.least(F.last_day("_m"), F.col("end")).alias("end_date"),
        F.date_format("_m", "yyyy-MM").alias("month"),
    )


def is_loaded(existing: DataFrame, start: str, end: str, day: str = "game_date") -> bool:
    """Whether any row of the range exists already; stops at the first row found."""
    inside = existing.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return not inside.limit(1).isEmpty()


def batches_to_load(batches: DataFrame, existing: DataFrame, day: str = "game_date") -> DataFrame:
    """Batches without a single loaded row (an anti join on the month)."""
    present = existing.select(F.date_format(day, "yyyy-MM").alias("month")).distinct()
    return batches.join(present, "month", "left_anti")
