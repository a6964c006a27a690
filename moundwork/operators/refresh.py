"""Features kept up to date by batches of new or late pitches, without recomputing what cannot change.

Two tables live beside each other, both by month: daily sums of every pitcher (mergeable, so a batch
is added to the days it holds) and one feature row per pitcher and game day. A pitch of day ``d``
changes features of its pitcher from ``d`` to ``d + LONGEST`` days, and these look back ``LONGEST`` days. So a
batch reads the daily sums of the months around its days, only for its pitchers, and replaces the
feature rows of that range; months that it cannot reach are neither read nor written.

Features are those of day windows: pitches strictly before the game (7, 14, 30 and 60 days) and load
with the game itself (7, 14 and 30 days). Counts by games instead of days have no last day on which
a late pitch shows, so they are not kept here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundwork.functions import windows as w
from moundwork.operators import rolling
from moundwork.session import written_once
from moundwork.sources.partitions import PartitionedTable

BEFORE, LOAD = (7, 14, 30, 60), (7, 14, 30)
LONGEST = max(*BEFORE, *LOAD)
MONTH = "date_format(game_date, 'yyyy-MM')"
KEYS = ["pitcher_id", "game_date"]


def window_features(daily: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """All day-window features of every row of ``rolling.daily_pitch_sums``; columns in ``also`` stay.

    One line of days per pitcher carries all of them, so nothing wider than the daily sums is exchanged.
    """
    load = {}
    for n in LOAD:
        frame = w.last_days(n)
        load[f"roll{n}d_pitch_count"] = F.sum("n").over(frame)
        load[f"roll{n}d_appearances"] = F.count(F.lit(1)).over(frame)
        load[f"roll{n}d_avg_pitches_per_appearance"] = F.avg("n").over(frame)
    placed = daily.withColumn(w.DAY_NUMBER, w.day_number()).withColumns(load).withColumn("last_game_pitches", F.col("n"))
    return rolling.pregame_from_days(placed, BEFORE, ["last_game_pitches", *load, *also])


class FeatureStore:
    """Daily sums and features under one folder; ``add`` is the nightly step."""

    def __init__(self, spark: SparkSession, folder: str, pitches: DataFrame):
        sums = rolling.daily_pitch_sums(pitches.where("false"))
        self.daily = PartitionedTable(spark, f"{folder}/daily", MONTH, sums.schema)
        self.features = PartitionedTable(spark, f"{folder}/features", MONTH, window_features(sums).schema)

    def add(self, pitches: DataFrame, batch: str) -> None:
        """Take in the pitches of a batch, each new to the store, in any order of days; sent again, it changes nothing.

        Rows without a pitcher or day belong to no feature row and are left out. The features are committed last: a run
        that dies between the two commits is finished by sending the batch again.
        """
        if self.features.has(batch):
            return
        fresh = written_once(
            rolling.daily_pitch_sums(pitches.where(F.col("pitcher_id").isNotNull() & F.col("game_date").isNotNull())), "batch-days")
        self._add_days(fresh, batch)
        changed = fresh.select(*KEYS)
        context = self._marked(self.daily.read(self._months(changed, -LONGEST, LONGEST)), changed)
        renewed = window_features(context, ["_hit"]).where("_hit").drop("_hit")
        months = self._months(changed, 0, LONGEST)
        kept = self._changed_rows(self.features.read(months), self._touched(changed), False)
        self.features.replace(kept.unionByName(renewed), months, batch, dealt=True)

    def _add_days(self, fresh: DataFrame, batch: str) -> None:
        if self.daily.has(batch):
            return
        months = self.daily.parts_of(fresh)
        both = self.daily.read(months).unionByName(fresh)
        largest = ("max_speed",)
        summed = both.groupBy(*KEYS).agg(*[
            (F.max(c) if c in largest else F.sum(c)).alias(c) for c in fresh.columns if c not in KEYS])
        self.daily.replace(summed, months, batch, spread="pitcher_id")

    @staticmethod
    def _months(changed: DataFrame, first: int, last: int) -> set[str]:
        """The months from ``first`` to ``last`` days after a changed day; a few a row, as the rows may be listed before they are distinct."""
        months = F.sequence(F.trunc(F.date_add("game_date", first), "MM"), F.date_add("game_date", last), F.expr("interval 1 month"))
        found = changed.select("game_date").distinct().select(F.explode(months).alias("game_date"))
        return {r[0] for r in found.select(F.expr(MONTH)).distinct().collect()}

    @staticmethod
    def _marked(days: DataFrame, changed: DataFrame) -> DataFrame:
        """Daily rows of the pitchers with a changed day, and ``_hit``: one lies at most ``LONGEST`` days back.

        Changed days stand on the line of daily rows as marks, which the frames see and the filter then drops.
        """
        marks = changed.select(*KEYS, F.lit(True).alias("_mark"))
        line = days.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True).withColumn(w.DAY_NUMBER, w.day_number())
        seen = line.withColumns({"_hit": F.max("_mark").over(w.last_days(LONGEST)), "_any": F.max("_mark").over(Window.partitionBy("pitcher_id"))})
        return seen.where(F.col("_any") & ~F.col("_mark")).drop("_any", "_mark")

    @staticmethod
    def _touched(changed: DataFrame) -> DataFrame:
        """Changed days that a month of a pitcher can see: a row per (pitcher, month) with a list of at most three months' days."""
        months = F.sequence(F.trunc("game_date", "MM"), F.date_add("game_date", LONGEST), F.expr("interval 1 month"))
        seen = changed.select("pitcher_id", "game_date", F.explode(months).alias("_month"))
        return seen.groupBy("pitcher_id", "_month").agg(F.collect_set("game_date").alias("_changed"))

    @staticmethod
    def _changed_rows(rows: DataFrame, touched: DataFrame, wanted: bool) -> DataFrame:
        """Rows within ``LONGEST`` days after a changed day of their pitcher, or the others.

        Joined on the executors: the lists compress so well that they would pass for small and go through the driver.
        """
        placed = rows.withColumn("_month", F.trunc("game_date", "MM")).join(touched.hint("merge"), ["pitcher_id", "_month"], "left")
        hit = F.exists("_changed", lambda d: (d <= F.col("game_date")) & (d >= F.date_sub("game_date", LONGEST)))
        return placed.where(F.coalesce(hit, F.lit(False)) == F.lit(wanted)).drop("_month", "_changed")
