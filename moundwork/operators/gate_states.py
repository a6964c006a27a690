"""Quality gates from stored states: a run reads the days it is given, not the history.

For every day three small results are kept, each mergeable over days: one row of counts, sums, ends and
products of its pitches and games (``days``), and the pitchers seen (``pitchers``). A key of a
pitch holds its day, so copies of a key are counted within days. A batch is the whole content of the
days it names: new days are added, days that came again are replaced. Gates are then folded
from the states, with the checks of ``operators.quality``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundwork.operators import quality as q
from moundwork.sources.partitions import PartitionedTable

MONTH = "date_format(game_date, 'yyyy-MM')"
SUMS = ("rows", "no_speed", "no_spin", "no_type", "speed", "spin", "pairs", "xy", "x", "y", "xx", "yy", "keys", "copied", "games", "load")
# Speeds and spins are summed around these centres, so that squares stay small.
CENTRES = {"release_speed": 90.0, "release_spin_rate": 2200.0}


def day_states(pitches: DataFrame, games: DataFrame) -> DataFrame:
    """One row per day of the mergeable results; rows without a day belong to none."""
    speed, spin = (F.col(c).cast("double") - centre for c, centre in CENTRES.items())
    both = speed.isNotNull() & spin.isNotNull()

    def over_pairs(value):
        return F.coalesce(F.sum(F.when(both, value)), F.lit(0.0))

    per_key = pitches.where("game_date is not null").groupBy(*q.PITCH_KEY).agg(F.count(F.lit(1)).alias("n"))
    copies = per_key.groupBy("game_date").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("copied"))
    per_day = pitches.where("game_date is not null").groupBy("game_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(speed.isNull()).alias("no_speed"), F.count_if(spin.isNull()).alias("no_spin"),
        F.count_if(F.col("pitch_type").isNull()).alias("no_type"),
        F.coalesce(F.sum(speed), F.lit(0.0)).alias("speed"), F.coalesce(F.sum(spin), F.lit(0.0)).alias("spin"),
        F.min("release_speed").cast("double").alias("min_speed"), F.max("release_speed").cast("double").alias("max_speed"),
        F.min("release_spin_rate").cast("double").alias("min_spin"), F.max("release_spin_rate").cast("double").alias("max_spin"),
        F.count_if(both).alias("pairs"), over_pairs(speed * spin).alias("xy"), over_pairs(speed).alias("x"), over_pairs(spin).alias("y"),
        over_pairs(speed * speed).alias("xx"), over_pairs(spin * spin).alias("yy"))
    played = games.where("game_date is not null").groupBy("game_date").agg(
        F.count(F.lit(1)).alias("games"), F.coalesce(F.sum("pitches_thrown"), F.lit(0)).cast("long").alias("load"), F.max("pitches_thrown").cast("long").alias("max_load"))
    joined = per_day.join(copies, "game_date").join(played, "game_date", "full")
    return joined.fillna(0, [c for c in SUMS])


def day_pitchers(pitches: DataFrame) -> DataFrame:
    return pitches.where("game_date is not null and pitcher_id is not null").select("game_date", "pitcher_id").distinct()


class GateStates:
    def __init__(self, spark: SparkSession, folder: str, pitches: DataFrame, games: DataFrame):
        none = pitches.where("false"), games.where("false")
        self.days = PartitionedTable(spark, f"{folder}/days", MONTH, day_states(*none).schema)
        self.pitchers = PartitionedTable(spark, f"{folder}/pitchers", MONTH, day_pitchers(none[0]).schema)

    def put(self, pitches: DataFrame, games: DataFrame, batch: str) -> None:
        """All pitches and games of the days they hold; a batch that is sent again changes nothing."""
        for table, rows in ((self.days, day_states(pitches, games)), (self.pitchers, day_pitchers(pitches))):
            if table.has(batch):
                continue
            months = table.parts_of(rows)
            kept = table.read(months).join(rows.select("game_date").distinct(), "game_date", "left_anti")
            table.replace(kept.unionByName(rows), months, batch)

    def gates(self, as_of: str, min_pitches: int = q.MIN_PITCHES_PER_SEASON, min_games: int = q.MIN_APPEARANCES_PER_SEASON) -> DataFrame:
        """Row counts, missing data, ranges, duplicates, days and speeds against spins, as the gates over all rows give them."""
        days = self.days.read()
        season = F.year("game_date").alias("season")
        ends = [f(c).alias(c) for f, names in ((F.min, ("min_speed", "min_spin")), (F.max, ("max_speed", "max_spin", "max_load"))) for c in names]
        total = days.agg(*[F.sum(c).alias(c) for c in SUMS], *ends)
        seen = self.pitchers.read().select(season, "pitcher_id").distinct().groupBy("season").agg(F.count(F.lit(1)).alias("pitchers"))
        seasons = days.where("rows > 0").groupBy(season).agg(F.sum("rows").alias("rows")).join(seen, "season", "left").fillna(0, ["pitchers"])
        played = days.where("games > 0").groupBy(season).agg(F.sum("games").alias("games"))

        def share(part):
            return F.col(part) * 100.0 / F.nullif(F.col("rows"), F.lit(0))

        means = {
            name: F.col(name) / F.nullif(F.col("rows") - F.col(f"no_{name}"), F.lit(0)) + centre
            for name, centre in zip(("speed", "spin"), CENTRES.values())}
        ranges = []
        for name, label, span, mean in (("speed", "velocity", q.VELOCITY_RANGE, q.MEAN_VELOCITY_RANGE), ("spin", "spin", q.SPIN_RANGE, q.MEAN_SPIN_RANGE)):
            ranges += [
                q.at_least(f"min_{label}", F.col(f"min_{name}"), span[0]), q.at_most(f"max_{label}", F.col(f"max_{name}"), span[1]),
                q.at_least(f"avg_{label}_low", means[name], mean[0], "warning"), q.at_most(f"avg_{label}_high", means[name], mean[1], "warning")]
        n = F.col("pairs")
        spread = (F.col("xx") - F.col("x") * F.col("x") / n) * (F.col("yy") - F.col("y") * F.col("y") / n)
        corr = F.when((n > 1) & (spread > 0), (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(spread))
        future, old = F.col("game_date") > F.lit(as_of).cast("date"), F.col("game_date") < F.lit(q.OLDEST_DAY).cast("date")
        pitched = days.where("rows > 0").agg(
            F.count(F.lit(1)).alias("dates"), F.coalesce(F.sum(F.when(future, F.col("rows"))), F.lit(0)).alias("future"),
            F.coalesce(F.sum(F.when(old, F.col("rows"))), F.lit(0)).alias("old"),
            (F.count_if(F.dayofweek("game_date").isin(1, 7)) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("weekend"))
        load = F.col("load") / F.nullif(F.col("games"), F.lit(0))
        frames = [
            q.as_gate("row_counts", total, [q.more_than("total_pitches", F.col("rows"), 0), q.more_than("total_appearances", F.col("games"), 0)]),
            q.as_gate("row_counts", seasons, [
                q.at_least("season_pitches", F.col("rows"), min_pitches), q.at_least("season_pitchers", F.col("pitchers"), q.MIN_PITCHERS, "warning")], F.col("season")),
            q.as_gate("row_counts", played, [q.at_least("season_appearances", F.col("games"), min_games)], F.col("season")),
            q.as_gate("missing_data", total, [
                q.at_most("null_velocity_pct", share("no_speed"), q.MAX_NULL_VELOCITY_PCT), q.at_most("null_spin_pct", share("no_spin"), q.MAX_NULL_SPIN_PCT),
                q.at_most("null_pitch_type_pct", share("no_type"), 1.0, "warning")]),
            q.as_gate("data_ranges", total, ranges),
            q.as_gate("duplicates", total, [
                q.at_most("duplicate_pct", (F.col("rows") - F.col("keys")) * 100.0 / F.nullif(F.col("rows"), F.lit(0)), q.MAX_DUPLICATE_PCT),
                q.at_most("duplicate_groups", F.col("copied"), 0, "warning")]),
            q.as_gate("temporal", pitched, [
                q.more_than("valid_dates", F.col("dates"), 0), q.at_most("future_pitches", F.col("future"), 0), q.at_most("pitches_before_2015", F.col("old"), 0, "warning"),
                q.at_least("weekend_pct_low", F.col("weekend"), q.WEEKEND_PCT_RANGE[0], "warning"),
                q.at_most("weekend_pct_high", F.col("weekend"), q.WEEKEND_PCT_RANGE[1], "warning")]),
            q.as_gate("monotonic", total, [
                q.more_than("valid_pairs", n, 0), q.check("speed_spin_corr", corr, 0.0, corr > 0, "warning"),
                q.at_least("mean_pitches_low", load, 10, "warning"), q.at_most("mean_pitches_high", load, 50, "warning"),
                q.at_most("max_pitches", F.col("max_load"), 200, "warning")]),
        ]
        return reduce(DataFrame.unionByName, frames)
