"""Forward-looking injury labels and sample selection.

A label asks whether a pitcher has an injury start inside a day window around a game. Instead of
a range join (which pairs every game with every injury of the pitcher) the injury days and the
game days are put on one daily line per pitcher and looked up with range frames of one sort: one
shuffle, linear work, no row multiplication. Where the answer really is one row per (injury,
game), the fixed number of window days is exploded and joined by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = "game_date"


def _pitcher_days() -> Window:
    return Window.partitionBy("pitcher_id").orderBy("_day")


def _injury_days(injuries: DataFrame) -> DataFrame:
    return injuries.select("pitcher_id", F.col("il_start").alias("_start")).distinct()


def with_injury_windows(
    games: DataFrame, injuries: DataFrame, windows: dict[str, tuple[int, int]], day: str = DAY
) -> DataFrame:
    """Add a boolean per window: some injury starts between ``day + lo`` and ``day + hi`` (closed)."""
    rows = games.withColumns({"_day": F.unix_date(day), "_hurt": F.lit(None).cast("int")})
    marks = _injury_days(injuries).select(
        "pitcher_id", F.unix_date("_start").alias("_day"), F.lit(1).alias("_hurt")
    )
    line = rows.unionByName(marks, allowMissingColumns=True)
    order = _pitcher_days()
    seen = {
        name: F.max("_hurt").over(order.rangeBetween(lo, hi)).isNotNull()
        for name, (lo, hi) in windows.items()
    }
    return line.withColumns(seen).where(F.col("_hurt").isNull()).drop("_day", "_hurt")


def label_forward(
    games: DataFrame, injuries: DataFrame, horizons: tuple[int, ...] = (21,), day: str = DAY
) -> DataFrame:
    """``label_<h>d``: 1 when an injury starts in (day, day + h]."""
    flags = {f"label_{h}d": (1, h) for h in horizons}
    out = with_injury_windows(games, injuries, flags, day)
    return out.withColumns({name: F.col(name).cast("int") for name in flags})


def label_with_blackout(
    games: DataFrame, injuries: DataFrame, blackout: int = 3, horizon: int = 21, keep: bool = False,
    day: str = DAY,
) -> DataFrame:
    """1/0 label with games 0..blackout days before an injury set to null (and dropped)."""
    out = with_injury_windows(
        games, injuries, {"_near": (0, blackout), "_ahead": (1, horizon)}, day
    ).withColumn(
        "injury_within_21d", F.when(~F.col("_near"), F.col("_ahead").cast("int"))
    ).withColumnRenamed("_near", "blackout_violation").drop("_ahead")
    return out if keep else out.where(~F.col("blackout_violation"))


def healthy_appearances(games: DataFrame, injuries: DataFrame, days: int = 30) -> DataFrame:
    """Games with no injury of that pitcher within ``days`` on either side."""
    return with_injury_windows(games, injuries, {"_near": (-days, days)}).where(~F.col("_near")).drop("_near")


def _stint_days(injuries: DataFrame, first: int, last: int) -> DataFrame:
    """Every stint once per day of [start + first, start + last]; the day count is fixed."""
    span = F.sequence(F.date_add("il_start", first), F.date_add("il_start", last))
    return injuries.withColumn(DAY, F.explode(span))


def pre_injury_appearances(
    games: DataFrame, injuries: DataFrame, window: int = 21, distinct: bool = False
) -> DataFrame:
    """Games in [start - window, start), once per stint they precede (or once if ``distinct``)."""
    if distinct:
        return with_injury_windows(games, injuries, {"_ahead": (1, window)}).where("_ahead").drop("_ahead")
    days = _stint_days(injuries, -window, -1)
    return games.join(days, ["pitcher_id", DAY]).withColumn("label", F.lit(1))


def last_n_before_injury(games: DataFrame, injuries: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` games strictly before each stint, found by game ordinal.

    The number of games before a stint comes from a running count on the shared daily line; its
    last ``n`` ordinals are then an equality join.
    """
    by_day = _pitcher_days()
    numbered = games.withColumn(
        "_no", F.row_number().over(Window.partitionBy("pitcher_id").orderBy(DAY))
    )
    line = games.select("pitcher_id", F.unix_date(DAY).alias("_day"), F.lit(1).alias("_game")).unionByName(
        injuries.withColumns({"_day": F.unix_date("il_start"), "_game": F.lit(0)}), allowMissingColumns=True
    )
    before = F.sum("_game").over(by_day.rangeBetween(Window.unboundedPreceding, -1))
    stints = line.withColumn("_before", before).where(
        F.col("il_start").isNotNull() & (F.col("_before") > 0)
    ).drop("_day", "_game")
    wanted = stints.withColumn(
        "_no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_before") - (n - 1)), F.col("_before")))
    ).withColumn("_no", F.col("_no").cast("int"))
    return (
        numbered.join(wanted, ["pitcher_id", "_no"])
        .withColumns({"label": F.lit(1), "games_before_injury": F.col("_before") - F.col("_no") + 1})
        .drop("_no", "_before")
    )


def hash_order(seed: int, *cols: str) -> Column:
    """A reproducible shuffle order that any engine with md5 can repeat."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def healthy_control_window(
    games: DataFrame, injuries: DataFrame, first: int = 120, last: int = 60, most: int = 3, seed: int = 42
) -> DataFrame:
    """Up to ``most`` games per stint from [start - first, start - last], drawn in hash order."""
    days = _stint_days(injuries.select("pitcher_id", "il_start"), -first, -last)
    rank = F.row_number().over(
        Window.partitionBy("pitcher_id", "il_start").orderBy(hash_order(seed, "pitcher_id", "il_start", DAY))
    )
    return (
        games.join(days, ["pitcher_id", DAY]).withColumn("_draw", rank).where(F.col("_draw") <= most)
        .drop("_draw").withColumn("label", F.lit(0))
    )


def gap_label(appearances: DataFrame, days: int = 21) -> DataFrame:
    """Days to the pitcher's next game; label 1 above ``days``, the last game has 0."""
    following = F.lead(DAY).over(Window.partitionBy("pitcher_id").orderBy(DAY))
    gap = F.datediff(following, DAY)
    return appearances.withColumns(
        {"gap_days": gap, "gap_label": F.when(gap > days, 1).otherwise(0)}
    )


def features_with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels, ["pitcher_id", "as_of_date"], "inner")


def features_with_pitcher_labels(features: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Join on the pitcher alone (one label row per pitcher); rows without a label are dropped."""
    return features.join(labels, "pitcher_id", "inner").dropna(subset=[label])


def earliest_stint_in_window(injuries: DataFrame, start: str, end: str) -> DataFrame:
    """First stint start per pitcher inside a date range, with its recovery length in days."""
    inside = injuries.where(F.col("il_start").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return (
        inside.groupBy("pitcher_id")
        .agg(F.min(F.struct("il_start", "il_end")).alias("s"), F.count(F.lit(1)).alias("stints"))
        .select("pitcher_id", "stints", "s.il_start", "s.il_end",
                F.datediff("s.il_end", "s.il_start").alias("injury_recovery_days"))
    )
