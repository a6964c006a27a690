"""Frames over the daily line of one pitcher.

All of them share ``partitionBy(pitcher_id).orderBy(day number)``, so any mix of frames costs one
exchange and one sort. A partition holds at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

DAY_NUMBER = "_day"


def day_number(day: str = "game_date") -> Column:
    return F.unix_date(day)


def pitcher_days() -> WindowSpec:
    return Window.partitionBy("pitcher_id").orderBy(DAY_NUMBER)


def last_days(days: int) -> WindowSpec:
    """Closed at both ends: the row's day and the ``days`` days before it."""
    return pitcher_days().rangeBetween(-days, 0)


def trailing_days(days: int) -> WindowSpec:
    """Half-open: (day - days, day]."""
    return pitcher_days().rangeBetween(-(days - 1), 0)


def days_before(days: int) -> WindowSpec:
    """Strictly before the row's day: [day - days, day)."""
    return pitcher_days().rangeBetween(-days, -1)


def last_games(games: int) -> WindowSpec:
    return pitcher_days().rowsBetween(-(games - 1), 0)


def so_far() -> WindowSpec:
    return pitcher_days().rowsBetween(Window.unboundedPreceding, 0)


def sample_std(n: Column, total: Column, squares: Column) -> Column:
    """Sample deviation from centred sums; null below two values."""
    return F.when(n > 1, F.sqrt(F.greatest(squares - total * total / n, F.lit(0.0)) / (n - 1)))


def trend_label(slope: Column, spread: Column, n: Column) -> Column:
    """increasing / decreasing when the slope passes a tenth of the population deviation."""
    edge = spread * 0.1
    return (
        F.when(n < 3, "stable").when(slope > edge, "increasing").when(slope < -edge, "decreasing")
        .otherwise("stable")
    )
