"""Profile joins, key checks and newest-row lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def appearance_with_profile(appearances: DataFrame, pitchers: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Games of a span of seasons with the pitcher's name, team and role.

    The profile side is not forced into a broadcast: its size decides, through the session's
    broadcast threshold. Games are filtered and reduced before the join.
    """
    games = appearances.where(
        F.col("game_date").between(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-31").cast("date"))
        & (F.col("pitches_thrown") > 0)
    ).select("pitcher_id", "game_date", "pitches_thrown", "innings_pitched")
    profile = pitchers.select("pitcher_id", F.col("name").alias("pitcher_name"), "team", "role")
    return games.distinct().join(profile, "pitcher_id", "left").withColumn("season", F.year("game_date"))


def missing_rows(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def existing_rows(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def pitchers_only_in(df: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct pitchers of ``df`` that ``other`` lacks; both sides are reduced to ids first."""
    ids = df.select("pitcher_id").distinct()
    return ids.join(other.select("pitcher_id").distinct(), "pitcher_id", "left_anti")


def pitcher_coverage(pitches: DataFrame, appearances: DataFrame) -> DataFrame:
    """Pitchers with games but no pitches, and with pitches but no games, as counts."""
    parts = [
        pitchers_only_in(a, b).agg(F.count(F.lit(1)).alias("pitchers")).withColumn("side", F.lit(name))
        for name, a, b in (
            ("appearances_without_pitches", appearances, pitches),
            ("pitches_without_appearances", pitches, appearances),
        )
    ]
    return parts[0].unionByName(parts[1]).select("side", "pitchers")


def id_overlap(pitches: DataFrame, appearances: DataFrame) -> DataFrame:
    """Is every pitcher with games also in the pitch table, and how many are in both?"""
    a = appearances.select("pitcher_id").distinct()
    p = pitches.select("pitcher_id").distinct()
    marks = a.withColumns({"in_a": F.lit(1), "in_p": F.lit(0)}).unionByName(
        p.withColumns({"in_a": F.lit(0), "in_p": F.lit(1)})
    ).groupBy("pitcher_id").agg(F.max("in_a").alias("a"), F.max("in_p").alias("p"))
    return marks.agg(
        F.count_if((F.col("a") == 1) & (F.col("p") == 1)).alias("shared"),
        F.count_if((F.col("a") == 1) & (F.col("p") == 0)).alias("only_appearances"),
        F.count_if((F.col("a") == 0) & (F.col("p") == 1)).alias("only_pitches"),
    ).withColumn("contained", F.col("only_appearances") == 0)


def injury_history(pitchers: DataFrame, injuries: DataFrame) -> DataFrame:
    """Every stint of every pitcher, numbered from the newest."""
    newest = Window.partitionBy("pitcher_id").orderBy(F.desc("il_start"))
    return pitchers.select("pitcher_id", "name").join(injuries, "pitcher_id").withColumn(
        "stint_no", F.row_number().over(newest)
    )


def newest_row(df: DataFrame, day: str, as_of: str | None = None) -> DataFrame:
    """Each pitcher's newest row, optionally at or before a date: one max_by aggregate."""
    if as_of is not None:
        df = df.where(F.col(day) <= F.lit(as_of).cast("date"))
    names = [c for c in df.columns if c != "pitcher_id"]
    return df.groupBy("pitcher_id").agg(F.max_by(F.struct(*names), day).alias("r")).select(
        "pitcher_id", *[F.col(f"r.{n}").alias(n) for n in names]
    )


def latest_snapshot(pitchers: DataFrame, snapshots: DataFrame, as_of: str | None = None) -> DataFrame:
    """All pitchers with their newest snapshot (nulls when there is none)."""
    return pitchers.select("pitcher_id", "name", "team", "role").join(
        newest_row(snapshots, "as_of_date", as_of), "pitcher_id", "left"
    )


def latest_appearance(appearances: DataFrame) -> DataFrame:
    return newest_row(appearances.select("pitcher_id", "game_date", "avg_vel"), "game_date")
