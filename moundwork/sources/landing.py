"""Shaping landed feeds: pitch rows, pages, API payloads, transactions and rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundwork.functions import text
from moundwork.functions.barrier import compute_once
from moundwork.sources.markup import page_parts

# The feed columns worth keeping, words that mark injury text, and line words.
FEED_COLUMNS = (
    "game_date", "pitcher", "batter", "events", "description", "pitch_type", "release_speed",
    "release_spin_rate", "release_pos_x", "release_pos_z", "release_extension", "at_bat_number",
    "pitch_number", "player_name",
)
PAGE_WORDS = (
    "injury", "injured", "disabled", "out", "surgery", "recovery", "strain", "sprain", "tear",
    "fracture", "soreness",
)
LINE_WORDS = ("injury", "out", "surgery", "strain", "sprain")


def select_feed(raw: DataFrame) -> DataFrame:
    """Known columns that exist, a real date, and no rows without pitcher or speed."""
    kept = raw.select(*[c for c in FEED_COLUMNS if c in raw.columns])
    return kept.withColumn("game_date", F.to_date("game_date")).dropna(subset=["pitcher", "release_speed"])


def feed_to_pitches(feed: DataFrame) -> DataFrame:
    """Feed names and defaults to the pitch table; a missing pitch type value reads ``nan``."""
    def field(name: str, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in feed.columns else F.lit(default)

    kind = F.coalesce(F.col("pitch_type"), F.lit("nan")) if "pitch_type" in feed.columns else F.lit("FF")
    return feed.select(
        F.col("pitcher").cast("int").alias("pitcher_id"),
        F.col("game_date"),
        field("pitch_number", 1).cast("int").alias("pitch_number"),
        field("at_bat_number", 1).cast("bigint").alias("at_bat_id"),
        F.substring(kind, 1, 10).alias("pitch_type"),
        field("release_speed", 0.0).cast("double").alias("release_speed"),
        field("release_spin_rate", 0).cast("int").alias("release_spin_rate"),
    ).dropna(subset=["pitcher_id"])


def injury_table_rows(pages: DataFrame, min_cells: int = 4) -> DataFrame:
    """Rows of every HTML table with at least ``min_cells`` cells; each table's first row is skipped."""
    rows = page_parts(pages, ("row",)).where((F.col("row_no") >= 2) & (F.size("cells") >= min_cells))
    return rows.select("page_id", "url", "table_no", "row_no", "cells")


def injury_rows(pages: DataFrame, min_cells: int = 4) -> DataFrame:
    """Table rows of pitchers: player, position, injury text and status."""
    cell = lambda i: F.get("cells", i - 1)
    position = cell(2)
    named = injury_table_rows(pages, min_cells).select(
        "page_id", "url", cell(1).alias("pitcher_name"), position.alias("position"),
        cell(3).alias("injury_info"), cell(4).alias("status"),
    )
    return named.where(F.col("position").contains("P") | F.lower("position").contains("pitcher"))


def injury_elements(pages: DataFrame) -> DataFrame:
    """Page parts that may describe injuries: text nodes per matching word, the text of tables and of
    divs of an injury, player or status class. One pass over the pages."""
    words = F.array(*[F.lit(w) for w in PAGE_WORDS])
    parts = page_parts(pages, ("text", "table", "div"))
    hits = F.when(F.col("kind") == "text", F.filter(words, lambda w: F.lower("content").contains(w))).otherwise(F.array(F.lit("")))
    return parts.select("page_id", "kind", F.explode(hits).alias("word"), "content")


def parse_element(df: DataFrame, content: str = "content") -> DataFrame:
    """First name-like line and last other line with injury words; rows lacking either are dropped."""
    lines = F.filter(F.transform(F.split(content, "\n"), text.strip), lambda x: F.length(x) > 2)
    named = compute_once(df, {"_lines": lines})
    named = compute_once(named, {"_at": F.array_position(F.transform("_lines", text.looks_like_name), F.lit(True))})
    named = named.where(F.col("_at") > 0)

    def has_words(line: Column) -> Column:
        low = F.lower(line)
        hit = low.contains(LINE_WORDS[0])
        for word in LINE_WORDS[1:]:
            hit = hit | low.contains(word)
        return hit

    info = F.filter("_lines", lambda x, i: (i.cast("bigint") != F.col("_at") - 1) & has_words(x))
    out = compute_once(named, {"_info": info}).where(F.size("_info") > 0)
    return out.withColumns({
        "player_name": F.get("_lines", (F.col("_at") - 1).cast("int")),
        "injury_info": F.get("_info", F.size("_info") - 1),
    }).drop("_lines", "_at", "_info")


PAYLOAD = (
    "struct<name:string,athletes:array<struct<id:string,displayName:string,position:struct<abbreviation:string>,"
    "status:struct<type:struct<state:string,description:string>>>>>"
)


def flatten_team_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Team JSON to one row per pitcher who is not active."""
    team = payloads.select(F.from_json(column, PAYLOAD).alias("t")).select(
        F.coalesce("t.name", F.lit("Unknown")).alias("team"), F.explode("t.athletes").alias("a")
    )
    state = F.col("a.status.type.state")
    return team.where(
        (F.col("a.position.abbreviation") == "P") & (state.isNull() | (state != "active"))
    ).select(
        F.col("a.id").alias("pitcher_id"), F.coalesce("a.displayName", F.lit("Unknown")).alias("pitcher_name"), "team",
        F.coalesce("a.status.type.description", F.lit("")).alias("notes"),
    )


def il_transactions(transactions: DataFrame) -> DataFrame:
    """Injured-list moves by a bare substring test, mapped to open stints."""
    kept = transactions.where(F.col("description").rlike("(?i)IL|disabled"))
    return kept.select(
        F.col("player_id").alias("pitcher_id"), "player_name", F.to_date("date").alias("il_start"),
        F.lit(None).cast("date").alias("il_end"),
        text.il_injury_type(F.col("description")).alias("injury_type"),
        text.il_stint_type(F.col("description")).alias("stint_type"), F.lit("transactions").alias("source"),
    )


def pitcher_roster(rows: DataFrame) -> DataFrame:
    """Pitchers of roster pages, one row per id (the first team by name), role from the position."""
    kept = rows.where(F.col("pos").contains("P") & F.col("playerid").isNotNull())
    return kept.groupBy(F.col("playerid").alias("pitcher_id")).agg(
        F.min(F.struct("team", "name", "pos")).alias("r")
    ).select(
        "pitcher_id", "r.name", "r.team",
        F.when(F.col("r.pos").contains("SP"), "starter").otherwise("reliever").alias("role"),
    )
