"""Rolling workload, rest, trend and mix features.

Five window conventions exist side by side and are kept apart:
anchored at the pitcher's last game (closed, ``last_days`` on a game row), anchored at an as-of
date, strictly before the game (``days_before``), counted in games (``last_games``), and
half-open day windows (``trailing_days``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundwork.functions import windows as w
from moundwork.session import written_once

# Pitch codes by family, and the centre used to keep squared sums small.
BREAKING_CODES = ("SL", "CU", "CB", "ST", "SV", "FC", "CT", "KC")
FASTBALL_CODES = ("FF", "SI", "FT", "FA")
OFFSPEED_CODES = ("CH", "FS", "FO", "SC")
SPEED_CENTRE = 90.0
SPIN_CENTRE = 2200.0
DEFAULT_REST = 4.0
NEVER = 999

as_day = lambda value: F.lit(value).cast("date")


def history_upto(df: DataFrame, as_of: str, day: str = "game_date") -> DataFrame:
    return df.where(F.col(day) <= as_day(as_of))


def recent_window(df: DataFrame, days: int, day: str = "game_date") -> DataFrame:
    """Rows within ``days`` of the pitcher's own last day, both ends included.

    The last day per pitcher is aggregated first, and the kept days are an equality join, so a
    pitcher with very many rows is never gathered into one window.
    """
    last = df.groupBy("pitcher_id").agg(F.max(day).alias("_last"))
    kept = last.select(
        "pitcher_id", F.explode(F.sequence(F.date_sub("_last", days), F.col("_last"))).alias(day)
    )
    return df.join(kept, ["pitcher_id", day])


def _numbered(appearances: DataFrame) -> DataFrame:
    return appearances.withColumn(w.DAY_NUMBER, w.day_number())


def _gap() -> Column:
    return F.col(w.DAY_NUMBER) - F.lag(w.DAY_NUMBER).over(w.pitcher_days())


def rest_days(appearances: DataFrame) -> DataFrame:
    """Days between games so far: mean, population deviation, min, max; 0 before the second game."""
    gaps = _numbered(appearances).withColumn("_gap", _gap())
    seen = w.so_far()
    stats = {
        "avg_rest_days": F.avg("_gap"), "std_rest_days": F.stddev_pop("_gap"),
        "min_rest_days": F.min("_gap"), "max_rest_days": F.max("_gap"),
    }
    return gaps.withColumns(
        {k: F.coalesce(v.over(seen).cast("double"), F.lit(0.0)) for k, v in stats.items()}
    ).drop("_gap", w.DAY_NUMBER)


def game_features(appearances: DataFrame, rest_in_fatigue: bool = False) -> DataFrame:
    """All workload, role and rest features as of every game (one shuffle, one sort)."""
    base = _numbered(appearances).withColumn("_gap", _gap())
    pitches, innings = F.col("pitches_thrown"), F.col("innings_pitched")
    cols: dict[str, Column] = {
        "total_appearances": F.count(F.lit(1)).over(w.so_far()),
        "avg_innings_per_appearance": F.avg(innings).over(w.so_far()),
        "_recent_innings": F.avg(innings).over(w.last_games(10)),
        "last_game_pitches": pitches,
        "last_3_games_pitches": F.sum(pitches).over(w.last_games(3)),
        "first_game": F.min("game_date").over(w.so_far()),
    }
    for days in (7, 14, 30):
        frame = w.last_days(days)
        cols[f"roll{days}d_pitch_count"] = F.sum(pitches).over(frame)
        cols[f"roll{days}d_appearances"] = F.count(F.lit(1)).over(frame)
        cols[f"roll{days}d_avg_pitches_per_appearance"] = F.avg(pitches).over(frame)
    for days in (7, 14):
        cols[f"multi_inning_rate_{days}d"] = F.avg((innings >= 2.0).cast("double")).over(w.last_days(days))
        # a one-day gap counts only when its earlier game is inside the window as well
        cols[f"back_to_back_days_{days}d"] = F.count_if(F.col("_gap") == 1).over(w.trailing_days(days))
    for name, stat in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
        cols[f"{name}_rest_days"] = F.coalesce(stat("_gap").over(w.so_far()).cast("double"), F.lit(0.0))
    wide = base.withColumns(cols)
    few = F.col("total_appearances") < 3
    mean = F.col("_recent_innings")
    role = (
        F.when(few, "unknown").when(mean >= 5.0, "starter").when(mean >= 1.0, "reliever").otherwise("closer")
    )
    rest = F.when(F.col("total_appearances") > 1, F.col("avg_rest_days")) if rest_in_fatigue else F.lit(None)
    return (
        wide.withColumns({
            "recent_role": role,
            "workload_intensity": F.col("roll7d_pitch_count") / F.col("roll7d_appearances"),
        })
        .withColumn(
            "fatigue_score",
            F.col("workload_intensity") * 0.7
            + (F.lit(4.0) - F.coalesce(rest.cast("double"), F.lit(DEFAULT_REST))) * 0.3,
        )
        .drop("_gap", "_recent_innings", w.DAY_NUMBER)
    )


def latest_game(features: DataFrame, as_of: str) -> DataFrame:
    """Each pitcher's newest game row at or before ``as_of`` with the days passed since."""
    names = [c for c in features.columns if c != "pitcher_id"]
    newest = (
        history_upto(features, as_of).groupBy("pitcher_id")
        .agg(F.max_by(F.struct(*names), "game_date").alias("r"))
        .select("pitcher_id", *[F.col(f"r.{n}").alias(n) for n in names])
    )
    return newest.withColumns({
        "as_of_date": as_day(as_of),
        "days_since_last_appearance": F.datediff(as_day(as_of), "game_date"),
        "days_of_data": F.datediff(as_day(as_of), "first_game"),
    })


def days_of_data(appearances: DataFrame, as_of: str) -> DataFrame:
    """Days from each pitcher's first game to ``as_of``, for pitchers with a game until then."""
    first = history_upto(appearances, as_of).groupBy("pitcher_id").agg(F.min("game_date").alias("first_game"))
    return first.select("pitcher_id", F.datediff(as_day(as_of), "first_game").alias("days_of_data"))


def rolling_workload(appearances: DataFrame, as_of: str, days: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Pitch sum, game count and mean per window anchored at each pitcher's last game.

    As a plain aggregate: the anchor is a per-pitcher maximum over the daily grain.
    """
    anchored = history_upto(appearances, as_of).withColumn(
        "_back", F.datediff(F.max("game_date").over(Window.partitionBy("pitcher_id")), "game_date")
    )
    aggs = []
    for n in days:
        inside = F.col("_back") <= n
        aggs += [
            F.sum(F.when(inside, F.col("pitches_thrown"))).alias(f"roll{n}d_pitch_count"),
            F.count_if(inside).alias(f"roll{n}d_appearances"),
            F.avg(F.when(inside, F.col("pitches_thrown"))).alias(f"roll{n}d_avg_pitches_per_appearance"),
        ]
    return anchored.groupBy("pitcher_id").agg(*aggs)


def days_since_last_appearance(pitchers: DataFrame, appearances: DataFrame, as_of: str) -> DataFrame:
    """Days from the last game to ``as_of`` for every pitcher; 999 when there is none."""
    span = history_upto(appearances, as_of).groupBy("pitcher_id").agg(
        F.max("game_date").alias("last_game"), F.min("game_date").alias("first_game")
    )
    return pitchers.select("pitcher_id").join(span, "pitcher_id", "left").select(
        "pitcher_id",
        F.coalesce(F.datediff(as_day(as_of), "last_game"), F.lit(NEVER)).alias("days_since_last_appearance"),
        F.coalesce(F.datediff(as_day(as_of), "first_game"), F.lit(0)).alias("days_of_data"),
    )


def _snapshot_tail(r7: Column, decline: Column) -> dict[str, Column]:
    intensity = F.least(r7 / 150.0, F.lit(2.0))
    hot = F.when(decline > 1.0, 1.0).otherwise(0.0)
    return {"workload_intensity": intensity, "fatigue_score": intensity * 0.7 + hot * 0.3}


def snapshot_rolling(appearances: DataFrame, min_games: int = 5) -> DataFrame:
    """Feature snapshot as of every game day that has at least ``min_games`` games behind it.

    ``roll21d_vel_decline`` is newest minus oldest speed of the window (negative when speed is
    lost); ``vel_drop_21d`` is the same with the sign of a loss. ``vel_trend_slope`` is against
    days ago over the last five games, so a loss of speed gives a positive slope.
    """
    base = _numbered(appearances).where(F.col("pitches_thrown").isNotNull())
    cols: dict[str, Column] = {"games_so_far": F.count(F.lit(1)).over(w.so_far())}
    for n in (21, 7, 3):
        frame = w.last_days(n)
        cols[f"roll{n}d_pitch_count"] = F.sum("pitches_thrown").over(frame)
        cols[f"roll{n}d_avg_vel"] = F.avg("avg_vel").over(frame)
        cols[f"roll{n}d_appearances"] = F.count(F.lit(1)).over(frame)
        if n > 3:
            cols[f"roll{n}d_vel_decline"] = F.col("avg_vel") - F.first("avg_vel").over(frame)
    days_ago = -F.col(w.DAY_NUMBER).cast("double")
    cols["vel_trend_slope"] = F.coalesce(F.regr_slope("avg_vel", days_ago).over(w.last_games(5)), F.lit(0.0))
    return (
        base.withColumns(cols)
        .where(F.col("games_so_far") >= min_games)
        .withColumns({
            **_snapshot_tail(F.col("roll7d_pitch_count"), F.col("roll21d_vel_decline")),
            "vel_drop_21d": -F.col("roll21d_vel_decline"),
            "days_since_last_appearance": F.lit(0),
            "data_completeness": F.when(F.col("games_so_far") >= 10, "medium").otherwise("low"),
        })
        .withColumnRenamed("game_date", "as_of_date")
        .drop(w.DAY_NUMBER)
    )


def snapshot_rolling_asof(
    appearances: DataFrame, as_of: str, last: int = 50, min_games: int = 5
) -> DataFrame:
    """The same snapshot for one as-of date: windows count back from ``as_of`` itself."""
    ago = F.datediff(as_day(as_of), "game_date")
    newest_first = Window.partitionBy("pitcher_id").orderBy(F.desc("game_date"))
    recent = (
        history_upto(appearances, as_of)
        .withColumns({"_rank": F.row_number().over(newest_first), "_ago": ago})
        .where(F.col("_rank") <= last)
    )
    vel, pitches = F.col("avg_vel"), F.col("pitches_thrown")
    aggs = [F.count(F.lit(1)).alias("games"), F.min("_ago").alias("days_since_last_appearance")]
    for n in (21, 7, 3):
        inside = F.col("_ago") <= n
        day = F.when(inside, F.col("game_date"))
        aggs += [
            F.sum(F.when(inside, pitches)).alias(f"roll{n}d_pitch_count"),
            F.avg(F.when(inside, vel)).alias(f"roll{n}d_avg_vel"),
            F.count_if(inside).alias(f"roll{n}d_appearances"),
            (F.max_by(vel, day) - F.min_by(vel, day)).alias(f"roll{n}d_vel_decline"),
        ]
    last5 = F.col("_rank") <= 5
    aggs.append(F.regr_slope(F.when(last5, vel), F.when(last5, F.col("_ago").cast("double"))).alias("vel_trend_slope"))
    rows = recent.groupBy("pitcher_id").agg(*aggs).where(F.col("games") >= min_games)
    rows = rows.fillna(0, ["roll21d_pitch_count", "roll21d_avg_vel", "roll21d_vel_decline",
                           "roll7d_pitch_count", "roll7d_vel_decline", "vel_trend_slope"])
    return rows.drop("roll3d_vel_decline").withColumns({
        **_snapshot_tail(F.col("roll7d_pitch_count"), F.col("roll21d_vel_decline")),
        "as_of_date": as_day(as_of),
        "vel_drop_21d": -F.col("roll21d_vel_decline"),
        "data_completeness": F.when(F.col("games") >= 10, "medium").otherwise("low"),
    })


def daily_pitch_sums(pitches: DataFrame) -> DataFrame:
    """Sufficient statistics per pitcher and day for pitch-level windows."""
    speed = F.col("release_speed") - SPEED_CENTRE
    spin = F.col("release_spin_rate").cast("double") - SPIN_CENTRE
    return pitches.groupBy("pitcher_id", "game_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("release_speed").alias("n_speed"), F.sum(speed).alias("s_speed"),
        F.sum(speed * speed).alias("q_speed"), F.max("release_speed").alias("max_speed"),
        F.count("release_spin_rate").alias("n_spin"), F.sum(spin).alias("s_spin"),
        F.sum(spin * spin).alias("q_spin"),
        F.count_if(F.col("pitch_type").isin(*BREAKING_CODES)).alias("n_breaking"),
        F.count_if(F.col("pitch_type").isin(*FASTBALL_CODES)).alias("n_fastball"),
        F.count_if(F.col("pitch_type").isin(*OFFSPEED_CODES)).alias("n_offspeed"),
    )


def pregame_rolling(pitches: DataFrame, days: Sequence[int] = (7, 14, 30, 60)) -> DataFrame:
    """Pitch-level history strictly before each game, from daily sums.

    The gaps between the games of the longest window (a bounded list) give the shortest one.
    """
    return pregame_from_days(daily_pitch_sums(pitches), days)


def pregame_from_days(daily: DataFrame, days: Sequence[int] = (7, 14, 30, 60), also: Sequence[str] = ()) -> DataFrame:
    """The same from rows of ``daily_pitch_sums``, one per pitcher and day; columns in ``also`` stay."""
    base = daily.withColumn(w.DAY_NUMBER, w.day_number()).withColumn("_gap", F.coalesce(_gap(), F.lit(0)))
    zero, sums = F.lit(0), ("n_speed", "s_speed", "q_speed", "n_spin", "s_spin", "q_spin")
    # Each frame is summed once per column; what is made of the sums follows in a projection.
    seen: dict[str, Column] = {
        "_gaps": F.collect_list("_gap").over(w.days_before(max(days))), "_last": F.lag(w.DAY_NUMBER).over(w.pitcher_days()),
    }
    for n in days:
        frame = w.days_before(n)
        seen |= {
            f"_n_{n}": F.sum("n").over(frame), f"_games_{n}": F.count(F.lit(1)).over(frame),
            f"_first_{n}": F.min(w.DAY_NUMBER).over(frame), f"_top_{n}": F.max("max_speed").over(frame),
        }
        seen |= {f"_{c}_{n}": F.sum(c).over(frame) for c in sums}
    base = base.withColumns(seen)
    cols: dict[str, Column] = {}
    for n in days:
        count, games = F.coalesce(F.col(f"_n_{n}"), zero), F.col(f"_games_{n}")
        total = {c: F.col(f"_{c}_{n}") for c in sums}
        empty = games == 0
        # A game's gap counts when the game before it is in the window too: all but the oldest of the window's gaps.
        pairs = (games - 1).cast("int")
        gaps = F.slice("_gaps", -F.greatest(pairs, F.lit(1)), F.greatest(pairs, zero))
        cols |= {
            f"pitch_count_{n}d": count,
            f"games_pitched_{n}d": games,
            f"avg_velocity_{n}d": F.when(empty, 0.0).otherwise(total["s_speed"] / F.nullif(total["n_speed"], F.lit(0)) + SPEED_CENTRE),
            f"max_velocity_{n}d": F.coalesce(F.col(f"_top_{n}"), F.lit(0.0)),
            f"velocity_std_{n}d": F.when(empty, 0.0).otherwise(
                w.sample_std(total["n_speed"], total["s_speed"], total["q_speed"])),
            f"avg_spin_rate_{n}d": F.when(empty, 0.0).otherwise(total["s_spin"] / F.nullif(total["n_spin"], F.lit(0)) + SPIN_CENTRE),
            f"spin_rate_std_{n}d": F.when(empty, 0.0).otherwise(
                w.sample_std(total["n_spin"], total["s_spin"], total["q_spin"])),
            f"pitches_per_game_{n}d": F.when(empty, 0.0).otherwise(count / games),
            f"avg_rest_days_{n}d": F.when(games > 1, (F.col("_last") - F.col(f"_first_{n}")) / (games - 1)).otherwise(0.0),
            f"min_rest_days_{n}d": F.coalesce(F.array_min(gaps), zero),
        }
    wide = base.withColumns(cols)
    extra = {}
    if {7, 30} <= set(days):
        extra["vel_decline_7d_vs_30d"] = F.col("avg_velocity_7d") - F.col("avg_velocity_30d")
        extra["workload_increase_7d_vs_30d"] = F.col("pitch_count_7d") - F.col("pitch_count_30d") / 4
    if {14, 30} <= set(days):
        extra["vel_decline_14d_vs_30d"] = F.col("avg_velocity_14d") - F.col("avg_velocity_30d")
        extra["workload_increase_14d_vs_30d"] = F.col("pitch_count_14d") - F.col("pitch_count_30d") / 2
    return wide.withColumns(extra).select("pitcher_id", "game_date", *cols, *extra, *also)


def rowcount_rolling(
    games: DataFrame, measures: Sequence[str] = ("pitches_thrown", "innings_pitched", "strikeouts", "walks"),
    sizes: Sequence[int] = (7, 14, 30),
) -> DataFrame:
    """Sums over the last n games (named ``_<n>d`` in the source data, though they count games)."""
    base = _numbered(games)
    short = {"pitches_thrown": "pitches", "innings_pitched": "innings"}
    cols = {
        f"{short.get(m, m)}_{n}d": F.sum(m).over(w.last_games(n)) for n in sizes for m in measures
    }
    return base.withColumns(cols).drop(w.DAY_NUMBER)


def trend_direction(
    series: DataFrame, value: str, keys: Sequence[str] = ("pitcher_id",), order: str = "game_date",
    name: str = "trend",
) -> DataFrame:
    """Least-squares slope of the value against its position, labelled per key.

    The slope needs only sums, so positions are numbered on the (short) per-key series and the
    rest is one aggregate.
    """
    placed = series.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    y, x = F.col(value).cast("double"), F.col("_i").cast("double")
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.stddev_pop(y).alias("spread"),
    ).withColumn(name, w.trend_label(F.col("slope"), F.col("spread"), F.col("points")))


def time_rolling(appearances: DataFrame) -> DataFrame:
    """Half-open day windows: workload sums, 7/30-day speed and spin, drops, rest, completeness."""
    base = _numbered(appearances)
    full3 = F.count(F.lit(1)).over(w.last_games(3)) == 3
    cols = {
        "roll3g_pitch_count": F.when(full3, F.sum("pitches_thrown").over(w.last_games(3))),
        **{f"roll{n}d_pitch_count": F.sum("pitches_thrown").over(w.trailing_days(n)) for n in (3, 7, 14)},
        **{f"avg_{m}_{n}d": F.avg(f"avg_{m}").over(w.trailing_days(n)) for m in ("vel", "spin") for n in (7, 30)},
        "rest_days": F.coalesce(_gap(), F.lit(0)),
    }
    wide = base.withColumns(cols).withColumns({
        "vel_drop_vs_30d": F.col("avg_vel_7d") - F.col("avg_vel_30d"),
        "spin_drop_vs_30d": F.col("avg_spin_7d") - F.col("avg_spin_30d"),
    })
    level = (
        F.when((F.col("roll7d_pitch_count") < 10) | F.col("avg_vel_7d").isNull(), "low")
        .when(F.col("vel_drop_vs_30d").isNull(), "med").otherwise("high")
    )
    return wide.withColumn("data_completeness", level).drop(w.DAY_NUMBER)


def last_pitch_day(pitches: DataFrame, as_of: str) -> DataFrame:
    """(pitcher_id, anchor): each pitcher's newest pitch day at or before ``as_of``."""
    return history_upto(pitches, as_of).groupBy("pitcher_id").agg(F.max("game_date").alias("anchor"))


STRETCH = 92  # days of anchors that are looked up together


def _stretch(day: Column) -> Column:
    return F.floor(F.unix_date(day) / F.lit(STRETCH)).cast("int")


def _window_rows(pitches: DataFrame, anchors: DataFrame, days: int) -> DataFrame:
    """One row per pitch and window (``pitcher_id``, ``anchor``) that holds it: the ``days`` days up to the anchor and its own.

    Anchors of a pitcher are gathered by stretch of ``STRETCH`` days (a bounded list). A pitch is sent to the
    stretches that may see it, mostly one, and meets their anchors there; what follows groups by
    (pitcher, stretch, anchor), which needs no further exchange. No day of a window is ever listed.
    """
    near = anchors.select("pitcher_id", "anchor", _stretch(F.col("anchor")).alias("_stretch")).groupBy("pitcher_id", "_stretch").agg(
        F.collect_set("anchor").alias("_anchors"))
    first, last = _stretch(F.col("game_date")), _stretch(F.date_add("game_date", days))
    sent = pitches.where(F.col("pitcher_id").isNotNull() & F.col("game_date").isNotNull()).withColumn("_stretch", F.explode(F.sequence(first, last)))
    inside = F.filter("_anchors", lambda a: (a >= F.col("game_date")) & (a <= F.date_add("game_date", days)))
    sent = sent.repartition("pitcher_id", "_stretch")  # also where the list of anchors is broadcast: windows are many rows a pitch
    return sent.join(near, ["pitcher_id", "_stretch"]).withColumn("anchor", F.explode(inside)).drop("_anchors")


WINDOW = ("pitcher_id", "_stretch", "anchor")


def _within(n: int) -> Column:
    return F.col("game_date") >= F.date_sub("anchor", n)


def _ewm_parts(
    rows: DataFrame, spans: Sequence[int], min_pitches: int, metrics: Sequence[str],
) -> tuple[DataFrame, list[Column], dict[str, Column]]:
    """Rows with their places and window sums, the sums of weights per window, and the features made of these."""
    from_end = Window.partitionBy(*WINDOW).orderBy(
        F.desc("game_date"), F.desc("pitch_number"), F.desc("at_bat_id"), F.desc("release_speed"), F.desc("release_spin_rate"))
    whole = Window.partitionBy(*WINDOW)
    cols = {"_k": (F.row_number().over(from_end) - 1).cast("double")}
    cols |= {f"n_{n}": F.count_if(_within(n)).over(whole) for n in spans}
    for m in metrics:
        cols[f"mid_{m}"] = F.sum(F.col(m).cast("double")).over(whole) / F.nullif(F.count(m).over(whole), F.lit(0))
    placed = rows.withColumns(cols)
    counts = F.col("pitch_number").isNotNull()
    aggs = [F.count("pitch_number").alias("_numbered")]
    aggs += [F.first(f"n_{n}").alias(f"n_{n}") for n in spans]
    aggs += [F.first(f"mid_{m}").alias(f"mid_{m}") for m in metrics]
    for n in spans:
        alpha = F.lit(2.0) / (F.least(F.lit(n), F.col(f"n_{n}")) + 1.0)
        weight = F.when(_within(n) & counts, F.pow(1.0 - alpha, F.col("_k")))
        for m in metrics:
            x = F.col(m).cast("double") - F.col(f"mid_{m}")
            wt = F.when(x.isNotNull(), weight)
            aggs += [
                F.sum(wt).alias(f"w_{m}_{n}"), F.sum(wt * wt).alias(f"ww_{m}_{n}"),
                F.sum(wt * x).alias(f"wx_{m}_{n}"), F.sum(wt * x * x).alias(f"wxx_{m}_{n}"),
            ]
    longest = max(spans)
    out: dict[str, Column] = {}
    for m in metrics:
        mean = {}
        for n in spans:
            enough = F.col(f"n_{n}") >= min_pitches
            total, sq = F.nullif(F.col(f"w_{m}_{n}"), F.lit(0.0)), F.col(f"ww_{m}_{n}")
            mid = F.col(f"wx_{m}_{n}") / total
            var = F.greatest(F.col(f"wxx_{m}_{n}") / total - mid * mid, F.lit(0.0))
            unbias = total * total / F.nullif(total * total - sq, F.lit(0.0))
            mean[n] = mid + F.col(f"mid_{m}")
            out[f"roll{n}d_{m}_ewm_mean"] = F.when(enough, mean[n]).otherwise(0.0)
            out[f"roll{n}d_{m}_ewm_std"] = F.when(enough, F.coalesce(F.sqrt(var * unbias), F.lit(0.0))).otherwise(0.0)
        for n in spans:
            # the plain mean of the longest window is the baseline
            both = (F.col(f"n_{n}") >= min_pitches) & (F.col(f"n_{longest}") >= min_pitches) & F.lit(n < longest)
            out[f"roll{n}d_{m}_delta_vs_30d"] = F.when(both, mean[n] - F.col(f"mid_{m}")).otherwise(0.0)
    # Pitches without a number have a place and count, but no weight; a window of such pitches only has no features.
    return placed, aggs, {name: F.when(F.col("_numbered") > 0, value) for name, value in out.items()}


FAMILIES = ("breaking_ball", "fastball", "off_speed")


def _mix_parts(days: Sequence[int], breaking: Sequence[str], min_pitches: int) -> tuple[list[Column], dict[str, Column]]:
    """Counts of pitch families per window, and the shares made of these."""
    codes = dict(zip(FAMILIES, (breaking, FASTBALL_CODES, OFFSPEED_CODES)))
    aggs = []
    for n in days:
        aggs.append(F.count_if(_within(n)).alias(f"all_{n}"))
        aggs += [F.count_if(_within(n) & F.col("pitch_type").isin(*own)).alias(f"{c}_{n}") for c, own in codes.items()]
    out: dict[str, Column] = {}
    for n in days:
        total = F.nullif(F.col(f"all_{n}"), F.lit(0))
        for c in FAMILIES:
            out[f"roll{n}d_{c}_pct"] = F.coalesce(F.col(f"{c}_{n}") / total, F.lit(0.0))
        if n < max(days):
            base = F.col(f"breaking_ball_{max(days)}") / F.nullif(F.col(f"all_{max(days)}"), F.lit(0))
            out[f"roll{n}d_breaking_ball_delta_vs_30d"] = out[f"roll{n}d_breaking_ball_pct"] - base
        for kind in ("velo", "spin"):
            out[f"has_{kind}_data_{n}d"] = (F.col(f"all_{n}") > 0) & (F.col(f"all_{n}") >= min_pitches)
    return aggs, out


def ewm_features(
    pitches: DataFrame, anchors: DataFrame, spans: Sequence[int] = (7, 14, 30), min_pitches: int = 20,
    metrics: Sequence[str] = ("release_speed", "release_spin_rate"),
) -> DataFrame:
    """Exponentially weighted mean and deviation of pitches in windows ending at each anchor.

    Closed form of the adjusted weights: a pitch k places from the end weighs (1 - a)^k with
    a = 2 / (min(span, n) + 1). Only the pitches of one window are ordered against each other.
    """
    needed = dict.fromkeys(["pitcher_id", "game_date", "pitch_number", "at_bat_id", "release_speed", "release_spin_rate", *metrics])
    rows, aggs, out = _ewm_parts(_window_rows(pitches.select(*needed), anchors, max(spans)), spans, min_pitches, metrics)
    return rows.groupBy(*WINDOW).agg(*aggs).where("_numbered > 0").select("pitcher_id", "anchor", *[c.alias(k) for k, c in out.items()])


def pitch_mix(
    pitches: DataFrame, anchors: DataFrame, days: Sequence[int] = (7, 14, 30),
    breaking: Sequence[str] = BREAKING_CODES, min_pitches: int = 20,
) -> DataFrame:
    """Pitch-family shares, their change against 30 days, and data completeness per anchor."""
    aggs, out = _mix_parts(days, breaking, min_pitches)
    rows = _window_rows(pitches.select("pitcher_id", "game_date", "pitch_type"), anchors, max(days))
    return rows.groupBy(*WINDOW).agg(*aggs).select("pitcher_id", "anchor", *[c.alias(k) for k, c in out.items()])


def window_features(pitches: DataFrame, anchors: DataFrame, spans: Sequence[int] = (7, 14, 30), min_pitches: int = 20) -> DataFrame:
    """``ewm_features`` and ``pitch_mix`` of the same windows in one pass over their pitches."""
    metrics = ("release_speed", "release_spin_rate")
    needed = ["pitcher_id", "game_date", "pitch_number", "at_bat_id", *metrics, "pitch_type"]
    rows, aggs, out = _ewm_parts(_window_rows(pitches.select(*needed), anchors, max(spans)), spans, min_pitches, metrics)
    mix_aggs, mix_out = _mix_parts(spans, BREAKING_CODES, min_pitches)
    return rows.groupBy(*WINDOW).agg(*aggs, *mix_aggs).select(
        "pitcher_id", "anchor", *[c.alias(k) for k, c in (out | mix_out).items()])


def completeness_score(df: DataFrame, days: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Mean of the eight availability flags and its high / medium / low level."""
    flags = [F.col(f"has_{k}_data_{n}d") for k in ("velo", "spin") for n in days]
    games = F.col("total_appearances")
    flags += [games > 0, games >= 3]
    total = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))
    score = total / float(len(flags))
    level = F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")
    return df.withColumns({
        "has_recent_appearances": games > 0, "has_multiple_appearances": games >= 3,
        "data_completeness_score": score, "data_completeness": level,
    })


def engineered_features(
    appearances: DataFrame, pitches: DataFrame, as_of: str, min_pitches: int = 20
) -> DataFrame:
    """The full per-pitcher feature row for one as-of date."""
    pitches = history_upto(pitches, as_of)
    games = latest_game(game_features(history_upto(appearances, as_of)), as_of)
    anchors = last_pitch_day(pitches, as_of)
    recent = window_features(pitches, anchors, min_pitches=min_pitches).drop("anchor")
    wide = games.join(recent, "pitcher_id", "left")
    return completeness_score(wide).withColumns({
        "vel_decline_7d_vs_30d": F.col("roll7d_release_speed_delta_vs_30d"),
        "vel_decline_14d_vs_30d": F.col("roll14d_release_speed_delta_vs_30d"),
    })


def training_features(
    appearances: DataFrame, pitches: DataFrame, grid: DataFrame, min_pitches: int = 20, keep: Sequence[str] = ()
) -> DataFrame:
    """The same features on a grid of as-of dates (``snapshot_grid``), joined on the last game day.

    ``keep`` names further columns of the grid that stay.

    Games that are no date's last game are marked before the (narrow) rows go to their pitcher's line and
    left out behind it, so that wide rows are only moved for the grid.
    """
    # Written, because the grid's line of days is the base of three joins.
    grid = written_once(grid.select("pitcher_id", "as_of_date", "last_game", *keep), "grid")
    anchors = grid.select("pitcher_id", F.col("last_game").alias("anchor")).distinct()
    marked = appearances.join(
        anchors.select("pitcher_id", F.col("anchor").alias("game_date"), F.lit(True).alias("_wanted")), ["pitcher_id", "game_date"], "left")
    games = game_features(marked).where("_wanted").drop("_wanted").withColumnRenamed("game_date", "last_game")
    recent = window_features(pitches, anchors, min_pitches=min_pitches).withColumnRenamed("anchor", "last_game")
    key = ["pitcher_id", "last_game"]
    wide = (
        grid.join(games.join(recent, key, "left"), key)
        .withColumn("days_since_last_appearance", F.datediff("as_of_date", "last_game"))
    )
    return completeness_score(wide).withColumns({
        "vel_decline_7d_vs_30d": F.col("roll7d_release_speed_delta_vs_30d"),
        "vel_decline_14d_vs_30d": F.col("roll14d_release_speed_delta_vs_30d"),
    })


def workload_timeseries(appearances: DataFrame, start: str, end: str) -> DataFrame:
    """Games of a date range with rest days (gap - 1, 0 for the first game in range)."""
    inside = appearances.where(F.col("game_date").between(as_day(start), as_day(end)))
    rest = F.coalesce(_gap() - 1, F.lit(0))
    return _numbered(inside).withColumn("rest_days", rest).drop(w.DAY_NUMBER)


def workload_series_summary(series: DataFrame) -> DataFrame:
    """Per pitcher: the points in day order, totals, mean rest without the first game, trends."""
    placed = series.withColumn(
        "_i", F.row_number().over(Window.partitionBy("pitcher_id").orderBy("game_date")) - 1
    )
    x = F.col("_i").cast("double")
    n = F.count(F.lit(1))

    def trend(value: str) -> Column:
        y = F.col(value).cast("double")
        return w.trend_label(F.coalesce(F.regr_slope(y, x), F.lit(0.0)), F.stddev_pop(y), n)

    point = F.struct("game_date", "pitches_thrown", "avg_vel", "avg_spin", "rest_days", "innings_pitched")
    return placed.groupBy("pitcher_id").agg(
        n.alias("games"),
        F.sum("pitches_thrown").alias("total_pitches"),
        F.avg("pitches_thrown").alias("avg_pitches_per_game"),
        F.avg("avg_vel").alias("avg_velocity"),
        F.coalesce(F.avg(F.when(F.col("_i") > 0, F.col("rest_days"))), F.lit(0.0)).alias("avg_rest_days"),
        trend("pitches_thrown").alias("pitch_count_trend"),
        trend("avg_vel").alias("velocity_trend"),
        F.array_sort(F.collect_list(point)).alias("data_points"),
    )


def spec_features(pitches: DataFrame, appearances: DataFrame, min_samples: dict[int, int] | None = None) -> DataFrame:
    """The documented 32-feature contract as of every game, with a missing flag per family."""
    need = {7: 10, 14: 20, 30: 30} | (min_samples or {})
    daily = daily_pitch_sums(pitches).join(
        appearances.select("pitcher_id", "game_date", "pitches_thrown", "avg_vel", "avg_spin"),
        ["pitcher_id", "game_date"],
    ).withColumn(w.DAY_NUMBER, w.day_number())
    daily = daily.withColumns({
        "_gap": _gap(), "_no": F.row_number().over(w.pitcher_days()).cast("double"),
        "_fast": F.col("n_fastball") / F.col("n"),
    })
    cols: dict[str, Column] = {}
    for n in (7, 14, 30):
        f = w.last_days(n)
        cols[f"pitch_count_{n}d"] = F.sum("pitches_thrown").over(f)
        cols[f"_games_{n}"] = F.count(F.lit(1)).over(f)
        cols[f"_n_{n}"] = F.sum("n").over(f)
        for metric, centre in (("speed", SPEED_CENTRE), ("spin", SPIN_CENTRE)):
            k, s, q = (F.sum(f"{p}_{metric}").over(f) for p in ("n", "s", "q"))
            cols[f"_avg_{metric}_{n}"] = s / F.nullif(k, F.lit(0)) + centre
            cols[f"_std_{metric}_{n}"] = w.sample_std(k, s, q)
        for family in ("fastball", "breaking", "offspeed"):
            cols[f"_{family}_{n}"] = F.sum(f"n_{family}").over(f) / F.sum("n").over(f)
    month = w.last_days(30)
    cols |= {
        "avg_pitches_per_appearance": F.avg("pitches_thrown").over(month),
        "rest_days": F.coalesce(F.col("_gap"), F.lit(0)),
        "avg_rest_days": F.avg("_gap").over(month),
        "short_rest_appearances": F.count_if(F.col("_gap") < 3).over(month),
        "high_workload_days": F.count_if(F.col("pitches_thrown") > 100).over(month),
        "velocity_trend": F.coalesce(F.regr_slope("avg_vel", "_no").over(month), F.lit(0.0)),
        "spin_rate_trend": F.coalesce(F.regr_slope("avg_spin", "_no").over(month), F.lit(0.0)),
        "pitch_mix_volatility": F.stddev_samp("_fast").over(month),
    }
    wide = daily.withColumns(cols)

    def intensity(n: int) -> Column:
        games = F.col(f"_games_{n}")
        return F.col(f"pitch_count_{n}d") / F.greatest(games, F.lit(1)) * 0.7 + games / float(n) * 30 * 0.3

    def mix_change(n: int) -> Column:
        base = F.col("_fastball_30")
        return F.when(base == 0, 0.0).otherwise((F.col(f"_fastball_{n}") - base) / base * 100)

    out = {
        **{c: F.col(c) for c in ("pitch_count_7d", "pitch_count_14d", "pitch_count_30d", "avg_pitches_per_appearance",
                                 "rest_days", "avg_rest_days", "short_rest_appearances", "high_workload_days",
                                 "velocity_trend", "spin_rate_trend", "pitch_mix_volatility")},
        "workload_intensity_7d": intensity(7), "workload_intensity_14d": intensity(14),
        "avg_velocity_7d": F.col("_avg_speed_7"), "avg_velocity_14d": F.col("_avg_speed_14"),
        "velocity_decline_7d": F.col("_avg_speed_7") - F.col("_avg_speed_14"),
        "velocity_decline_14d": F.col("_avg_speed_14") - F.col("_avg_speed_30"),
        "velocity_std_7d": F.col("_std_speed_7"), "velocity_std_14d": F.col("_std_speed_14"),
        "avg_spin_rate_7d": F.col("_avg_spin_7"), "avg_spin_rate_14d": F.col("_avg_spin_14"),
        "spin_rate_decline_7d": F.col("_avg_spin_7") - F.col("_avg_spin_14"),
        "spin_rate_std_7d": F.col("_std_spin_7"),
        "spin_velocity_ratio": F.col("_avg_spin_14") / F.nullif(F.col("_avg_speed_14"), F.lit(0.0)),
        "fastball_pct": F.col("_fastball_30") * 100, "breaking_pct": F.col("_breaking_30") * 100,
        "off_speed_pct": F.col("_offspeed_30") * 100,
        "pitch_mix_change_7d": mix_change(7), "pitch_mix_change_14d": mix_change(14),
        "vel_7d_missing": F.col("_n_7") < need[7], "vel_14d_missing": F.col("_n_14") < need[14],
        "vel_trend_missing": F.col("_n_30") < need[30],
    }
    return wide.select("pitcher_id", "game_date", *[c.alias(k) for k, c in out.items()])


def high_workload_streak(appearances: DataFrame, limit: int = 90) -> DataFrame:
    """Consecutive games above ``limit`` pitches, up to and including each game."""
    high = F.col("pitches_thrown") > limit
    base = _numbered(appearances).withColumn(
        "_breaks", F.sum(F.when(high, 0).otherwise(1)).over(w.so_far())
    )
    run = Window.partitionBy("pitcher_id", "_breaks").orderBy(w.DAY_NUMBER).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return base.withColumn("streak", F.count_if(high).over(run)).drop("_breaks", w.DAY_NUMBER)


def history_features(appearances: DataFrame, injuries: DataFrame) -> DataFrame:
    """Prior stints in two years, innings this season to date and last season to the same date,
    and the 7-day load as of 7 and 14 days earlier."""
    rows = _numbered(appearances).withColumn("_stints", F.lit(None).cast("bigint"))
    marks = injuries.groupBy("pitcher_id", "il_start").agg(F.count(F.lit(1)).alias("_stints")).select(
        "pitcher_id", F.unix_date("il_start").alias(w.DAY_NUMBER), "_stints"
    )
    line = rows.unionByName(marks, allowMissingColumns=True)
    line = line.withColumn(
        "prior_il_2y", F.coalesce(F.sum("_stints").over(w.pitcher_days().rangeBetween(-730, 0)), F.lit(0))
    ).withColumns({
        "load_7d_lag7": F.coalesce(F.sum("pitches_thrown").over(w.pitcher_days().rangeBetween(-14, -7)), F.lit(0)),
        "load_7d_lag14": F.coalesce(F.sum("pitches_thrown").over(w.pitcher_days().rangeBetween(-21, -14)), F.lit(0)),
    }).where(F.col("_stints").isNull())
    # All frames run on the one daily line: seasons are cut out of running sums, read where a season starts.
    day, innings, zero = F.col("game_date"), F.col("innings_pitched"), F.lit(0.0)
    earlier = w.pitcher_days().rowsBetween(Window.unboundedPreceding, -1)
    until = {n: w.pitcher_days().rangeBetween(Window.unboundedPreceding, -n) for n in (365, 366)}
    line = line.withColumn("_year", F.year(day)).withColumns({
        "_sum": F.coalesce(F.sum(innings).over(earlier), zero), "_n": F.count(innings).over(earlier),
        "_last_year": F.lag("_year", 1, 0).over(w.pitcher_days()),
        **{f"_until_{n}": F.sum(innings).over(frame) for n, frame in until.items()},
    })
    starts = ~F.col("_last_year").eqNullSafe(F.col("_year"))
    line = line.withColumn("_season", F.last(F.when(starts, F.struct("_sum", "_n")), True).over(w.so_far()))
    line = line.withColumn("_season_before", F.lag("_season").over(w.pitcher_days()))
    older = F.when(F.col("_last_year") == F.col("_year") - 1, F.col("_season_before._sum")).otherwise(F.col("_season._sum"))
    line = line.withColumn("_older", F.last(F.when(starts, older), True).over(w.so_far()))
    some = F.col("_n") + innings.isNotNull().cast("int") > F.col("_season._n")
    same_date = F.when(F.datediff(day, F.add_months(day, -12)) == 365, F.col("_until_365")).otherwise(F.col("_until_366"))
    return line.withColumns({
        "innings_ytd": F.when(some, F.col("_sum") + F.coalesce(innings, zero) - F.col("_season._sum")),
        "innings_last_ytd": F.when(day.isNull(), zero).otherwise(F.coalesce(same_date, zero) - F.col("_older")),
    }).withColumn("innings_ytd_change", F.col("innings_ytd") - F.col("innings_last_ytd")).drop(
        "_year", "_last_year", "_sum", "_n", "_season", "_season_before", "_older", "_stints", w.DAY_NUMBER,
        *[f"_until_{n}" for n in until],
    )


def volatility(appearances: DataFrame, games: int = 5) -> DataFrame:
    frame = w.last_games(games)
    return _numbered(appearances).withColumns({
        "vel_volatility": F.stddev_samp("avg_vel").over(frame),
        "spin_volatility": F.stddev_samp("avg_spin").over(frame),
    }).drop(w.DAY_NUMBER)


def snapshot_grid(
    appearances: DataFrame, step: int = 7, lead: int = 14, min_games: int = 10, min_past: int = 5
) -> DataFrame:
    """As-of dates every ``step`` days from ``lead`` days after a pitcher's first game to the last.

    Each date carries the last game at or before it and how many games came before, read off the
    daily line of grid days and game days together instead of a grid-by-history join.
    """
    span = appearances.groupBy("pitcher_id").agg(
        F.min("game_date").alias("_first"), F.max("game_date").alias("_last"), F.count(F.lit(1)).alias("_games")
    ).where((F.col("_games") >= min_games) & (F.date_add("_first", lead) <= F.col("_last")))
    grid = span.select(
        "pitcher_id",
        F.explode(F.sequence(F.date_add("_first", lead), F.col("_last"), F.expr(f"interval {step} days"))).alias("as_of_date"),
    )
    marks = grid.select("pitcher_id", F.unix_date("as_of_date").alias(w.DAY_NUMBER), "as_of_date")
    games = appearances.select(
        "pitcher_id", w.day_number().alias(w.DAY_NUMBER), F.col("game_date").alias("last_game"), "pitches_thrown"
    )
    line = marks.unionByName(games, allowMissingColumns=True)
    upto = w.pitcher_days().rangeBetween(Window.unboundedPreceding, 0)
    return line.withColumns({
        "past_appearances": F.count("last_game").over(upto),
        "pitches_30d": F.coalesce(F.sum("pitches_thrown").over(w.last_days(30)), F.lit(0)),
        "last_game": F.max("last_game").over(upto),
    }).where(F.col("as_of_date").isNotNull() & (F.col("past_appearances") >= min_past)).select(
        "pitcher_id", "as_of_date", "last_game", "past_appearances", "pitches_30d"
    )


def quarter_block(day: str = "game_date") -> Column:
    return F.concat(F.year(day), F.lit("Q"), F.quarter(day))
