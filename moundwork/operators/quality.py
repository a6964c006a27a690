"""Data-quality gates, constraints and validators.

A gate is a frame of checks (gate, check, season, observed, threshold, severity, passed). Each
reads its table once with combined aggregates; counts of distinct keys are grouped first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundwork.operators import aggregates, lookups

# Gate thresholds.
MIN_PITCHES_PER_SEASON = 100_000
MIN_APPEARANCES_PER_SEASON = 5_000
MIN_PITCHERS = 100
MAX_NULL_VELOCITY_PCT = 3.0
MAX_NULL_SPIN_PCT = 5.0
VELOCITY_RANGE = (60.0, 110.0)
SPIN_RANGE = (500.0, 3500.0)
MEAN_VELOCITY_RANGE = (80.0, 95.0)
MEAN_SPIN_RANGE = (1800.0, 2500.0)
MAX_DUPLICATE_PCT = 0.1
WEEKEND_PCT_RANGE = (20.0, 50.0)
OLDEST_DAY = "2015-01-01"
PITCH_KEY = ("pitcher_id", "game_date", "at_bat_id", "pitch_number")

COLUMNS = ("gate", "check", "season", "observed", "threshold", "severity", "passed")


def check(name: str, observed: Column, threshold: float, passed: Column, severity: str = "error") -> Column:
    """One check as a struct; nothing observed passes."""
    return F.struct(
        F.lit(name).alias("check"), observed.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold"),
        F.lit(severity).alias("severity"), F.coalesce(passed, F.lit(True)).alias("passed"),
    )


def at_least(name: str, observed: Column, bound: float, severity: str = "error") -> Column:
    return check(name, observed, bound, observed >= bound, severity)


def at_most(name: str, observed: Column, bound: float, severity: str = "error") -> Column:
    return check(name, observed, bound, observed <= bound, severity)


def more_than(name: str, observed: Column, bound: float, severity: str = "error") -> Column:
    return check(name, observed, bound, F.coalesce(observed, F.lit(0)) > bound, severity)


def as_gate(gate: str, frame: DataFrame, checks: Sequence[Column], season: Column | None = None) -> DataFrame:
    rows = frame.select((season if season is not None else F.lit(None)).cast("int").alias("season"), F.inline(F.array(*checks)))
    return rows.select(F.lit(gate).alias("gate"), "check", "season", "observed", "threshold", "severity", "passed")


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def gate_row_counts(
    pitches: DataFrame, appearances: DataFrame, pitchers: DataFrame,
    min_pitches: int = MIN_PITCHES_PER_SEASON, min_appearances: int = MIN_APPEARANCES_PER_SEASON,
) -> DataFrame:
    by_season = aggregates.season_counts(pitches)
    games = aggregates.season_counts(appearances)
    name = "row_counts"
    n = F.count(F.lit(1))
    return _union(
        *[as_gate(name, df.agg(n.alias("n")), [more_than(f"total_{label}", F.col("n"), 0)])
          for label, df in (("pitches", pitches), ("appearances", appearances), ("pitchers", pitchers))],
        as_gate(name, by_season, [
            at_least("season_pitches", F.col("rows"), min_pitches),
            at_least("season_pitchers", F.col("pitchers"), MIN_PITCHERS, "warning"),
        ], F.col("season")),
        as_gate(name, games, [at_least("season_appearances", F.col("rows"), min_appearances)], F.col("season")),
    )


def null_pct(column: str) -> Column:
    return F.avg(F.col(column).isNull().cast("double")) * 100


def gate_missing_data(pitches: DataFrame, speed: str = "release_speed", spin: str = "release_spin_rate",
                      kind: str = "pitch_type", day: str = "game_date") -> DataFrame:
    shares = pitches.agg(
        null_pct(speed).alias("speed"), null_pct(spin).alias("spin"), null_pct(kind).alias("kind"), null_pct(day).alias("day")
    )
    return as_gate("missing_data", shares, [
        at_most("null_velocity_pct", F.col("speed"), MAX_NULL_VELOCITY_PCT),
        at_most("null_spin_pct", F.col("spin"), MAX_NULL_SPIN_PCT),
        at_most("null_pitch_type_pct", F.col("kind"), 1.0, "warning"),
        at_most("null_date_pct", F.col("day"), 0.1, "warning"),
    ])


def gate_data_ranges(pitches: DataFrame) -> DataFrame:
    stats = pitches.agg(*[
        f(F.col(c).cast("double")).alias(f"{n}_{f.__name__}")
        for c, n in (("release_speed", "v"), ("release_spin_rate", "s")) for f in (F.min, F.max, F.avg)
    ])
    checks = []
    for n, label, span, mean in (("v", "velocity", VELOCITY_RANGE, MEAN_VELOCITY_RANGE), ("s", "spin", SPIN_RANGE, MEAN_SPIN_RANGE)):
        checks += [
            at_least(f"min_{label}", F.col(f"{n}_min"), span[0]), at_most(f"max_{label}", F.col(f"{n}_max"), span[1]),
            at_least(f"avg_{label}_low", F.col(f"{n}_avg"), mean[0], "warning"),
            at_most(f"avg_{label}_high", F.col(f"{n}_avg"), mean[1], "warning"),
        ]
    return as_gate("data_ranges", stats, checks)


def gate_duplicates(pitches: DataFrame, keys: Sequence[str] = PITCH_KEY) -> DataFrame:
    per = pitches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = per.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("groups")
    ).withColumn("pct", (F.col("rows") - F.col("keys")) * 100.0 / F.col("rows"))
    return as_gate("duplicates", totals, [
        at_most("duplicate_pct", F.col("pct"), MAX_DUPLICATE_PCT),
        at_most("duplicate_groups", F.col("groups"), 0, "warning"),
    ])


def gate_temporal(pitches: DataFrame, as_of: str) -> DataFrame:
    """Future and very old pitches, and the weekend share of distinct dates. Rows are counted per
    date first, so one small frame answers every check."""
    days = pitches.groupBy("game_date").agg(F.count(F.lit(1)).alias("n"))
    future = F.col("game_date") > F.lit(as_of).cast("date")
    old = F.col("game_date") < F.lit(OLDEST_DAY).cast("date")
    counted = days.agg(
        F.count("game_date").alias("dates"), F.coalesce(F.sum(F.when(future, F.col("n"))), F.lit(0)).alias("future"),
        F.coalesce(F.sum(F.when(old, F.col("n"))), F.lit(0)).alias("old"),
        (F.count_if(F.dayofweek("game_date").isin(1, 7)) * 100.0 / F.nullif(F.count("game_date"), F.lit(0))).alias("weekend"),
    )
    return as_gate("temporal", counted, [
        more_than("valid_dates", F.col("dates"), 0), at_most("future_pitches", F.col("future"), 0),
        at_most("pitches_before_2015", F.col("old"), 0, "warning"),
        at_least("weekend_pct_low", F.col("weekend"), WEEKEND_PCT_RANGE[0], "warning"),
        at_most("weekend_pct_high", F.col("weekend"), WEEKEND_PCT_RANGE[1], "warning"),
    ])


def gate_pitcher_consistency(pitches: DataFrame, appearances: DataFrame) -> DataFrame:
    counts = lookups.id_overlap(pitches, appearances)
    with_pitches = F.col("shared") + F.col("only_pitches")
    return as_gate("pitcher_consistency", counts, [
        more_than("pitchers_with_pitches", with_pitches, 0),
        more_than("pitchers_with_appearances", F.col("shared") + F.col("only_appearances"), 0),
        at_most("appearances_without_pitches", F.col("only_appearances"), 0, "warning"),
        at_most("pitches_without_appearances", F.col("only_pitches"), 0, "warning"),
        at_least("enough_pitchers", with_pitches, MIN_PITCHERS, "warning"),
    ])


def gate_monotonic(pitches: DataFrame, appearances: DataFrame) -> DataFrame:
    """Valid speed/spin pairs, their correlation, and plausible game loads."""
    both = pitches.where(F.col("release_speed").isNotNull() & F.col("release_spin_rate").isNotNull()).agg(
        F.count(F.lit(1)).alias("pairs"), F.corr("release_speed", F.col("release_spin_rate").cast("double")).alias("corr")
    )
    load = appearances.agg(F.avg("pitches_thrown").alias("mean"), F.max("pitches_thrown").alias("top"))
    name = "monotonic"
    return _union(
        as_gate(name, both, [
            more_than("valid_pairs", F.col("pairs"), 0),
            check("speed_spin_corr", F.col("corr"), 0.0, F.col("corr") > 0, "warning"),
        ]),
        as_gate(name, load, [
            at_least("mean_pitches_low", F.col("mean"), 10, "warning"), at_most("mean_pitches_high", F.col("mean"), 50, "warning"),
            at_most("max_pitches", F.col("top"), 200, "warning"),
        ]),
    )


def gate_score_monotonic(scored: DataFrame) -> DataFrame:
    """Scores should rise with the 21-day load and fall with rest, as regression signs."""
    slopes = scored.agg(
        F.regr_slope("score", F.col("roll21d_pitch_count").cast("double")).alias("load"),
        F.regr_slope("score", F.col("rest_days").cast("double")).alias("rest"),
    )
    return as_gate("score_monotonic", slopes, [
        check("score_rises_with_load", F.col("load"), 0.0, F.col("load") >= 0, "warning"),
        check("score_falls_with_rest", F.col("rest"), 0.0, F.col("rest") <= 0, "warning"),
    ])


def quality_report(gates: DataFrame) -> DataFrame:
    """Per gate: checks, failed errors, warnings and the verdict."""
    failed = ~F.col("passed")
    return gates.groupBy("gate").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(failed & (F.col("severity") == "error")).alias("errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"),
    ).withColumn("passed", F.col("errors") == 0)


def may_train(gates: DataFrame) -> bool:
    """False as soon as one error check failed."""
    return gates.where(~F.col("passed") & (F.col("severity") == "error")).limit(1).isEmpty()


def _between(name: str, low: float, high: float) -> Column:
    c = F.col(name)
    return c.isNull() | c.between(low, high)


def constraints(table: str) -> dict[str, Column]:
    """Rule name to condition; built on use because columns need a session."""
    return {
        "pitches": lambda: {
            "chk_release_speed": _between("release_speed", 50, 110), "chk_release_spin": _between("release_spin_rate", 0, 3500),
            "chk_pitch_number": F.col("pitch_number") > 0, "chk_game_date": F.col("game_date") >= F.lit(OLDEST_DAY).cast("date"),
        },
        "appearances": lambda: {
            "chk_pitches_thrown": F.col("pitches_thrown") > 0, "chk_avg_vel": _between("avg_vel", 50, 110),
            "chk_avg_spin": _between("avg_spin", 0, 3500),
            "chk_innings_pitched": F.col("innings_pitched").isNull() | (F.col("innings_pitched") >= 0),
        },
        "feature_snapshots": lambda: {
            "chk_rolling_counts": (F.col("roll3g_pitch_count") >= 0) & (F.col("roll3d_pitch_count") >= 0)
            & (F.col("roll7d_pitch_count") >= 0) & (F.col("roll14d_pitch_count") >= 0),
            "chk_data_completeness": F.col("data_completeness").isin("high", "med", "low"),
            "chk_rest_days": F.col("rest_days") >= 0,
        },
        "injuries": lambda: {"chk_injury_dates": F.col("il_end").isNull() | (F.col("il_start") <= F.col("il_end"))},
    }[table]()


def check_constraints(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule in one pass (a rule that is unknown for a row is not violated)."""
    counts = [
        F.struct(F.lit(n).alias("rule"), F.count_if(~F.coalesce(c, F.lit(True))).alias("violations"), F.count(F.lit(1)).alias("rows"))
        for n, c in rules.items()
    ]
    return df.agg(F.array(*counts).alias("m")).select(F.inline("m"))


def violating_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every violating row once per broken rule."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()
    )
    return df.withColumn("rule", F.explode(broken))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): valid means every rule holds."""
    good = F.lit(True)
    for condition in rules.values():
        good = good & F.coalesce(condition, F.lit(True))
    return df.where(good), df.where(~good)


def check_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count_if(F.col("n") > 1).alias("violations"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows")
    ).select(F.lit(name).alias("rule"), "violations", "surplus_rows")


def check_foreign_key(df: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """Keys without a parent and the rows behind them; children are counted per key before the join."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    orphans = per.join(parents.select(key), key, "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("violations"), F.coalesce(F.sum("n"), F.lit(0)).alias("surplus_rows")).select(
        F.lit(name).alias("rule"), "violations", "surplus_rows"
    )


def validate_pitches(pitches: DataFrame) -> DataFrame:
    per = pitches.groupBy("pitcher_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("release_speed").between(85, 105)).alias("v"),
        F.count_if(~F.col("release_spin_rate").between(1800, 3200)).alias("s"),
        F.count_if(F.col("release_speed").isNull() | F.col("release_spin_rate").isNull() | F.col("pitch_type").isNull()).alias("m"),
    )
    return per.agg(
        F.sum("v").alias("invalid_velocities"), F.sum("s").alias("invalid_spin_rates"), F.sum("m").alias("missing_values"),
        F.sum("n").alias("total_pitches"), F.count("pitcher_id").alias("unique_pitchers"),
    ).withColumn("valid", (F.col("invalid_velocities") == 0) & (F.col("invalid_spin_rates") == 0) & (F.col("missing_values") == 0))


def validate_appearances(appearances: DataFrame) -> DataFrame:
    per = appearances.groupBy("pitcher_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("pitches_thrown").between(1, 150)).alias("p"),
        F.count_if(~F.col("avg_vel").between(85, 105)).alias("v"),
    )
    return per.agg(
        F.sum("p").alias("invalid_pitch_counts"), F.sum("v").alias("invalid_velocities"),
        F.sum("n").alias("total_appearances"), F.count("pitcher_id").alias("unique_pitchers"),
    ).withColumn("valid", (F.col("invalid_pitch_counts") == 0) & (F.col("invalid_velocities") == 0))


def validate_injuries(injuries: DataFrame) -> DataFrame:
    """Unreadable dates and stints that do not end after they start; dates may be text."""
    def day(c: str) -> Column:
        return F.to_date(F.try_to_timestamp(F.col(c).cast("string")))

    start, end = day("il_start"), day("il_end")
    bad = (F.col("il_start").isNotNull() & start.isNull()) | (F.col("il_end").isNotNull() & end.isNull())
    return injuries.agg(
        F.count(F.lit(1)).alias("total_injuries"), F.count_if(bad).alias("invalid_dates"),
        F.count_if(end <= start).alias("end_not_after_start"),
    ).withColumn("valid", (F.col("invalid_dates") == 0) & (F.col("end_not_after_start") == 0))


def prediction_volume(assessments: DataFrame, level: str, stamp: str = "ts", width: str = "1 hour") -> DataFrame:
    return assessments.groupBy(F.window(stamp, width).alias("w"), level).agg(F.count(F.lit(1)).alias("assessments")).select(
        F.col("w.start").alias("window_start"), level, "assessments"
    )


def freshness(df: DataFrame, stamp: str, now: str, max_hours: float = 24.0) -> DataFrame:
    newest = df.agg(F.max(F.col(stamp).cast("timestamp")).alias("last_update"))
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_update")) / 3600.0
    return newest.withColumn("hours_old", hours).withColumn("stale", F.col("hours_old") > max_hours)


def weekly_metrics(scored: DataFrame, day: str = "as_of_date") -> DataFrame:
    """Weekly means with the change from the week before (at most one row per calendar week)."""
    weeks = scored.groupBy(F.to_date(F.date_trunc("week", day)).alias("week")).agg(
        F.count(F.lit(1)).alias("snapshots"), F.avg("score").alias("mean_score"),
        F.avg("roll7d_pitch_count").alias("mean_load"),
    )
    before = Window.orderBy("week")
    return weeks.withColumns({
        "prior_mean_score": F.lag("mean_score").over(before),
        "score_change": F.col("mean_score") - F.lag("mean_score").over(before),
    })
