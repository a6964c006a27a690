"""Domain tables as views over the generic test tables.

Each maker takes a ``Tables`` handle (``raw(name)`` reads one parquet table) and returns a lazy
DataFrame; nothing here is materialised, so predicates and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAKERS = {}

# Phrases attached to the test documents so that every classification rule has
# matching text, and transaction lines for the injured-list rules.
REPORT_NOTES = (
    "Right forearm tightness",
    "Torn labrum, out for season",
    "Tommy John recovery",
    "10-day IL, left hamstring strain on 04/15/2024",
    "COVID-19 illness list",
    "Lower back spasms since yesterday, day-to-day",
    "UCL sprain, 60-day IL 3/9",
    "Stress fracture in foot, expected back in weeks",
    "Oblique soreness, questionable, today",
    "Rotator cuff inflammation, grade 2",
    "Paternity leave",
    "Shoulder surgery on April 15, 2024",
    "Knee contusion 2024-05-01 last week",
    "Concussion after landing on 12/31/2023",
    "Season plan under review",
    "Shin splints while running",
)
TRANSACTION_LINES = (
    "Placed RHP on the 15-day IL. Right shoulder inflammation.",
    "Placed LHP on the 10-day IL. Left elbow soreness.",
    "Transferred RHP to the 60-day IL. Tommy John surgery.",
    "Filed for arbitration",
    "Activated RHP from the disabled list. Lateral meniscus.",
    "Signed free agent to a minor league contract",
    "Placed RHP on the IL. Forearm strain.",
    "Optioned RHP to Triple-A",
    "Placed RHP on the 10-day IL. Lower back tightness.",
    "Placed LHP on the 15-day IL. Finger blister.",
    "Recalled LHP from Triple-A",
    "Placed RHP on the IL with oblique strain",
)
INJURY_PLACES = ("elbow", "shoulder", "forearm", "back", "oblique", "hamstring", "knee")


def binding(maker):
    MAKERS[maker.__name__] = maker
    return maker


def pick(options, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def half_even(col: Column, digits: int) -> Column:
    """Round on the scaled binary value, ties to even (the convention of numpy)."""
    scale = 10.0**digits
    return F.rint(col * scale) / scale


@binding
def pitches(t) -> DataFrame:
    flags = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    kind = (
        F.when(flags == "RF", "FF").when(flags == "RO", "SI").when(flags == "AF", "SL")
        .when(flags == "AO", "CU").when(flags == "NF", "CH").otherwise("FC")
    )
    day = F.to_date("l_shipdate")
    return t.raw("lineitem").select(
        F.col("l_suppkey").cast("int").alias("pitcher_id"),
        day.alias("game_date"),
        F.col("l_orderkey").alias("at_bat_id"),
        F.col("l_linenumber").alias("pitch_number"),
        kind.alias("pitch_type"),
        (F.lit(70.0) + F.col("l_quantity") * 0.5).alias("release_speed"),
        (F.lit(1500.0) + F.col("l_extendedprice") / 100.0).cast("int").alias("release_spin_rate"),
        (F.col("l_discount") * 10.0 - 0.5).alias("release_pos_x"),
        (F.lit(5.0) + F.col("l_tax") * 10.0).alias("release_pos_z"),
        (F.lit(6.0) + F.col("l_quantity") * 0.02).alias("release_extension"),
        F.year(day).alias("season"),
    )


@binding
def box_scores(t) -> DataFrame:
    """Appearances with the box-score counts; pitch load is the summed line quantity."""
    kind = F.col("pitch_type")
    load = F.sum((F.col("release_speed") - 70.0) * 2.0).cast("int")
    return (
        t.pitches.groupBy("pitcher_id", "game_date")
        .agg(
            load.alias("pitches_thrown"),
            half_even(F.avg("release_speed"), 2).alias("avg_vel"),
            F.coalesce(half_even(F.stddev_samp("release_speed"), 2), F.lit(0.0)).alias("vel_std"),
            half_even(F.avg("release_spin_rate"), 2).alias("avg_spin"),
            F.coalesce(half_even(F.stddev_samp("release_spin_rate"), 2), F.lit(0.0)).alias("spin_std"),
            F.count_if(kind == "CH").alias("earned_runs"),
            F.count_if(F.col("pitch_number") == 1).alias("walks"),
            F.count_if(F.col("pitch_number") >= 6).alias("strikeouts"),
            F.count_if(kind == "SL").alias("hits_allowed"),
        )
        .withColumn("innings_pitched", half_even(F.col("pitches_thrown") / 15.0, 1))
        .withColumn("outs_recorded", (F.col("innings_pitched") * 3).cast("int"))
    )


@binding
def appearances(t) -> DataFrame:
    return t.box_scores.select(
        "pitcher_id", "game_date", "pitches_thrown", "avg_vel", "vel_std", "avg_spin", "spin_std",
        "innings_pitched", "outs_recorded",
    )


@binding
def pitchers(t) -> DataFrame:
    key = F.col("s_suppkey")
    return (
        t.raw("supplier")
        .join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            key.cast("int").alias("pitcher_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("team"),
            F.when(F.col("s_acctbal") > 4500, "starter").otherwise("reliever").alias("role"),
            (F.lit(90.0) + key % 6).alias("baseline_velocity"),
            (F.lit(2000) + (key % 10) * 50).cast("int").alias("baseline_spin_rate"),
        )
    )


@binding
def injuries(t) -> DataFrame:
    """One stint per (pitcher, start day), started 1..7 days after a chosen appearance."""
    source = t.raw("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.10))
    start = F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber"))
    is_open = (F.col("l_linestatus") == "O") & (F.col("l_tax") >= 0.06)
    line = F.col("line")
    return (
        source.groupBy(F.col("l_suppkey").cast("int").alias("pitcher_id"), start.alias("il_start"))
        .agg(
            F.max(is_open).alias("open_stint"),
            F.max(F.col("l_partkey") % 50).alias("stay"),
            F.min("l_linenumber").alias("line"),
            F.min("l_tax").alias("tax"),
        )
        .select(
            "pitcher_id",
            "il_start",
            F.when(~F.col("open_stint"), F.date_add("il_start", (F.col("stay") + 10).cast("int"))).alias("il_end"),
            F.when(line <= 2, "10-day").when(line <= 5, "15-day").otherwise("60-day").alias("stint_type"),
            pick(INJURY_PLACES, line - 1).alias("injury_location"),
            F.when(line <= 3, "strain").when(line <= 5, "soreness").otherwise("tear").alias("injury_type"),
            F.when(line <= 3, "mild").when(line <= 5, "moderate").otherwise("severe").alias("severity"),
            (F.lit(0.2) + F.col("tax") * 10.0).alias("confidence_score"),
        )
    )


@binding
def injury_reports(t) -> DataFrame:
    """Free-text reports: the whole document text behind a short note."""
    key = F.col("doc_id")
    return t.raw("documents").select(
        key.alias("report_id"),
        F.concat(F.lit("Player "), F.col("lang"), F.lit(" "), F.col("source")).alias("pitcher_name"),
        F.upper("lang").alias("team"),
        F.date_add(F.lit("2024-03-01").cast("date"), (key % 9).cast("int")).alias("injury_date"),
        F.col("source"),
        pick(REPORT_NOTES, key % len(REPORT_NOTES)).alias("notes"),
        F.col("text").alias("raw_text"),
    ).withColumn("full_text", F.concat_ws(" ", "notes", "raw_text"))


@binding
def statcast_raw(t) -> DataFrame:
    """Feed-shaped rows with the gaps real feeds have (missing ids, speeds, spins, numbers)."""
    tax, disc = F.col("l_tax"), F.col("l_discount")
    return t.raw("lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("game_date"),
        F.when(tax != 0.08, F.col("l_suppkey")).alias("pitcher"),
        F.col("l_partkey").alias("batter"),
        F.when(disc != 0.05, F.concat_ws("_", F.col("l_returnflag"), F.lit("long_pitch_code"))).alias("pitch_type"),
        F.when(disc != 0.0, F.lit(70.0) + F.col("l_quantity") * 0.5).alias("release_speed"),
        F.when(disc != 0.01, F.lit(1500.0) + F.col("l_extendedprice") / 100.0).alias("release_spin_rate"),
        F.when(tax != 0.0, F.col("l_orderkey")).alias("at_bat_number"),
        F.when(tax != 0.01, F.col("l_linenumber")).alias("pitch_number"),
    )


@binding
def transactions(t) -> DataFrame:
    key = F.col("o_orderkey")
    return t.raw("orders").select(
        key.alias("transaction_id"),
        F.col("o_custkey").alias("player_id"),
        F.concat(F.lit("Player "), F.col("o_custkey")).alias("player_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        pick(TRANSACTION_LINES, key % len(TRANSACTION_LINES)).alias("description"),
    )


@binding
def roster_rows(t) -> DataFrame:
    """Roster pages: every player listed under the home team and again under a camp roster."""
    base = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    one = base.select(
        F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey")).alias("playerid"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("team"),
        pick(("SP", "RP", "C", "P"), F.col("s_suppkey") % 4).alias("pos"),
    )
    return one.unionByName(one.withColumn("team", F.concat(F.lit("CAMP_"), F.col("team"))))


@binding
def roster_payloads(t) -> DataFrame:
    """API-shaped JSON, one document per roster entry, with a second non-pitcher athlete."""
    base = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    state = F.when(F.col("s_acctbal") > 6000, "active").otherwise("injured")
    body = F.format_string(
        '{"name":"%s","athletes":[{"id":"%s","displayName":"%s","position":{"abbreviation":"P"},'
        '"status":{"type":{"state":"%s","description":"%s"}}},{"id":"x%s","displayName":"Catcher",'
        '"position":{"abbreviation":"C"},"status":{"type":{"state":"injured","description":"knee"}}}]}',
        "n_name", F.col("s_suppkey").cast("string"), "s_name", state,
        pick(REPORT_NOTES, F.col("s_suppkey") % len(REPORT_NOTES)), F.col("s_suppkey").cast("string"),
    )
    return base.select(body.alias("payload"))


@binding
def landed_pages(t) -> DataFrame:
    """Fetched pages; an injury table is appended to each page's own markup."""
    key = F.col("page_id")
    rows = [
        F.concat(
            F.lit("<tr><td>"), pick(names, key % 3), F.lit("</td><td>"), F.lit(position),
            F.lit("</td><td>"), pick(REPORT_NOTES, (key + shift) % len(REPORT_NOTES)),
            F.lit("</td><td><b>"), pick(("10-day IL", "60-day IL", "Active"), (key + shift) % 3),
            F.lit("</b></td></tr>"),
        )
        for shift, position, names in (
            (0, "SP", ("John Smith", "Mary-Jones", "x")),
            (5, "C", ("Al Moe", "Ben Noe", "Cy Poe")),
            (9, "RP", ("Dan Roe", "Eli.Soe", "Fay Toe")),
        )
    ]
    head = F.lit('<div class="injury-status"><table><tr><th>Player</th><th>Pos</th><th>Injury</th><th>Status</th></tr>')
    short = F.lit("<tr><td>totals</td><td>3</td></tr></table></div>")
    return t.raw("pages").select(
        "page_id", "url", F.concat(F.col("html"), head, *rows, short).alias("html")
    )


@binding
def pitch_events(t) -> DataFrame:
    return shape_events(t.raw("events"))


def shape_events(events: DataFrame) -> DataFrame:
    """Event stream rows as pitches; works on a batch and on a streaming frame alike."""
    return events.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("game_date"),
        F.col("user_id").cast("int").alias("pitcher_id"),
        F.col("event_type").alias("pitch_type"),
        F.col("value").alias("release_speed"),
        F.get_json_object("props", "$.k").cast("int").alias("release_spin_rate"),
    )
