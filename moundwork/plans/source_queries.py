"""Queries for reading, landing and loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from moundwork.bindings import REPORT_NOTES
from moundwork.functions import text
from moundwork.operators import rolling
from moundwork.plans.check_tables import pick
from moundwork.plans.check_tables import text as quoted
from moundwork.plans.label_queries import CUT
from moundwork.plans.registry import query, sql_table
from moundwork.plans.text_queries import NAME_SQL, category_sql, contains_any
from moundwork.functions import vocabulary as v
from moundwork.session import shared_folder
from moundwork.sources import landing, loading, partitions, tables

PITCH = "pitcher_id:n game_date:d at_bat_id:n pitch_number:n pitch_type:s release_speed:r release_spin_rate:n"


@query("csv_round_trip", "pitcher_id:n game_date:d pitches_thrown:n avg_vel:r innings_pitched:r", "SELECT * FROM appearances", "appearances")
def _(t):
    path = shared_folder(t.spark, "appearances-csv")
    columns = ["game_date", "pitcher_id", "pitches_thrown", "avg_vel", "avg_spin", "vel_std", "spin_std", "outs_recorded", "innings_pitched"]
    games = t.appearances.withColumns({c: F.col(c).cast("int") for c in ("avg_spin", "spin_std")})
    tables.write_table(games.select(*columns), path, "csv")
    return tables.read_table(t.spark, path, "appearances", "csv")


@query("parquet_by_season", "season:n rows:n pitches_thrown:n", """
SELECT year(game_date) AS season, count(*) AS rows, sum(pitches_thrown) AS pitches_thrown FROM appearances WHERE year(game_date) >= 1999 GROUP BY 1""", "appearances")
def _(t):
    path = shared_folder(t.spark, "appearances")
    tables.write_table(t.appearances, path, season_of="game_date")
    back = tables.read_table(t.spark, path).where(F.col("season") >= 1999)
    return back.groupBy("season").agg(F.count("*").alias("rows"), F.sum("pitches_thrown").alias("pitches_thrown"))


@query("append_in_two_batches", "season:n rows:n", "SELECT year(game_date) AS season, count(*) AS rows FROM appearances GROUP BY 1", "appearances")
def _(t):
    path = shared_folder(t.spark, "appended")
    early = F.col("game_date") <= F.lit(CUT).cast("date")
    tables.append_table(t.appearances.where(early), path)
    tables.append_table(t.appearances.where(~early), path)
    return tables.read_table(t.spark, path).groupBy(F.year("game_date").alias("season")).agg(F.count("*").alias("rows"))


@query("dataset_metadata", "total_pitchers:n total_pitches:n start_date:d end_date:d total_appearances:n total_injuries:n", """
SELECT count(DISTINCT pitcher_id) AS total_pitchers, count(*) AS total_pitches, min(game_date) AS start_date, max(game_date) AS end_date,
  (SELECT count(*) FROM appearances) AS total_appearances, (SELECT count(*) FROM injuries) AS total_injuries FROM pitches""", "pitches appearances injuries")
def _(t):
    return tables.dataset_metadata(t.pitches, t.appearances, t.injuries)


@query("scan_table", "pitcher_id:n game_date:d release_speed:r", """
SELECT pitcher_id, game_date, release_speed FROM pitches WHERE release_speed >= 90 AND pitch_type = 'FF'""", "pitches")
def _(t):
    wanted = (F.col("release_speed") >= 90) & (F.col("pitch_type") == "FF")
    return tables.scan_table(t.pitches, ["pitcher_id", "game_date", "release_speed"], wanted)


@query("scan_date_range", "pitcher_id:n game_date:d pitch_number:n release_speed:r", """
SELECT pitcher_id, game_date, pitch_number, release_speed FROM pitches WHERE game_date BETWEEN DATE '2000-04-01' AND DATE '2000-09-30'""", "pitches")
def _(t):
    return tables.scan_date_range(t.pitches, "2000-04-01", "2000-09-30", ["pitcher_id", "game_date", "pitch_number", "release_speed"],
                                  order=("pitcher_id", "game_date", "pitch_number"))


@query("statcast_select", "game_date:d pitcher:n pitch_type:s release_speed:r release_spin_rate:r", """
SELECT CAST(game_date AS DATE) AS game_date, pitcher, pitch_type, release_speed, release_spin_rate FROM statcast_raw
WHERE pitcher IS NOT NULL AND release_speed IS NOT NULL""", "statcast_raw")
def _(t):
    return landing.select_feed(t.statcast_raw)


@query("statcast_to_pitches", PITCH, """
SELECT pitcher AS pitcher_id, CAST(game_date AS DATE) AS game_date, coalesce(at_bat_number, 1) AS at_bat_id, coalesce(pitch_number, 1) AS pitch_number,
  left(coalesce(pitch_type, 'nan'), 10) AS pitch_type, coalesce(release_speed, 0) AS release_speed,
  CAST(trunc(coalesce(release_spin_rate, 0)) AS BIGINT) AS release_spin_rate FROM statcast_raw WHERE pitcher IS NOT NULL AND release_speed IS NOT NULL""", "statcast_raw")
def _(t):
    return landing.feed_to_pitches(landing.select_feed(t.statcast_raw))


# The check SQL of pages does not read markup: it builds the cells that the binding puts there.
LANDED_ROWS = ((0, "SP", ("John Smith", "Mary-Jones", "x")), (5, "C", ("Al Moe", "Ben Noe", "Cy Poe")), (9, "RP", ("Dan Roe", "Eli.Soe", "Fay Toe")))


def landed_cells(shift: int, position: str, names) -> str:
    return (f"[{pick(names, 'page_id % 3')}, '{position}', {pick(REPORT_NOTES, f'(page_id + {shift}) % {len(REPORT_NOTES)}')}, "
            f"{pick(('10-day IL', '60-day IL', 'Active'), f'(page_id + {shift}) % 3')}]")


sql_table("table_rows", " UNION ALL ".join(f"SELECT page_id, url, {landed_cells(*row)} AS cells FROM pages" for row in LANDED_ROWS))
sql_table("landed_texts", f"""
SELECT page_id, html, 'Player Pos Injury Status ' || {" || ' ' || ".join(f"array_to_string({landed_cells(*row)}, ' ')" for row in LANDED_ROWS)} || ' totals 3' AS appended FROM pages""")


@query("injury_table_rows", "page_id:n player:s position:s info:s status:s", """
SELECT page_id, cells[1] AS player, cells[2] AS position, cells[3] AS info, cells[4] AS status FROM table_rows""", "table_rows")
def _(t):
    rows = landing.injury_table_rows(t.landed_pages)
    return rows.select("page_id", *[F.element_at("cells", i + 1).alias(n) for i, n in enumerate(("player", "position", "info", "status"))])


WORD_LIST = "[" + ", ".join(quoted(w) for w in landing.PAGE_WORDS) + "]"


def decoded(expr: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', {quoted(char)})"
    return expr


@query("injury_elements", "page_id:n kind:s word:s content:s", f"""
SELECT page_id, 'text' AS kind, w AS word, regexp_replace({decoded('c')}, '^\\s+|\\s+$', '', 'g') AS content FROM (
  SELECT page_id, unnest(regexp_split_to_array(html, '<[^>]*>')) AS c FROM pages
  UNION ALL SELECT page_id, unnest({' || '.join(landed_cells(*row) for row in LANDED_ROWS)} || ['Player', 'Pos', 'Injury', 'Status', 'totals', '3']) FROM pages),
  (SELECT unnest({WORD_LIST}) AS w) WHERE contains(lower({decoded('c')}), w)
UNION ALL SELECT page_id, unnest(['table', 'div']), '', appended FROM landed_texts""", "landed_texts")
def _(t):
    return landing.injury_elements(t.landed_pages)


PAGE_RECORD = """
SELECT page_id, lines[pos] AS player_name, info[-1] AS injury_info FROM (
  SELECT *, list_filter([CASE WHEN i != pos AND """ + contains_any('lower(lines[i])', landing.LINE_WORDS) + """ THEN lines[i] END for i in range(1, len(lines) + 1)], lambda x: x IS NOT NULL) AS info
  FROM (SELECT page_id, lines, list_position([""" + NAME_SQL.format('l') + """ for l in lines], true) AS pos FROM (
    SELECT page_id, list_filter(cells, lambda x: length(x) > 2) AS lines FROM table_rows)) WHERE pos > 0) WHERE len(info) > 0"""


@query("page_records", "page_id:n player_name:s injury_info:s", PAGE_RECORD, "table_rows")
def _(t):
    """Pages to table rows to records: every row's cells are the lines of an element."""
    rows = landing.injury_table_rows(t.landed_pages)
    return landing.parse_element(rows.select("page_id", F.array_join("cells", "\n").alias("content")))


NAMES = ("John Smith", "Mary-Jones", "john", "Al.Moe")
sql_table("element_texts", f"""
SELECT report_id, {pick(NAMES, 'report_id % 4')} || chr(10) || '  ' || notes || ' ' || chr(10) || raw_text AS content FROM injury_reports""", "injury_reports")


def element_texts(t):
    from moundwork.bindings import pick as choose
    name = choose(NAMES, F.col("report_id") % 4)
    return t.injury_reports.select("report_id", F.concat(name, F.lit("\n  "), "notes", F.lit(" \n"), "raw_text").alias("content"))


@query("parse_injury_element", "report_id:n player_name:s injury_info:s", f"""
SELECT report_id, lines[pos] AS player_name, info[-1] AS injury_info FROM (
  SELECT *, list_filter([CASE WHEN i != pos AND {contains_any('lower(lines[i])', landing.LINE_WORDS)} THEN lines[i] END for i in range(1, len(lines) + 1)], lambda x: x IS NOT NULL) AS info
  FROM (SELECT *, list_position([{NAME_SQL.format('l')} for l in lines], true) AS pos
    FROM (SELECT report_id, list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in string_split(content, chr(10))], lambda x: length(x) > 2) AS lines FROM element_texts))
  WHERE pos > 0) WHERE len(info) > 0""", "element_texts")
def _(t):
    return landing.parse_element(element_texts(t))


@query("flatten_team_payloads", "pitcher_id:s pitcher_name:s team:s notes:s", f"""
SELECT CAST(s_suppkey AS VARCHAR) AS pitcher_id, s_name AS pitcher_name, n_name AS team, {pick(REPORT_NOTES, f's_suppkey % {len(REPORT_NOTES)}')} AS notes
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal <= 6000""")
def _(t):
    return landing.flatten_team_payloads(t.roster_payloads)


@query("il_transactions", "pitcher_id:n player_name:s il_start:d il_end:d injury_type:s stint_type:s source:s", f"""
SELECT player_id AS pitcher_id, player_name, CAST(date AS DATE) AS il_start, CAST(NULL AS DATE) AS il_end,
  {category_sql('lower(description)', v.LIST_INJURY_TYPES, 'Unspecified Injury')} AS injury_type,
  {category_sql('lower(description)', v.LIST_STINTS, '10-day IL')} AS stint_type, 'transactions' AS source
FROM transactions WHERE regexp_matches(description, '(?i)IL|disabled')""", "transactions")
def _(t):
    return landing.il_transactions(t.transactions)


@query("pitcher_roster", "pitcher_id:n name:s team:s role:s", """
SELECT playerid AS pitcher_id, name, team, CASE WHEN contains(pos, 'SP') THEN 'starter' ELSE 'reliever' END AS role FROM roster_rows
WHERE contains(pos, 'P') AND playerid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY playerid ORDER BY team, name, pos) = 1""", "roster_rows")
def _(t):
    return landing.pitcher_roster(t.roster_rows)


@query("idempotent_load_pitches", PITCH, f"""
SELECT * FROM pitches a WHERE NOT EXISTS (SELECT 1 FROM pitches b WHERE b.game_date <= DATE '{CUT}'
  AND a.pitcher_id = b.pitcher_id AND a.game_date = b.game_date AND a.at_bat_id = b.at_bat_id AND a.pitch_number = b.pitch_number)
QUALIFY row_number() OVER (PARTITION BY pitcher_id, game_date, at_bat_id, pitch_number ORDER BY pitch_type, release_speed, release_spin_rate) = 1""", "pitches")
def _(t):
    new = t.pitches.select(
        *loading.PITCH_KEY, "pitch_type", "release_speed", "release_spin_rate")
    return loading.idempotent_load(new, rolling.history_upto(t.pitches, CUT), loading.PITCH_KEY)


@query("idempotent_load_appearances", "pitcher_id:n game_date:d pitches_thrown:n", f"SELECT * FROM appearances WHERE game_date > DATE '{CUT}'", "appearances")
def _(t):
    return loading.idempotent_load(t.appearances, rolling.history_upto(t.appearances, CUT), loading.GAME_KEY)


@query("idempotent_load_pitchers", "pitcher_id:n name:s role:s", "SELECT * FROM pitchers WHERE role = 'reliever'", "pitchers")
def _(t):
    return loading.idempotent_load(t.pitchers, t.pitchers.where(F.col("role") == "starter"), loading.PITCHER_KEY)


@query("upsert_injury_records", "pitcher_name:s injury_date:d source:s notes:s updated_at:d", """
SELECT * FROM (SELECT pitcher_name, injury_date, source, notes, updated_at FROM (
    SELECT pitcher_name, injury_date, source, notes, DATE '2024-05-01' AS updated_at, 0 AS n FROM injury_reports WHERE injury_date < DATE '2024-03-06'
    UNION ALL SELECT pitcher_name, injury_date, source, notes, DATE '2024-06-01', 1 FROM injury_reports WHERE injury_date >= DATE '2024-03-03')
  QUALIFY row_number() OVER (PARTITION BY pitcher_name, injury_date ORDER BY updated_at DESC, n DESC, source DESC, notes DESC) = 1)""", "injury_reports")
def _(t):
    base = t.injury_reports.select("pitcher_name", "injury_date", "source", "notes")
    old = base.where(F.col("injury_date") < F.lit("2024-03-06").cast("date")).withColumn("updated_at", F.lit("2024-05-01").cast("date"))
    new = base.where(F.col("injury_date") >= F.lit("2024-03-03").cast("date")).withColumn("updated_at", F.lit("2024-06-01").cast("date"))
    return loading.upsert_records(new, old, ["pitcher_name", "injury_date"])


@query("upsert_by_month", "pitcher_name:s injury_date:d source:s notes:s updated_at:d", """
SELECT pitcher_name, injury_date, source, notes, updated_at FROM (
    SELECT pitcher_name, injury_date, source, notes, DATE '2024-05-01' AS updated_at, 0 AS n FROM injury_reports
    UNION ALL SELECT pitcher_name, injury_date, source, notes, DATE '2024-06-01', 1 FROM injury_reports WHERE day(injury_date) = 3)
QUALIFY row_number() OVER (PARTITION BY pitcher_name, injury_date ORDER BY updated_at DESC, n DESC, source DESC, notes DESC) = 1""", "injury_reports")
def _(t):
    """The same upsert on a stored table by month; the second batch goes to the months of its days, twice."""
    base = t.injury_reports.select("pitcher_name", "injury_date", "source", "notes").withColumn("updated_at", F.lit("2024-05-01").cast("date"))
    table = partitions.PartitionedTable(t.spark, shared_folder(t.spark, "injury-records"), "date_format(injury_date, 'yyyy-MM')", base.schema)
    keys = ["pitcher_name", "injury_date"]
    loading.upsert_batch(table, base, keys, "first")
    for _ in range(2):
        loading.upsert_batch(table, base.where(F.dayofmonth("injury_date") == 3).withColumn("updated_at", F.lit("2024-06-01").cast("date")), keys, "second")
    return table.read()


@query("register_missing_pitchers", "pitcher_id:n name:s team:s role:s total_pitches:n first_game:d last_game:d baseline_velocity:r baseline_spin_rate:n", """
SELECT pitcher_id, 'MLB Pitcher ' || pitcher_id AS name, 'MLB' AS team, CASE WHEN count(*) > 50 THEN 'starter' ELSE 'reliever' END AS role,
  count(*) AS total_pitches, min(game_date) AS first_game, max(game_date) AS last_game, avg(release_speed) AS baseline_velocity, 2200 AS baseline_spin_rate
FROM pitches WHERE pitcher_id > 10 AND pitcher_id NOT IN (SELECT pitcher_id FROM pitchers WHERE role = 'starter') GROUP BY 1""", "pitches pitchers")
def _(t):
    return loading.missing_pitcher_profiles(t.pitches, t.pitchers.where(F.col("role") == "starter"), above_id=10)


@query("infer_role_from_load", "pitcher_id:n mean_pitches:r role:s", """
SELECT pitcher_id, avg(pitches_thrown) AS mean_pitches, CASE WHEN avg(pitches_thrown) > 28 THEN 'starter' ELSE 'reliever' END AS role FROM appearances GROUP BY 1""", "appearances")
def _(t):
    return loading.role_from_load(t.appearances, 28.0)


sql_table("batches", """
SELECT season, CAST(greatest(m, s) AS DATE) AS start_date, CAST(least(last_day(m), e) AS DATE) AS end_date, strftime(m, '%Y-%m') AS month FROM (
  SELECT season, s, e, CAST(unnest(generate_series(CAST(date_trunc('month', s) AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m
  FROM (SELECT year(game_date) AS season, min(game_date) AS s, max(game_date) AS e FROM pitches GROUP BY 1))""", "pitches")


@query("month_batches", "season:n start_date:d end_date:d month:s", "SELECT * FROM batches", "batches")
def _(t):
    return loading.month_batches(loading.season_spans(t.pitches))


@query("skip_loaded_period", "season:n start_date:d end_date:d month:s", f"""
SELECT * FROM batches WHERE month NOT IN (SELECT strftime(game_date, '%Y-%m') FROM pitches WHERE game_date <= DATE '{CUT}')""", "batches pitches")
def _(t):
    return loading.batches_to_load(loading.month_batches(loading.season_spans(t.pitches)), rolling.history_upto(t.pitches, CUT))


@query("table_counts", "table:s rows:n", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in ("pitchers", "pitches", "appearances", "injuries", "injury_reports")),
    "pitchers pitches appearances injuries injury_reports")
def _(t):
    return tables.table_counts({n: getattr(t, n) for n in ("pitchers", "pitches", "appearances", "injuries", "injury_reports")})




FEED_TYPES = (("game_date", "string"), ("pitcher", "bigint"), ("batter", "bigint"), ("pitch_type", "string"), ("release_speed", "double"),
              ("release_spin_rate", "double"), ("at_bat_number", "bigint"), ("pitch_number", "int"))


@query("table_profile", "column:s type:s rows:n nulls:n min:s max:s distinct_values:n", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{ty}' AS type, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, CAST(min({c}) AS VARCHAR) AS min,
  CAST(max({c}) AS VARCHAR) AS max, count(DISTINCT {c}) AS distinct_values FROM statcast_raw"""
    for c, ty in FEED_TYPES), "statcast_raw")
def _(t):
    return tables.table_profile(t.statcast_raw, [name for name, _ in FEED_TYPES])
