"""Queries over injury reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from moundwork.functions import text
from moundwork.functions import vocabulary as v
from moundwork.operators import reports as op
from moundwork.plans.check_tables import text as quoted
from moundwork.plans.registry import query, sql_table

REF = "2024-06-01"
NAME_SQL = ("(length({0}) BETWEEN 3 AND 50 AND (regexp_matches({0}, '^[A-Z][a-z]+ [A-Z][a-z]+$') "
            "OR regexp_matches({0}, '^[A-Z][a-z]+[-.][A-Z][a-z]+$')))")


def contains_any(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(term)})" for term in terms) + ")"


def category_sql(expr: str, table, default: str = "unknown") -> str:
    whens = " ".join(f"WHEN {contains_any(expr, terms)} THEN {quoted(name)}" for name, terms in table.items())
    return f"CASE {whens} ELSE {quoted(default)} END"


def terms_sql(expr: str, terms) -> str:
    whens = " ".join(f"WHEN contains({expr}, {quoted(term)}) THEN {quoted(place)}" for term, place in terms.items())
    return f"CASE {whens} ELSE 'unknown' END"


def pts(condition: str, value: float) -> str:
    return f"CASE WHEN {condition} THEN {value}::DOUBLE ELSE 0 END"


sql_table("lowered", "SELECT *, lower(full_text) AS low, lower(notes) AS low_notes FROM injury_reports", "injury_reports")


def lowered(t):
    return t.injury_reports.withColumns({"low": F.lower("full_text"), "low_notes": F.lower("notes")})


def classify(name: str, expression, sql: str):
    """Register one class rule over whole documents and over the notes alone."""
    @query(name, "report_id:n of_text:s of_notes:s", f"SELECT report_id, {sql.format('low')} AS of_text, {sql.format('low_notes')} AS of_notes FROM lowered", "lowered")
    def _(t):
        return lowered(t).select(
            "report_id", expression(F.col("low")).alias("of_text"), expression(F.col("low_notes")).alias("of_notes"))


classify("injury_location", text.injury_location, category_sql("{0}", v.LOCATIONS))
classify("injury_type", text.injury_type, category_sql("{0}", v.TYPES))
classify("injury_location_site", lambda c: text.injury_location(c, v.SITE_LOCATIONS), category_sql("{0}", v.SITE_LOCATIONS))
classify("injury_type_site", lambda c: text.injury_type(c, v.SITE_TYPES), category_sql("{0}", v.SITE_TYPES))
classify("severity", text.severity, category_sql("{0}", v.SEVERITIES))
classify("severity_site", lambda c: text.severity(c, v.SITE_SEVERITIES), category_sql("{0}", v.SITE_SEVERITIES))
classify("medical_term_location", text.medical_term_location, terms_sql("{0}", v.MEDICAL_TERMS))
classify("context_location", text.context_location, category_sql("{0}", v.CONTEXT_LOCATIONS))
classify("pattern_type", text.pattern_type, category_sql("{0}", v.PATTERN_TYPES))
for _reader in ("page", "short"):
    for _rule in ("locations", "types", "severities"):
        _table = getattr(v, f"{_reader}_{_rule}".upper())
        _name = {"locations": "injury_location", "types": "injury_type", "severities": "severity"}[_rule]
        classify(f"{_name}_{_reader}", lambda c, table=_table: text.first_category(c, table), category_sql("{0}", _table))
classify("medical_term_location_page", lambda c: text.first_category(c, v.PAGE_MEDICAL_TERMS), category_sql("{0}", v.PAGE_MEDICAL_TERMS))
classify("context_location_page", lambda c: text.first_category(c, v.PAGE_CONTEXT_LOCATIONS), category_sql("{0}", v.PAGE_CONTEXT_LOCATIONS))
classify("pattern_type_page", lambda c: text.first_category(c, v.PAGE_PATTERN_TYPES), category_sql("{0}", v.PAGE_PATTERN_TYPES))


def parsed_sql(column: str, source: str, keep: str) -> str:
    return f"""
SELECT {keep}, loc AS injury_location, kind AS injury_type, sev AS severity,
  CASE WHEN direct THEN 'direct_keyword' ELSE 'none' END || CASE WHEN loc1 != loc2 THEN '+medical' ELSE '' END
    || CASE WHEN loc2 != loc THEN '+context' ELSE '' END || CASE WHEN kind1 != kind THEN '+patterns' ELSE '' END AS parsing_method,
  round(least(1, greatest(0, base + {pts("loc != 'unknown' AND kind != 'unknown'", 0.1)} + {pts("sev != 'unknown'", 0.05)} + {pts(f"length({column}) > 50", 0.05)}
    + {pts(contains_any('low', v.MEDICAL_TERMS), 0.1)} - {pts(f"length({column}) < 10", 0.1)})), 6) AS confidence_score
FROM (SELECT *, {pts('direct', 0.7)} + {pts('loc1 != loc2', 0.1)} + {pts('loc2 != loc', 0.05)} + {pts('kind1 != kind', 0.05)} AS base
  FROM (SELECT *, CASE WHEN loc2 = 'unknown' THEN {category_sql('low', v.CONTEXT_LOCATIONS)} ELSE loc2 END AS loc,
      CASE WHEN kind1 = 'unknown' THEN {category_sql('low', v.PATTERN_TYPES)} ELSE kind1 END AS kind,
      loc1 != 'unknown' OR kind1 != 'unknown' OR sev != 'unknown' AS direct
    FROM (SELECT *, CASE WHEN loc1 = 'unknown' THEN {terms_sql('low', v.MEDICAL_TERMS)} ELSE loc1 END AS loc2
      FROM (SELECT *, {category_sql('low', v.LOCATIONS)} AS loc1, {category_sql('low', v.TYPES)} AS kind1, {category_sql('low', v.SEVERITIES)} AS sev
        FROM (SELECT *, lower({column}) AS low FROM {source})))))"""


RECORD_KEEP = "report_id, pitcher_name, team, injury_date, source, notes, raw_text"
sql_table("parsed", parsed_sql("full_text", "injury_reports", RECORD_KEEP), "injury_reports")
sql_table("parsed_raw", parsed_sql("raw_text", "injury_reports", RECORD_KEEP), "injury_reports")
sql_table("parsed_notes", parsed_sql("notes", "injury_reports", RECORD_KEEP), "injury_reports")
def parsed(t, *columns):
    """Whole documents classified, cut down to the wanted columns before anything is shuffled."""
    return op.parse_injury_text(t.injury_reports, "full_text").select(*columns)


PARSED = "report_id:n injury_location:s injury_type:s severity:s parsing_method:s confidence_score:r"


@query("parse_injury_text", PARSED, "SELECT * FROM parsed", "parsed")
def _(t):
    return op.parse_injury_text(t.injury_reports, "full_text")


@query("parse_injury_notes", PARSED, "SELECT * FROM parsed_notes", "parsed_notes")
def _(t):
    return op.parse_injury_text(t.injury_reports, "notes")


@query("parse_confidence", "report_id:n confidence_score:r", "SELECT report_id, confidence_score FROM parsed", "parsed")
def _(t):
    return parsed(t, "report_id", "confidence_score")


RECORD_SCORE = f"""round(least(1, greatest(0, {pts("regexp_replace(info, '^\\s+|\\s+$', '', 'g') != ''", 0.3)} + {pts("regexp_replace(status, '^\\s+|\\s+$', '', 'g') != ''", 0.2)}
  + {pts("kind != 'unknown'", 0.2)} + {pts("loc != 'unknown'", 0.2)} + {pts(contains_any('lower(status)', v.RECORD_SEVERITY_WORDS), 0.1)} - {pts('length(info) < 10', 0.1)})), 6)"""


def date_sql(expr: str, ref: str) -> str:
    tries = []
    for p in text.DATE_PATTERNS:
        found = f"nullif(regexp_extract({expr}, '{p}', 1), '')"
        full = f"(CASE WHEN len(string_split({found}, '/')) = 2 THEN {found} || '/2024' ELSE {found} END)"
        tries.append(f"CAST(try_strptime(CASE WHEN regexp_full_match({full}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN {full} END, '%m/%d/%Y') AS DATE)")
    shift = " ".join(f"WHEN contains(lower({expr}), '{w}') THEN {d}" for w, d in v.RELATIVE_DAYS.items())
    return f"coalesce({', '.join(tries)}, {ref} + CAST(CASE {shift} ELSE 0 END AS INTEGER))"


@query("record_confidence", "page_id:n pitcher_name:s pitcher_id:s injury_type:s injury_location:s severity:s injury_date:d confidence_score:r", f"""
SELECT page_id, pitcher_name, 'temp_' || left(md5(pitcher_name), 8) AS pitcher_id, kind AS injury_type, loc AS injury_location, severity, injury_date, score AS confidence_score
FROM (SELECT *, {RECORD_SCORE} AS score FROM (SELECT page_id, cells[1] AS pitcher_name, cells[3] AS info, cells[4] AS status,
    {category_sql("lower(cells[3] || ' ' || cells[4])", v.TYPES)} AS kind, {category_sql("lower(cells[3] || ' ' || cells[4])", v.LOCATIONS)} AS loc,
    {category_sql('lower(cells[4])', v.SEVERITIES)} AS severity, {date_sql("cells[4] || ' '", f"DATE '{REF}'")} AS injury_date
  FROM table_rows WHERE contains(cells[2], 'P') OR contains(lower(cells[2]), 'pitcher'))) WHERE score >= 0.3::DOUBLE""", "table_rows")
def _(t):
    from moundwork.sources import landing
    return op.table_rows_to_records(landing.injury_rows(t.landed_pages), F.lit(REF).cast("date"))


@query("extract_injury_date", "report_id:n of_text:d of_notes:d", f"""
SELECT report_id, {date_sql('full_text', f"DATE '{REF}'")} AS of_text, {date_sql('notes', f"DATE '{REF}'")} AS of_notes FROM injury_reports""", "injury_reports")
def _(t):
    ref = F.lit(REF).cast("date")
    return t.injury_reports.select(
        "report_id", text.extract_injury_date(F.col("full_text"), ref).alias("of_text"), text.extract_injury_date(F.col("notes"), ref).alias("of_notes"))


# Written forms of an order date, one per supported format, and two that must fall back.
WRITTEN = ("%m/%d/%Y", "%Y-%m-%d", "%m/%d/%y", "%B %d, %Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%m-%d-%Y", "%d.%m.%Y", "TBD")
SPARK_WRITTEN = ("MM/dd/yyyy", "yyyy-MM-dd", "MM/dd/yy", "MMMM dd, yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM-dd-yyyy", "dd.MM.yyyy", "'TBD'")
READ = ("%m/%d/%Y", "%Y-%m-%d", "%m/%d/%y", "%B %d, %Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%m-%d-%Y", "%d/%m/%Y")


@query("parse_date_multi", "o_orderkey:n written:s parsed:d", f"""
SELECT o_orderkey, written, CASE WHEN lower(written) IN ('tbd', 'unknown', '', 'null') THEN DATE '{REF}'
  ELSE coalesce({', '.join(f"CASE WHEN regexp_matches(written, '{'[0-9]{4}' if f.endswith('%Y') else ''}$') THEN CAST(try_strptime(written, '{f}') AS DATE) END" for f in READ)}, DATE '{REF}') END AS parsed
FROM (SELECT o_orderkey, CASE o_orderkey % {len(WRITTEN)} {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(WRITTEN))} END AS written FROM orders)""")
def _(t):
    index = F.col("o_orderkey") % len(WRITTEN)
    written = F.when(index == 0, F.date_format("o_orderdate", SPARK_WRITTEN[0]))
    for i, f in enumerate(SPARK_WRITTEN[1:], 1):
        written = written.when(index == i, F.date_format("o_orderdate", f))
    rows = t.raw("orders").select("o_orderkey", written.alias("written"))
    return rows.withColumn("parsed", text.parse_date_multi(F.col("written"), F.lit(REF).cast("date")))


@query("il_types", "transaction_id:n injury_type:s stint_type:s", f"""
SELECT transaction_id, {category_sql('lower(description)', v.LIST_INJURY_TYPES, 'Unspecified Injury')} AS injury_type,
  {category_sql('lower(description)', v.LIST_STINTS, '10-day IL')} AS stint_type FROM transactions""", "transactions")
def _(t):
    d = F.col("description")
    return t.transactions.select("transaction_id", text.il_injury_type(d).alias("injury_type"), text.il_stint_type(d).alias("stint_type"))


@query("stint_type_by_duration", "pitcher_id:n il_start:d stint:s", """
SELECT pitcher_id, il_start, CASE WHEN il_end - il_start <= 15 THEN '10-day IL' WHEN il_end - il_start <= 60 THEN '15-day IL' ELSE '60-day IL' END AS stint
FROM injuries WHERE il_end IS NOT NULL""", "injuries")
def _(t):
    closed = t.injuries.where(F.col("il_end").isNotNull())
    return closed.withColumn("stint", text.stint_type_by_duration(F.datediff("il_end", "il_start")))


sql_table("mentions", """
SELECT s_suppkey AS mention_id, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'Mr ' || right(s_name, 9) ELSE 'Nobody Special' || s_suppkey END AS player_name,
  CASE WHEN s_suppkey % 3 = 0 AND s_acctbal > 2000 THEN n_name ELSE 'Unknown' END AS team FROM supplier JOIN nation ON s_nationkey = n_nationkey""")


def mentions(t):
    kind = F.col("s_suppkey") % 3
    base = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return base.select(
        F.col("s_suppkey").alias("mention_id"),
        F.when(kind == 0, F.col("s_name")).when(kind == 1, F.concat(F.lit("Mr "), F.right("s_name", F.lit(9))))
        .otherwise(F.concat(F.lit("Nobody Special"), F.col("s_suppkey"))).alias("player_name"),
        F.when((kind == 0) & (F.col("s_acctbal") > 2000), F.col("n_name")).otherwise("Unknown").alias("team"))


@query("resolve_pitcher_id", "mention_id:n player_name:s team:s pitcher_id:s match:s", """
SELECT m.mention_id, m.player_name, m.team, coalesce(CAST(e AS VARCHAR), CAST(f AS VARCHAR), 'temp_' || left(md5(m.player_name || '_' || m.team), 8)) AS pitcher_id,
  CASE WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'fuzzy' ELSE 'surrogate' END AS match
FROM (SELECT *, (SELECT min(pitcher_id) FROM pitchers p WHERE p.name = m.player_name AND p.team = m.team) AS e,
  (SELECT min(pitcher_id) FROM pitchers p WHERE contains(lower(p.name), lower(m.player_name)) OR contains(lower(p.name), lower(string_split(m.player_name, ' ')[-1]))) AS f
  FROM mentions m) m""", "mentions pitchers")
def _(t):
    return op.resolve_pitcher_ids(mentions(t), t.pitchers)


@query("reparse_unknown", "report_id:n injury_location:s injury_type:s severity:s confidence_score:r data_quality:s", """
SELECT n.report_id, CASE WHEN better THEN p.injury_location ELSE n.injury_location END AS injury_location, CASE WHEN better THEN p.injury_type ELSE n.injury_type END AS injury_type,
  CASE WHEN better THEN p.severity ELSE n.severity END AS severity, CASE WHEN better THEN p.confidence_score ELSE n.confidence_score END AS confidence_score,
  CASE WHEN better THEN 'improved_parsing' ELSE 'raw' END AS data_quality
FROM (SELECT n.*, (n.injury_type = 'unknown' OR n.injury_location = 'unknown') AND (p.injury_type != 'unknown' OR p.injury_location != 'unknown') AS better
  FROM parsed_raw n JOIN parsed_stripped p ON n.report_id = p.report_id) n JOIN parsed_stripped p ON n.report_id = p.report_id""", "parsed_raw parsed_stripped")
def _(t):
    """Records first read from the document alone, then again with their notes."""
    return op.reparse_unknown(op.parse_injury_text(t.injury_reports, "raw_text"))


sql_table("stripped_reports", "SELECT * REPLACE (regexp_replace(full_text, '^\\s+|\\s+$', '', 'g') AS full_text) FROM injury_reports", "injury_reports")
sql_table("parsed_stripped", parsed_sql("full_text", "stripped_reports", RECORD_KEEP), "stripped_reports")


@query("dedup_first", "report_id:n pitcher_name:s injury_date:d injury_type:s", """
SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY pitcher_name, injury_date, injury_type ORDER BY report_id) = 1""", "parsed")
def _(t):
    rows = parsed(t, "report_id", "pitcher_name", "injury_date", "injury_type")
    return op.dedup_first(rows, [F.col("pitcher_name"), F.col("injury_date"), F.col("injury_type")], "report_id")


@query("dedup_first_by_name", "report_id:n pitcher_name:s injury_date:d", """
SELECT * FROM injury_reports QUALIFY row_number() OVER (PARTITION BY lower(pitcher_name), injury_date ORDER BY report_id) = 1""", "injury_reports")
def _(t):
    return op.dedup_first(t.injury_reports.select("report_id", "pitcher_name", "injury_date"), [F.lower("pitcher_name"), F.col("injury_date")], "report_id")


@query("dedup_best", "report_id:n pitcher_name:s injury_date:d confidence_score:r", """
SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY lower(pitcher_name), injury_date ORDER BY confidence_score DESC, report_id) = 1""", "parsed")
def _(t):
    return op.dedup_best(parsed(t, "report_id", "pitcher_name", "injury_date", "confidence_score"), "report_id")


@query("union_sources", "source:s pitcher_name:s injury_type:s notes:s", f"""
SELECT source, pitcher_name, injury_type, notes FROM parsed UNION ALL
SELECT 'transactions', player_name, {category_sql('lower(description)', v.LIST_INJURY_TYPES, 'Unspecified Injury')}, NULL
FROM transactions WHERE regexp_matches(description, '(?i)IL|disabled')""", "parsed transactions")
def _(t):
    from moundwork.sources import landing
    listed = landing.il_transactions(t.transactions).select("source", F.col("player_name").alias("pitcher_name"), "injury_type")
    return op.union_sources(parsed(t, "source", "pitcher_name", "injury_type", "notes"), listed)


@query("confidence_filter", "report_id:n confidence_score:r", "SELECT * FROM parsed WHERE confidence_score > 0.8::DOUBLE", "parsed")
def _(t):
    return op.confidence_filter(parsed(t, "report_id", "confidence_score"), 0.8, strict=True)


@query("arm_injury_filter", "report_id:n notes:s", f"""
SELECT report_id, notes FROM lowered WHERE {contains_any('low', v.ARM_WORDS)} AND NOT {contains_any('low', v.NOT_ARM_WORDS)}""", "lowered")
def _(t):
    return op.arm_injury_filter(t.injury_reports, "full_text")


@query("normalize_text", "report_id:n normal:s", "SELECT report_id, regexp_replace(lower(full_text), '[^a-z0-9 ]', ' ', 'g') AS normal FROM injury_reports", "injury_reports")
def _(t):
    return t.injury_reports.select("report_id", text.normalize_text(F.col("full_text")).alias("normal"))


@query("looks_like_name", "page_id:n player:s is_name:b", f"SELECT page_id, cells[1] AS player, {NAME_SQL.format('cells[1]')} AS is_name FROM table_rows", "table_rows")
def _(t):
    from moundwork.sources import landing
    player = F.element_at("cells", 1)
    return landing.injury_table_rows(t.landed_pages).select("page_id", player.alias("player"), text.looks_like_name(player).alias("is_name"))


@query("surrogate_pitcher_id", "report_id:n by_name:s by_name_and_team:s", """
SELECT report_id, 'temp_' || left(md5(pitcher_name), 8) AS by_name, 'temp_' || left(md5(pitcher_name || '_' || team), 8) AS by_name_and_team FROM injury_reports""", "injury_reports")
def _(t):
    name, team = F.col("pitcher_name"), F.col("team")
    return t.injury_reports.select("report_id", text.surrogate_id(name).alias("by_name"), text.surrogate_id(name, team).alias("by_name_and_team"))


@query("classification_rates", "records:n type_rate:r location_rate:r severity_rate:r mean_confidence:r", """
SELECT count(*) AS records, 100 * avg(CASE WHEN injury_type != 'unknown' THEN 1.0::DOUBLE ELSE 0 END) AS type_rate,
  100 * avg(CASE WHEN injury_location != 'unknown' THEN 1.0::DOUBLE ELSE 0 END) AS location_rate,
  100 * avg(CASE WHEN severity != 'unknown' THEN 1.0::DOUBLE ELSE 0 END) AS severity_rate, avg(confidence_score) AS mean_confidence FROM parsed""", "parsed")
def _(t):
    from moundwork.operators.aggregates import classification_rates
    return classification_rates(parsed(t, "injury_type", "injury_location", "severity", "confidence_score"))


REPORT_CATEGORIES = ("injury_type", "injury_location", "severity", "source")


@query("report_category_counts", "category:s value:s records:n share_pct:r", """
SELECT *, records * 100.0::DOUBLE / sum(records) OVER (PARTITION BY category) AS share_pct FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, {c} AS value, count(*) AS records FROM parsed GROUP BY 2" for c in REPORT_CATEGORIES) + ")", "parsed")
def _(t):
    from moundwork.operators.aggregates import category_counts
    return category_counts(parsed(t, *REPORT_CATEGORIES), REPORT_CATEGORIES)


@query("latest_records", "report_id:n injury_date:d pitcher_name:s", """
SELECT * FROM injury_reports ORDER BY injury_date DESC, report_id LIMIT 20""", "injury_reports")
def _(t):
    from moundwork.operators.selection import latest_records
    return latest_records(t.injury_reports)


@query("confidence_samples", "report_id:n confidence_score:r sample:s", """
SELECT * FROM (SELECT report_id, confidence_score, 'high' AS sample FROM parsed WHERE confidence_score >= 0.6::DOUBLE ORDER BY report_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT report_id, confidence_score, 'low' FROM parsed WHERE confidence_score < 0.3::DOUBLE ORDER BY report_id LIMIT 10)""", "parsed")
def _(t):
    from moundwork.operators.selection import confidence_samples
    return confidence_samples(parsed(t, "report_id", "confidence_score"))
