"""Queries for labels, sample selection, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from moundwork.operators import labels as op
from moundwork.operators import lookups, neighbours, rolling, scoring, selection
from moundwork.operators.appearances import labels_per_pitcher
from moundwork.plans.registry import query, sql_table
from moundwork.plans.rolling_queries import AS_OF
from moundwork.session import written_once

CUT = "1999-06-30"
GAME = "pitcher_id:n game_date:d"


def scores_of(t, upto=None):
    """Scores of all games; with ``upto`` of the games until then (no window looks ahead, so the day
    filter stands below the windows and reaches the scan)."""
    games = t.appearances if upto is None else rolling.history_upto(t.appearances, upto)
    return scoring.heuristic_score(rolling.snapshot_rolling(games))


def stored_scores(t, *features):
    """Scores (and named features) written once, for operators that read their input repeatedly."""
    return written_once(scores_of(t).select("pitcher_id", "as_of_date", "score", *features), "scores")


def ahead(lo: int, hi: int, a: str = "a") -> str:
    return (f"EXISTS (SELECT 1 FROM injuries i WHERE i.pitcher_id = {a}.pitcher_id "
            f"AND i.il_start BETWEEN {a}.game_date + ({lo}) AND {a}.game_date + ({hi}))")


@query("label_forward", f"{GAME} label_7d:n label_14d:n label_21d:n", f"""
SELECT pitcher_id, game_date, {', '.join(f"CASE WHEN {ahead(1, h)} THEN 1 ELSE 0 END AS label_{h}d" for h in (7, 14, 21))}
FROM appearances a""", "appearances injuries")
def _(t):
    return op.label_forward(t.appearances, t.injuries, (7, 14, 21))


sql_table("blackout", f"""
SELECT *, CASE WHEN {ahead(0, 3)} THEN NULL WHEN {ahead(1, 21)} THEN 1 ELSE 0 END AS injury_within_21d FROM appearances a""",
          "appearances", "injuries")


@query("label_with_blackout", f"{GAME} injury_within_21d:n blackout_violation:b", """
SELECT pitcher_id, game_date, injury_within_21d, false AS blackout_violation FROM blackout WHERE injury_within_21d IS NOT NULL""", "blackout")
def _(t):
    return op.label_with_blackout(t.appearances, t.injuries)


@query("pre_injury_appearances", f"{GAME} il_start:d injury_location:s severity:s label:n", """
SELECT a.pitcher_id, a.game_date, il_start, injury_location, severity, 1 AS label
FROM appearances a JOIN injuries i ON a.pitcher_id = i.pitcher_id AND a.game_date >= il_start - 21 AND a.game_date < il_start""", "appearances injuries")
def _(t):
    return op.pre_injury_appearances(t.appearances, t.injuries)


@query("pre_injury_appearances_distinct", f"{GAME} pitches_thrown:n", f"""
SELECT * FROM appearances a WHERE {ahead(1, 21)}""", "appearances injuries")
def _(t):
    return op.pre_injury_appearances(t.appearances, t.injuries, distinct=True)


sql_table("last_five", """
SELECT a.pitcher_id, a.game_date, il_start, pitches_thrown, 1 AS label,
  row_number() OVER (PARTITION BY i.pitcher_id, il_start ORDER BY a.game_date DESC) AS games_before_injury
FROM injuries i JOIN appearances a ON a.pitcher_id = i.pitcher_id AND a.game_date < il_start
QUALIFY games_before_injury <= 5""", "appearances", "injuries")


@query("last_n_before_injury", f"{GAME} il_start:d pitches_thrown:n games_before_injury:n label:n", "SELECT * FROM last_five", "last_five")
def _(t):
    return op.last_n_before_injury(t.appearances, t.injuries, 5)


@query("healthy_appearances", f"{GAME} pitches_thrown:n", f"SELECT * FROM appearances a WHERE NOT {ahead(-30, 30)}", "appearances injuries")
def _(t):
    return op.healthy_appearances(t.appearances, t.injuries)


@query("healthy_control_window", f"{GAME} il_start:d label:n", """
SELECT a.pitcher_id, a.game_date, il_start, 0 AS label
FROM injuries i JOIN appearances a ON a.pitcher_id = i.pitcher_id AND a.game_date BETWEEN il_start - 120 AND il_start - 60
QUALIFY row_number() OVER (PARTITION BY i.pitcher_id, il_start
  ORDER BY md5(concat_ws('|', a.pitcher_id, il_start, a.game_date, 42))) <= 3""", "appearances injuries")
def _(t):
    return op.healthy_control_window(t.appearances, t.injuries)


@query("gap_label", f"{GAME} gap_days:n gap_label:n", "SELECT * FROM gap_labels", "gap_labels")
def _(t):
    return op.gap_label(t.appearances)


sql_table("labelled_snapshots", """
SELECT s.*, b.injury_within_21d AS y FROM scores s JOIN blackout b ON s.pitcher_id = b.pitcher_id AND s.as_of_date = b.game_date
WHERE b.injury_within_21d IS NOT NULL""", "scores", "blackout")


def labelled(t):
    """Scored snapshots with their label, read off the snapshots' own daily line (no join)."""
    flagged = op.label_with_blackout(scores_of(t), t.injuries, day="as_of_date")
    return flagged.withColumnRenamed("injury_within_21d", "y")


def stored_labelled(t, *features):
    return written_once(labelled(t).select("pitcher_id", "as_of_date", "score", "y", *features), "labelled")


@query("features_with_labels", "pitcher_id:n as_of_date:d roll21d_pitch_count:n score:r y:n", "SELECT * FROM labelled_snapshots", "labelled_snapshots")
def _(t):
    labels = op.label_with_blackout(t.appearances, t.injuries).select(
        "pitcher_id", F.col("game_date").alias("as_of_date"), F.col("injury_within_21d").alias("y")
    )
    return op.features_with_labels(scores_of(t), labels)


@query("features_with_labels_by_pitcher", "pitcher_id:n roll21d_pitch_count:n injury_within_21d:n last_date:d", """
SELECT s.pitcher_id, roll21d_pitch_count, m.injury_within_21d, last_date FROM asof_snapshots s
JOIN (SELECT pitcher_id, max(injury_within_21d) AS injury_within_21d, max(game_date) AS last_date FROM blackout
  WHERE injury_within_21d IS NOT NULL GROUP BY 1) m ON s.pitcher_id = m.pitcher_id""", "asof_snapshots blackout")
def _(t):
    per = labels_per_pitcher(op.label_with_blackout(t.appearances, t.injuries), "injury_within_21d")
    return op.features_with_pitcher_labels(rolling.snapshot_rolling_asof(t.appearances, AS_OF), per, "injury_within_21d")


@query("injury_recovery", "pitcher_id:n stints:n il_start:d il_end:d injury_recovery_days:n", """
SELECT pitcher_id, count(*) AS stints, min(il_start) AS il_start, arg_min_null(il_end, il_start) AS il_end,
  arg_min_null(il_end, il_start) - min(il_start) AS injury_recovery_days
FROM injuries WHERE il_start BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1""", "injuries")
def _(t):
    return op.earliest_stint_in_window(t.injuries, "2000-01-01", "2000-12-31")


@query("appearance_with_profile", f"{GAME} pitches_thrown:n innings_pitched:r pitcher_name:s team:s role:s season:n", """
SELECT DISTINCT a.pitcher_id, game_date, pitches_thrown, innings_pitched, name AS pitcher_name, team, role, year(game_date) AS season
FROM appearances a LEFT JOIN pitchers p ON a.pitcher_id = p.pitcher_id
WHERE game_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND pitches_thrown > 0""", "appearances pitchers")
def _(t):
    return lookups.appearance_with_profile(t.appearances, t.pitchers, 1998, 2000)


@query("pitcher_coverage", "side:s pitchers:n", """
SELECT 'appearances_without_pitches' AS side, count(DISTINCT pitcher_id) AS pitchers FROM appearances WHERE pitcher_id NOT IN (SELECT pitcher_id FROM pitch_events)
UNION ALL SELECT 'pitches_without_appearances', count(DISTINCT pitcher_id) FROM pitch_events WHERE pitcher_id NOT IN (SELECT pitcher_id FROM appearances)""", "appearances pitch_events")
def _(t):
    return lookups.pitcher_coverage(t.pitch_events, t.appearances)


@query("id_overlap", "shared:n only_appearances:n only_pitches:n contained:b", """
SELECT *, only_appearances = 0 AS contained FROM (SELECT
  (SELECT count(*) FROM (SELECT pitcher_id FROM appearances INTERSECT SELECT pitcher_id FROM pitch_events)) AS shared,
  (SELECT count(*) FROM (SELECT pitcher_id FROM appearances EXCEPT SELECT pitcher_id FROM pitch_events)) AS only_appearances,
  (SELECT count(*) FROM (SELECT pitcher_id FROM pitch_events EXCEPT SELECT pitcher_id FROM appearances)) AS only_pitches)""", "appearances pitch_events")
def _(t):
    return lookups.id_overlap(t.pitch_events, t.appearances)


@query("missing_rows", f"{GAME} pitches_thrown:n", f"""
SELECT * FROM appearances a WHERE NOT EXISTS (SELECT 1 FROM appearances b WHERE b.game_date <= DATE '{CUT}'
  AND a.pitcher_id = b.pitcher_id AND a.game_date = b.game_date)""", "appearances")
def _(t):
    return lookups.missing_rows(t.appearances, rolling.history_upto(t.appearances, CUT), ["pitcher_id", "game_date"])


@query("existing_rows", f"{GAME} pitches_thrown:n", f"SELECT * FROM appearances WHERE game_date <= DATE '{CUT}'", "appearances")
def _(t):
    return lookups.existing_rows(t.appearances, rolling.history_upto(t.appearances, CUT), ["pitcher_id", "game_date"])


@query("injury_history", "pitcher_id:n name:s il_start:d il_end:d stint_type:s injury_location:s stint_no:n", """
SELECT p.pitcher_id, name, il_start, il_end, stint_type, injury_location,
  row_number() OVER (PARTITION BY p.pitcher_id ORDER BY il_start DESC) AS stint_no
FROM pitchers p JOIN injuries i ON p.pitcher_id = i.pitcher_id""", "pitchers injuries")
def _(t):
    return lookups.injury_history(t.pitchers, t.injuries)


sql_table("newest_scores", f"""
SELECT p.pitcher_id, name, team, role, s.* EXCLUDE (pitcher_id) FROM pitchers p LEFT JOIN (SELECT * FROM scores WHERE as_of_date <= DATE '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY pitcher_id ORDER BY as_of_date DESC) = 1) s ON p.pitcher_id = s.pitcher_id""", "pitchers", "scores")


@query("latest_snapshot", "pitcher_id:n name:s team:s role:s as_of_date:d roll21d_pitch_count:n score:r", "SELECT * FROM newest_scores", "newest_scores")
def _(t):
    return lookups.latest_snapshot(t.pitchers, scores_of(t, AS_OF), AS_OF)


@query("latest_appearance", f"{GAME} avg_vel:r", """
SELECT * FROM appearances QUALIFY row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date DESC) = 1""", "appearances")
def _(t):
    return lookups.latest_appearance(t.appearances)


@query("recent_appearances", f"{GAME} pitches_thrown:n recency:n", """
SELECT *, row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date DESC) AS recency FROM appearances QUALIFY recency <= 20""", "appearances")
def _(t):
    return selection.recent_appearances(t.appearances)


@query("top_k_percent", "pitcher_id:n as_of_date:d score:r position:n", """
SELECT *, row_number() OVER (ORDER BY score DESC, pitcher_id, as_of_date) AS position FROM scores
QUALIFY position <= greatest(1, floor(count(*) OVER () * 0.1::DOUBLE + 1e-9))""", "scores")
def _(t):
    return selection.top_k_percent(stored_scores(t))


@query("stratified_split", "pitcher_id:n as_of_date:d y:n split:s", """
SELECT pitcher_id, as_of_date, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', pitcher_id, as_of_date, 42)))
  <= floor(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE + 1e-9) THEN 'test' ELSE 'train' END AS split FROM labelled_snapshots""", "labelled_snapshots")
def _(t):
    return selection.stratified_split(stored_labelled(t), "y", ["pitcher_id", "as_of_date"])


sql_table("cut_date", """
SELECT min(as_of_date) AS cut FROM (SELECT as_of_date, sum(count(*)) OVER (ORDER BY as_of_date) AS upto, sum(count(*)) OVER () AS total
  FROM labelled_snapshots GROUP BY 1) WHERE upto > total * 0.8::DOUBLE""", "labelled_snapshots")


@query("time_split", "pitcher_id:n as_of_date:d y:n split:s", """
SELECT pitcher_id, as_of_date, y, CASE WHEN as_of_date < cut THEN 'train' ELSE 'validation' END AS split FROM labelled_snapshots, cut_date""", "labelled_snapshots cut_date")
def _(t):
    return selection.time_split(stored_labelled(t))


@query("split_by_bounds", "pitcher_id:n as_of_date:d split:s", f"""
SELECT pitcher_id, as_of_date, CASE WHEN as_of_date <= DATE '{CUT}' THEN 'train' ELSE 'validation' END AS split FROM scores""", "scores")
def _(t):
    return selection.split_by_bounds(scores_of(t), CUT)


@query("union_samples", f"{GAME} label:n", f"""
SELECT pitcher_id, game_date, label FROM last_five UNION ALL SELECT pitcher_id, game_date, 0 FROM appearances a WHERE NOT {ahead(-30, 30)}""", "last_five appearances injuries")
def _(t):
    positives = op.last_n_before_injury(t.appearances, t.injuries).select("pitcher_id", "game_date", "label")
    negatives = op.healthy_appearances(t.appearances, t.injuries).select("pitcher_id", "game_date", F.lit(0).alias("label"))
    return selection.union_samples(positives, negatives)


@query("training_blocks", f"{GAME} block:s", """
SELECT pitcher_id, game_date, year(game_date) || 'Q' || quarter(game_date) AS block FROM appearances
WHERE year(game_date) || 'Q' || quarter(game_date) < '2000Q3'""", "appearances")
def _(t):
    return selection.training_blocks(t.appearances.withColumn("block", rolling.quarter_block()), "2000Q3")


@query("distinct_game_dates", "dates:n weekend_dates:n", """
SELECT count(*) AS dates, count(*) FILTER (dayofweek(game_date) IN (0, 6)) AS weekend_dates FROM (SELECT DISTINCT game_date FROM pitches)""", "pitches")
def _(t):
    return selection.distinct_game_dates(t.pitches)


@query("duplicates", "at_bat_id:n pitch_number:n copies:n", """
SELECT at_bat_id, pitch_number, count(*) AS copies FROM pitches GROUP BY 1, 2 HAVING count(*) > 1""", "pitches")
def _(t):
    return selection.duplicates(t.pitches, ["at_bat_id", "pitch_number"])


@query("minority_oversampling", "pitcher_id:n as_of_date:d y:n copy:n", """
SELECT pitcher_id, as_of_date, y, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy FROM (
  SELECT l.*, CASE WHEN y = 1 THEN floor(f) + CASE WHEN CAST('0x' || left(md5(concat_ws('|', pitcher_id, as_of_date, 42)), 8) AS BIGINT) / 4294967296.0::DOUBLE < f - floor(f) THEN 1 ELSE 0 END ELSE 1 END AS copies
  FROM labelled_snapshots l, (SELECT greatest(1, count(*) FILTER (y = 0) * 0.5::DOUBLE / count(*) FILTER (y = 1)) AS f FROM labelled_snapshots))""", "labelled_snapshots")
def _(t):
    return selection.oversample(stored_labelled(t).select("pitcher_id", "as_of_date", "y"), "y", 0.5)


SMOTE_RATIO = 2.0
SMOTE_FEATURES = ("roll21d_pitch_count", "roll7d_pitch_count", "roll21d_vel_decline", "vel_trend_slope")
sql_table("minority", f"""
SELECT pitcher_id, as_of_date, {', '.join(f"coalesce(CAST({f} AS DOUBLE), 0) AS {f}" for f in SMOTE_FEATURES)} FROM labelled_snapshots WHERE y = 1""", "labelled_snapshots")
sql_table("minority_neighbours", f"""
SELECT pitcher_id, as_of_date, other, other_date, d2, row_number() OVER (PARTITION BY pitcher_id, as_of_date ORDER BY d2, other, other_date) AS rank FROM (
  SELECT a.pitcher_id, a.as_of_date, b.pitcher_id AS other, b.as_of_date AS other_date,
    {' + '.join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in SMOTE_FEATURES)} AS d2 FROM scaled_minority a, scaled_minority b
  WHERE a.pitcher_id <> b.pitcher_id OR a.as_of_date <> b.as_of_date) QUALIFY rank <= 5""", "scaled_minority")
sql_table("scaled_minority", f"""
SELECT pitcher_id, as_of_date, {', '.join(f"coalesce(({f} - min({f}) OVER ()) / nullif(max({f}) OVER () - min({f}) OVER (), 0), 0) AS {f}" for f in SMOTE_FEATURES)}
FROM minority""", "minority")


@query("minority_nearest", "pitcher_id:n as_of_date:d rank:n other:n other_date:d d2:r", "SELECT * FROM minority_neighbours", "minority_neighbours")
def _(t):
    rows = stored_labelled(t, *SMOTE_FEATURES).where("y = 1")
    near = neighbours.nearest_rows(rows, ["pitcher_id", "as_of_date"], SMOTE_FEATURES)
    return near.select("*", F.col("neighbour.pitcher_id").alias("other"), F.col("neighbour.as_of_date").alias("other_date"))


@query("smote", f"pitcher_id:n as_of_date:d copy:n other:n other_date:d {' '.join(f'{f}:r' for f in SMOTE_FEATURES)}", f"""
SELECT c.pitcher_id, c.as_of_date, c.copy, n.other, n.other_date,
  {', '.join(f"m.{f} + CAST('0x' || substr(c.digest, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE * (o.{f} - m.{f}) AS {f}" for f in SMOTE_FEATURES)}
FROM (SELECT *, md5(concat_ws('|', pitcher_id, as_of_date, copy, 42)) AS digest FROM (
    SELECT pitcher_id, as_of_date, unnest(range(1, CAST(floor(f) + CASE WHEN CAST('0x' || left(md5(concat_ws('|', pitcher_id, as_of_date, 42)), 8) AS BIGINT) / 4294967296.0::DOUBLE < f - floor(f) THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy
    FROM minority, (SELECT greatest(0, count(*) FILTER (y = 0) * {SMOTE_RATIO}::DOUBLE / count(*) FILTER (y = 1) - 1) AS f FROM labelled_snapshots))) c
JOIN (SELECT pitcher_id, as_of_date, count(*) AS k FROM minority_neighbours GROUP BY ALL) k ON c.pitcher_id = k.pitcher_id AND c.as_of_date = k.as_of_date
JOIN minority_neighbours n ON c.pitcher_id = n.pitcher_id AND c.as_of_date = n.as_of_date
  AND n.rank = 1 + floor(CAST('0x' || left(c.digest, 8) AS BIGINT) / 4294967296.0::DOUBLE * k.k)
JOIN minority m ON c.pitcher_id = m.pitcher_id AND c.as_of_date = m.as_of_date
JOIN minority o ON n.other = o.pitcher_id AND n.other_date = o.as_of_date""", "labelled_snapshots minority minority_neighbours")
def _(t):
    """New rows of the minority until it is ``SMOTE_RATIO`` of the majority."""
    rows = stored_labelled(t, *SMOTE_FEATURES)
    made = neighbours.smote(rows, "y", ["pitcher_id", "as_of_date"], SMOTE_FEATURES, SMOTE_RATIO)
    return made.select("*", F.col("neighbour.pitcher_id").alias("other"), F.col("neighbour.as_of_date").alias("other_date"))


@query("riskiest_pitchers", "pitcher_id:n name:s as_of_date:d roll7d_pitch_count:n roll21d_pitch_count:n score:r risk_bucket:s", """
SELECT *, CASE WHEN score < 0.1::DOUBLE THEN 'low' WHEN score < 0.3::DOUBLE THEN 'medium' ELSE 'high' END AS risk_bucket
FROM newest_scores WHERE score IS NOT NULL ORDER BY score DESC, roll21d_pitch_count DESC, pitcher_id LIMIT 20""", "newest_scores")
def _(t):
    """Flagship: game loads, as-of snapshot, score, bucket, and the twenty riskiest pitchers."""
    newest = lookups.latest_snapshot(t.pitchers, scores_of(t, AS_OF), AS_OF).where(F.col("score").isNotNull())
    bucketed = newest.withColumn("risk_bucket", scoring.risk_bucket(F.col("score")))
    return bucketed.orderBy(F.desc("score"), F.desc("roll21d_pitch_count"), "pitcher_id").limit(20)
