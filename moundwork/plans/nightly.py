"""The daily batch: from pitch rows to written game, score, label and assessment tables.

Each step reads the table written by the step before, so raw pitches are scanned once for the
gates and once for the game table, and a failed run resumes from the last finished table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundwork.operators import appearances as games_of
from moundwork.operators import labels, quality, rolling, scoring
from moundwork.sources import tables


def build_tables(
    spark: SparkSession, pitches: DataFrame, pitchers: DataFrame, injuries: DataFrame, target: str, as_of: str,
    require_gates: bool = True,
) -> dict[str, str]:
    """Write every table under ``target`` and return their paths.

    With ``require_gates`` a failed error check stops the run before anything is derived.
    """
    paths = {n: f"{target}/{n}" for n in ("gates", "appearances", "scores", "labels", "assessments")}
    gates = quality.gate_data_ranges(pitches).unionByName(quality.gate_duplicates(pitches)).unionByName(
        quality.gate_missing_data(pitches)
    ).unionByName(quality.gate_temporal(pitches, as_of))
    tables.write_table(gates, paths["gates"])
    if require_gates and not quality.may_train(tables.read_table(spark, paths["gates"])):
        raise ValueError(f"data-quality gates failed, see {paths['gates']}")

    tables.write_table(games_of.pitches_to_appearances(pitches), paths["appearances"], season_of="game_date")
    games = tables.read_table(spark, paths["appearances"])

    scored = scoring.heuristic_score(rolling.snapshot_rolling(games))
    tables.write_table(scored.drop("season"), paths["scores"], season_of="as_of_date")
    scores = tables.read_table(spark, paths["scores"]).select("pitcher_id", "as_of_date", "score")

    labelled = labels.label_forward(scores, injuries, (7, 14, 21), day="as_of_date")
    tables.write_table(labelled, paths["labels"], season_of="as_of_date")

    assessed = scoring.risk_assessment(pitchers, games.drop("season"), as_of)
    tables.write_table(assessed.withColumn("as_of_date", F.lit(as_of).cast("date")), paths["assessments"])
    return paths
