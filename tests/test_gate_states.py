"""Gates folded from stored day states equal the gates over all rows, after appends and replaced days."""

from __future__ import annotations

import datetime as dt
import random

from moundwork import schemas
from moundwork.operators import appearances, gate_states, quality

AS_OF = "2024-03-31"


def rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_appended_and_replaced_days(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        (dt.date(2023, 12, 1) + dt.timedelta(days=rng.randrange(140)), rng.randrange(1, 6), "FF", rng.choice([None, 88.0, 93.5, 97.0]),
         rng.choice([None, 2100, 2400]), rng.randrange(1, 4), rng.randrange(40)) for _ in range(400)]
    pitches = spark.createDataFrame(rows, schemas.PITCHES)
    games = appearances.pitches_to_appearances(pitches)
    states = gate_states.GateStates(spark, str(tmp_path / "g"), pitches, games)
    assert all(r.passed for r in states.gates(AS_OF).where("gate = 'duplicates'").collect())  # nothing observed passes
    old, month = "game_date < '2024-02-01'", "game_date >= '2024-01-01' and game_date < '2024-02-01'"
    states.put(pitches.where(old).where("pitch_number = 1"), games.where(old), "first")
    states.put(pitches.where(f"not ({old})"), games.where(f"not ({old})"), "second")
    states.put(pitches.where("game_date < '2024-01-01'"), games.where("game_date < '2024-01-01'"), "again")
    places = states.days.state()["places"]
    for _ in range(2):
        states.put(pitches.where(month), games.where(month), "and again")
    now = states.days.state()
    assert now["number"] == 4 and {m for m in places if now["places"][m] != places[m]} == {"2024-01"}
    found = states.gates(AS_OF, 1, 1)
    for gate, want in (
        ("data_ranges", quality.gate_data_ranges(pitches)), ("temporal", quality.gate_temporal(pitches, AS_OF)),
        ("monotonic", quality.gate_monotonic(pitches, games)), ("duplicates", quality.gate_duplicates(pitches))):
        assert rounded(found.where(f"gate = '{gate}'")) == rounded(want)
    counts = quality.gate_row_counts(pitches, games, games.select("pitcher_id"), 1, 1).where("check <> 'total_pitchers'")
    assert rounded(found.where("gate = 'row_counts'")) == rounded(counts)
