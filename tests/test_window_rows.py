from __future__ import annotations

import datetime as dt
import random

from moundwork.operators import rolling


def test_windows_on_a_grid_list_no_days_and_move_narrow_rows(spark):
    rng = random.Random(3)
    first = dt.date(2024, 3, 1)
    rows = [(rng.choice([1, 2]), first + dt.timedelta(days=rng.randrange(120)), rng.choice([None, 1, 2, 3]), n, 90.0 + rng.random(), 2000 + n, "SL" if n % 3 else "FF")
            for n in range(400)] + [(None, first, 1, 1, 90.0, 2000, "FF"), (1, None, 1, 1, 90.0, 2000, "FF")]
    pitches = spark.createDataFrame(
        rows, "pitcher_id int, game_date date, pitch_number int, at_bat_id long, release_speed double, release_spin_rate int, pitch_type string")
    days = sorted({(p, d) for p, d, *_ in rows if p and d})[::5]
    anchors = spark.createDataFrame(days, "pitcher_id int, anchor date")
    both = rolling.window_features(pitches, anchors, min_pitches=3)
    got = {(r.pitcher_id, r.anchor): r for r in both.collect()}
    assert set(got) == set(days)
    for p, a in days:
        own = [r for r in rows if r[0] == p and r[1] and 0 <= (a - r[1]).days <= 14]
        own.sort(key=lambda r: (r[1], r[2] or 0, r[3]), reverse=True)
        row = got[p, a]
        assert abs(row.roll14d_breaking_ball_pct - sum(r[6] == "SL" for r in own) / len(own)) < 1e-9
        if len(own) >= 3 and any(r[2] for r in own):
            alpha = 2 / (min(14, len(own)) + 1)
            weights = [((1 - alpha) ** k, r[4]) for k, r in enumerate(own) if r[2]]
            assert abs(row.roll14d_release_speed_ewm_mean - sum(w * x for w, x in weights) / sum(w for w, _ in weights)) < 1e-9
    # before, every anchor was listed once per day of its window and joined to the pitches by day
    assert "sequence(date_sub(anchor" not in both._jdf.queryExecution().optimizedPlan().toString()
