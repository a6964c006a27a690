from __future__ import annotations

import pytest

from moundwork.plans import nightly
from moundwork.plans.registry import Tables
from moundwork.sources import tables


def test_tables_are_written(spark, folder, tmp_path):
    t = Tables(spark, folder)
    paths = nightly.build_tables(spark, t.pitches, t.pitchers, t.injuries, str(tmp_path), "2001-12-31")
    games = tables.read_table(spark, paths["appearances"])
    assert games.count() == t.appearances.count()
    assert "season" in games.columns
    assert tables.read_table(spark, paths["labels"]).where("label_7d > label_21d").count() == 0
    assert tables.read_table(spark, paths["assessments"]).count() == t.pitchers.count()


def test_failed_gate_stops_the_run(spark, folder, tmp_path):
    t = Tables(spark, folder)
    with pytest.raises(ValueError, match="gates failed"):
        nightly.build_tables(spark, t.pitches, t.pitchers, t.injuries, str(tmp_path), "1996-01-01")
