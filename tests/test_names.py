"""Names by containment: an index of short runs against a look at every name."""

from __future__ import annotations

import random

import pytest

from moundwork.operators import reports


def plain(needles, pitchers):
    hits = {n: [i for i, name, _ in pitchers if name and n in name.lower()] for n in needles}
    return {n: min(ids) for n, ids in hits.items() if ids}


@pytest.mark.parametrize("per_share", [2, 10_000])
def test_names_containing(spark, monkeypatch, per_share):
    monkeypatch.setattr(reports, "NAMES_PER_SHARE", per_share)
    rng = random.Random(4)
    letters = lambda k: "".join(rng.choice("abcÉ ") for _ in range(k))
    pitchers = [(i, letters(rng.randrange(1, 12)).upper() + "son", "T") for i in rng.sample(range(10**6), 150)]
    pitchers += [(7, "", "T"), (8, None, "T"), (9, "a" * 3000 + "b", "T"), (10, "a" * 3000 + "b", "U")]
    needles = {letters(rng.randrange(1, 7)).lower() for _ in range(300)} | {"son", "cson", "zzzz", "a" * 2000, "n", "aab", "a" * 3000 + "b"}
    frame = spark.createDataFrame(pitchers, "pitcher_id int, name string, team string")
    out = reports.names_containing(spark.createDataFrame([(n,) for n in sorted(needles)], "needle string"), frame)
    assert {r.needle: r.found for r in out.collect()} == plain(needles, pitchers) and out.count() == len(plain(needles, pitchers))


def test_the_index_is_linear_and_tables_may_be_empty(spark):
    names = spark.createDataFrame([(1, "abcdefghij" * 300), (2, "x"), (3, "")], "pitcher_id int, low string")
    rows = reports.name_grams(names).groupBy("pitcher_id").count().collect()
    assert {r.pitcher_id: r["count"] for r in rows} == {1: 30, 2: 1}
    frame = spark.createDataFrame([(1, "A B", "T")], "pitcher_id int, name string, team string")
    needles = spark.createDataFrame([("a b",)], "needle string")
    assert reports.names_containing(needles, frame.where("false")).count() == 0
    assert reports.names_containing(needles.where("false"), frame).count() == 0
    seen = spark.createDataFrame([(None, "T"), ("", "T"), (" ", "T"), ("A B", "T")], "player_name string, team string")
    assert sorted(r.match for r in reports.resolve_pitcher_ids(seen, frame).collect()) == ["exact", "fuzzy", "surrogate", "surrogate"]
