"""Nearest rows are exact on any layout of points; made rows lie between neighbours."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundwork.operators import neighbours


def brute(rows, k):
    """(key, rank, neighbour) by all pairs of scaled rows."""
    values = [[0.0 if v is None else float(v) for v in r[1:]] for r in rows]
    columns = list(zip(*values))
    low, high = [min(c) for c in columns], [max(c) for c in columns]
    points = [[(v - a) / (b - a) if b > a else 0.0 for v, a, b in zip(row, low, high)] for row in values]
    out = set()
    for i, p in enumerate(points):
        found = []
        for j, q in enumerate(points):
            if i != j:
                total = (p[0] - q[0]) * (p[0] - q[0])
                for a, b in list(zip(p, q))[1:]:
                    total = total + (a - b) * (a - b)
                found.append((total, rows[j][0]))
        out |= {(rows[i][0], n, key) for n, (_, key) in enumerate(sorted(found)[:k], 1)}
    return out


def layout(kind, n, rng):
    if kind == "even":
        return [(i, rng.random(), rng.random(), rng.random()) for i in range(n)]
    if kind == "copies":  # a third of all rows is one row
        return [(i, 1.0, 2.0, 3.0) if i % 3 == 0 else (i, rng.random(), rng.choice([0.0, 1.0]), None) for i in range(n)]
    if kind == "clusters":
        return [(i, *(c + rng.gauss(0, 1e-4) for c in rng.choice([(0, 0, 0), (1, 1, 0), (0, 9, 9), (5, 5, 5)]))) for i in range(n)]
    return [(i, float(i % 7), 4.0, float(i % 5)) for i in range(n)]  # "grid": many ties, one constant feature


@pytest.mark.parametrize("kind", ["even", "copies", "clusters", "grid"])
def test_nearest_rows_equal_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "ROWS_A_CELL", 4)
    rows = layout(kind, 240, random.Random(kind))
    frame = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {(r.id, r.rank, r.neighbour.id) for r in neighbours.nearest_rows(frame, ["id"], ["a", "b", "c"], 4).collect()}
    assert got == brute(rows, 4)


def test_made_rows_lie_between_a_row_and_a_neighbour(spark):
    rng = random.Random(1)
    rows = [(i, int(i % 10 == 0), rng.random() * 50, rng.random()) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, y int, a double, b double")
    made = neighbours.smote(frame, "y", ["id"], ["a", "b"], 0.3).collect()
    own = {r[0]: r[2:] for r in rows}
    near = {}
    for key, _, other in brute([(r[0], *r[2:]) for r in rows if r[1] == 1], 5):
        near.setdefault(key, set()).add(other)
    assert abs(40 + len(made) - 0.3 * 360) <= 25 and {r.id for r in made} == set(near)
    for r in made:
        assert r.neighbour.id in near[r.id]
        for i, value in enumerate((r.a, r.b)):
            low, high = sorted((own[r.id][i], own[r.neighbour.id][i]))
            assert low - 1e-9 <= value <= high + 1e-9
    again = neighbours.smote(frame.repartition(7), "y", ["id"], ["a", "b"], 0.3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, made))


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(1, 1, 0.0, None), (2, 1, 2.0, 1.0), (3, 0, 9.0, 9.0)], "id long, y int, a double, b double")
    assert [(r.id, r.neighbour.id) for r in neighbours.nearest_rows(frame.where("y = 1"), ["id"], ["a", "b"]).orderBy("id").collect()] == [(1, 2), (2, 1)]
    assert neighbours.smote(frame.where("id = 1"), "y", ["id"], ["a", "b"], 5.0).count() == 0
    assert neighbours.smote(frame.where("y = 0"), "y", ["id"], ["a", "b"]).count() == 0
    assert neighbours.nearest_rows(frame.where("false"), ["id"], ["a", "b"]).count() == 0
    assert math.isclose(neighbours.scaled(frame, ["a"]).agg(F.max(F.col("point")[0])).first()[0], 1.0)


def test_joins_of_neighbours_stay_off_the_driver(spark):
    rows = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("a"), F.pmod(F.col("id") * 7, F.lit(31)).cast("double").alias("b"))
    near = neighbours.nearest_rows(rows, ["id"], ["a", "b"], 3)
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_comparisons_grow_with_the_points(monkeypatch):
    """Four features, the first two of them nearly constant: a grid over two features compared all pairs here."""
    compared = []

    def counted(a, b, plain=neighbours._squares):
        compared.append(len(a) * len(b))
        return plain(a, b)

    monkeypatch.setattr(neighbours, "_squares", counted)
    rng = np.random.default_rng(3)
    points = rng.random((20000, 4)) * (1e-9, 1e-9, 1, 1)
    place, other, d2 = neighbours._searched(points, points, None, 6)
    assert sum(compared) < 1000 * len(points) and (np.bincount(place) == 6).all()
    for i in range(0, 20000, 997):
        every = ((points - points[i]) ** 2).sum(1)
        assert set(other[place == i]) == set(np.lexsort((np.arange(20000), every))[:6])


def test_points_visit_the_cells_within_their_bound():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.random((3000, 3)), rng.integers(0, 3, (500, 3)) / 2])
    splits = neighbours.Splits(points[::7], 37)
    cells = splits.cell(points)
    held = np.unique(cells)
    splits.boxed(held, np.array([points[cells == c].min(0) for c in held]), np.array([points[cells == c].max(0) for c in held]))
    bound = np.where(np.arange(3500) % 50 == 0, np.inf, 0.003)
    visits = set(zip(*map(np.ndarray.tolist, splits.near(points, bound))))
    assert all((i, c) in visits for i in range(0, 3500, 50) for c in held.tolist())
    for i in range(1, 3500, 101):
        inside = np.unique(cells[neighbours._squares(points[i:i + 1], points)[0] <= bound[i]])
        assert {(i, c) for c in inside.tolist()} <= visits
        assert sum((i, c) in visits for c in held.tolist()) < len(held)


def test_many_visitors_are_dealt_out_and_lost_points_come_last(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_A_CELL", 20)
    monkeypatch.setattr(neighbours, "VISITORS_A_SHARE", 10)
    rows = layout("even", 300, random.Random(9))
    frame = spark.createDataFrame(rows, "id long, a double, b double, c double")
    assert {(r.id, r.rank, r.neighbour.id) for r in neighbours.nearest_rows(frame, ["id"], ["a", "b", "c"], 4).collect()} == brute(rows, 4)
    odd = spark.createDataFrame([(i, float(i)) for i in range(3)] + [(7, math.inf), (8, math.inf)], "id long, a double")
    got = {}
    for r in neighbours.nearest_rows(odd, ["id"], ["a"], 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour.id)
    assert got == {0: [1, 2, 7], 1: [0, 2, 7], 2: [0, 1, 7], 7: [0, 1, 2], 8: [0, 1, 2]}


def test_made_rows_take_the_lists_as_they_are(spark):
    """No list is taken apart and gathered again, and a copy travels with the share of the way, not with its digest and list."""
    rng = random.Random(2)
    frame = spark.createDataFrame([(i, int(i % 4 == 0), rng.random(), rng.random()) for i in range(80)], "id long, y int, a double, b double")
    made = neighbours.smote(frame, "y", ["id"], ["a", "b"], 2.0)
    plan = made._jdf.queryExecution().optimizedPlan()
    assert "posexplode" not in plan.toString()
    sent = plan.child() if plan.nodeName() == "Project" else plan
    assert sent.nodeName() == "Join"
    sides = [[column.split("#")[0] for column in sent.children().apply(i).output().mkString(" ").split()] for i in (0, 1)]
    assert ["id", "a", "b", "copy", "neighbour", "_far"] in sides
