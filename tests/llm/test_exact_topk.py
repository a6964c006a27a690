from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundwork.llm import exact_topk as t
from moundwork.llm import queries

EVERY = "key % 100 = 0"


def brute(rows, k=10, every=100):
    """Rank lists of all queries by all pairs, in Python integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in kept if i % every == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


def ask(spark, rows, extra="", **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in extra.split():
        frame = frame.withColumn(name, F.lit(1))
    return {tuple(r) for r in t.exact_topk(frame, F.expr(EVERY), **options).collect()}


def test_query_equals_check_sql(spark, folder):
    from parity import compare, open_views

    frame = queries.op12_exact_topk(spark, folder)
    cursor = open_views(folder).execute(queries.ORACLES["op12_exact_topk"])
    names = [d[0] for d in cursor.description]
    problem, _ = compare([tuple(r) for r in frame.collect()], frame.columns, cursor.fetchall(), names)
    assert problem is None, problem


@pytest.mark.parametrize("kind", ["families", "ties", "random"])
def test_many_ranges_and_groups(spark, monkeypatch, kind):
    for name, size in (("RANGE", 128), ("BLOCK", 16), ("GROUP", 8), ("CHUNK", 4)):
        monkeypatch.setattr(t, name, size)
    rng = np.random.default_rng(3)
    if kind == "families":
        x = rng.normal(size=(20, 12))[rng.integers(0, 20, 3000)] + 0.02 * rng.normal(size=(3000, 12))
    elif kind == "ties":
        x = rng.integers(-1, 2, (3000, 4)).astype(float)
        x[1000:2000] = x[0]
    else:
        x = rng.normal(size=(3000, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert ask(spark, rows) == brute(rows)


def test_bounds_prune_families_and_never_lose(spark):
    rng = np.random.default_rng(5)
    rows = np.sort(rng.integers(0, 16, 1024)).repeat(1)
    rows = (rng.normal(size=(16, 8))[rows] * 1000 + rng.normal(size=(1024, 8))).astype(np.int64)
    queries_ = rows[::100]
    blocks = t._maxima(rows, t.BLOCK)
    assert (t._exact(t._signed(queries_), blocks).repeat(t.BLOCK, axis=1) >= queries_ @ rows.T).all()


def test_edges(spark):
    big = float(1 << 27)
    rows = [
        (0, [0.5, -0.25]), (100, [0.5, -0.25]), (100, [0.5, -0.25]), (100, [1.0, 0.0]), (None, [9.0, 9.0]), (1, None), (2, [None, 1.0]),
        (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.1]), (6, [0.1, 0.2, 0.3]), (7, []), (8, [-0.0001, 0.0001]), (9, [big, -big]), (200, [big, big])]
    assert ask(spark, rows, "key label serial n") == brute(rows)
    assert ask(spark, rows, k=3) == brute(rows, 3)
    assert ask(spark, []) == set()
    assert ask(spark, [(1, [1.0]), (2, [2.0])]) == set()
    assert ask(spark, [(0, []), (1, []), (100, None)]) == {(0, 1, 1, 0)}
