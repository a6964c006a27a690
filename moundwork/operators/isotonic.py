"""Isotonic curves by pool-adjacent-violators over ordered blocks of scores.

A pool is a run of neighbouring scores with its rows and hits; pools whose shares do not rise are
merged. Pooling is associative: pooling blocks of a sorted sequence, then pooling what is left of
several blocks together, gives the pools of the whole sequence. So rows are counted per distinct
score (a hot score is one pool), the scores are cut into blocks of about ``BLOCK`` rows in order,
every block is pooled by a task of its own, and ``FAN`` blocks become one until one is left. Shares
of neighbouring pools are fractions that rise strictly, so N rows leave at most about N ** (2/3) pools.

Counts are compared as integers, so the pools do not depend on the cut. Rows without a score or a
label are left out; a null key is a key; an empty table has an empty curve.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundwork.functions.ranking import value_positions
from moundwork.session import written_once

BLOCK, FAN = 100_000, 64
POOL = ("low", "high", "n", "hits")


def pool(rows: Iterable[tuple[float, float, int, int]]) -> list[list]:
    """Pools (low, high, n, hits) with strictly rising shares, from pools in score order."""
    out: list[list] = []
    for low, high, n, hits in rows:
        while out and out[-1][3] * n >= hits * out[-1][2]:
            low, _, m, more = out.pop()
            n, hits = n + m, hits + more
        out.append([low, high, n, hits])
    return out


def _pool_blocks(pools: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every (keys, block) pooled on its own."""
    kinds = ", ".join(f"`{k}` {pools.schema[k].dataType.simpleString()}" for k in keys)
    schema = (kinds + ", " if keys else "") + "low double, high double, n long, hits long, block long"

    def run(labels: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("low")
        made = pd.DataFrame(pool(zip(*(ordered[c].tolist() for c in POOL))), columns=list(POOL))
        for name, label in zip([*keys, "block"], labels):
            made[name] = label
        return made[[*keys, *POOL, "block"]]

    return pools.groupBy(*keys, "block").applyInPandas(run, schema)


def isotonic_curve(
    scored: DataFrame, score: str = "risk_score_raw", label: str = "y", keys: Sequence[str] = (), block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """``keys``, ``low``, ``high``, ``n``, ``hits`` and ``value`` (share of hits) of every pool; labels are 0 or 1."""
    rows = scored.where(F.col(label).isNotNull()).select(*keys, F.col(score).cast("double").alias("score"), F.col(label).cast("long").alias("label"))
    spots = value_positions(rows, "score", keys, {"hits": F.sum("label")})
    first = F.floor(F.col("n_before") / block).cast("long")
    pools = spots.select(*keys, F.col("score").alias("low"), F.col("score").alias("high"), "n", "hits", first.alias("block"))
    pools = written_once(_pool_blocks(pools, keys), "isotonic-pools")
    last = pools.agg(F.max("block")).first()[0] or 0
    while last:
        pools = written_once(_pool_blocks(pools.withColumn("block", F.floor(F.col("block") / fan).cast("long")), keys), "isotonic-pools")
        last //= fan
    return pools.select(*keys, *POOL, (F.col("hits") / F.col("n")).alias("value"))
