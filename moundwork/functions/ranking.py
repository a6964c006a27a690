"""Exact global order statistics without a single-task sort.

A window without a fine partition key (a league-wide percentile, an ROC curve, a top ten
percent) would pull every row into one task. Here the rows are first counted per distinct value
(a map-side combined aggregate, so ties and hot values collapse), the distinct values are split
into ordered buckets, and running totals are formed inside each bucket and shifted by the totals
of the buckets before it. Bucket edges come from the values with the smallest hashes: they only
steer the split, are the same on every evaluation, and never change a result.

The counts are used three times (edges, bucket totals, running totals). They are written to the
shared folder once, so the rows behind them are read and computed once, and a lost executor
recomputes nothing upstream.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundwork.session import written_once

VALUES_PER_BUCKET = 50_000


def bucket_count(values: int) -> int:
    """Buckets for so many distinct values; their number grows with the values, a bucket does not."""
    return max(4, math.ceil(values / VALUES_PER_BUCKET))


def _with_bucket(df: DataFrame, value: str, edges: Column, most: int) -> DataFrame:
    """Add ``_bucket``: how many of the ascending ``edges`` (at most ``most``) are at or below ``value``.

    By halving, one projection a step, so that a row costs a few compiled comparisons and no lambda.
    """
    placed = df.withColumns({"_edges": edges, "_bucket": F.lit(0)})
    for power in reversed(range(most.bit_length())):
        reached = F.get("_edges", F.col("_bucket") + (2**power - 1)) <= F.col(value)
        placed = placed.withColumn("_bucket", F.col("_bucket") + F.when(reached, 2**power).otherwise(0))
    return placed.drop("_edges")


def value_positions(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    measures: dict[str, Column] | None = None,
    weight: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """One row per (keys, value) with its totals, the totals below it, and the key's totals.

    For every measure ``m`` the result has ``m``, ``m_before`` (sum over smaller values of the
    same key) and ``m_total``; ``n`` counts rows (or sums ``weight`` of rows counted before).
    Null values are left out. ``stored`` says that ``df`` is a written table already holding one
    row per (keys, value), so that it is not written again.
    """
    measures = {"n": F.sum(weight) if weight else F.count(F.lit(1)), **(measures or {})}
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[agg.alias(name) for name, agg in measures.items()]
    )
    if not stored:
        counted = written_once(counted, "value-counts")
    # A value that several keys share makes one edge, and as many fewer values lie between two edges.
    most = bucket_count(counted.count()) - 1
    edges = (
        counted.select(value).orderBy(F.xxhash64(value), value).limit(most).agg(F.array_sort(F.collect_set(value)))
    ).scalar()
    placed = _with_bucket(counted, value, edges, most)
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    shifts = placed.groupBy(*keys, "_bucket").agg(
        *[F.sum(name).alias(f"_b_{name}") for name in measures]
    ).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_join_bucket"),
        *[F.coalesce(F.sum(f"_b_{name}").over(below), F.lit(0)).alias(f"_s_{name}") for name in measures],
        *[F.sum(f"_b_{name}").over(whole).alias(f"{name}_total") for name in measures],
    )
    match = F.col("_bucket") == F.col("_join_bucket")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumns(
            {f"{name}_before": F.coalesce(F.sum(name).over(inside), F.lit(0)) for name in measures}
        )
        .join(shifts, match)
        .withColumns({f"{name}_before": F.col(f"{name}_before") + F.col(f"_s_{name}") for name in measures})
        .select(
            *keys, value,
            *[f"{name}{part}" for name in measures for part in ("", "_before", "_total")],
        )
    )


def lookup(df: DataFrame, key: str) -> Column:
    """The few rows of ``df`` (one per key of a fixed list) as a scalar map from the key to its other columns."""
    entry = F.struct(key, F.struct(*[c for c in df.columns if c != key]))
    return df.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def percentiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated percentiles per key; one column per entry of ``probs``."""
    placed = value_positions(df, value, keys, weight=weight)
    before, upto = F.col("n_before"), F.col("n_before") + F.col("n")

    def at(slot: Column) -> Column:
        return F.max(F.when((before <= slot) & (slot < upto), F.col(value).cast("double")))

    picks = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("n_total") - 1)
        picks += [
            at(F.floor(place)).alias(f"_lo_{name}"),
            at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_w_{name}"),
        ]
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


def with_positions(
    df: DataFrame, value: str, keys: Sequence[str] = (), measures: dict[str, Column] | None = None
) -> DataFrame:
    """Attach ``value_positions`` columns to every row of ``df`` (rows with a value only)."""
    placed = value_positions(df, value, keys, measures)
    renamed = placed.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.col(value).alias("_r_value"),
        *[c for c in placed.columns if c not in (*keys, value)],
    )
    match = F.col(value) == F.col("_r_value")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(renamed, match).drop("_r_value", *[f"_r_{k}" for k in keys])


def percent_rank(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "pct") -> DataFrame:
    """SQL ``percent_rank() over (partition by keys order by value)`` for coarse keys."""
    ranked = with_positions(df, value, keys)
    share = F.when(
        F.col("n_total") > 1, F.col("n_before") / (F.col("n_total") - 1)
    ).otherwise(F.lit(0.0))
    return ranked.withColumn(name, share).drop("n", "n_before", "n_total")


def global_row_number(
    df: DataFrame, value: str, spread: str, last: str, descending: bool = True, name: str = "rn"
) -> DataFrame:
    """Row number over (value, spread, last), plus ``row_total``; no task sees a whole value group.

    Ties on ``value`` are ordered by ``spread`` through a second set of bucketed totals; only the
    rows of one (value, spread) pair are ordered in a window, by ``last``.
    """
    pairs = written_once(df.groupBy(value, spread).agg(F.count(F.lit(1)).alias("_n")), "pair-counts")
    outer = value_positions(pairs, value, weight="_n")
    first = F.col("n_total") - F.col("n_before") - F.col("n") if descending else F.col("n_before")
    outer = outer.select(value, first.alias("_start"), F.col("n_total").alias("row_total"))
    inner = value_positions(pairs, spread, [value], weight="_n", stored=True)
    starts = inner.join(outer, value).select(
        F.col(value).alias("_v"), F.col(spread).alias("_s"), (F.col("_start") + F.col("n_before")).alias("_start"),
        "row_total",
    )
    within = F.row_number().over(Window.partitionBy(value, spread).orderBy(last))
    rows = df.join(starts, (F.col(value) == F.col("_v")) & (F.col(spread) == F.col("_s")))
    return rows.withColumn(name, F.col("_start") + within).drop("_v", "_s", "_start")


def ntile(position: Column, total: Column, parts: int) -> Column:
    """SQL ``ntile`` from a 1-based row number and a row count."""
    size, extra = F.floor(total / parts), total % parts
    zero = position - 1
    return F.when(zero < extra * (size + 1), F.floor(zero / (size + 1)) + 1).otherwise(
        extra + F.floor((zero - extra * (size + 1)) / F.greatest(size, F.lit(1))) + 1
    ).cast("bigint")
