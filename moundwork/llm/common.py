"""Small helpers that several operators share."""

from __future__ import annotations

import math
import os
import pathlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

# Rows of an Arrow batch; texts of a hundred thousand characters then stay well below a worker's memory.
BATCH_ROWS = 512
SOURCE = str(pathlib.Path(__file__).resolve().parents[2])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers a few hundred rows at a time, and let them import this package.

    The path serves workers that see the driver's source folder; elsewhere the package is installed
    or shipped with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if SOURCE not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([SOURCE, *filter(None, known)])


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows as one struct ``row`` beside ``columns``, so that no column name of the input clashes."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(whole, *[c.alias(name) for name, c in columns.items()])


def stage(df: DataFrame, keep: Iterable[str], columns: dict[str, Column]) -> DataFrame:
    """Columns computed once per row: a one-element ``inline`` keeps them from being copied into later lambdas."""
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*keep, F.inline(packed))


def range_fences(keys: DataFrame, key: str, rows_per_range: int, most: int = 10_000) -> list:
    """Ascending upper ends of ranges of about ``rows_per_range`` keys; the last one is the largest key.

    The ends come from about twenty keys a range, picked by hash, so at most ``20 * most`` keys
    reach the driver. They steer only how evenly the ranges are filled, never which rows count.
    """
    n, top = keys.agg(F.count(key), F.max(key)).first()
    if not n:
        return []
    ranges = min(most, math.ceil(n / rows_per_range))
    if ranges == 1:
        return [top]
    share = min(1.0, 20 * ranges / n)
    picked = keys.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    drawn = sorted(r[0] for r in picked.where(F.col(key).isNotNull()).select(key).distinct().collect())
    step = max(1.0, len(drawn) / ranges)
    ends = {drawn[int(i * step)] for i in range(1, ranges) if int(i * step) < len(drawn)}
    return sorted(ends | {top})


def range_of(value: Column, fences: list) -> Column:
    """Index of the first fence not below ``value``, by halving; null goes to range 0."""
    if len(fences) < 2:
        return F.lit(0)
    ends = F.array(*[F.lit(x) for x in fences])
    halvings = math.ceil(math.log2(len(fences))) + 1
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(fences) - 1).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(ends, mid) < value
        narrowed = F.struct(
            F.when(below, mid + 1).otherwise(acc["lo"]).cast("int").alias("lo"),
            F.when(below, acc["hi"]).otherwise(mid).cast("int").alias("hi"))
        return F.when(acc["lo"] < acc["hi"], narrowed).otherwise(acc)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve, lambda acc: acc["lo"])
    return F.when(value.isNull(), 0).otherwise(found)
