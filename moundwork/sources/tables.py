"""Reading, writing and describing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundwork import schemas


def read_table(spark: SparkSession, path: str, name: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read csv or parquet; a known table name fixes the schema so nothing is inferred."""
    reader = spark.read
    if name is not None:
        reader = reader.schema(schemas.TABLES[name])
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.parquet(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", season_of: str | None = None
) -> None:
    """Write csv or parquet; ``season_of`` names a date column to partition the files by year.

    Rows of a season are spread over tasks by a second key, so a large season is not one file.
    """
    parts: list[str] = []
    if season_of is not None:
        df = df.withColumn("season", F.year(season_of))
        spread = [c for c in ("pitcher_id", season_of) if c in df.columns]
        df, parts = df.repartition("season", *spread), ["season"]
    writer = df.write.mode(mode).partitionBy(*parts) if parts else df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(df, path, fmt, mode="append")


def scan_table(df: DataFrame, columns: Sequence[str], predicate: Column | None = None) -> DataFrame:
    """Projection and filter in a form the file reader can push down."""
    return (df if predicate is None else df.where(predicate)).select(*columns)


def scan_date_range(
    df: DataFrame, start: str, end: str, columns: Sequence[str], day: str = "game_date",
    order: Sequence[str] = (),
) -> DataFrame:
    inside = df.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(*columns)
    return inside.orderBy(*order) if order else inside


def dataset_metadata(pitches: DataFrame, appearances: DataFrame, injuries: DataFrame) -> DataFrame:
    """One row: pitchers, date span and row counts. Distinct pitchers come from grouped partials."""
    per = pitches.groupBy("pitcher_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("game_date").alias("a"), F.max("game_date").alias("b")
    )
    head = per.agg(
        F.count(F.lit(1)).alias("total_pitchers"), F.sum("n").alias("total_pitches"),
        F.min("a").alias("start_date"), F.max("b").alias("end_date"),
    )
    counts = {
        "total_appearances": appearances.agg(F.count(F.lit(1))).scalar(),
        "total_injuries": injuries.agg(F.count(F.lit(1))).scalar(),
    }
    return head.withColumns(counts)


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: type, rows, nulls, distinct values, min and max (as text).

    Values are counted per (column, value) first; the distinct count is then a count of rows and
    combines on the map side.
    """
    types = dict(df.dtypes)
    plain = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
        )
        for c in columns
    ]).alias("m")).select(F.inline("m"))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    distinct = (
        df.select(pairs.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())
        .distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    )
    return plain.join(distinct, "column", "left").fillna(0, ["distinct_values"])


def add_missing_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Schema growth: union that fills columns absent from either side with null."""
    return old.unionByName(new, allowMissingColumns=True)
