"""Structured Streaming twins of the batch operators over pitch events.

Sources are file folders read as streams; ``availableNow`` with a checkpoint takes the place of a
stored "last processed" date. Aggregates run in update mode and write each micro-batch's changed
rows to its own ``epoch=`` folder, which a replay overwrites, so a restarted job repeats nothing.
Readers keep the newest epoch of every key; ``compact`` merges epochs into a base table, so that readers
scan one base and the epochs since, however long the stream has run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from moundwork.bindings import half_even, shape_events
from moundwork.sources.partitions import Files

DELAY = "1 day"


def open_events(spark: SparkSession, folder: str, table: str = "events.parquet", per_batch: int | None = None) -> DataFrame:
    """The part files of a table's folder (or its single file) as a stream of pitch rows."""
    path = f"{folder.rstrip('/')}/{table}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    # A pattern that matches just this path: a plain path to a stream must be a folder.
    return shape_events(reader.parquet(f"{path[:-1]}[{path[-1]}]"))


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rows_dropped_late(query: StreamingQuery) -> int:
    """Rows behind the watermark, as counted by the state operators."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress for op in progress["stateOperators"]
    )


def _save_changes(folder: str) -> Callable[[DataFrame, int], None]:
    def save(changes: DataFrame, epoch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return save


def _compacted(files: Files, folder: str) -> dict | None:
    """The newest commit of a folder of changes: ``path`` of its base and ``upto``, the last epoch in it."""
    commits = [n for n in files.names(f"{folder}/_commits") if n.endswith(".json") and n[0] != "."]
    return files.get(f"{folder}/_commits/{max(commits)}") if commits else None


def _finished(files: Files, folder: str, after: int) -> list[int]:
    """Epochs behind ``after`` that are written in full."""
    found = [int(n.removeprefix("epoch=")) for n in files.names(folder) if n.startswith("epoch=")]
    return sorted(e for e in found if e > after and files.exists(f"{folder}/epoch={e}/_SUCCESS"))


def _newest(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in changes.columns if c not in (*keys, "epoch")]
    return changes.groupBy(*keys).agg(F.max("epoch").alias("epoch"), F.max_by(F.struct(*rest), "epoch").alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "epoch")


def _changes(spark: SparkSession, folder: str, base: dict | None, epochs: Sequence[int]) -> DataFrame:
    parts = [spark.read.parquet(f"{folder}/{base['path']}")] if base else []
    if epochs:
        later = spark.read.option("basePath", folder).parquet(*[f"{folder}/epoch={e}" for e in epochs])
        parts.append(later.withColumn("epoch", F.col("epoch").cast("long")))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def newest_changes(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The current table behind a folder of changes: the last compaction and the epochs after it."""
    files = Files(spark, folder)
    base = _compacted(files, folder)
    epochs = _finished(files, folder, base["upto"] if base else -1)
    return _newest(_changes(spark, folder, base, epochs), keys).drop("epoch")


def compact(spark: SparkSession, folder: str, keys: Sequence[str]) -> bool:
    """Merge all finished epochs into a new base; true if there was something to merge.

    The base is written beside the old one and takes its place when a commit file appears, so readers see the old
    state or the new one, never half of either, and a run that dies leaves only a folder that nobody
    reads. Streams may go on writing later epochs meanwhile; one compaction at a time.
    """
    files = Files(spark, folder)
    base = _compacted(files, folder)
    epochs = _finished(files, folder, base["upto"] if base else -1)
    if not epochs:
        return False
    path = f"_base/{uuid.uuid4().hex}"
    _newest(_changes(spark, folder, base, epochs), keys).write.parquet(f"{folder}/{path}")
    files.put(f"{folder}/_commits/{epochs[-1]:012d}.json", {"path": path, "upto": epochs[-1]})
    return True


def drop_compacted(spark: SparkSession, folder: str) -> None:
    """Delete the epochs and bases that the last commit has replaced; for a time when no reader from before it is at work."""
    files = Files(spark, folder)
    base = _compacted(files, folder)
    if base is None:
        return
    old = [f"epoch={e}" for e in _finished(files, folder, -1) if e <= base["upto"]]
    old += [f"_base/{n}" for n in files.names(f"{folder}/_base") if f"_base/{n}" != base["path"]]
    for name in old:
        files.remove(f"{folder}/{name}")


def ingest_to(events: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = ("event_id",)) -> StreamingQuery:
    """Each key once, however late its copies or it arrive.

    A micro-batch is held against the rows of earlier epochs on its own days (the target is laid out
    by day, so the others are not read) and written to its epoch's folder, which a replay overwrites.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        span = fresh.agg(F.min("game_date").alias("a"), F.max("game_date").alias("b")).first()
        if epoch and span["a"] is not None:
            loaded = _ingested(spark, folder, batch.schema).where(
                (F.col("epoch") < epoch) & F.col("game_date").between(F.lit(span["a"]), F.lit(span["b"])))
            fresh = fresh.join(loaded.select(*keys), list(keys), "left_anti")
        fresh.write.mode("overwrite").partitionBy("game_date").parquet(f"{folder}/epoch={epoch}")

    return run_available(events.writeStream.foreachBatch(handle), checkpoint)


def _ingested(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    return spark.read.schema(whole).option("basePath", folder).parquet(folder)


def read_ingested(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder).drop("epoch")


def daily_appearances(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Game aggregates per pitcher and day as events arrive."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    return events.groupBy("pitcher_id", F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("pitches_thrown"),
        half_even(F.avg("release_speed"), 2).alias("avg_vel"),
        F.coalesce(half_even(F.stddev_samp("release_speed"), 2), F.lit(0.0)).alias("vel_std"),
        half_even(F.avg("release_spin_rate"), 2).alias("avg_spin"),
    ).select("pitcher_id", F.to_date("w.start").alias("game_date"), "pitches_thrown", "avg_vel", "vel_std", "avg_spin")


def rolling_load(events: DataFrame, delay: str = DELAY, days: int = 7) -> DataFrame:
    """Pitches per pitcher in windows of ``days`` days that start every day."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    return events.groupBy("pitcher_id", F.window("ts", f"{days} days", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("pitches"), F.avg("release_speed").alias("avg_vel")
    ).select("pitcher_id", F.to_date("w.start").alias("first_day"), F.date_sub(F.to_date("w.end"), 1).alias("last_day"), "pitches", "avg_vel")


def outings(events: DataFrame, gap: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Runs of activity separated by at least ``gap`` without a pitch."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    return events.groupBy("pitcher_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("pitches")
    ).select("pitcher_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "pitches")


def run_changes(frame: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Run an update-mode aggregate and keep its changes per epoch."""
    return run_available(frame.writeStream.outputMode("update").foreachBatch(_save_changes(folder)), checkpoint)


def run_outings(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Finished outings only: session windows are emitted once the watermark passed their end."""
    # Sessions are combined before the shuffle, so a busy pitcher sends one row per outing and task.
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    writer = outings(events).writeStream.outputMode("append").format("parquet").option("path", folder)
    return run_available(writer, checkpoint)


def load_states(daily: DataFrame, limit: int, days: int = 7) -> DataFrame:
    """Every day's trailing load and whether it reaches ``limit`` after a day (or no day) below it."""
    order = Window.partitionBy("pitcher_id").orderBy("_d")
    load = daily.withColumn("_d", F.unix_date("game_date")).withColumn(
        "load", F.sum("pitches_thrown").over(order.rangeBetween(-(days - 1), 0))
    )
    before = F.coalesce(F.lag("load").over(order), F.lit(0))
    return load.withColumn("crossed", (F.col("load") >= limit) & (before < limit)).select(
        "pitcher_id", "game_date", "load", "crossed")


def load_crossings(daily: DataFrame, limit: int, days: int = 7) -> DataFrame:
    return load_states(daily, limit, days).where("crossed").drop("crossed")


def alert_writer(spark: SparkSession, folder: str, limit: int, days: int = 7) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: add the batch to the daily counts, then write the state of every day it can change.

    A late pitch may void an alert that an earlier epoch wrote, so a day that no longer crosses the
    limit is written as well; readers keep the newest state. Counts are kept in files partitioned by day; only the days a batch can influence are read
    back (the day filter prunes folders), and only for pitchers of the batch.
    """
    counts, alerts = f"{folder}/counts", f"{folder}/alerts"

    def handle(batch: DataFrame, epoch: int) -> None:
        fresh = batch.groupBy("pitcher_id", "game_date").agg(F.count(F.lit(1)).alias("n")).withColumn("epoch", F.lit(epoch))
        fresh = fresh.persist()
        try:
            first = fresh.agg(F.min("game_date").alias("d")).first()["d"]
            if first is None:
                return
            fresh.repartition("game_date").write.mode("append").partitionBy("game_date").parquet(counts)
            touched = fresh.select("pitcher_id").distinct()
            near = (
                spark.read.parquet(counts)
                .where(F.col("game_date") >= F.date_sub(F.lit(first), 2 * days))
                .join(touched, "pitcher_id", "left_semi")
                .distinct()  # a replayed epoch wrote the same rows again
                .groupBy("pitcher_id", "game_date").agg(F.sum("n").alias("pitches_thrown"))
            )
            found = load_states(near, limit, days).where(F.col("game_date") >= F.lit(first))
            found.write.mode("overwrite").parquet(f"{alerts}/epoch={epoch}")
        finally:
            fresh.unpersist()

    return handle


def run_alerts(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str, limit: int) -> StreamingQuery:
    handler = alert_writer(spark, folder, limit)
    return run_available(events.writeStream.foreachBatch(handler), checkpoint)


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/alerts"
    return newest_changes(spark, path, ["pitcher_id", "game_date"]).where("crossed").drop("crossed")
