"""Stored tables by partition: untouched files stay, a batch counts once, a run that dies leaves the old table."""

from __future__ import annotations

import datetime as dt
import pathlib
import random
import time

import pytest
from days import day
from pyspark.sql import functions as F

from moundwork import schemas
from moundwork.operators import refresh, rolling
from moundwork.session import written_once
from moundwork.sources import loading, partitions

MONTH = "date_format(seen, 'yyyy-MM')"
SCHEMA = "name string, seen date, note string, updated_at date"


def files(folder):
    return {str(p.relative_to(folder)) for p in pathlib.Path(folder).rglob("*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def records(spark, items, stamp):
    return spark.createDataFrame([(n, day(d), note, day(stamp)) for n, d, note in items], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return partitions.PartitionedTable(spark, str(tmp_path / "t"), MONTH, SCHEMA)


def test_upsert_touches_only_its_months(spark, table):
    old = records(spark, [("a", "2024-03-01", "x"), ("b", "2024-04-02", "y"), ("c", "2024-05-03", "z")], "2024-06-01")
    loading.upsert_batch(table, old, ["name", "seen"], "one")
    before, places = files(table.folder), table.state()["places"]
    new = records(spark, [("b", "2024-04-02", "newer"), ("d", "2024-04-09", "added"), ("e", "2024-07-01", "month")], "2024-06-02")
    loading.upsert_batch(table, new, ["name", "seen"], "two")
    now = table.state()["places"]
    assert {p: now[p] for p in ("2024-03", "2024-05")} == {p: places[p] for p in ("2024-03", "2024-05")} and before <= files(table.folder)
    assert rows(table.read()) == rows(loading.upsert_records(new, old, ["name", "seen"]))
    assert all("2024-04" in str(f) for f in table.read(["2024-04"]).inputFiles())
    stale = records(spark, [("b", "2024-04-02", "stale")], "2024-01-01")
    loading.upsert_batch(table, stale, ["name", "seen"], "three")
    assert rows(table.read(["2024-04"])) == rows(loading.upsert_records(new, old, ["name", "seen"]).where("month(seen) = 4"))


def test_a_batch_counts_once_and_an_empty_one_changes_nothing(spark, table):
    one = records(spark, [("a", "2024-03-01", "x")], "2024-06-01")
    for _ in range(2):
        loading.upsert_batch(table, one, ["name", "seen"], "one")
    assert table.state()["number"] == 1
    loading.upsert_batch(table, one.where("false"), ["name", "seen"], "none")
    assert rows(table.read()) == rows(one) and table.has("none") and not table.has("other")
    assert table.read(["1999-01"]).count() == 0 and table.read().columns == one.columns


def test_a_run_that_dies_leaves_the_old_table(spark, table, monkeypatch):
    one = records(spark, [("a", "2024-03-01", "x")], "2024-06-01")
    loading.upsert_batch(table, one, ["name", "seen"], "one")
    two = records(spark, [("a", "2024-03-01", "y")], "2024-06-02")
    with monkeypatch.context() as patch:
        patch.setattr(partitions.Files, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            loading.upsert_batch(table, two, ["name", "seen"], "two")
    assert rows(table.read()) == rows(one) and not table.has("two")
    loading.upsert_batch(table, two, ["name", "seen"], "two")
    assert rows(table.read()) == rows(two)
    with pytest.raises(FileExistsError):
        table.files.put(f"{table.folder}/commits/{2:09d}.json", {})
    with pytest.raises(ValueError):
        table.replace(two, ["1999-01"], "three")


def pitches(spark, items):
    return spark.createDataFrame([(d, p, "FF", v, s, n, n) for n, (p, d, v, s) in enumerate(items)], schemas.PITCHES)


@pytest.fixture
def history(spark):
    rng = random.Random(3)
    start = dt.date(2023, 1, 1)
    return [
        (rng.randrange(1, 5), start + dt.timedelta(days=rng.randrange(420)), rng.choice([None, 88.5, 92.0, 95.5]), rng.choice([None, 2100, 2300]))
        for _ in range(500)]


def features(spark, items):
    found = refresh.window_features(rolling.daily_pitch_sums(pitches(spark, items)))
    return rounded(found)


def rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_batches_in_any_order_equal_the_full_run(spark, history, tmp_path):
    order = sorted(history, key=lambda r: r[1])
    late = order[100:110] + order[300:305]
    first = [r for r in order[:400] if r not in late]
    store = refresh.FeatureStore(spark, str(tmp_path / "f"), pitches(spark, order))
    store.add(pitches(spark, first), "first")
    assert rounded(store.features.read()) == features(spark, first)
    store.add(pitches(spark, order[400:]), "second")
    before = store.features.state()["places"]
    for _ in range(2):
        store.add(pitches(spark, late), "late")
    after = store.features.state()["places"]
    everything = first + order[400:] + late
    assert rounded(store.features.read()) == features(spark, everything)
    reached = {(r[1] + dt.timedelta(days=k)).strftime("%Y-%m") for r in late for k in range(refresh.LONGEST + 1)}
    assert {m for m in before if before[m] != after[m]} <= reached and any(before[m] == after[m] for m in before)


def test_a_late_pitch_reads_only_months_around_it(spark, history, tmp_path):
    store = refresh.FeatureStore(spark, str(tmp_path / "f"), pitches(spark, history))
    store.add(pitches(spark, history), "first")
    read = []

    def spy(table):
        plain = table.read

        def reading(parts=None):
            read.append(None if parts is None else set(parts))
            return plain(parts)
        table.read = reading

    spy(store.daily)
    spy(store.features)
    store.add(pitches(spark, [(1, dt.date(2023, 6, 15), 90.0, 2000)]), "late")
    assert read and all(parts is not None and parts <= {"2023-04", "2023-05", "2023-06", "2023-07", "2023-08"} for parts in read)


def test_a_run_that_dies_between_both_tables_is_finished_by_the_same_batch(spark, history, tmp_path, monkeypatch):
    store = refresh.FeatureStore(spark, str(tmp_path / "f"), pitches(spark, history))
    store.add(pitches(spark, history[:300]), "first")
    with monkeypatch.context() as patch:
        patch.setattr(store.features, "replace", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.add(pitches(spark, history[300:]), "second")
    assert rounded(store.features.read()) == features(spark, history[:300])
    store.add(pitches(spark, history[300:]), "second")
    assert rounded(store.features.read()) == features(spark, history)
    nobody = pitches(spark, history[:2]).withColumn("pitcher_id", F.lit(None).cast("int"))
    store.add(nobody, "nobody")
    store.add(nobody.where("false"), "empty")
    assert rounded(store.features.read()) == features(spark, history)


def test_feature_batches_join_on_the_executors(spark):
    days = spark.range(3000).select((F.col("id") % 5).cast("int").alias("pitcher_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("game_date"))
    touched = refresh.FeatureStore._touched(days)
    rows = refresh.FeatureStore._changed_rows(days, touched, True)
    rows.collect()
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    one = days.where("pitcher_id = 1 and game_date = date'2024-01-02'").limit(1)
    got = refresh.FeatureStore._changed_rows(days.distinct(), refresh.FeatureStore._touched(one), True)
    want = days.distinct().where("pitcher_id = 1 and game_date between date'2024-01-02' and date'2024-03-02'")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    assert refresh.FeatureStore._months(one, 0, refresh.LONGEST) == {"2024-01", "2024-02", "2024-03"}


def test_features_come_from_one_exchange_of_daily_sums(spark, history):
    daily = written_once(rolling.daily_pitch_sums(pitches(spark, history)), "test-days")
    changed = daily.where("pitcher_id < 3 and day(game_date) = 5").select("pitcher_id", "game_date")
    found = refresh.window_features(refresh.FeatureStore._marked(daily, changed), ["_hit"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    reached = {(r.pitcher_id, r.game_date + dt.timedelta(days=k)) for r in changed.collect() for k in range(refresh.LONGEST + 1)}
    hit = found.where("_hit").drop("_hit")
    assert rounded(hit) == [r for r in features(spark, history) if r[:2] in reached] and 0 < hit.count() < found.count()
    assert {r.pitcher_id for r in found.collect()} == {1, 2}


def test_dealt_rows_are_written_where_they_are(spark, history, tmp_path):
    daily = rolling.daily_pitch_sums(pitches(spark, history)).repartition(5)
    tables = [partitions.PartitionedTable(spark, str(tmp_path / name), refresh.MONTH, daily.schema) for name in ("moved", "dealt")]
    for table, dealt in zip(tables, (False, True)):
        table.replace(daily, table.parts_of(daily), "one", dealt=dealt)
    assert rounded(tables[0].read()) == rounded(tables[1].read())
    sizes = [len(list((tmp_path / name).rglob("*.parquet"))) for name in ("moved", "dealt")]
    assert sizes[0] == len(tables[1].state()["places"]) < sizes[1]


def test_written_rows_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    before = shuffled()
    rows = written_once(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "test-rows")
    until = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < until:  # files are freed in the background
        time.sleep(0.2)
    assert not shuffled() - before and rows.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
