from __future__ import annotations

import datetime as dt
import os
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from days import day  # noqa: E402

from moundwork import schemas  # noqa: E402
from moundwork.session import build_session  # noqa: E402

TESTDATA = pathlib.Path(os.environ.get("MOUNDWORK_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not TESTDATA.exists():
        pytest.skip("no test tables")
    return str(TESTDATA)


@pytest.fixture
def make(spark):
    """Frames of the domain tables from short tuples."""

    class Make:
        @staticmethod
        def pitches(rows):
            """(pitcher, date, type, speed, spin, number, at_bat)"""
            data = [(day(d), p, kind, speed, spin, number, ab) for p, d, kind, speed, spin, number, ab in rows]
            return spark.createDataFrame(data, schemas.PITCHES)

        @staticmethod
        def games(rows):
            """(pitcher, date, pitches, velocity, spin, innings)"""
            data = [(p, day(d), n, float(v), float(s), float(i)) for p, d, n, v, s, i in rows]
            return spark.createDataFrame(
                data, "pitcher_id int, game_date date, pitches_thrown int, avg_vel double, avg_spin double, innings_pitched double")

        @staticmethod
        def injuries(rows):
            """(pitcher, start, end or None)"""
            data = [(p, day(a), day(b) if b else None, "10-day") for p, a, b in rows]
            return spark.createDataFrame(data, schemas.INJURIES)

        @staticmethod
        def scored(y, score, **extra):
            data = [(i % 3, day("2024-04-01") + dt.timedelta(days=i), a, float(b)) for i, (a, b) in enumerate(zip(y, score))]
            return spark.createDataFrame(data, "pitcher_id int, as_of_date date, y int, score double")

    return Make
