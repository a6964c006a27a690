"""Session settings the operators rely on (UTC days, AQE, ANSI casts)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}
# The Java compiler of the JVM leaves methods above 8000 bytes of code uncompiled; projections of many feature
# columns are such methods unless Spark then makes them in pieces.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")
SETTINGS |= dict([METHOD_LIMIT])


def build_session(app: str = "moundwork", master: str | None = None, **extra: str) -> SparkSession:
    """Create a session; on a cluster leave ``master`` and shuffle settings to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. A session of one machine (``local`` or
    ``local[...]``) may go without it and gets a temporary folder that is removed at the end; on any
    other master a missing setting is an error, because executors would each write to a disk of
    their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = tempfile.mkdtemp(prefix="moundwork-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside free their shuffle files when they end: what they wrote is read from then on, and a session keeps
    the files of all its jobs otherwise. A version of Spark without the setting ignores it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written_once(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For rows that several jobs use (a fit makes many passes): the files survive lost executors and
    end the lineage, which recomputation or an executor cache would not.
    """
    path = shared_folder(df.sparkSession, purpose)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
