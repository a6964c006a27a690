"""Tables of replaceable partitions: a batch rewrites the partitions it touches and no other file.

A batch writes its partitions to a folder of its own and then one small commit file, put in place by a
rename, that names the folder of every partition of the table. Until that file is there, readers see the
table as it was; a run that dies before leaves only a folder that nobody reads. A commit also
carries the names of all batches so far, so a batch that is sent again changes nothing. One writer at
a time. The list of partitions goes through the driver: it is as long as the calendar, not as the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundwork.session import shuffles_freed


class Files:
    """The few calls on Spark's own file systems that commits need."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.lines = spark.read.text

    def names(self, folder: str) -> list[str]:
        """Entries of a folder, none if it is missing."""
        if not self.system.exists(self.path(folder)):
            return []
        return sorted(found.getPath().getName() for found in self.system.listStatus(self.path(folder)))

    def exists(self, path: str) -> bool:
        return self.system.exists(self.path(path))

    def remove(self, path: str) -> None:
        self.system.delete(self.path(path), True)

    def put(self, path: str, value: dict) -> None:
        """Write a file beside ``path`` and rename it; an existing one is an error."""
        parent, _, name = path.rpartition("/")
        draft = f"{parent}/.{name}-{uuid.uuid4().hex}"
        out = self.system.create(self.path(draft), False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        if self.exists(path) or not self.system.rename(self.path(draft), self.path(path)):
            raise FileExistsError(f"{path} has been committed by another writer")

    def get(self, path: str) -> dict:
        return json.loads("\n".join(r.value for r in self.lines(path).collect()))


class PartitionedTable:
    """A table under ``folder`` whose rows belong to the partition that ``part``, an expression on its columns, names."""

    def __init__(self, spark: SparkSession, folder: str, part: str, schema: T.StructType | str):
        self.spark, self.folder, self.part = spark, folder.rstrip("/"), part
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        self.files = Files(spark, folder)

    def state(self) -> dict:
        """The newest commit: ``number``, ``places`` (folder of every partition) and ``batches``."""
        numbers = [int(n.split(".")[0]) for n in self.files.names(f"{self.folder}/commits") if n.endswith(".json") and n[0] != "."]
        if not numbers:
            return {"number": 0, "places": {}, "batches": []}
        return {"number": max(numbers), **self.files.get(f"{self.folder}/commits/{max(numbers):09d}.json")}

    def read(self, parts: Iterable[str] | None = None) -> DataFrame:
        """All rows, or those of some partitions; files of other partitions are not even listed."""
        places = self.state()["places"]
        chosen = [places[p] for p in sorted(places if parts is None else set(parts) & set(places))]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{place}" for place in chosen])

    def has(self, batch: str) -> bool:
        return batch in self.state()["batches"]

    def parts_of(self, rows: DataFrame) -> set[str]:
        """The partitions that rows belong to."""
        return {r[0] for r in rows.select(F.expr(self.part).cast("string")).distinct().collect()}

    def replace(self, rows: DataFrame, parts: Iterable[str], batch: str, spread: Column | str | None = None, dealt: bool = False) -> None:
        """``rows`` become all the rows of ``parts``; ``spread`` deals a partition's rows over several files.

        Rows that are ``dealt`` over tasks already, like those of windows, are written by these tasks without another exchange.
        """
        if self.has(batch):
            return
        staged = f"data/{uuid.uuid4().hex}"
        keyed = rows.select(*self.schema.names, F.expr(self.part).cast("string").alias("_part"))
        if not dealt:
            keyed = keyed.repartition("_part", *([spread] if spread is not None else []))
        with shuffles_freed(self.spark):
            keyed.write.partitionBy("_part").option("compression", "zstd").parquet(f"{self.folder}/{staged}")
        self._commit(staged, set(parts), batch)

    def _commit(self, staged: str, parts: set[str], batch: str) -> None:
        state = self.state()
        places = {p: place for p, place in state["places"].items() if p not in parts}
        for name in self.files.names(f"{self.folder}/{staged}"):
            if name.startswith("_part="):
                value = name.removeprefix("_part=")
                if value not in parts:
                    raise ValueError(f"a row of partition {value}, which the batch does not replace")
                places[value] = f"{staged}/{name}"
        self.files.put(f"{self.folder}/commits/{state['number'] + 1:09d}.json", {
            "places": places, "batches": [*state["batches"], batch]})
