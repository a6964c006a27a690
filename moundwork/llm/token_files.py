"""Token id files: blocks of Huffman-coded ids in ascending document order.

A folder holds ``codebook`` (id, bits) and ``blocks``. Codes come from the counts of all ids of all
documents. A block is a row of its own with the documents it holds, their numbers of ids, the place
of its first id in the whole corpus, the coded bits (every document starts on a byte) and the bit
offsets of every 64th id of each document. Any block decodes alone, and within it all checkpoints
are decoded side by side by table look-up. Blocks are numbered by range and place; Parquet is the
container. A document must fit a task's memory; nothing else grows with the corpus.

Null and empty texts are documents of one end id; null keys come first; rows with equal keys are
ordered by their text's hash; an empty table gives an empty folder of the same form.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundwork.llm import huffman
from moundwork.llm.common import range_fences, range_of, small_batches
from moundwork.llm.tokens import words_of
from moundwork.session import written_once

END = 2
BLOCK_IDS = 500_000
ROWS_PER_RANGE = 4_000


def _packed(ids: np.ndarray) -> bytes:
    """Ids of two bytes where they fit, else of four."""
    return ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _ids(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}" if n else "<u2")


def tokenised(docs: DataFrame, tokenizer: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``mark`` (hash of the text), ``n_ids`` and ``packed`` ids, written once: the only pass of the tokenizer."""
    small_batches(docs.sparkSession)
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(data + closing, "<u4") for data in words_of(tokenizer).encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([_packed(x) for x in ids], pa.binary())], ["key", "mark", "n_ids", "packed"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("mark"))
    return written_once(rows.mapInArrow(run, f"key {kind}, mark long, n_ids long, packed binary"), "token-ids")


def _counts(staged: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.bincount(np.concatenate([_ids(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]))
            if len(more) > len(total):
                total = np.concatenate([total, np.zeros(len(more) - len(total), np.int64)])
            total[: len(more)] += more
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    summed = staged.select("packed", "n_ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = summed.collect()  # at most one row per vocabulary entry
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int = END, key: str = "doc_id", text: str = "text") -> None:
    spark = docs.sparkSession
    staged = tokenised(docs, tokenizer, end, key, text)
    lengths = huffman.code_lengths(_counts(staged))
    used = np.nonzero(lengths)[0]
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")

    fences = range_fences(staged.select("key"), "key", ROWS_PER_RANGE)
    ranges = max(1, len(fences))
    ranged = staged.withColumn("part", range_of(F.col("key"), fences))
    sums = ranged.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = {r.part: r.at for r in sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("at")).collect()}  # one row per range

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = huffman.canonical(lengths)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate([_ids(*r) for r in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())])
            coded = huffman.encode(ids, batch.column(3).to_numpy().astype(np.int64), codes, lengths)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(4)), pa.array([c[0] for c in coded], pa.binary()),
                pa.array([c[1].astype("<u4").tobytes() for c in coded], pa.binary())],
                ["part", "key", "mark", "n_ids", "payload", "checkpoints"])

    kind = docs.schema[key].dataType.simpleString()
    coded = ranged.select("part", "key", "mark", "n_ids", "packed").mapInArrow(
        encode, f"part int, key {kind}, mark long, n_ids long, payload binary, checkpoints binary")
    ordered = coded.repartition(ranges, "part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "mark")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first, held, bits = None, 0, 0, 0, 0
        keys, sizes, payload, points = [], [], [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()),
                pa.array([keys], pa.list_(types)), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(payload)], pa.binary()),
                pa.array([np.concatenate(points).astype("<u8").tobytes()], pa.binary())],
                ["part", "seq", "first", "keys", "sizes", "payload", "checkpoints"])

        types = None
        for batch in batches:
            types = batch.column(1).type
            for p, k, n, data, marks in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if keys and (p != part or held + n > BLOCK_IDS):
                    yield close()
                    first, seq, held, bits = first + held, seq + 1, 0, 0
                    keys, sizes, payload, points = [], [], [], []
                if p != part:
                    part, seq, first = p, 0, base[p]
                keys.append(k)
                sizes.append(n)
                payload.append(data)
                points.append(np.frombuffer(marks, "<u4").astype(np.int64) + bits)
                held += n
                bits += 8 * len(data)
        if keys:
            yield close()

    blocks = ordered.mapInArrow(
        block, f"part int, seq long, first long, keys array<{kind}>, sizes array<bigint>, payload binary, checkpoints binary")
    blocks.write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start`` (ids of all documents before), ``n_ids`` and ``ids`` (little-endian unsigned 32-bit)."""
    small_batches(spark)
    book = spark.read.parquet(f"{folder}/codebook").collect()  # bounded by the vocabulary
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r.id] = r.bits
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    lengths_bytes = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(lengths_bytes)
        for batch in batches:
            for i in range(batch.num_rows):
                first, keys, payload = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(3)[i].as_py()
                sizes = np.array(batch.column(2)[i].as_py(), np.int64)
                points = np.frombuffer(batch.column(4)[i].as_py(), "<u8").astype(np.int64)
                segments = -(-sizes // huffman.EVERY)
                counts = np.full(int(segments.sum()), huffman.EVERY, np.int64)
                counts[np.cumsum(segments) - 1] = sizes - huffman.EVERY * (segments - 1)
                ids = decoder.decode(payload, points, counts).astype("<u4")
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())],
                    [key, "start", "n_ids", "ids"])

    return blocks.select("first", "keys", "sizes", "payload", "checkpoints").mapInArrow(
        run, f"`{key}` {kind}, start long, n_ids long, ids binary")


@lru_cache(maxsize=2)
def _decoder(lengths: bytes) -> huffman.Decoder:
    return huffman.Decoder(np.frombuffer(lengths, np.uint8))
