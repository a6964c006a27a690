"""Document fingerprints that keep every shingle hash below a fixed share of the hash range.

A sketch (FracMinHash) of a text grows with the text, so the share of a small text's hashes found in
a large text's sketch estimates how much of the small one the large one contains. Hashes are XXH64 of
runs of ``WORDS`` words (a shorter text is one run), kept when below ``SHARE`` of the range; their
leading 32 bits are stored. Nothing else is ever kept, so the sketch of all shingles of several texts
is exactly the union of their sketches.

The price is that a text of few shingles may have none below the bound: its sketch is empty and says
nothing. That happens to a text of n different shingles with probability (1 - SHARE) ** n. SHARE is
therefore high, one text of up to five words in sixteen has an empty sketch; a corpus of long texts
only can take a far smaller share, at an error that falls with the square root of the kept hashes.
An empty sketch is contained in nothing but an empty one: likeness 0, or 1 for two empty ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundwork.llm.common import range_fences, range_of, small_batches
from moundwork.llm.simhash import shingle_hashes

WORDS = 5
SHARE = 15 / 16
ROWS_PER_RANGE = 4_000


def sketch(text: str | None, words: int = WORDS, share: float = SHARE) -> np.ndarray:
    """The kept hashes, ascending and distinct, as unsigned 32-bit numbers."""
    leading = (shingle_hashes(text, words) >> np.uint64(32)).astype(np.uint32)
    return np.unique(leading[leading < share * 2.0**32])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the shingles of two texts together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the other text has; 1 for two empty sketches, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def write(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype(">u4").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u4").astype(np.uint32)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, in descending key order.

    The edited text has its last half replaced by the beginning of the next document. Documents are
    dealt into ranges of keys with one shuffle of the texts; the first document of the next range
    comes along as a guest, so every range is walked in a stream, a batch at a time, and the ranges
    only steer the balance. Equal keys are ordered by their text's hash, null keys come last; null
    texts count as empty; the last document is followed by the first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    fences = range_fences(docs.select(F.col(key).alias("key")), "key", ROWS_PER_RANGE)
    ranges = max(1, len(fences))
    whole = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    own = range_of(F.col("key"), fences)
    guest = F.when(F.get(F.array(*[F.lit(x) for x in fences]), own) == F.col("key"), F.pmod(own + 1, F.lit(ranges))) if fences else F.lit(None).cast("int")
    places = F.array_compact(F.array(F.struct(own.alias("range"), F.lit(False).alias("guest")), F.when(guest.isNotNull(), F.struct(guest.alias("range"), F.lit(True).alias("guest")))))
    dealt = whole.select("key", "text", F.xxhash64("text").alias("mark"), F.inline(places))
    walked = dealt.repartition(ranges, "range").sortWithinPartitions(
        "range", "guest", F.col("key").desc_nulls_last(), "mark")
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def row(doc: str, following: str, doc_sketch: np.ndarray, next_sketch: np.ndarray) -> tuple:
        half = len(doc) // 2
        edited = doc[:len(doc) - half] + following[:half]
        edited_sketch = sketch(edited) if edited != doc else doc_sketch
        digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
        return (len(doc), digest, write(doc_sketch), write(edited_sketch), containment(doc_sketch, edited_sketch), containment(doc_sketch, next_sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = first = None  # (range, key, text, sketch) of the document before, of the range's first
        out: list[tuple] = []

        def settle(following: tuple | None) -> None:
            if waiting is not None:
                after = following or first
                out.append((waiting[1], *row(waiting[2], after[2], waiting[3], after[3])))

        def flush() -> pa.RecordBatch:
            made = pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, zip(*out), types)})
            return made.combine_chunks().to_batches()[0]

        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            types[0] = batch.column(0).type
            for k, t, place, is_guest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if waiting is not None and waiting[0] != place:
                    settle(None)
                    waiting = None
                if is_guest and waiting is None:
                    first = (place, k, t or "", None) if first is None or first[0] != place else first
                    continue
                current = (place, k, t or "", sketch(t))
                if is_guest:
                    settle(current)
                    waiting = None
                    continue
                if waiting is None:
                    first = current
                else:
                    settle(current)
                waiting = current
            if out:
                yield flush()
                out.clear()
        settle(None)
        if out:
            yield flush()

    return walked.mapInArrow(run, schema)
