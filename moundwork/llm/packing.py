"""Packing token pieces into sequences: first-fit decreasing in randomised groups.

Every document is tokenised, closed with an end id and cut into whole sequences plus a rest. Pieces
are spread at random (by a hash of document, place, row and seed) over groups of about ``GROUP`` pieces;
each group is packed on its own by first-fit decreasing, with a tournament tree of bin capacities
that finds the first bin with room in logarithmic time. Since cutting is free, the emptiest bins of a
group are then dissolved into the gaps of the others, so that all gaps of a group together are less
than one sequence.

Null and empty texts are documents of one end id. Repeated rows are packed as often as they come and
spread over the groups like others. A very long text spreads over the groups piece by piece. An empty
table gives no pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundwork.llm.common import small_batches
from moundwork.llm.tokens import words_of

LENGTH = 1024
END = 0
GROUP = 8_192
SEED = 42


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit) and ``doc_tokens`` of every piece.

    Further ``place``, the number of its document's row in the task that read it.
    """
    small_batches(docs.sparkSession)
    closing = np.array([end], "<u4").tobytes()
    names = [key, "start", "length", "ids", "doc_tokens", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            keys, rows = batch.column(0), []
            for i, ids in enumerate(words_of(tokenizer).encode(batch.column(1).to_pylist())):
                ids += closing
                total = len(ids) // 4
                rows += [(i, at, min(length, total - at), ids[4 * at:4 * (at + length)], total) for at in range(0, total, length)]
            if not rows:
                continue
            place, start, size, data, total = zip(*rows)
            places = np.array(place, np.int64) + seen
            seen += len(keys)
            yield pa.RecordBatch.from_arrays([
                keys.take(pa.array(place)), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                pa.array(data, pa.binary()), pa.array(total, pa.int64()), pa.array(places)], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(
        run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, place long")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every item; items are taken from large to small, ties in the given order."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # an inner node holds the larger capacity of its two children
    bins = [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item] = node - leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left > right else right
    return bins


def pack_group(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, offset in the item, size, bin, offset in the bin), in as few bins as the sum of sizes allows."""
    bins = first_fit_decreasing(sizes, capacity)
    used = max(bins, default=-1) + 1
    held: list[list[int]] = [[] for _ in range(used)]
    room = [capacity] * used
    for item, b in enumerate(bins):
        held[b].append(item)
        room[b] -= sizes[item]
    needed = math.ceil(sum(sizes) / capacity)
    by_room = sorted(range(used), key=lambda b: (room[b], b))
    stay, dissolve = by_room[:needed], by_room[needed:]
    number = {b: i for i, b in enumerate(stay)}
    placed, fill = [], [0] * needed
    for b in stay:
        for item in held[b]:
            placed.append((item, 0, sizes[item], number[b], fill[number[b]]))
            fill[number[b]] += sizes[item]
    gap = 0
    for b in dissolve:
        for item in held[b]:
            at = 0
            while at < sizes[item]:
                while fill[gap] == capacity:
                    gap += 1
                part = min(sizes[item] - at, capacity - fill[gap])
                placed.append((item, at, part, gap, fill[gap]))
                fill[gap] += part
                at += part
    return placed


def pack(parts: DataFrame, n_groups: int, length: int = LENGTH, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The pieces, cut further where that fills a gap, with ``sequence_id`` and ``offset``."""
    small_batches(parts.sparkSession)
    group = F.pmod(F.xxhash64(key, "start", "doc_tokens", "place", F.crc32("ids"), F.lit(seed)), F.lit(n_groups))
    kind = parts.schema[key].dataType.simpleString()

    def run(group_key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(key, "ascending"), ("start", "ascending"), ("doc_tokens", "ascending")])
        placed = pack_group(table.column("length").to_pylist(), length)
        item, skip, size, number, offset = (np.array(x, np.int64) for x in zip(*placed))
        ids = table.column("ids").combine_chunks()
        data = ids.take(pa.array(item))
        if skip.any() or (size != np.array(table.column("length"))[item]).any():
            data = pa.array([v.as_py()[4 * s:4 * (s + n)] for v, s, n in zip(data, skip.tolist(), size.tolist())], pa.binary())
        base = int(group_key[0].as_py()) << 32
        return pa.table({
            key: table.column(key).take(pa.array(item)), "start": np.array(table.column("start"))[item] + skip, "length": size,
            "ids": data, "doc_tokens": np.array(table.column("doc_tokens"))[item], "sequence_id": base + number, "offset": offset})

    return parts.withColumn("group", group).groupBy("group").applyInArrow(
        run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise, cut and pack. ``docs`` is a stored table: its rows are read twice and their places steer the groups.

    The number of groups follows a bound on the number of pieces: a token is at least one byte, so a
    document has at most ``bytes / length + 1`` pieces. No group has more than about ``group`` pieces,
    however long the documents are.
    """
    bound = F.floor(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) / length) + 1
    most = docs.agg(F.sum(bound).alias("n")).first()["n"] or 0
    return pack(pieces(docs, tokenizer, length, end, key, text), max(1, math.ceil(most / group)), length, key)
