"""Exact nearest neighbours among rows, and minority rows made between neighbours.

Points are dealt to cells by a tree of splits, each at the middle of the widest feature of a sample, so all
features narrow the search. A cell searches itself first, block against block: the k-th neighbour found there
bounds what other cells can add. A point then visits the cells whose box comes within that bound, and the
lists are merged. Boxes are those of all points and distances are summed in the same order of features, so rounding
cannot put a box farther than a point in it. The sample and the sizes steer cost only: neighbours are exact.
Rows equal in all features are one point with a few of their keys, so copies add no comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundwork.operators.labels import hash_order
from moundwork.session import written_once

ROWS_A_CELL, MOST_CELLS, SAMPLED_A_CELL = 4096, 2048, 16
ROWS_A_BLOCK = 64
VISITORS_A_SHARE = 65536
APART = "merge"  # join by sorting on the executors: the tables compress so well that their size on disk would send them through the driver


def scaled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``point``: every feature between 0 (least) and 1 (most); missing values count as 0 before, constant features are 0."""
    value = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    ends = rows.agg(F.array(*[F.struct(F.min(v).alias("low"), F.max(v).alias("high")) for v in value.values()]).alias("ends"))
    wide = rows.crossJoin(F.broadcast(ends))  # one row
    return wide.withColumn("point", F.array(*[
        F.coalesce((v - F.col("ends")[i]["low"]) / F.nullif(F.col("ends")[i]["high"] - F.col("ends")[i]["low"], F.lit(0.0)), F.lit(0.0))
        for i, v in enumerate(value.values())])).drop("ends")


class Splits:
    """A tree of splits. Node ``i`` has children ``2 i + 1`` and ``2 i + 2``; the leaves, all on one level, are the cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = math.ceil(math.log2(cells))
        self.inner = 2**self.depth - 1
        self.axis, self.at = np.zeros(self.inner, np.int64), np.zeros(self.inner)
        held = {0: sample}
        for node in range(self.inner):
            own = held.pop(node)
            if len(own):
                self.axis[node] = a = np.argmax(own.max(0) - own.min(0))
                self.at[node] = np.partition(own[:, a], (len(own) - 1) // 2)[(len(own) - 1) // 2]
            right = own[:, self.axis[node]] > self.at[node]
            held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - self.inner

    def boxed(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Takes the boxes of the cells that hold points; those of inner nodes follow from them."""
        n = 2 * self.inner + 1
        self.low, self.high = np.full((n, low.shape[1]), np.inf), np.full((n, low.shape[1]), -np.inf)
        self.low[self.inner + cells], self.high[self.inner + cells] = low, high
        for node in range(self.inner - 1, -1, -1):
            two = slice(2 * node + 1, 2 * node + 3)
            self.low[node], self.high[node] = self.low[two].min(0), self.high[two].max(0)

    def near(self, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point's place (ascending) and a cell with points whose box is within the point's bound."""
        place, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level in range(self.depth + 1):
            if level:
                place, node = np.repeat(place, 2), (2 * node[:, None] + (1, 2)).ravel()
            held = np.isfinite(self.low[node, 0])
            place, node = place[held], node[held]
            own = points[place]
            good = _to_boxes(own, own, self.low[node], self.high[node]) <= bound[place]
            place, node = place[good], node[good]
        return place, node - self.inner


def _to_boxes(low: np.ndarray, high: np.ndarray, box_low: np.ndarray, box_high: np.ndarray) -> np.ndarray:
    """Squared distances between boxes, row by row."""
    total = None
    for a in range(box_low.shape[1]):
        gap = np.maximum(np.maximum(box_low[:, a] - high[..., a], low[..., a] - box_high[:, a]), 0.0)
        total = gap * gap if total is None else total + gap * gap
    return total


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, summed feature by feature."""
    total = None
    for i in range(a.shape[1]):
        step = a[:, i, None] - b[None, :, i]
        step *= step
        total = step if total is None else np.add(total, step, out=total)
    return total


def _blocks(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of points in compact blocks of at most ``size``, each more than half full if there are that many points."""
    out, open_ = [], [np.arange(len(points))]
    while open_:
        own = open_.pop()
        if len(own) <= size:
            out.append(own)
            continue
        held = points[own]
        middle = len(own) // 2
        order = np.argpartition(held[:, np.argmax(held.max(0) - held.min(0))], middle)
        open_ += [own[order[middle:]], own[order[:middle]]]
    return out


def _searched(points: np.ndarray, asked: np.ndarray, bound: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``asked`` (ascending) and in ``points`` and the distances of at most ``k`` nearest points that are within ``bound``.

    Ties go to the smaller place. Without ``bound``, ``asked`` are the points.
    """
    size = max(ROWS_A_BLOCK, 2 * k)
    held = _blocks(points, size)
    low, high = np.array([points[b].min(0) for b in held]), np.array([points[b].max(0) for b in held])
    found = []
    for own in held if bound is None else _blocks(asked, size):
        here = asked[own]
        if bound is not None:
            most = bound[own]
        elif len(own) < k:
            most = np.full(len(own), np.inf)
        else:
            most = np.partition(_squares(here, here), k - 1, axis=1)[:, k - 1]
        chosen = np.flatnonzero(_to_boxes(here.min(0), here.max(0), low, high) <= most.max())
        if not len(chosen):
            continue
        others = np.sort(np.concatenate([held[b] for b in chosen]))
        d2 = _squares(here, points[others])
        if len(others) > k:
            most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1])
        row, column = np.nonzero(d2 <= most[:, None])
        d2 = d2[row, column]
        order = np.lexsort((column, d2, row))
        row, column, d2 = row[order], column[order], d2[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < k
        found.append((own[row[kept]], others[column[kept]], d2[kept]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    place, other, d2 = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(place, kind="stable")
    return place[order], other[order], d2[order]


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, n)


def _lists(place: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """``values`` as one list for each of ``n`` places."""
    return pa.ListArray.from_arrays(np.searchsorted(place, np.arange(n + 1)).astype(np.int32), values)


def _near(points: pa.Table, other: np.ndarray, d2: np.ndarray) -> pa.Array:
    members = points.column("members").combine_chunks().take(pa.array(other))
    return pa.StructArray.from_arrays([pa.array(d2), members], ["d2", "members"])


def _nearest_points(points: DataFrame, k: int, n: int) -> DataFrame:
    """``id`` and ``near``: the ``k`` nearest points of every point, itself among them, as ``d2`` and ``members``, ties by first member."""
    count = points.count()
    cells = min(MOST_CELLS, max(1, count // ROWS_A_CELL))
    wanted = cells * SAMPLED_A_CELL
    sample = points if count <= 2 * wanted else points.sample(wanted / count, seed=1)
    splits = Splits(_matrix(sample.select("point").toArrow().column(0), n), cells)
    members = points.schema["members"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = splits.cell(batch.column("point").flatten().to_numpy().reshape(-1, n))
            yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    placed = written_once(points.mapInArrow(place, f"id bigint, point array<double>, members {members}, cell int"), "cell-points")
    ends = [f(F.col("point")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(n)]
    boxes = placed.groupBy("cell").agg(*ends).toArrow()  # a row a cell
    low, high = (np.stack([boxes.column(f"{name}{i}").to_numpy() for i in range(n)], 1) for name in ("low", "high"))
    splits.boxed(boxes.column("cell").to_numpy(), low, high)

    def own(table: pa.Table) -> pa.Table:
        at = _matrix(table.column("point"), n)
        place, other, d2 = _searched(at, at, None, k)
        ends = np.searchsorted(place, np.arange(len(at)), "right")
        full = ends - np.searchsorted(place, np.arange(len(at))) == k
        bound = np.where(full, d2[ends - 1], np.inf)
        asker, cell = splits.near(at, bound)
        away = cell != table.column("cell")[0].as_py()
        return pa.table({
            "id": table.column("id"), "point": table.column("point"), "bound": bound,
            "near": _lists(place, len(at), _near(table, other, d2)), "visits": _lists(asker[away], len(at), pa.array(cell[away].astype(np.int32)))})

    def visited(table: pa.Table) -> pa.Table:
        here = table.column("bound").is_null().combine_chunks().to_numpy(zero_copy_only=False)
        points, asked = table.filter(pa.array(here)), table.filter(pa.array(~here))
        place, other, d2 = _searched(_matrix(points.column("point"), n), _matrix(asked.column("point"), n), asked.column("bound").to_numpy(), k)
        hit = np.unique(place)
        return pa.table({"id": asked.column("id").take(pa.array(hit)), "near": _lists(np.searchsorted(hit, place), len(hit), _near(points, other, d2))})

    def ordered(rows: DataFrame, *by: str) -> DataFrame:
        """Cells whose points come in the order of their first members, which settles ties. The work follows the cells, not their bytes."""
        return rows.repartition(math.ceil(cells / 2), *by).sortWithinPartitions(*by, F.col("members")[0])

    near = f"array<struct<d2: double, members: {members}>>"
    searched = written_once(ordered(placed, "cell").groupBy("cell").applyInArrow(
        own, f"id bigint, point array<double>, bound double, near {near}, visits array<int>"), "neighbours")
    calls = searched.select("id", "point", "bound", F.explode("visits").alias("cell"))
    shares = calls.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS_A_SHARE).cast("int").alias("shares"))  # a row a cell
    called = calls.join(F.broadcast(shares), "cell").select(
        "id", "point", "bound", F.lit(None).cast(members).alias("members"), "cell", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))
    homes = placed.join(F.broadcast(shares), "cell").select(
        "id", "point", F.lit(None).cast("double").alias("bound"), "members", "cell", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"))
    met = ordered(called.unionByName(homes), "cell", "share").groupBy("cell", "share").applyInArrow(visited, f"id bigint, near {near}")
    more = written_once(met, "neighbours-met").groupBy("id").agg(F.flatten(F.collect_list("near")).alias("more"))
    every = F.concat("near", F.coalesce("more", F.array().cast(near)))
    return searched.select("id", "near").join(more.hint(APART), "id", "left").select("id", F.slice(F.sort_array(every), 1, k).alias("near"))


def _first(points: DataFrame, k: int) -> DataFrame:
    """One row, ``least``: the ``k`` points with the smallest first members, at the distance to and from a point that is not a number."""
    least = points.orderBy(F.col("members")[0]).limit(k)
    return F.broadcast(least.agg(F.sort_array(F.collect_list(F.struct(F.lit(float("nan")).alias("d2"), "members"))).alias("least")))


def _near_lists(rows: DataFrame, keys: Sequence[str], features: Sequence[str], k: int) -> DataFrame:
    """``key`` and ``near``: the ``k`` nearest other rows of every row as ``d2`` and ``neighbour``."""
    own = F.struct(*keys)
    base = written_once(scaled(rows, features).select(own.alias("key"), "point"), "scaled-rows")
    member = Window.partitionBy("point").orderBy("key")
    few = base.withColumn("place", F.row_number().over(member)).where(F.col("place") <= k + 1)
    points = few.groupBy("point").agg(F.sort_array(F.collect_list("key")).alias("members"))  # k + 1 keys at most
    points = written_once(points.select(F.monotonically_increasing_id().alias("id"), "point", "members"), "points")
    lost = F.exists("point", F.isnan)
    near = _nearest_points(points.where(~lost), k + 1, len(features))  # a point is its own nearest
    if not points.where(lost).isEmpty():
        far = near.crossJoin(_first(points.where(lost), k + 1)).select("id", F.slice(F.concat("near", "least"), 1, k + 1).alias("near"))
        near = far.unionByName(points.where(lost).crossJoin(_first(points, k + 1)).select("id", F.col("least").alias("near")))
    each = F.flatten(F.transform("near", lambda x: F.transform(x["members"], lambda m: F.struct(x["d2"].alias("d2"), m.alias("neighbour")))))
    lists = near.select("id", F.slice(F.sort_array(each), 1, k + 1).alias("near"))
    owners = base.join(points.select("id", "point").hint(APART), "point").select("key", "id").join(lists.hint(APART), "id")
    return owners.select("key", F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("key")), 1, k).alias("near"))


def nearest_rows(rows: DataFrame, keys: Sequence[str], features: Sequence[str], k: int = 5) -> DataFrame:
    """``keys``, ``rank`` (from 1), ``neighbour`` (a struct of keys) and ``d2`` of the ``k`` nearest other rows.

    Distance is that of the scaled features; ties go to smaller keys. ``keys`` name a row.
    """
    ranked = _near_lists(rows, keys, features, k).select("key", F.posexplode("near").alias("at", "found"))
    return ranked.select(
        *[F.col(f"key.{c}").alias(c) for c in keys], (F.col("at") + 1).alias("rank"), F.col("found.neighbour").alias("neighbour"), F.col("found.d2").alias("d2"))


def smote(
    rows: DataFrame, label: str, keys: Sequence[str], features: Sequence[str], ratio: float = 0.3, k: int = 5, seed: int = 42,
) -> DataFrame:
    """New minority rows until the minority is ``ratio`` of the majority: ``keys``, ``copy``, ``neighbour`` and the features.

    A new row lies between a minority row and one of its ``k`` nearest minority rows; which one, how far, and which
    rows get one more copy than others come from hashes of the keys, so every run makes the same rows.
    """
    minority = written_once(rows.where(F.col(label) == 1).select(
        *keys, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]), "minority")
    wanted = rows.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"),
    ).agg(F.max(F.greatest(F.lit(0.0), F.col("q") * ratio / F.nullif(F.col("p"), F.lit(0)) - 1.0))).scalar()

    def unit(digest: Column, first: int) -> Column:
        return F.conv(F.substring(digest, first, 8), 16, 10).cast("double") / float(1 << 32)

    extra = F.floor("_f") + F.when(unit(hash_order(seed, *keys), 1) < F.col("_f") - F.floor("_f"), 1).otherwise(0)
    copies = minority.withColumn("_f", wanted).withColumn("_extra", extra.cast("int")).select("*", F.explode(F.expr("sequence(1, greatest(1, _extra))")).alias("copy")).where("copy <= _extra")
    ranked = F.transform("near", lambda x, at: F.struct((at + 1).alias("rank"), x["neighbour"].alias("neighbour")))
    near = _near_lists(minority, keys, features, k).where(F.size("near") > 0).select(*[F.col(f"key.{c}").alias(c) for c in keys], ranked.alias("near"))
    lists = near.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))  # k rows
    digest = hash_order(seed, *keys, "copy")
    chosen = copies.join(lists.hint(APART), list(keys)).withColumn("digest", digest).select(
        *keys, *features, "copy", F.get("near", F.floor(unit(F.col("digest"), 1) * F.size("near")).cast("int"))["neighbour"].alias("neighbour"),
        unit(F.col("digest"), 9).alias("_far"))
    other = minority.select(F.struct(*keys).alias("neighbour"), F.struct(*features).alias("there"))
    return chosen.join(other.hint(APART), "neighbour").select(
        *keys, "copy", "neighbour", *[(F.col(f) + F.col("_far") * (F.col(f"there.{f}") - F.col(f))).alias(f) for f in features])
