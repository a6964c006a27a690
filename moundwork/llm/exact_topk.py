"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are documents over signed terms: component ``i`` is the term ``+i`` with its value where that
is positive and ``-i`` with its size where it is negative. The maxima of a block's terms bound the
score of every vector in it: sum the maxima of the query's terms, times the query's weights. Vectors are put in an
order of likeness and cut into ranges of up to ``RANGE`` rows, a range into blocks of ``BLOCK``.
A range is one row of the index table: its vectors in block order (the forward index), the term maxima
of its blocks, and those of the range.

The search has three steps. Every query first searches the range with the highest bound, which
gives a score that its k-th result reaches at least. Then ranges whose bound is below that score
are left out for the query. What is left is searched: blocks in the order of their bounds, scored
through the forward index, until the bounds fall below the k-th score found so far. All queries
of a group walk the blocks together, so a block is one product of matrices. Equal bounds are not
pruned, because ties go to smaller ids; results are exact.

The order comes from centres fitted on at most ``SAMPLE`` vectors; they only steer how tight the bounds are,
every vector is in the index. Cells of the order (a centre and the signs of some projections) have counted sizes:
small neighbours share a range, large cells are split by hash, so a vector that a third of all rows repeat
fills many ranges. Bounds of all ranges are made from chunks of their maxima, ``CHUNK`` ranges each.
On data without any structure, as random directions of the unit sphere, no bound can prune, and the
search is one pass of all queries over all vectors, in blocks.

Components become integers of ``floor(scale * x)``. Products are made in the smallest float that holds all partial
sums exactly (they are bounded by the product of the norms), else in 64-bit integers; results are exact
where scores fit a long. Vectors that are null or hold null or non-finite components, and rows without
an id, take no part; vectors of different lengths are filled up with zeros; an empty vector scores 0.
Rows that share a query's id are its own; queries equal in id and vector are one. An empty table
gives an empty result, other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundwork.llm.common import small_batches
from moundwork.session import written_once

SCALE = 1024
RANGE, BLOCK, GROUP, CHUNK = 2048, 64, 1024, 1024
SAMPLE, CENTRES, SIGNS = 8192, 64, 6
NEVER = -np.iinfo(np.int64).max


def _narrow(rows: np.ndarray) -> bytes:
    """Integers in the fewest of 2, 4 or 8 bytes each."""
    top = int(np.abs(rows).max(initial=0))
    return rows.astype("<i2" if 0 <= top < 1 << 15 else "<i4" if 0 <= top < 1 << 31 else "<i8").tobytes()


def _wide(data: bytes, rows: int, dims: int) -> np.ndarray:
    size = len(data) // (rows * dims) if rows * dims else 8
    return np.frombuffer(data, f"<i{size}").astype(np.int64).reshape(rows, dims)


def scaled(table: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``key``, ``serial`` (tells rows apart), ``dims`` and ``data`` of every vector that takes part."""
    small_batches(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, serials, dims, data = [], [], [], []
            for key_, vector_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                serial += 1
                if any(x is None for x in vector_):
                    continue
                exact = np.array(vector_, np.float64)
                if np.isfinite(exact).all():
                    keys.append(key_)
                    serials.append(serial)
                    dims.append(len(exact))
                    data.append(_narrow(np.floor(scale * exact).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(serials, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())],
                ["key", "serial", "dims", "data"])

    rows = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return rows.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(
        run, "key long, serial long, dims int, data binary")


def _matrix(data: list[bytes], sizes: list[int], dims: int) -> np.ndarray:
    rows = np.zeros((len(data), dims), np.int64)
    for i, (raw, n) in enumerate(zip(data, sizes)):
        if n:
            rows[i, :n] = np.frombuffer(raw, f"<i{len(raw) // n}")
    return rows


def _centres(vectors: DataFrame, n: int, dims: int) -> np.ndarray:
    """Centres of a bounded sample, by a few rounds of nearest-centre means."""
    picked = vectors.where(F.pmod(F.xxhash64("serial"), F.lit(1 << 20)) * F.lit(n) < F.lit(SAMPLE << 20)).select("data", "dims").limit(2 * SAMPLE)
    rows = picked.collect()  # at most 2 * SAMPLE vectors
    sample = _matrix([bytes(r.data) for r in rows], [r.dims for r in rows], dims).astype(np.float64)
    centres = sample[np.random.default_rng(7).permutation(len(sample))[:CENTRES]]
    for _ in range(5):
        nearest = (sample @ centres.T - (centres ** 2).sum(axis=1) / 2).argmax(axis=1)
        for c in np.unique(nearest):
            centres[c] = sample[nearest == c].mean(axis=0)
    return centres


def placed(vectors: DataFrame, n: int, dims: int) -> DataFrame:
    """The vectors with their ``cell``: nearest centre, then the signs of fixed projections; near cells have near numbers."""
    centres = _centres(vectors, n, dims)
    axes = np.random.default_rng(11).normal(size=(dims, SIGNS))
    half = (centres ** 2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(3).to_pylist(), batch.column(2).to_pylist(), dims).astype(np.float64)
            nearest = (rows @ centres.T - half).argmax(axis=1) if len(centres) else np.zeros(len(rows), np.int64)
            signs = (((rows - centres[nearest]) @ axes > 0) << np.arange(SIGNS)).sum(axis=1) if len(centres) else nearest
            cell = pa.array(((nearest << SIGNS) | signs).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], [*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, "key long, serial long, dims int, data binary, cell int")


def _dealt(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """The rows with the ``part`` they belong to: runs of small cells, or shares of a large one, of about ``most`` rows.

    At most ``CENTRES << SIGNS`` cells are counted and broadcast.
    """
    counted = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout, part, held = [], 0, 0
    for cell in sorted(counted):
        shares = max(1, math.ceil(counted[cell] / most))
        if held and (shares > 1 or held + counted[cell] > most):
            part, held = part + 1, 0
        layout.append((cell, part, shares))
        held += counted[cell]
        if shares > 1:
            part, held = part + shares, 0
    table = rows.sparkSession.createDataFrame(layout, "cell int, first int, shares int")
    share = F.pmod(F.xxhash64("serial", F.lit(salt)), F.col("shares")).cast("int")
    return rows.join(F.broadcast(table), "cell").withColumn("part", F.col("first") + share)


def _bisected(rows: np.ndarray, most: int) -> np.ndarray:
    """An order of the rows in which blocks of ``most`` are alike: halved along the widest component."""
    done, stack = [], [np.arange(len(rows))]
    while stack:
        own = stack.pop()
        if len(own) <= most or not rows.shape[1]:
            done.append(own)
            continue
        widest = (rows[own].max(axis=0) - rows[own].min(axis=0)).argmax()
        ordered = own[np.argsort(rows[own, widest], kind="stable")]
        cut = math.ceil(len(own) / most) // 2 * most
        stack += [ordered[cut:], ordered[:cut]]
    return np.concatenate(done)


def _maxima(rows: np.ndarray, size: int) -> np.ndarray:
    """Per block of ``size`` rows the maxima of the terms: of all components, then of all components negated."""
    begins = np.arange(0, len(rows), size)
    return np.concatenate([np.maximum.reduceat(rows, begins), -np.minimum.reduceat(rows, begins)], axis=1)


def build_index(vectors: DataFrame, dims: int) -> DataFrame:
    """One row per range: ``part``, ``n``, ``keys``, ``rows``, ``blocks`` and ``top`` (maxima), all little-endian integers."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("serial")
        rows = _matrix(table.column("data").to_pylist(), table.column("dims").to_pylist(), dims)
        order = _bisected(rows, BLOCK)
        rows, keys = rows[order], table.column("key").to_numpy()[order]
        return pa.table({
            "part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "keys": [keys.astype("<i8").tobytes()],
            "rows": [_narrow(rows)], "blocks": [_narrow(_maxima(rows, BLOCK))], "top": [_maxima(rows, len(rows)).astype("<i8").tobytes()]})

    return written_once(
        _dealt(vectors, RANGE, 1).select("part", "key", "serial", "dims", "data").groupBy("part").applyInArrow(
            run, "part int, n int, keys binary, rows binary, blocks binary, top binary"), "topk-index")


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in the smallest type that holds every partial sum."""
    most = math.sqrt(float((a.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * float((b.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _signed(queries: np.ndarray) -> np.ndarray:
    """Weights of the query's terms, in the order of the maxima."""
    return np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1)


def search_range(queries: np.ndarray, own: np.ndarray, reached: np.ndarray, keys: np.ndarray, rows: np.ndarray, blocks: np.ndarray, k: int, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (each n x k, ``NEVER`` where there are fewer) of every query's best rows of one range.

    ``own`` is the id a query does not find, ``reached`` a score that its k-th result has at least.
    """
    bounds = _exact(_signed(queries), blocks)
    order = np.argsort(-bounds, axis=1, kind="stable")
    scores = np.full((len(queries), k), NEVER)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    for step in range(len(blocks)):
        block = order[:, step]
        floor = np.maximum(scores[:, -1], reached)
        live = np.nonzero(bounds[np.arange(len(queries)), block] >= floor)[0]
        if not len(live):
            break  # the bounds only fall from here on
        for b in np.unique(block[live]):
            who = live[block[live] == b]
            these = slice(b * size, (b + 1) * size)
            got = _exact(queries[who], rows[these])
            got[own[who, None] == keys[None, these]] = NEVER
            fit = got >= floor[who, None]
            some = np.nonzero(fit.any(axis=1) & (got.max(axis=1) > NEVER))[0]
            if not len(some):
                continue
            who = who[some]
            both = np.concatenate([scores[who], np.where(fit[some], got[some], NEVER)], axis=1)
            names = np.concatenate([ids[who], np.broadcast_to(keys[None, these], (len(who), len(keys[these])))], axis=1)
            best = np.lexsort((names, -both), axis=1)[:, :k]
            scores[who] = np.take_along_axis(both, best, axis=1)
            ids[who] = np.take_along_axis(names, best, axis=1)
    return scores, ids


def _groups(queries: DataFrame, dims: int) -> DataFrame:
    """Queries in groups of neighbours: ``grp``, ``n``, ``keys``, ``serials``, ``rows``."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = _matrix(table.column("data").to_pylist(), table.column("dims").to_pylist(), dims)
        return pa.table({
            "grp": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "keys": [table.column("key").to_numpy().astype("<i8").tobytes()],
            "serials": [table.column("serial").to_numpy().astype("<i8").tobytes()], "rows": [_narrow(rows)]})

    dealt = _dealt(queries, GROUP, 2).select("part", "key", "serial", "dims", "data")
    return written_once(dealt.groupBy("part").applyInArrow(
        run, "grp int, n int, keys binary, serials binary, rows binary"), "topk-queries")


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _bounded(groups: DataFrame, index: DataFrame, dims: int, floors: DataFrame | None) -> DataFrame:
    """Pairs (``grp``, ``part``) with the queries that may find something there: ``place``, ``reached`` and ``bound`` of each.

    Without ``floors`` a query goes to the best range of each chunk; else to all ranges whose bound is
    not below its floor, but for the one it has searched already.
    """
    last = index.agg(F.max("part")).first()[0] // CHUNK
    tops = index.groupBy(F.floor(F.col("part") / CHUNK).cast("int").alias("chunk")).agg(
        F.collect_list(F.struct("part", "top")).alias("tops"))  # CHUNK ranges at most
    asked = groups.select("grp", "n", "rows", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("chunk"))
    if floors is None:
        asked = asked.withColumn("floors", F.lit(None).cast("array<struct<place:int,floor:bigint,part:int>>"))
    else:
        asked = asked.join(floors.groupBy("grp").agg(F.collect_list(F.struct("place", "floor", "part")).alias("floors")), "grp")  # GROUP queries
    first = floors is None

    def run(key: tuple, table: pa.Table) -> pa.Table:
        r = table.to_pylist()[0]
        queries = _signed(_wide(r["rows"], r["n"], dims))
        parts = np.array([t["part"] for t in r["tops"]])
        bounds = _exact(queries, np.frombuffer(b"".join(t["top"] for t in r["tops"]), "<i8").reshape(len(parts), 2 * dims))
        reached = np.full(r["n"], NEVER)
        if first:
            keep = bounds.argmax(axis=1)[:, None] == np.arange(len(parts))
        else:
            searched = np.zeros(r["n"], np.int64)
            for f in r["floors"]:
                reached[f["place"]], searched[f["place"]] = f["floor"], f["part"]
            keep = (bounds >= reached[:, None]) & (parts != searched[:, None])
        some = np.nonzero(keep.any(axis=0))[0]
        who = [np.nonzero(keep[:, i])[0] for i in some]
        return pa.table({
            "grp": pa.array([r["grp"]] * len(some), pa.int32()), "part": pa.array(parts[some], pa.int32()),
            "place": pa.array([w.astype(np.int32) for w in who], pa.list_(pa.int32())),
            "reached": pa.array([reached[w] for w in who], pa.list_(pa.int64())),
            "bound": pa.array([bounds[w, i] for w, i in zip(who, some)], pa.list_(pa.int64()))})

    joined = asked.join(tops, "chunk").select("grp", "chunk", "n", "rows", "floors", "tops")
    return joined.groupBy("grp", "chunk").applyInArrow(run, "grp int, part int, place array<int>, reached array<bigint>, bound array<bigint>")


def _searched(pairs: DataFrame, groups: DataFrame, index: DataFrame, dims: int, k: int) -> DataFrame:
    """``grp``, ``place``, ``key``, ``serial``, ``found`` and ``score``: up to ``k`` rows for every query of every pair."""
    asked = groups.select("grp", F.col("n").alias("q_n"), F.col("keys").alias("q_keys"), F.col("serials").alias("q_serials"), F.col("rows").alias("q_rows"))
    joined = pairs.select("grp", "part", F.col("place").alias("who"), "reached").join(asked, "grp").join(index.drop("top"), "part")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        r = table.to_pylist()[0]
        who = np.array(r["who"], np.int64)
        queries = _wide(r["q_rows"], r["q_n"], dims)[who]
        own, serials = np.frombuffer(r["q_keys"], "<i8")[who], np.frombuffer(r["q_serials"], "<i8")[who]
        rows, blocks = _wide(r["rows"], r["n"], dims), _wide(r["blocks"], math.ceil(r["n"] / BLOCK), 2 * dims)
        scores, ids = search_range(queries, own, np.array(r["reached"], np.int64), np.frombuffer(r["keys"], "<i8"), rows, blocks, k, BLOCK)
        at, rank = np.nonzero(scores > NEVER)
        return pa.table({
            "grp": np.full(len(at), r["grp"], np.int32), "place": who[at].astype(np.int32), "key": own[at], "serial": serials[at],
            "found": ids[at, rank], "score": scores[at, rank]})

    return joined.groupBy("grp", "part").applyInArrow(run, "grp int, place int, key long, serial long, found long, score long")


def exact_topk(table: DataFrame, asks: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the ``k`` best rows for every row of which ``asks`` (on ``key``) holds."""
    empty = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = written_once(scaled(table, key, vector, scale), "topk-vectors")
    n, dims = vectors.agg(F.count(F.lit(1)), F.max("dims")).first()
    if not n:
        return empty
    vectors = written_once(placed(vectors, n, dims), "topk-cells")
    queries = vectors.where(asks)
    once = queries.groupBy("key", "data", "dims").agg(F.min("serial").alias("serial")).select("serial")
    groups = _groups(queries.join(once, "serial"), dims)
    if groups.isEmpty():
        return empty
    index = build_index(vectors, dims)

    # First every query's range of the highest bound, for a score that its k-th result reaches at least.
    bounds = _bounded(groups, index, dims, None).select("grp", "part", F.inline(F.arrays_zip("place", "bound")))
    best = written_once(bounds.groupBy("grp", "place").agg(F.max_by("part", F.struct("bound", "part")).alias("part")), "topk-best")
    pairs = best.groupBy("grp", "part").agg(F.collect_list("place").alias("place"))  # GROUP queries at most
    begun = written_once(_searched(
        pairs.withColumn("reached", F.transform("place", lambda p: F.lit(NEVER).cast("long"))), groups, index, dims, k), "topk-first")
    floors = begun.groupBy("grp", "place").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(NEVER).cast("long")).alias("floor"))
    floors = written_once(best.join(floors, ["grp", "place"], "left").select(
        "grp", "place", "part", F.coalesce("floor", F.lit(NEVER).cast("long")).alias("floor")), "topk-floors")
    found = begun.unionByName(_searched(_bounded(groups, index, dims, floors), groups, index, dims, k))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("serial").orderBy(F.desc("score"), "found")))
    return ranked.where(F.col("rank") <= k).select(F.col("key").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")
