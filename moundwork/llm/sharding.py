"""Shards of near equal size that keep linked documents together: balanced label propagation.

Documents with equal texts are linked (all members of a group are neighbours). They start in random
shards. In a round every group looks where most of its members are among the shards with room (a
group larger than a shard at as many shards as it fills), and the members elsewhere that see fewer
of their own ask to move there. A shard admits moves, group after group in
a random but fixed order, until its quota of bytes is used up; the others ask again in the next
round, when the group may see another shard with room. A group larger than a shard thus fills a few
shards instead of being spread over all. Documents without equals cannot be cut off from anything;
they are poured into what room is left, large ones first, so that
the sizes of shards differ by about one small document.

The number of shards is a small constant; their loads and room are the only values that pass through
the driver. Groups meet by joins on their hash that Spark may split; sums combine before shuffles.

Null texts have no equals. Repeated rows are documents of equal text. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundwork.llm import prefix
from moundwork.session import written_once

SHARDS = 24
ROUNDS = 8
#: Rounds in which only groups that fit easily move, before large ones fill whole shards.
SMALL_FIRST = 2
SEED = 42
QUOTA_SLICES = 4096
#: A group above this share of a shard's bytes is admitted document by document.
LARGE = 1 / 64


def nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 8), ``crc`` and ``g``, a 128-bit hash of the text."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    return docs.select(
        F.col(key).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        F.substring(F.sha2(text, 256), 1, 32).alias("g"))


def _random_shard(shards: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "crc", F.lit(seed)), F.lit(shards)).cast("int")


def _per_shard(values: list[float], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), shard + 1)


def _loads(placed: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.sum("size")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _round(linked: DataFrame, room: list[float], quota: float, seed: int, large: bool) -> DataFrame:
    """One round of moves; ``linked`` gets new ``shard`` values and ``moved``."""
    votes = linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    rank = F.struct("n", F.xxhash64("g", "shard").alias("tie"), "shard")
    open_ = _per_shard(room, F.col("shard")) > 0
    wish = votes.groupBy("g").agg(  # lists of at most one entry per shard
        F.sort_array(F.collect_list(F.when(open_, rank)), asc=False).alias("tops"), F.sum("bytes").alias("group_bytes"),
        F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held"))
    asks = (F.size("tops") > 0) & (F.size("held") > 1)
    if not large:
        asks = asks & (F.col("group_bytes") <= quota * LARGE)
    wish = wish.where(asks).select(
        F.col("g").alias("of"), F.slice("tops", F.lit(1), F.ceil(F.col("group_bytes") / max(1.0, quota)).cast("int")).alias("tops"), "group_bytes", "held")
    wish = written_once(wish, "shard-wish")
    own = F.struct(F.element_at("held", F.col("shard")).alias("n"), F.xxhash64("g", "shard").alias("tie"), "shard")
    chosen = F.get("tops", F.pmod(F.xxhash64("doc_id", "crc", F.lit(seed)), F.size("tops")).cast("int"))
    settled = F.exists("tops", lambda t: t["shard"] == F.col("shard")) | (F.col("own.n") > F.col("chosen.n"))
    together = prefix.unit("g", seed=seed)
    alone = prefix.unit("g", "doc_id", seed=seed)
    asked = linked.join(wish, F.col("g") == F.col("of"), "left").withColumn("own", own).withColumn("chosen", chosen).select(
        "doc_id", "size", "crc", "g", "shard", F.when(~settled, F.col("chosen.shard")).alias("to"),
        prefix.slice_of(F.when(F.col("group_bytes") > quota * LARGE, alone).otherwise(together), QUOTA_SLICES).alias("part"))
    asked = written_once(asked, "shard-asked")
    sums = asked.where("to is not null").groupBy("to", "part").agg(F.sum("size").alias("bytes"))
    upto = F.sum("bytes").over(Window.partitionBy("to").orderBy("part"))
    admitted = sums.withColumn("upto", upto).where(F.col("upto") <= _per_shard(room, F.col("to")))
    admitted = written_once(admitted.select(F.col("to").alias("into"), F.col("part").alias("slice")), "shard-admitted")
    joined = asked.join(admitted, (F.col("to") == F.col("into")) & (F.col("part") == F.col("slice")), "left")
    moves = F.col("into").isNotNull()
    return joined.select("doc_id", "size", "crc", "g", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard"), moves.alias("moved"))


def propagate(linked: DataFrame, quota: float, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Shards of linked documents after the rounds; no round lifts a shard above ``quota`` bytes."""
    placed = written_once(linked.withColumn("shard", _random_shard(shards, seed)), "shard-linked")
    for n in range(rounds):
        room = [quota - load for load in _loads(placed, shards)]
        after = written_once(_round(placed, room, quota, seed, n >= SMALL_FIRST), "shard-linked")
        moved = after.where("moved").limit(1).count()
        placed = after.drop("moved")
        if not moved and n >= SMALL_FIRST:
            break
    return placed


def _pour(free: DataFrame, room: list[float], share: float, seed: int) -> DataFrame:
    """Free documents into ``share`` of the room of the shards, one shard after the other along a random order."""
    slices = prefix.slices_for(free.count())
    place = prefix.unit("doc_id", "crc", seed=seed)
    lined = free.withColumn("place", place).withColumn("part", prefix.slice_of(F.col("place"), slices)).withColumn("line", F.lit(0))
    walked = prefix.running(lined, "line", "part", [F.col("place"), F.col("doc_id"), F.col("crc")], "size", "before")
    edges, at = [], 0.0
    for space in room:
        at += max(0.0, space) * share
        edges.append(at)
    middle = F.col("before") + F.col("size") / 2
    shard = sum((F.when(middle >= edge, 1).otherwise(0) for edge in edges[:-1]), F.lit(0))
    return walked.select("doc_id", "size", "crc", "g", shard.cast("int").alias("shard"))


def pour(free: DataFrame, room: list[float], seed: int) -> DataFrame:
    """Free documents into the room, large ones first: the small ones then even out what those left."""
    n, total = free.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = total / max(1, n)
    size, out = F.col("size"), None
    for tier in (size > 4 * mean, (size > mean) & (size <= 4 * mean), size <= mean):
        some = written_once(free.where(tier), "shard-free")
        held = some.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        poured = written_once(_pour(some, room, held / total if total else 1.0, seed), "shard-poured")
        room = [space - load for space, load in zip(room, _loads(poured, len(room)))]
        total -= held
        out = poured if out is None else out.unionByName(poured)
    return out


def assign(parts: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``parts`` (a written table of ``nodes``) with ``shard``."""
    total, n = parts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    quota = total / shards
    counts = parts.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written_once(counts.select(F.col("g").alias("of")), "shard-groups")
    marked = written_once(parts.join(groups, F.col("g") == F.col("of"), "left").withColumn("linked", F.col("of").isNotNull()).drop("of"), "shard-marked")
    columns = ("doc_id", "size", "crc", "g")
    placed = propagate(marked.where("linked").select(*columns), quota, shards, rounds, seed)
    loads = _loads(placed, shards)
    free = marked.where("not linked").select(*columns)
    if max(loads) > quota:
        # Random starts may overfill shards where nearly all documents are linked: what lies beyond
        # the quota goes the way of the free ones.
        walk = placed.withColumn("place", prefix.unit("g", seed=seed)).withColumn("part", prefix.slice_of(F.col("place"), prefix.slices_for(n)))
        walk = prefix.running(walk, "shard", "part", [F.col("place"), F.col("doc_id"), F.col("crc")], "size", "before")
        split = written_once(walk.withColumn("fits", F.col("before") + F.col("size") <= quota).select(*columns, "shard", "fits"), "shard-fits")
        placed = split.where("fits").drop("fits")
        free = free.unionByName(split.where("not fits").select(*columns))
        loads = _loads(placed, shards)
    poured = pour(free, [quota - load for load in loads], seed)
    return placed.select(*columns, "shard").unionByName(poured)


def with_slots(placed: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard."""
    placed = written_once(placed, "shard-placed")
    place = prefix.unit("doc_id", "crc", seed=seed + 1)
    slices = prefix.slices_for(placed.count() // shards)
    lined = placed.withColumn("place", place).withColumn("part", prefix.slice_of(F.col("place"), slices)).withColumn("one", F.lit(1).cast("long"))
    return prefix.running(lined, "shard", "part", [F.col("place"), F.col("doc_id"), F.col("crc")], "one", "slot").drop("place", "part", "one")
