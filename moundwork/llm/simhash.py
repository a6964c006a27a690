"""Near-duplicates by SimHash with meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common point at most half the radius
away from each. So every distinct fingerprint emits all variants within half the radius, equal
variants meet, and pairs that collide are verified by counting bits. For radius 4 that are 2,081
variants a fingerprint.

Variants are dealt out by ``k`` of their 64 bits. Instead of shipping 2,081 variants, a fingerprint
is shipped once to each of the ``1 + k + k(k-1)/2`` shares whose bits it can reach, and the variants
of a share are made where they meet: the same variants in the same places, a hundredth of the bytes.
``k`` grows with the logarithm of the number of fingerprints, so a share keeps its size, and the bits
are those whose ones and zeros are most even, so that a large family of near copies, which agrees in
most bits, is spread by the bits in which it does not. A share too large for memory is halved by
further bits, one half after the other.

All fingerprints that collide in a variant lie within the radius of each other, so linking each to
the smallest keeps every connection without listing all pairs; a share returns a spanning forest of
its verified links. Components are then found by contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundwork.llm.common import boxed, small_batches
from moundwork.llm.components import components
from moundwork.session import written_once

BITS = 64
SEED = 42
ROUTED = 16_000_000  # variants that meet in one share
SHARE = 3_000_000  # about half of what is in memory at once; a larger share is halved
BANDS, BAND_ROWS = 24, 5  # of smallest hashes, for candidates of near-duplicates
PARITY_WORDS = 8  # longs with the parity of a text's shingles in 512 places


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; shorter texts are one run, empty ones none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII gaps
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = (begins + sizes)[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[b:e], seed) for b, e in zip(begins[:n].tolist(), ends)), np.uint64, n)


def _votes(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """The hashes of a further table: table 0 as they are, the others sent through a bit mixer."""
    if not table:
        return hashes
    z = hashes + np.uint64(0x9E3779B97F4A7C15 * table % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, words: int, table: int = 0) -> int:
    """The fingerprint as a signed long; 0 for a text without words."""
    return _votes(_mixed(shingle_hashes(text, words), table))


def fingerprints(docs: DataFrame, words: int = 4, tables: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``mark`` (hash of the text) and ``fp0`` and so on, one per table; null texts count as empty."""
    small_batches(docs.sparkSession)
    names = [f"fp{t}" for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_ in batch.column(1).to_pylist():
                hashes = shingle_hashes(text_, words)
                rows.append([_votes(_mixed(hashes, t)) for t in range(tables)])
            fps = [pa.array(list(c), pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64()) for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *fps], [key, "mark", *names])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select(key, "text", F.xxhash64("text").alias("mark")).mapInArrow(
        run, f"`{key}` {kind}, mark long, " + ", ".join(f"{n} long" for n in names))


def _gather(fps: np.ndarray, places: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for i, place in enumerate(places):
        out |= ((fps >> np.uint64(place)) & np.uint64(1)) << np.uint64(i)
    return out


def _flips(places: list[int], most: int) -> np.ndarray:
    masks = [0]
    for n in range(1, most + 1):
        masks += [sum(1 << p for p in chosen) for chosen in combinations(places, n)]
    return np.array(masks, np.uint64)


def _variants(fps: np.ndarray, fixed: list[int], value: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The variants of ``fps`` whose bits at ``fixed`` spell ``value``, and the index of their fingerprint."""
    free = [p for p in range(BITS) if p not in set(fixed)]
    wrong = _gather(fps, fixed) ^ np.uint64(value)
    away = np.bitwise_count(wrong)
    found, owners = [], []
    for spent in range(half + 1):
        chosen = np.nonzero(away == spent)[0]
        if not len(chosen):
            continue
        moved = fps[chosen].copy()
        for i, place in enumerate(fixed):
            moved ^= ((wrong[chosen] >> np.uint64(i)) & np.uint64(1)) << np.uint64(place)
        masks = _flips(free, half - spent)
        found.append((moved[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(chosen, len(masks)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _collisions(fps: np.ndarray, order: list[int], fixed: int, value: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller, other) indices into the sorted ``fps`` of every variant that several emit."""
    away = np.bitwise_count(_gather(fps, order[:fixed]) ^ np.uint64(value))
    near = np.nonzero(away <= half)[0]
    if len(near) < 2:
        return
    free = BITS - fixed
    sizes = np.array([sum(math.comb(free, n) for n in range(half - spent + 1)) for spent in range(half + 1)])
    if sizes[away[near]].sum() > 2 * SHARE and fixed < BITS:
        for bit in (0, 1):
            for low, high in _collisions(fps[near], order, fixed + 1, value | (bit << fixed), half):
                yield near[low], near[high]
        return
    variants, owners = _variants(fps[near], order[:fixed], value, half)
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    # A bit table of the low bits thins out the variants before the exact look-up.
    width = max(16, int(len(twice)).bit_length() + 3)
    low_bits = np.uint64((1 << width) - 1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    marked = np.zeros(1 << width, bool)
    marked[((twice * mix) >> np.uint64(BITS - width)) & low_bits] = True
    maybe = np.nonzero(marked[((variants * mix) >> np.uint64(BITS - width)) & low_bits])[0]
    at = np.searchsorted(twice, variants[maybe])
    hit = twice[np.minimum(at, len(twice) - 1)] == variants[maybe]
    group, owner = at[hit], owners[maybe[hit]]
    first = np.full(len(twice), len(fps), np.int64)
    np.minimum.at(first, group, owner)
    pairs = np.unique(first[group] * len(near) + owner)
    low, high = pairs // len(near), pairs % len(near)
    differ = low != high
    yield near[low[differ]], near[high[differ]]


def _forest(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """The smallest index each index is connected to."""
    root = np.arange(n)
    while len(low):
        a, b = root[low], root[high]
        open_ = a != b
        low, high, a, b = low[open_], high[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (tab, a, b) that connect exactly the fingerprints of a table connected by steps of at most ``radius`` bits.

    ``fps`` (a written table) holds distinct (``tab``, ``fp``); the few tables are counted first, then joined at once.
    """
    small_batches(fps.sparkSession)
    half = radius // 2
    if radius % 2:
        raise ValueError("an even radius is needed: both sides go half the way")
    ball = sum(math.comb(BITS, i) for i in range(half + 1))
    counts = fps.groupBy("tab").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"bit{i}") for i in range(BITS)])
    orders: dict[int, list[int]] = {}
    fixed: dict[int, int] = {}
    dealt = fps.where("false").select("fp", F.lit(0).cast("long").alias("spot"))
    for found in counts.collect():  # one row per table
        tab, n = found.tab, found.n
        orders[tab] = sorted(range(BITS), key=lambda i: (abs(2 * found[f"bit{i}"] - n), i))
        fixed[tab] = k = min(BITS // 2, max(0, math.ceil(math.log2(n * ball / ROUTED))))
        spelled = F.lit(0).cast("long")
        for i, place in enumerate(orders[tab][:k]):
            spelled = spelled.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", place).bitwiseAND(F.lit(1)), i))
        reach = F.array(*[F.lit(int(m)).cast("long") for m in _flips(list(range(k)), half)])
        own = fps.where(F.col("tab") == tab).select("tab", "fp", spelled.alias("own"))
        spot = F.transform(reach, lambda m: F.col("own").bitwiseXOR(m) + (tab << 40))  # table and share in one number
        dealt = dealt.unionByName(own.select("fp", F.explode(spot).alias("spot")))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        # A group is one share of one table; its fingerprints are 8 bytes each.
        tab, share = divmod(int(key[0].as_py()), 1 << 40)
        own = np.unique(table.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        everyone = np.arange(len(own))
        root, low, high, pending = everyone, [], [], 0

        def settle() -> np.ndarray:
            return _forest(np.concatenate([*low, root]), np.concatenate([*high, everyone]), len(own))

        for a, b in _collisions(own, orders[tab], fixed[tab], share, half):
            good = np.bitwise_count(own[a] ^ own[b]) <= radius
            low.append(a[good])
            high.append(b[good])
            pending += int(good.sum())
            if pending > SHARE:
                root = settle()
                low, high, pending = [], [], 0
        root = settle()
        linked = np.nonzero(root != everyone)[0]
        return pa.table({
            "tab": np.full(len(linked), tab, np.int32), "a": own[root[linked]].view(np.int64), "b": own[linked].view(np.int64)})

    return dealt.groupBy("spot").applyInArrow(meet, "tab int, a long, b long")


def near_groups(prints: DataFrame, radius: int = 4, key: str = "doc_id") -> DataFrame:
    """``fp`` and ``component_id``, the smallest key whose fingerprint is reached, for every distinct ``fp0``.

    ``prints`` should be a written table: it is read more than once. Null keys are represented by
    others of their component, or by null if there is none.
    """
    distinct = written_once(prints.groupBy(F.col("fp0").alias("fp")).agg(F.min(key).alias("least")), "fingerprints")
    links = ball_links(distinct.select(F.lit(0).alias("tab"), "fp"), radius)
    roots = components(links.select("a", "b"))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = written_once(placed.select("fp", "least", "root"), "roots")
    linked = placed.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    alone = placed.where("root is null").select("fp", F.col("least").alias("component_id"))
    return written_once(joined.unionByName(alone), "components")


def band_keys(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``mark`` (hash of the text) and ``buckets``: one hash per band of ``BAND_ROWS`` smallest mixed hashes.

    Two texts of similarity ``s`` share a bucket with probability ``1 - (1 - s ** BAND_ROWS) ** BANDS``:
    all but 7 in 100,000 of those at 0.8.
    """
    small_batches(docs.sparkSession)
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    size = 8 * BAND_ROWS

    def buckets_of(text_: str) -> list[int]:
        hashes = shingle_hashes(text_, words)
        low = np.full(len(factors), (1 << 64) - 1, np.uint64)
        for at in range(0, len(hashes), 1024):
            mixed = hashes[at:at + 1024, None] * factors
            mixed ^= mixed >> np.uint64(32)
            np.minimum(low, (mixed * factors).min(axis=0), out=low)
        raw = low.tobytes()
        return [xxhash.xxh64_intdigest(raw[size * i:size * (i + 1)], i) for i in range(BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([buckets_of(t) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, BANDS).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(rows), pa.list_(pa.int64()))], [key, "mark", "buckets"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select(key, "text", F.xxhash64("text").alias("mark")).mapInArrow(run, f"`{key}` {kind}, mark long, buckets array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``mark`` and ``shingles``, the distinct hashes of its runs of ``words`` words; one and the same hash for texts without words.

    Further ``bits``: whether the number of shingles at each of 512 places is odd. A shingle that only one of two
    texts has turns one bit, so texts differ in at least as many shingles as bits.
    """
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text_, words)) for text_ in batch.column(1).to_pylist()]
            sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
            odd = [np.bincount((x >> np.uint64(32)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) % 2 for x in sets]
            bits = [np.packbits(o.astype(np.uint8)).view(np.int64) for o in odd]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["mark", "shingles", "bits"])

    return texts.select("mark", "text").mapInArrow(run, "mark long, shingles array<bigint>, bits array<bigint>")


def rare_shingles(sets: DataFrame, least: float) -> DataFrame:
    """``bucket`` and ``mark``: the rarest shingles of every text, as many as decide.

    Further ``bits`` of ``sets``, ``n``, the shingles of the text, ``shared``, those that some other text has, and ``place``, the bucket's place among these.

    Texts that share ``least`` of their shingles have more than ``n - ceil(least * n)`` of each in common, so
    in any one order of all shingles their first ``n - ceil(least * n) + 1`` meet. From rare to common, texts
    that only share a passage meet in none: what sets them apart comes first. Shingles of a single text
    come before all others and meet nothing, so only their number counts.
    """
    rows = sets.select("mark", F.size("shingles").alias("n"), F.explode("shingles").alias("bucket"))
    often = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    own = Window.partitionBy("mark")
    ranked = rows.join(often, "bucket").withColumns({
        "place": F.row_number().over(own.orderBy("times", "bucket")), "shared": F.count(F.lit(1)).over(own)})
    decisive = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    rare = ranked.where(F.col("place") <= decisive - (F.col("n") - F.col("shared")))
    return rare.join(sets.select("mark", "bits"), "mark").select("bucket", "mark", "n", "shared", "place", "bits")


def ball_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of marks that ball hashing proposes: texts of one fingerprint and of linked ones, by one text each.

    ``prints`` (a written table) are ``fingerprints``. Pairs are as many as texts at most, however large a family is.
    """
    marks = written_once(prints.select("mark", F.col("fp0").alias("fp")).distinct(), "marks")
    first = written_once(marks.groupBy("fp").agg(F.min("mark").alias("first")), "fingerprints")
    links = ball_links(first.select(F.lit(0).alias("tab"), "fp"))
    ends = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(
        first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    same = marks.join(first, "fp").where("mark <> first").select(F.col("first").alias("x"), F.col("mark").alias("y"))
    return ends.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of marks whose sets of shingles have at least ``least`` in common (Jaccard)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x, y = one.values.to_numpy(), other.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(sets.select(F.col("mark").alias("a"), F.col("shingles").alias("one")), "a")
    joined = joined.join(sets.select(F.col("mark").alias("b"), F.col("shingles").alias("other")), "b")
    return joined.select("a", "b", "one", "other").mapInArrow(run, "a long, b long")


def verified_roots(members: DataFrame, sets: DataFrame, least: float, proposed: DataFrame | None = None) -> DataFrame | None:
    """``node`` and ``root`` of all marks with a similar one; None if there are none.

    The ``proposed`` pairs (a written table) are verified first, so that families they connect need no comparisons.
    ``members`` are ``rare_shingles`` of ``sets``. In every round some members of a bucket lead it: they
    are compared with all others of the bucket that are not yet in their component, and then leave it.
    Pairs that cannot reach ``least`` are left out: both follow one order, so they share at most as many
    shingles up to the bucket as the one has that has fewer there, and behind it likewise; shingles of a
    single text never count, so members of a crowd that each have some of their own drop out. Nor can they if their
    parity bits differ in more places than the shingles of texts at ``least`` may. A bucket is
    done once the rest is one component, so a family of near copies takes one comparison a copy, and in
    the end every pair of a bucket has been compared or is connected. Leaders quadruple from round to round.
    """
    links: list[DataFrame] = []
    tested: list[DataFrame] = []
    roots, lead = None, 1
    own = ("bucket", "mark", "n", "shared", "place", "bits")
    if proposed is not None:
        tested.append(proposed)
        links.append(written_once(similar_pairs(proposed, sets, least), "similar"))
        roots = components(links[0])
    while True:
        live = members.withColumn("root", F.col("mark")) if roots is None else members.join(
            roots.withColumnRenamed("node", "mark"), "mark", "left").select(*own, F.coalesce("root", "mark").alias("root"))
        crowded = live.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("all"), F.min("mark").alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
        chance = F.pmod(F.xxhash64("mark", F.lit(lead)), F.lit(1 << 30)) * F.col("all") < (lead - 1) * (1 << 30)
        live = written_once(live.join(crowded.where("low < high").select("bucket", "all", "first"), "bucket").select(
            *own, "root", ((F.col("mark") == F.col("first")) | chance).alias("leads")), "buckets")
        if live.isEmpty():
            return roots
        leaders = live.where("leads").select("bucket", F.col("mark").alias("leader"), F.col("root").alias("its"), *[
            F.col(c).alias(f"its_{c}") for c in ("n", "shared", "place", "bits")])
        most = F.least("place", "its_place") + F.least(F.col("shared") - F.col("place"), F.col("its_shared") - F.col("its_place"))
        enough = most * (1 + least) >= (F.col("n") + F.col("its_n")) * least - 1e-6
        apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("its_bits")[i])) for i in range(PARITY_WORDS)), F.lit(0))
        enough = enough & (apart * (1 + least) <= (F.col("n") + F.col("its_n")) * (1 - least) + 1e-6)
        pairs = live.join(leaders, "bucket").where((F.col("root") != F.col("its")) & enough).select(
            F.least("mark", "leader").alias("a"), F.greatest("mark", "leader").alias("b")).distinct()
        for earlier in tested:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        tested.append(written_once(pairs, "pairs"))
        links.append(written_once(similar_pairs(tested[-1], sets, least), "similar"))
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        roots = components(found)
        members = live.where("not leads").select(*own)
        lead *= 4


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row left of every group of near-duplicates: that with the smallest key.

    Groups are the components of pairs that share at least ``least`` of their distinct runs of ``words``
    words. Ball hashing of the fingerprints proposes pairs first. It finds few of the pairs near ``least``, so bands of smallest
    hashes tell which texts have a partner at all, and the rarest shingles of those propose the rest. Exact similarity decides. The row that stays is chosen by
    key and text: of rows equal in both one stays, another text under the same key is a document of its
    own. Rows without a key have nothing to choose by: of those with equal texts one stays.
    """
    keyed = docs.where(F.col(key).isNotNull())
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bands = written_once(band_keys(keyed, words, key, text), "bands")
    texts = bands.groupBy("mark").agg(F.min(key).alias("least"))
    members = bands.select("mark", "buckets").dropDuplicates(["mark"]).select(F.explode("buckets").alias("bucket"), "mark")
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    proposed = written_once(ball_pairs(written_once(fingerprints(keyed, key=key, text=text), "prints")), "ball-pairs")
    open_ = members.join(crowded, "bucket", "left_semi").select("mark")
    for end in ("a", "b"):
        open_ = open_.unionByName(proposed.select(F.col(end).alias("mark")))
    open_ = written_once(open_.distinct(), "open-marks")
    whole_texts = keyed.select(F.xxhash64(whole).alias("mark"), whole.alias("text"))
    sets = written_once(shingle_sets(whole_texts.join(open_, "mark", "left_semi").dropDuplicates(["mark"]), words), "shingle-sets")
    roots = verified_roots(written_once(rare_shingles(sets, least), "rare-shingles"), sets, least, proposed)
    root = F.col("mark")
    if roots is not None:
        texts, root = texts.join(roots.withColumnRenamed("node", "mark"), "mark", "left"), F.coalesce("root", "mark")
    first = F.min(F.struct("least", "mark"))
    keepers = written_once(texts.groupBy(root.alias("root")).agg(first.alias("first")).select(
        F.col("first.least").alias("key"), F.col("first.mark").alias("mark")), "keepers")
    rows = boxed(keyed, key=keyed[key], mark=F.xxhash64(whole))
    kept = rows.join(keepers, ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"]).select("row.*")
    return kept.unionByName(docs.where(F.col(key).isNull()).dropDuplicates([text]))
