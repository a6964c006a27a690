"""Mixing sources to target weights by Pareto order sampling.

A source's target fixes how often its documents are expected in the mix. The whole part is allocated
as certain copies; what remains is an inclusion chance ``p``, and the documents to take once more are
the first of the order of ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` uniform from a hash of the
document (Pareto order sampling: a fixed amount, chances close to ``p``). The amount is counted in
words: documents are taken down the order until the source's words are as near to its target as
whole documents of that order allow; while that is not near, one document from beyond the cut is
added, or one from before it left out, where it closes most of the gap (large sources need none).

An optional ``chance`` column tilts the expected copies of single documents; they stay at most
``MOST``. Built-in column functions only. A document of a null text has no words and is never
taken; null is a source of its own, last in order; repeated rows are documents of their own; an
empty table gives an empty mix. Reruns agree because ``u`` is a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundwork.llm import prefix
from moundwork.llm.common import WORD, boxed
from moundwork.session import written_once

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 42
#: A source this near to its target (as a share of it) needs no closing document; small sources may take a few.
NEAR = 0.002
CLOSINGS = 6


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words, and a fingerprint of the text to tell equal ids apart."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("mark"))


def targets(sized: DataFrame) -> DataFrame:
    """``source``, ``source_size`` and ``target`` words per source.

    Weights repeat over the sources in code point order, null last. Shares are weights times a level;
    the level at which capped sources and shares add up to all words is found by running sums over
    the sources in the order in which they reach their caps. One row per source goes into the two
    windows without a partition; documents never do.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(ranked) - 1) % len(WEIGHTS) + 1)
    totals = totals.select("source", "source_size", weight.alias("weight"), (F.lit(float(MOST)) * F.col("source_size")).alias("cap"))
    full = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capping = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "*", F.sum("source_size").over(full).alias("words"), F.sum("weight").over(full).alias("weights"),
        F.coalesce(F.sum("cap").over(capping), F.lit(0.0)).alias("capped"),
        F.coalesce(F.sum("weight").over(capping), F.lit(0.0)).alias("capped_weight"))
    level = (F.col("words") - F.col("capped")) / (F.col("weights") - F.col("capped_weight"))
    # The sources before this one are capped, it and those after are not: the first such level holds.
    before = before.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    whole = capping.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = before.withColumn("level", F.first("level", ignorenulls=True).over(whole))
    share = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return before.select("source", "source_size", share.alias("target"))


def _chances(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    named = plan.select(F.col("source").alias("of"), "source_size", "target")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = rows.withColumn("copies", copies)
    if "chance" in sized.columns:
        rows = rows.withColumn("copies", F.least(F.lit(float(MOST)), F.col("copies") * F.col("chance")))
    rows = rows.withColumn("sure", F.floor("copies")).withColumn("p", F.col("copies") - F.col("sure"))
    u = prefix.unit("doc_id", "mark", seed=seed)
    odds = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    # Scaled by the source's own chance and mapped to [0, 1), odds keep their order and fill the range
    # evenly (without tilted chances the place is u itself): an even base for the slices.
    usual = F.least(F.lit(float(MOST)), F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    usual = usual - F.floor(usual)
    scaled = odds * F.when(usual > 0, usual / (1 - usual)).otherwise(1.0)
    return rows.withColumn("place", F.when(odds.isNull(), u).otherwise(scaled / (1 + scaled)))


def _close(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per source, take or leave the one document that brings its words nearest to the target."""
    of_source = F.col("source").eqNullSafe(F.col("of"))
    change = F.when(F.col("drawn"), -F.col("size")).otherwise(F.col("size"))
    best = rows.where((F.col("p") > 0) & (F.col("size") > 0)).join(gaps, of_source).select(
        "of", "doc_id", "mark", "place", F.abs(F.col("gap") - change).alias("left"), F.abs("gap").alias("now"))
    best = best.where("left < now").groupBy("of").agg(F.min(F.struct("left", "place", "doc_id", "mark")).alias("best"))
    best = written_once(best, "mix-closing")
    chosen = F.col("best").isNotNull() & F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & F.col("best.mark").eqNullSafe(F.col("mark"))
    joined = rows.join(best, of_source, "left")
    return joined.withColumn("drawn", F.when(chosen, ~F.col("drawn")).otherwise(F.col("drawn"))).drop("of", "best")


def mix(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized`` (a written table, read several times) with ``source_size``, ``target``, ``times`` and ``taken``.

    A source with any share of all rows is walked in slices of the order, each a task of its own.
    """
    plan = written_once(targets(sized), "mix-targets")
    slices = prefix.slices_for(sized.count())
    rows = _chances(sized, plan, seed).withColumn("part", prefix.slice_of(F.col("place"), slices))
    sure = rows.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("sure_words"))
    sure = written_once(sure.select(F.col("source").alias("of"), "sure_words"), "mix-sure")
    order = [F.col("place"), F.col("doc_id"), F.col("mark")]
    rows = prefix.running(rows, "source", "part", order, "size", "before")
    rows = rows.join(sure, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    wanted = F.col("target") - F.col("sure_words")
    # Half of a document must fit before the cut: the cut is then the nearest one of the order.
    drawn = (F.col("before") + F.col("size") / 2 <= wanted) & (F.col("p") > 0)
    rows = written_once(rows.withColumn("drawn", drawn), "mix-drawn")
    for _ in range(CLOSINGS):
        gaps = rows.groupBy("source", "target", "sure_words").agg(F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("drawn_words"))
        gaps = written_once(gaps.select(
            F.col("source").alias("of"), "target", (F.col("target") - F.col("sure_words") - F.col("drawn_words")).alias("gap")), "mix-gaps")
        if gaps.where(F.abs("gap") > NEAR * F.col("target")).isEmpty():
            break
        rows = written_once(_close(rows, gaps.drop("target")), "mix-drawn")
    extra = F.col("drawn").cast("long")
    times = F.col("sure") + F.when(F.col("p") > 0, extra).otherwise(0)
    return rows.withColumn("times", times.cast("long")).select(
        "doc_id", "source", "mark", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as many rows as it is taken times, with their own columns."""
    taken = mix(written_once(sizes(docs), "mix-sizes"), seed)
    times = written_once(taken.where("times > 0").groupBy("doc_id", "mark").agg(F.max("times").alias("times")), "mix-times")
    times = times.select(F.col("doc_id").alias("of"), F.col("mark").alias("by"), "times")
    rows = boxed(docs, key=docs["doc_id"], mark=F.xxhash64(docs["text"]))
    same = F.col("key").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("by"))
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")
    return rows.join(times, same).select("row", copies).select("row.*")
