"""Quality rules whose cutoffs are certified on labelled documents.

``signals`` measures a text. A rule rejects a document when its signal is above the rule's cutoff.
All rules of a stratum (language) step from mild to strict together along one fixed path of levels.
A level is certified when the exact binomial test rejects "more than ``risk`` of the good documents
that pass the base rules break some rule at this level", so the bound holds for all rules jointly.
The error ``delta`` is split over the strata (Bonferroni); within a stratum the levels are tested
from mild to strict and testing stops at the first that fails (fixed sequence), which needs no
further correction. Of the certified levels the one that catches most bad documents is taken, the
milder on a tie, none if none catches any. At least ``least_labels()`` good labels (90) are needed
before anything can be certified; with fewer the rules stay off in that stratum.

Built-in column functions only. A null text counts as empty, a null or other language falls into the
stratum ``other``, labels that disagree count as good (the careful side), documents without a label
only get judged. Empty tables and repeated rows are fine.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundwork.llm.common import GAP, WORD, boxed, stage

STRATA = ("en", "de", "es", "fr")
RISK, DELTA = 0.05, 0.05
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Signal of each rule (high is bad) and its cutoffs from mild to strict.
RULES = {
    "symbols": (3.0, 2.0, 1.0, 0.6, 0.4, 0.3, 0.2, 0.1),
    "capitals": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "exclaims": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeats": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "digits": (0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
}
LEVELS = 8


def signals(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``row`` (the input columns), ``stratum``, the measures, and one ratio per rule."""
    words, lines = F.col("words"), F.col("lines")
    frame = boxed(
        docs, text=F.coalesce(docs[text].cast("string"), F.lit("")),
        stratum=F.when(docs[lang].isin(*STRATA), docs[lang]).otherwise("other"))
    frame = stage(frame, ("row", "stratum"), {
        "words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        "lines": F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)),
        "word_chars": F.length(F.regexp_replace("text", GAP, "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_capitals": F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long"),
        "n_exclaims": F.regexp_count("text", F.lit("!")).cast("long"),
        "n_digits": F.regexp_count("text", F.lit("[0-9]")).cast("long"),
    })
    carried = ["row", "stratum", "word_chars", "n_symbols", "n_capitals", "n_exclaims", "n_digits"]
    triples = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )).otherwise(F.expr("cast(array() as array<string>)"))
    frame = stage(frame, carried, {
        "triples": triples, "n_words": F.size(words).cast("long"), "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    carried += ["n_words", "n_lines", "n_dup_lines"]
    # Most texts repeat no triple; only the others are sorted.
    ordered = F.when(
        F.size(F.array_distinct("triples")) < F.size("triples"),
        F.sort_array(F.transform("triples", lambda t, i: F.struct(t.alias("t"), i.alias("i")))))
    frame = stage(frame, carried, {"ordered": ordered})
    ordered = F.col("ordered")

    def at_repeat(x: Column, j: Column) -> Column:
        same = F.coalesce(x["t"] == F.get(ordered, j - 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get(ordered, j + 1)["t"], F.lit(False))
        return F.when(same, x["i"])

    places = F.sort_array(F.filter(F.transform(ordered, at_repeat), lambda i: i.isNotNull()))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - i)).alias("n")),
        lambda acc: acc["n"])
    frame = stage(frame, carried, {"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")})

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return frame.select(
        "row", "stratum", *MEASURES, share("n_symbols", "n_words").alias("symbols"), share("n_capitals", "word_chars").alias("capitals"),
        share("n_exclaims", "n_words").alias("exclaims"), share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"), share("n_digits", "word_chars").alias("digits"))


def lower_tail(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, share), summed in logarithms; 1 where k is at or above the mean."""
    odds = math.log(share) - math.log1p(-share)
    first = n * math.log1p(-share)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    summed = F.aggregate(
        F.sequence(F.lit(1), k.cast("int")), F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"])
    return F.when((n <= 0) | (k >= n * share), 1.0).when(k == 0, F.exp(first)).otherwise(F.least(F.lit(1.0), F.exp(summed)))


def least_labels(risk: float = RISK, delta: float = DELTA) -> int:
    """Good labels that a stratum needs before a level without any false rejection is certified."""
    return math.ceil(math.log(delta / (len(STRATA) + 1)) / math.log1p(-risk))


def _base_failed() -> Column:
    n = F.col("n_words")
    return (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)


def select_cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified level: ``cut_<rule>`` of every rule; ``measured`` carries the key in ``row``.

    At most ``len(STRATA) + 1`` rows, made from sums that are combined before any shuffle.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("mark_key")).agg(
        (F.max("quality") >= 1).alias("good"))
    passing = measured.where(~_base_failed()).select(F.col(f"row.{key}").alias("mark_key"), "stratum", *RULES)
    known = passing.join(marks, "mark_key")
    good = F.col("good")
    sums = [F.count(F.when(good, 1)).alias("n")]
    for level in range(LEVELS):
        breaks = reduce(Column.__or__, [F.col(rule) > cuts[level] for rule, cuts in RULES.items()])
        sums += [F.count(F.when(breaks & good, 1)).alias(f"k_{level}"), F.count(F.when(breaks & ~good, 1)).alias(f"b_{level}")]
    counted = known.groupBy("stratum").agg(*sums)
    steps = F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(f"k_{level}").alias("k"), F.col(f"b_{level}").alias("caught"),
                 *[F.lit(cuts[level]).alias(f"cut_{rule}") for rule, cuts in RULES.items()])
        for level in range(LEVELS)])
    path = counted.select("stratum", "n", F.inline(steps)).withColumn("p", lower_tail(F.col("k"), F.col("n"), risk))
    in_order = Window.partitionBy("stratum").orderBy("level")
    certified = path.withColumn("worst", F.max("p").over(in_order)).where(
        (F.col("worst") <= delta / (len(STRATA) + 1)) & (F.col("caught") > 0))
    order = F.struct("caught", -F.col("level"))
    return certified.groupBy("stratum").agg(*[F.max_by(f"cut_{rule}", order).alias(f"cut_{rule}") for rule in RULES])


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``broken`` (names of the rules a document breaks) and ``kept``."""
    marked = measured.join(F.broadcast(cutoffs), "stratum", "left")  # at most one row per stratum, five in all
    broken = F.array_compact(F.array(*[F.when(F.col(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in RULES]))
    return marked.withColumn("base_failed", _base_failed()).withColumn("broken", broken).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop(*[f"cut_{rule}" for rule in RULES])


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that pass, with their own columns. Only labelled documents are measured for the cutoffs."""
    known = labels.select(F.col(key).alias("label_key")).distinct()
    labelled = docs.join(known, docs[key] == known["label_key"], "left_semi")
    return judge(signals(docs), select_cutoffs(signals(labelled), labels, key)).where("kept").select("row.*")
