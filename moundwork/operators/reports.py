"""Injury reports: classification, confidence, identity and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundwork.functions import text
from moundwork.functions.barrier import compute_once
from moundwork.session import written_once


def parse_injury_text(df: DataFrame, column: str) -> DataFrame:
    """Location, type, severity, confidence and the trail of rules that produced them.

    The text is lower-cased once and every rule is a substring test inside generated code. Rule
    results are computed once per row (see ``functions.barrier``); what follows is cheap.
    """
    low = F.col("_low")
    unknown = F.lit(text.UNKNOWN)
    original = F.coalesce(F.col(column), F.lit(""))
    df = compute_once(df, {"_low": F.lower(original)})
    df = compute_once(df, {
        "_loc1": text.injury_location(low), "_type1": text.injury_type(low), "severity": text.severity(low),
        "_medical": text.medical_term_location(low), "_size": F.length(original),
    })
    no_place = (F.col("_loc1") == unknown) & (F.col("_medical") == unknown)
    df = compute_once(df, {
        "_context": F.when(no_place, text.context_location(low)).otherwise(unknown),
        "_pattern": F.when(F.col("_type1") == unknown, text.pattern_type(low)).otherwise(unknown),
    })
    direct = (F.col("_loc1") != unknown) | (F.col("_type1") != unknown) | (F.col("severity") != unknown)

    def fallback(first: str, second: str) -> Column:
        return F.when(F.col(first) == unknown, F.col(second)).otherwise(F.col(first))

    df = df.withColumns({"_loc2": fallback("_loc1", "_medical"), "injury_type": fallback("_type1", "_pattern")})
    df = df.withColumn("injury_location", fallback("_loc2", "_context"))
    by_medical = F.col("_loc1") != F.col("_loc2")
    by_context = F.col("_loc2") != F.col("injury_location")
    by_pattern = F.col("_type1") != F.col("injury_type")
    base = (
        text.points(direct, 0.7) + text.points(by_medical, 0.1) + text.points(by_context, 0.05)
        + text.points(by_pattern, 0.05)
    )
    trail = F.concat(
        F.when(direct, "direct_keyword").otherwise("none"),
        F.when(by_medical, "+medical").otherwise(""), F.when(by_context, "+context").otherwise(""),
        F.when(by_pattern, "+patterns").otherwise(""),
    )
    score = text.parse_confidence(
        F.col("_size"), F.col("_medical") != unknown, base,
        F.col("injury_location"), F.col("injury_type"), F.col("severity"),
    )
    return df.withColumns({"parsing_method": trail, "confidence_score": score}).drop(
        "_low", "_loc1", "_loc2", "_type1", "_medical", "_context", "_pattern", "_size"
    )


def reparse_unknown(records: DataFrame, notes: str = "notes", raw: str = "raw_text") -> DataFrame:
    """Parse notes and raw text of records with an unknown type or location; keep improvements."""
    open_case = (F.col("injury_type") == text.UNKNOWN) | (F.col("injury_location") == text.UNKNOWN)
    joined = text.strip(F.concat_ws(" ", F.coalesce(F.col(notes), F.lit("None")), F.coalesce(F.col(raw), F.lit("None"))))
    old = ["injury_type", "injury_location", "severity", "confidence_score"]
    base = records.withColumnsRenamed({c: f"_old_{c}" for c in old}).withColumn("_text", joined)
    parsed = parse_injury_text(base, "_text")
    was_open = (F.col("_old_injury_type") == text.UNKNOWN) | (F.col("_old_injury_location") == text.UNKNOWN)
    better = was_open & ((F.col("injury_type") != text.UNKNOWN) | (F.col("injury_location") != text.UNKNOWN))
    out = {c: F.when(better, F.col(c)).otherwise(F.col(f"_old_{c}")) for c in old}
    out["data_quality"] = F.when(better, "improved_parsing").otherwise(
        F.col("data_quality") if "data_quality" in records.columns else F.lit("raw")
    )
    return parsed.withColumn("_better", better).withColumns(
        {"data_quality": out.pop("data_quality")}
    ).withColumns(out).drop("_text", "_better", "parsing_method", *[f"_old_{c}" for c in old])


def dedup_first(records: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """First record per key in ingest order (an aggregate, so copies collapse before the shuffle)."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = records.withColumns(dict(zip(names, keys)))
    return keyed.groupBy(*names).agg(F.min_by(F.struct(*records.columns), order).alias("r")).select("r.*")


def dedup_best(records: DataFrame, order: str, name: str = "pitcher_name", day: str = "injury_date") -> DataFrame:
    """Highest confidence per (lower-cased name, day), the earlier record on ties."""
    best = F.struct(F.col("confidence_score"), -F.col(order))
    return records.groupBy(F.lower(name).alias("_n"), F.col(day).alias("_d")).agg(
        F.max_by(F.struct(*records.columns), best).alias("r")
    ).select("r.*")


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


GRAM = 3
NAMES_PER_SHARE = 10_000


def name_grams(names: DataFrame) -> DataFrame:
    """``gram`` and ``pitcher_id``: the distinct runs of one to ``GRAM`` characters of every name (``low``).

    At most ``GRAM`` rows a character, however long the names are.
    """
    def runs_of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("low") - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.col("low").substr(i, F.lit(k)))

    runs = F.flatten(F.array(*[runs_of(k) for k in range(1, GRAM + 1)]))
    return names.select("pitcher_id", F.explode(F.array_distinct(runs)).alias("gram")).where("gram <> ''")


def names_containing(needles: DataFrame, pitchers: DataFrame) -> DataFrame:
    """``needle`` and ``found``, the smallest id of a pitcher whose lower-cased name contains it; needles that none contains are left out.

    A needle of up to ``GRAM`` characters is a gram itself. A longer one is held against the names under the
    rarest of its runs of ``GRAM`` characters; the names of a frequent run are dealt into shares, so that
    none is one task. ``needles`` has distinct, non-empty ``needle``.
    """
    names = written_once(pitchers.where("name <> ''").groupBy(F.lower("name").alias("low")).agg(F.min("pitcher_id").alias("pitcher_id")), "names")
    grams = written_once(name_grams(names), "name-grams")
    totals = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("times"), F.min("pitcher_id").alias("found"))
    totals = written_once(totals.withColumn("shares", F.ceil(F.col("times") / NAMES_PER_SHARE).cast("int")), "gram-totals")
    size = F.length("needle")
    short = needles.where(size <= GRAM).join(totals.select(F.col("gram").alias("needle"), "found"), "needle")
    starts = F.sequence(F.lit(1), size - GRAM + 1)
    runs = needles.where(size > GRAM).select("needle", F.explode(F.array_distinct(
        F.transform(starts, lambda i: F.col("needle").substr(i, F.lit(GRAM))))).alias("gram"))
    rarest = runs.join(totals.select("gram", "times", "shares"), "gram", "left").groupBy("needle").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram", "shares")).alias("r")).where("r.times > 0")
    probes = rarest.select("needle", F.col("r.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.col("r.shares") - 1)).alias("share"))
    dealt = grams.where(F.length("gram") == GRAM).join(totals.select("gram", "shares"), "gram").select(
        "gram", "pitcher_id", F.pmod(F.xxhash64("pitcher_id"), F.col("shares")).cast("int").alias("share"))
    candidates = probes.join(dealt, ["gram", "share"]).select("needle", "pitcher_id").join(names, "pitcher_id")
    long = candidates.where(F.contains("low", "needle")).groupBy("needle").agg(F.min("pitcher_id").alias("found"))
    return short.unionByName(long)


def resolve_pitcher_ids(mentions: DataFrame, pitchers: DataFrame, name: str = "player_name", team: str = "team") -> DataFrame:
    """Exact (name, team), else a profile whose name contains the mention or its last word (the
    smallest id), else a surrogate id."""
    exact = pitchers.groupBy(F.col("name").alias(name), F.col("team").alias(team)).agg(F.min("pitcher_id").alias("_exact"))
    words = F.split(text.strip(F.col(name)), r"\s+")
    keyed = mentions.join(exact, [name, team], "left").withColumns({
        "_whole": F.when(F.col("_exact").isNull(), F.lower(name)),
        "_last": F.when(F.col("_exact").isNull(), F.lower(F.element_at(words, -1))),
    })
    needles = keyed.select(F.explode(F.array("_whole", "_last")).alias("needle")).where("needle <> ''").distinct()
    held = written_once(names_containing(written_once(needles, "needles"), pitchers), "names-found")
    whole = held.select(F.col("needle").alias("_whole"), F.col("found").alias("_id_whole"))
    tail = held.select(F.col("needle").alias("_last"), F.col("found").alias("_id_last"))
    found = keyed.join(whole, "_whole", "left").join(tail, "_last", "left")
    fuzzy = F.least("_id_whole", "_id_last")
    method = F.when(F.col("_exact").isNotNull(), "exact").when(fuzzy.isNotNull(), "fuzzy").otherwise("surrogate")
    chosen = F.coalesce(
        F.col("_exact").cast("string"), fuzzy.cast("string"), text.surrogate_id(F.col(name), F.col(team))
    )
    return found.withColumns({"pitcher_id": chosen, "match": method}).drop(
        "_exact", "_whole", "_last", "_id_whole", "_id_last"
    )


def arm_injury_filter(records: DataFrame, column: str) -> DataFrame:
    return records.where(text.is_arm_injury(F.lower(column)))


def confidence_filter(records: DataFrame, least: float, strict: bool = False) -> DataFrame:
    score = F.col("confidence_score")
    return records.where(score > least if strict else score >= least)


def table_rows_to_records(rows: DataFrame, reference: Column, source: str = "landed_pages") -> DataFrame:
    """Landed table rows to injury records with the second confidence scorer; below 0.3 dropped."""
    both = F.lower(F.concat_ws(" ", "injury_info", "status"))
    out = rows.withColumns({
        "injury_type": text.injury_type(both), "injury_location": text.injury_location(both),
        "severity": text.severity(F.lower("status")),
        "injury_date": text.extract_injury_date(F.concat(F.col("status"), F.lit(" ")), reference),
        "pitcher_id": text.surrogate_id(F.col("pitcher_name")), "source": F.lit(source),
        "notes": F.concat_ws(" - ", "injury_info", "status"),
    })
    score = text.record_confidence(F.col("injury_info"), F.col("status"), F.col("injury_type"), F.col("injury_location"))
    return out.withColumn("confidence_score", score).where(F.col("confidence_score") >= 0.3)
