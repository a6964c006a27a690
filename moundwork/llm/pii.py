"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score.

A kind is a pattern, a check on the matched text, a prior score and context words. Patterns run over
the whole text and give leftmost, non-overlapping matches; matches that fail the check are dropped
without a retry. Context words within ``REACH`` code points before or after a match raise or lower
its score. Kinds marked ``certain`` are kept whatever their score; the others need ``THRESHOLD``.

Everything is built-in column functions. Null texts count as empty; empty tables, repeated rows and
columns with any other names are fine; positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundwork.llm.common import boxed, stage

REACH = 40
THRESHOLD = 0.6
RAISE, LOWER = 0.3, 0.3

# Possessive quantifiers and the look-behind change no match: they only stop the engine from trying
# starts inside a run that has already failed, and from recursing once per digit of a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Characters of an account number by country, so that a word or number that follows is never taken in.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AO25 AT20 AZ28 BA20 BE16 BF28 BG22 BH22 BI27 BJ28 BR29 BY28 CF27 CG27 CH21 CI28 CM27 CR22 CV25 CY28 CZ24 "
    "DE22 DJ27 DK18 DO28 DZ26 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GA27 GB22 GE22 GI23 GL18 GQ27 GR27 GT28 GW25 HN28 HR21 HU28 "
    "IE22 IL23 IQ23 IR26 IS26 IT27 JO30 KM27 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MA28 MC27 MD24 ME22 MG27 MK19 ML28 "
    "MN20 MR27 MT31 MU30 MZ25 NE28 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 "
    "SM27 SN28 SO23 ST25 SV28 TD27 TG28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30 ").split()
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(
    "(?:" + "|".join(c[:2] for c in IBAN_LENGTHS if c[2:] == n) + r")[0-9]{2}(?:\x20?[A-Z0-9]){" + str(int(n) - 4) + "}"
    for n in sorted({c[2:] for c in IBAN_LENGTHS})) + r")(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{24,}+"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """14 to 19 digits whose sum, every second from the right doubled and cast out by nine, ends in 0."""
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.length(digits))
    doubled = F.transform(places, lambda i: digits.substr(i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def _mod97(value: Column) -> Column:
    """15 to 34 characters that leave 1 by 97 once the first four stand last and letters count from 10."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    marks = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(acc: Column, mark: Column) -> Column:
        letter = acc * 100 + (F.ascii(mark) - 55)
        return F.when(mark >= "A", letter).otherwise(acc * 10 + (F.ascii(mark) - 48)) % 97

    return F.when(F.length(bare).between(15, 34), F.aggregate(marks, F.lit(0), step) == 1).otherwise(False)


def _issued(value: Column) -> Column:
    return ~value.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$")


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    prior: float
    near: str
    against: str
    certain: bool


KINDS = (
    Kind("email", EMAIL, "@", lambda v: F.lit(True), 0.9, r"mail|contact|write", r"example", True),
    Kind("ip", IP, ".", lambda v: v.rlike(OCTETS), 0.6, r"\bip\b|host|server|address", r"version|release|section", True),
    Kind("card", CARD, "", _luhn, 0.7, r"card|visa|master|credit|payment", r"order|invoice|isbn|serial", True),
    Kind("phone", PHONE, "+", lambda v: F.length(_digits(v)).between(10, 15), 0.7, r"phone|tel|call|mobile|fax", r"score|range", True),
    Kind("iban", IBAN, "", _mod97, 0.7, r"iban|account|bank|konto|cuenta|compte", r"serial|part no", False),
    Kind("ssn", SSN, "-", _issued, 0.4, r"ssn|social security|tax id", r"order|part no|isbn", False),
    Kind("secret", SECRET, "", _mixed, 0.4, r"token|secret|password|api[_ -]?key|credential", r"sha1|checksum|commit", False),
)
RANK = {kind.name: i for i, kind in enumerate(KINDS)}
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,value:string,score:double>>"


def _spans_of(kind: Kind, text: Column, matches: Column) -> Column:
    """Positions from the pieces between matches: every piece and match moves the place by its length."""
    pieces = F.split(text, kind.pattern, -1)
    zipped = F.arrays_zip(
        pieces.alias("before"), matches.alias("value"), F.slice(pieces, F.lit(2), F.size(matches)).alias("after"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["before"])
        around = F.concat_ws(" ", F.right(x["before"], F.lit(REACH)), F.left(x["after"], F.lit(REACH)))
        score = (
            F.lit(kind.prior) + F.when(around.rlike(f"(?i){kind.near}"), RAISE).otherwise(0.0)
            - F.when(around.rlike(f"(?i){kind.against}"), LOWER).otherwise(0.0))
        span = F.struct(
            at.cast("int").alias("start"), F.lit(RANK[kind.name]).alias("rank"),
            (at + F.length(x["value"])).cast("int").alias("stop"), F.lit(kind.name).alias("kind"),
            x["value"].alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))
        good = kind.valid(x["value"])
        if not kind.certain:
            good = good & (score >= THRESHOLD)
        return F.struct(
            (at + F.coalesce(F.length(x["value"]), F.lit(0))).cast("int").alias("at"),
            F.when(x["value"].isNotNull() & good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    walked = F.aggregate(zipped, start, step, lambda acc: acc["found"])
    return F.when(F.size(matches) > 0, walked).otherwise(F.expr(f"cast(array() as {SPAN})"))


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the input columns), ``text`` (null as empty) and ``spans`` by start, then kind."""
    frame = boxed(docs, text=F.coalesce(docs[text].cast("string"), F.lit("")))
    matches = {}
    for kind in KINDS:
        hits = F.regexp_extract_all(F.col("text"), F.lit(kind.pattern), F.lit(0))
        if kind.needs:
            hits = F.when(F.contains(F.col("text"), F.lit(kind.needs)), hits).otherwise(F.expr("cast(array() as array<string>)"))
        matches[f"m_{kind.name}"] = hits
    frame = stage(frame, ("row", "text"), matches)
    parts = [_spans_of(kind, F.col("text"), F.col(f"m_{kind.name}")) for kind in KINDS]
    return stage(frame, ("row", "text"), {"spans": F.sort_array(F.concat(*parts))})


def labelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(named, ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input columns with every span replaced by its kind in angle brackets.

    Overlapping spans become one, named after the one that starts first. A text without spans stays
    as it is (a null text stays null). ``n_chars``, where present, follows the new text.
    """
    found = find_spans(docs, text)
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,kind:string>>)")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind"))
        fresh = F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
        overlaps = (F.size(acc) > 0) & (s["start"] < last["stop"])
        return F.when(overlaps, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    # try_element_at: the last of an empty list is null, whichever branch is then taken.
    merged = F.aggregate(
        F.transform(F.col("spans"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))),
        empty, lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(merge(acc, s)))
    frame = stage(found, ("row", "text", "spans"), {"cuts": F.when(F.size("spans") > 0, merged).otherwise(empty)})
    cuts = F.col("cuts")

    def piece(i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["stop"])
        end = F.coalesce(F.get(cuts, i)["start"], F.length("text"))
        between = F.substr(F.col("text"), begin + 1, end - begin)
        tag = F.when(i < F.size(cuts), F.concat(F.lit("<"), F.upper(F.get(cuts, i)["kind"]), F.lit(">"))).otherwise("")
        return F.concat(between, tag)

    clean = F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), piece), "")
    frame = stage(frame, ("row", "cuts"), {"clean": F.when(F.size(cuts) > 0, clean)})
    columns = []
    for name in docs.columns:
        old = F.col("row")[name]
        if name == text:
            old = F.coalesce(F.col("clean"), old)
        elif name == "n_chars":
            old = F.when(F.col("clean").isNotNull(), F.length("clean")).otherwise(old)
        columns.append(old.cast(docs.schema[name].dataType).alias(name))
    return frame.select(*columns)
