"""Revisit records of a web archive resolved to the full response they stand for.

A revisit (the server answered "not modified") carries no body. It stands for the latest earlier full
response of the same canonical URL, found by an as-of join. The validators must agree: where both
sides have an entity tag the tags decide, else the modification dates, else the revisit's note of the
payload digest; a revisit without any validator is taken on trust. The header of the resolved
record is that of the response, updated by what a "not modified" answer may change.

The join runs in two steps so that one URL with a third of all captures is no single task: the
responses of a URL are ordered within slices of time, and the last response of each earlier slice is
carried forward over the (few) slices of the URL. Only record ids and validators take part; headers
and bodies are fetched by record id afterwards.

Built-in column functions only. Records without a URL or time, and revisits without an earlier
response, stay unresolved with a reason; at equal times the larger record id is the later one, and a
response at the time of a revisit counts as earlier. Record ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE_SECONDS = 86_400

#: Fixed list: header fields that a "not modified" answer may not change in the stored response.
KEPT_FIELDS = (
    "content-encoding", "content-length", "content-md5", "content-range", "content-type", "connection", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no user, default port, "www.", fragment or session id; sorted query."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\d*\.|\.$", "")
    port = F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)
    port = F.when((port == "") | (port == F.when(scheme == "https", "443").otherwise("80")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(?:phpsessid|jsessionid|sid|utm_[a-z]+)="))
    query = F.array_join(F.array_sort(parts), "&")
    bare = F.concat(host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.isNotNull() & (host != ""), bare)


def _field(headers: Column, name: str) -> Column:
    value = F.trim(F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(0)))
    return F.when(value != "", value)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(_field(headers, "etag"), "^W/", "")


def lowered(headers: Column) -> Column:
    """Field names in lower case; of fields that then agree the last one counts."""
    entries = F.map_entries(headers)
    named = F.transform(entries, lambda e, i: F.struct(F.lower(F.trim(e["key"])).alias("k"), i.alias("i"), e["value"].alias("v")))
    last = F.filter(named, lambda x: ~F.exists(named, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, updated and completed by the fresh ones that may change."""
    allowed = F.map_filter(lowered(fresh), lambda k, _: ~k.isin(*KEPT_FIELDS))
    rest = F.map_filter(lowered(stored), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(rest, allowed)


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per revisit: ``record_id``, ``url``, ``captured_at``, ``refers_to``, ``verdict``, ``headers``, ``payload``.

    ``records``: record_id, kind ("response" or "revisit"), url, captured_at, status, headers (map),
    digest, payload. Full responses are those with status 200. ``verdict`` is ``resolved``,
    ``no earlier response`` or ``validator mismatch``; only resolved rows have headers and payload.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    narrow = records.where(full | (F.col("kind") == "revisit")).select(
        "record_id", "url", "captured_at", "kind", canonical_url(F.col("url")).alias("page"), _tag(F.col("headers")).alias("tag"),
        _field(F.col("headers"), "last-modified").alias("modified"), "digest")
    narrow = narrow.withColumn("slice", F.floor(F.unix_timestamp("captured_at") / slice_seconds))
    able = narrow.where(F.col("page").isNotNull() & F.col("captured_at").isNotNull())
    response = F.when(F.col("kind") == "response", F.struct("captured_at", "record_id", "tag", "modified", "digest"))

    # Responses sort before revisits of the same moment.
    inside = Window.partitionBy("page", "slice").orderBy("captured_at", (F.col("kind") == "revisit"), "record_id")
    near = able.withColumn("own", F.last(response, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = able.where("kind = 'response'").groupBy("page", "slice").agg(F.max(response).alias("end"))
    used = able.where("kind = 'revisit'").select("page", "slice").distinct()
    over = Window.partitionBy("page").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    lines = used.join(ends, ["page", "slice"], "full").withColumn("carried", F.last("end", ignorenulls=True).over(over))
    carried = lines.select(F.col("page").alias("p"), F.col("slice").alias("s"), "carried")
    found = near.where("kind = 'revisit'").join(carried, (F.col("page") == F.col("p")) & (F.col("slice") == F.col("s")), "left")
    found = found.withColumn("origin", F.coalesce("own", "carried"))

    def agree(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), a == b)

    same = F.coalesce(
        agree(F.col("tag"), F.col("origin.tag")), agree(F.col("modified"), F.col("origin.modified")),
        agree(F.col("digest"), F.col("origin.digest")), F.lit(True))
    verdict = F.when(F.col("origin").isNull(), "no earlier response").when(~same, "validator mismatch").otherwise("resolved")
    judged = found.select("record_id", "url", "captured_at", F.when(verdict == "resolved", F.col("origin.record_id")).alias("refers_to"), verdict.alias("verdict"))
    lost = narrow.where((F.col("kind") == "revisit") & (F.col("page").isNull() | F.col("captured_at").isNull())).select(
        "record_id", "url", "captured_at", F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"), F.lit("no earlier response").alias("verdict"))
    judged = judged.unionByName(lost)

    fresh = records.where("kind = 'revisit'").select(F.col("record_id").alias("of"), F.col("headers").alias("fresh"))
    stored = records.where(full).select(F.col("record_id").alias("origin_id"), F.col("headers").alias("stored"), "payload")
    joined = judged.join(fresh, F.col("record_id") == F.col("of"), "left").join(stored, F.col("refers_to") == F.col("origin_id"), "left")
    resolved = F.col("verdict") == "resolved"
    return joined.select(
        "record_id", "url", "captured_at", "refers_to", "verdict",
        F.when(resolved, merged_headers(F.coalesce("stored", F.create_map().cast("map<string,string>")), F.coalesce("fresh", F.create_map().cast("map<string,string>")))).alias("headers"), "payload")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records from a table of pages, for the query over ``pages``.

    A page is captured in full at an hour set by its id, and asked for again three times: twice with
    its validators (once under another spelling of the URL), once with an outdated tag. Every seventh
    page's first revisit comes before its capture. Only ids and digests set the times and tags.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    begin = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7_919, F.lit(2_000)) * 3_600)

    def record(n: int, kind: str, url: Column, hours: Column, status: int, etag: Column, payload: Column) -> Column:
        fields = [F.lit("ETag"), etag, F.lit("Date"), F.date_format(begin + F.make_dt_interval(hours=hours), "yyyy-MM-dd HH:mm:ss")]
        if kind == "response":
            fields += [F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string")]
        else:
            fields += [F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0")]
        return F.struct(
            (F.col("page_id") * 4 + n).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"),
            (begin + F.make_dt_interval(hours=hours)).alias("captured_at"), F.lit(status).alias("status"),
            F.create_map(*fields).alias("headers"), digest.alias("digest"), payload.alias("payload"))

    nothing = F.lit(None).cast("string")
    spelled = F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/$", ""), F.lit("#again"))
    early = F.when(F.col("page_id") % 7 == 0, -1).otherwise(5)
    return pages.select(F.inline(F.array(
        record(0, "response", F.col("url"), F.lit(0), 200, tag, F.col("html")),
        record(1, "revisit", F.col("url"), early, 304, tag, nothing),
        record(2, "revisit", spelled, F.lit(30), 304, F.concat(F.lit("W/"), tag), nothing),
        record(3, "revisit", F.col("url"), F.lit(60), 304, F.lit('"old"'), nothing))))
