from __future__ import annotations

import brute
from pyspark.sql import functions as F

from moundwork.llm import pii, queries

EDGES = [
    "a@b.c_d@e.f x@y..z", "+1 (017) 555-7713 256.1.1.1 1.2.3.4.5.6.7.8 0255.1.1.1", "é 4111 1111 1111 1111 \U0001F600 a@b.co",
    None, "", " ", "1" * 5000, "a" * 3000 + "@b.c", "1.2.3.4 " * 500, "4111-1111-1111-1111 4111 1111 1111 1112", "+" * 50, "a@b.c" * 3, "a@b.c" * 3,
]


def spans(frame):
    return {r.id: r.found for r in frame.select(F.col("row.doc_id").alias("id"), pii.labelled(F.col("spans")).alias("found")).collect()}


def test_base_spans_equal_regular_expressions(docs_of):
    base = pii.find_spans(docs_of(EDGES)).withColumn("spans", F.filter("spans", lambda s: s["rank"] < 4))
    assert spans(base) == {i: brute.base_spans(t) for i, t in enumerate(EDGES)}


def test_query_over_the_table(spark, folder, documents):
    rows = queries.op1_pii(spark, folder).collect()
    assert len(rows) == len(documents)
    for r in rows:
        want = brute.base_spans(documents[r.doc_id].text)
        kinds = [s.split(":")[0] for s in want.split(",") if s]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in ("email", "ip", "card", "phone"))
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_added_kinds_need_checksum_or_context(docs_of):
    found = spans(pii.find_spans(docs_of([
        "iban GB82 WEST 1234 5698 7654 32", "iban GB82 WEST 1234 5698 7654 33", 'token = "04dbebab91ab8568c7c5b09fe5949719"',
        "04dbebab91ab8568c7c5b09fe5949719", "ssn 123-45-6789", "ssn 000-45-6789", "order 123-45-6789"])))
    assert [found[i] for i in range(7)] == ["iban:5:32", "", "secret:9:41", "", "ssn:4:15", "", ""]


def test_text_after_an_iban_and_long_secrets(docs_of):
    found = spans(pii.find_spans(docs_of([
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "iban DE89370400440532013000 2024", "iban DE89 3704 0044 0532 0130 00 1",
        "iban NO93 8601 1117 947 OK, MT84 MALT 0110 0001 2345 MTLC AST0 01S AB", "iban DE89370400440532013000X",
        "token " + "a1" * 100, "token " + "a1" * 50_000 + " end"])))
    assert [found[i] for i in range(7)] == [
        "iban:5:32", "iban:5:27", "iban:5:32", "iban:5:23,iban:28:66", "", "secret:6:206", "secret:6:100006"]


def test_redact_keeps_columns_and_other_rows(docs_of):
    docs = docs_of(["call +1 (017) 555-7713 or a@b.co", "clean text", None, "a@b.co1.2.3.4"], extra=("spans", "row", "start"))
    rows = pii.redact(docs).orderBy("doc_id").collect()
    assert rows[0].text == "call <PHONE> or <EMAIL>" and rows[0].n_chars == len(rows[0].text)
    assert (rows[1].text, rows[2].text) == ("clean text", None) and rows[3].text == "<EMAIL>"
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(docs.where("false")).count() == 0
