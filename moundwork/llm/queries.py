"""The numbered queries over the document and page tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundwork.llm import alignment, check_sql, exact_topk, mixing, packing, page_diff, pii, quality_rules, sharding, simhash, sketches, spelling, token_files, warc
from moundwork.llm.common import table
from moundwork.session import shared_folder, written_once


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < 4)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.labelled(base), 256).alias("base_sha256"), pii.labelled(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = quality_rules.signals(docs).withColumn("row", F.struct("row.doc_id"))
    measured = written_once(measured, "quality-signals")
    cutoffs = quality_rules.select_cutoffs(measured, table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, cutoffs).select(
        "row.doc_id", *quality_rules.MEASURES, "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = written_once(simhash.fingerprints(docs, words=4), "prints")
    groups = simhash.near_groups(prints, radius=4)
    return prints.join(groups, prints["fp0"] == groups["fp"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written_once(mixing.sizes(table(spark, sf_dir, "documents")), "mix-sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "times")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = written_once(sharding.nodes(table(spark, sf_dir, "documents")), "shard-nodes")
    placed = sharding.with_slots(sharding.assign(parts))
    return placed.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = written_once(warc.captures(table(spark, sf_dir, "pages")), "captures")
    resolved = warc.resolve_revisits(records)
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return resolved.select(
        "record_id", "url", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"), "refers_to", "verdict",
        F.array_join(fields, "\n").alias("headers"), F.length("payload").cast("long").alias("n_chars"))


def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, tokenizer_path())
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = alignment.aligned_chunks(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return alignment.document_scores(chunks).withColumnRenamed("groups", "groups_sha256")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("key") % 100 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_sketches": op8_sketches,
    "op9_page_diff": op9_page_diff,
    "op10_token_files": op10_token_files,
    "op11_alignment": op11_alignment,
    "op12_exact_topk": op12_exact_topk,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str | None] = {
    "op2_quality_rules": check_sql.quality_sql(),
    "op7_warc_revisits": check_sql.revisit_sql(),
    "op12_exact_topk": check_sql.topk_sql(),
}
