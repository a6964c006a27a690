"""Which tokens of one tokenizer cover which tokens of another, and how often ids meet.

Side A is a byte-level vocabulary of the tokenizers library over a space and the text, side B a
sentencepiece model over the text. Tokens are spans of the same bytes, so a batch of documents is one line of
bytes: ``pandas.merge_asof``, keyed by document, finds for every start of A the token of B that
covers it and for every start of B the token of A; both directions together are all overlapping pairs.
Where a token of either side ends at the same byte, a group ends.

Texts are aligned in chunks of about ``CHUNK_LINKS`` links. A chunk is one row: its documents, the
ids of both sides with the links, and the distinct id pairs with their counts, which are what is
summed over the corpus. Corpus counts then go back to the chunks that hold a pair, one row per chunk
and pair, however often the pair occurs there; a chunk's rows give the documents' sums. So the frequent pairs,
which are in every chunk, are as many rows as there are chunks, and a document is never split from its links.

Texts that are null or empty, or whose tokens of either side do not spell a space and the text, have no
tokens. Names of special tokens inside texts are plain text. Repeated rows are documents of their own and
count as often; a null id stays null; an empty table gives an empty result; other columns are never
read. A document must fit a task's memory.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundwork.llm.common import small_batches
from moundwork.llm.tokens import PLAIN, Words
from moundwork.session import written_once

CHUNK_LINKS = 1_000_000
ROWS_AT_ONCE = 128


@dataclass
class Side:
    """A vocabulary as bytes: the spelling of every id, and the decimal id before ``,``, before a group's break and at the end."""

    spelt: pa.Array
    width: np.ndarray
    printed: pa.Array

    @classmethod
    def of(cls, spelt: list[bytes], closing: str) -> Side:
        printed = [f"{i}{after}" for after in (",", closing, "") for i in range(len(spelt))]
        return cls(pa.array(spelt, pa.large_binary()), np.array([len(x) for x in spelt], np.int64), pa.array(printed, pa.large_string()))

    def joined(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The bytes of every document."""
        return _concatenated(self.spelt.take(pa.array(ids)), sizes)


def _concatenated(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    none = "" if pa.types.is_large_string(values.type) else b""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values), pa.scalar(none, values.type))


class Bytes:
    """Side A: ids of plain text by a byte-level vocabulary."""

    def __init__(self, path: str):
        self.words = Words(path)
        self.words.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        odd = [b for b in range(256) if b not in PLAIN]
        byte_of = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(odd)}
        ids = spec["model"]["vocab"]
        spelt = [b""] * (max([*ids.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for word, i in ids.items():
            spelt[i] = bytes(byte_of[c] for c in word) if all(c in byte_of for c in word) else word.encode()
        for token in spec.get("added_tokens", []):
            spelt[token["id"]] = token["content"].encode()
        self.side = Side.of(spelt, "|")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        quick = self.words.quick
        if quick is not None:
            return [np.asarray(quick.encode_to_numpy(text, disallowed_special=()), np.int64) for text in texts]
        return [np.array(self.words.tokenizer.encode(text, add_special_tokens=False).ids, np.int64) for text in texts]


class Pieces:
    """Side B: ids by a sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.side = Side.of([
            bytes([int(name[3:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)], ";")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _opened(bytes_path: str, pieces_path: str) -> tuple[Bytes, Pieces]:
    return Bytes(bytes_path), Pieces(pieces_path)


@dataclass
class Aligned:
    """Links of a batch as places in the id arrays, in the order of documents; ``cuts`` are the bytes where groups end."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    links: np.ndarray
    groups_a: np.ndarray
    groups_b: np.ndarray
    n_groups: np.ndarray


def _spans(widths: np.ndarray, sizes: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Start, document and place of every token on the line of bytes of all documents, and the ends."""
    ends = np.cumsum(widths)
    return pd.DataFrame({"start": ends - widths, "doc": np.repeat(np.arange(len(sizes)), sizes), "place": np.arange(len(widths))}), ends


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], side_a: Side, side_b: Side) -> Aligned:
    """Alignment of documents whose tokens spell the same bytes on both sides."""
    sizes_a, sizes_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([np.empty(0, np.int64), *ids]) for ids in (ids_a, ids_b))
    tokens_a, ends_a = _spans(side_a.width[a], sizes_a)
    tokens_b, ends_b = _spans(side_b.width[b], sizes_b)
    covers_a = pd.merge_asof(tokens_a, tokens_b, on="start", by="doc", suffixes=("_a", "_b"))
    covers_b = pd.merge_asof(tokens_b, tokens_a, on="start", by="doc", suffixes=("_b", "_a"))
    later = covers_b["start"].to_numpy() != tokens_a["start"].to_numpy()[covers_b["place_a"].to_numpy(np.int64)]  # equal starts are there already
    both = pd.concat([covers_a, covers_b[later]])
    both = both.iloc[np.lexsort((both["place_b"], both["place_a"]))]
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    docs = len(sizes_a)
    at_cut = np.isin(ends_a, cuts, assume_unique=True)
    return Aligned(
        a, b, sizes_a, sizes_b, both["place_a"].to_numpy(np.int64), both["place_b"].to_numpy(np.int64), np.bincount(both["doc"], minlength=docs),
        np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), np.bincount(tokens_a["doc"].to_numpy()[at_cut], minlength=docs))


def printed_groups(found: Aligned, side_a: Side, side_b: Side) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    total = len(found.ids_a) + len(found.ids_b)
    place_a = np.arange(len(found.ids_a)) + np.searchsorted(found.groups_b, found.groups_a, "left")
    place_b = np.arange(len(found.ids_b)) + np.searchsorted(found.groups_a, found.groups_b, "right")
    last_a = np.diff(found.groups_a, append=-1) != 0
    last_b = (np.diff(found.groups_b, append=-1) != 0).astype(np.int64)
    ends = np.cumsum(found.sizes_b)
    last_b[ends[found.sizes_b > 0] - 1] = 2
    chosen = np.empty(total, np.int64)
    chosen[place_a] = found.ids_a + last_a * len(side_a.spelt)
    chosen[place_b] = found.ids_b + last_b * len(side_b.spelt) + len(side_a.printed)
    parts = pa.concat_arrays([side_a.printed, side_b.printed]).take(pa.array(chosen))
    return _concatenated(parts, found.sizes_a + found.sizes_b)


def aligned_batch(texts: list[str | None], paths: tuple[str, str]) -> tuple[Aligned, pa.Array]:
    """Alignment and printed groups of texts; texts that do not come back from their tokens have none."""
    one, other = _opened(*paths)
    whole = [" " + text if text else "" for text in texts]
    ids = [one.encode(whole), other.encode([text or "" for text in texts])]
    spelt = pa.array([text.encode("utf-8", "surrogatepass") for text in whole], pa.large_binary())
    good = np.ones(len(texts), bool)
    for side, own in zip((one.side, other.side), ids):
        back = side.joined(np.concatenate([np.empty(0, np.int64), *own]), np.array([len(x) for x in own], np.int64))
        good &= pc.equal(back, spelt).to_numpy(zero_copy_only=False)
    none = np.empty(0, np.int64)
    ids_a, ids_b = ([x if ok else none for x, ok in zip(own, good)] for own in ids)
    found = align(ids_a, ids_b, one.side, other.side)
    return found, printed_groups(found, one.side, other.side)


class _Chunk:
    """Documents gathered until their links are enough for a row."""

    names = ("chunk", "keys", "n_a", "n_b", "n_groups", "n_links", "groups", "ids_a", "ids_b", "link_a", "link_b", "linked", "pairs", "times")

    def __init__(self, whole: bool, kind: pa.DataType):
        self.whole, self.kind, self.held, self.parts = whole, kind, 0, []

    def add(self, keys: pa.Array, found: Aligned, printed: pa.Array) -> None:
        self.parts.append((keys, found, printed))
        self.held += len(found.link_a)

    def row(self, number: int) -> pa.RecordBatch:
        def all_of(make) -> np.ndarray:
            return np.concatenate([make(found) for _, found, _ in self.parts])

        codes = all_of(lambda f: (f.ids_a[f.link_a] << 32) | f.ids_b[f.link_b])
        pairs, which, times = np.unique(codes, return_inverse=True, return_counts=True)
        texts = [t for _, _, printed in self.parts for t in printed.to_pylist()]
        if not self.whole:
            texts = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]

        def packed(make) -> bytes | None:
            return all_of(make).astype("<u4").tobytes() if self.whole else None

        def own(link: str, sizes: str):
            def make(f: Aligned) -> np.ndarray:
                first = np.cumsum(getattr(f, sizes)) - getattr(f, sizes)
                return getattr(f, link) - np.repeat(first, f.links)
            return make

        lists = [all_of(lambda f: f.sizes_a), all_of(lambda f: f.sizes_b), all_of(lambda f: f.n_groups), all_of(lambda f: f.links)]
        columns = [
            pa.array([number], pa.int64()), pa.array([pa.concat_arrays([k for k, _, _ in self.parts]).to_pylist()], pa.list_(self.kind)),
            *(pa.array([x], pa.list_(pa.int64())) for x in lists), pa.array([texts], pa.list_(pa.string())),
            *(pa.array([packed(make)], pa.binary()) for make in (
                lambda f: f.ids_a, lambda f: f.ids_b, own("link_a", "sizes_a"), own("link_b", "sizes_b"))),
            pa.array([which.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()], pa.binary()),
            pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, list(self.names))


def aligned_chunks(docs: DataFrame, bytes_path: str, pieces_path: str, whole: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk of documents, written once; ``whole`` keeps ids, links and printed groups, else only the groups' hash."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    paths = (bytes_path, pieces_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                chunk = chunk or _Chunk(whole, batch.column(0).type)
                chunk.add(rows.column(0), *aligned_batch(rows.column(1).to_pylist(), paths))
                if chunk.held >= CHUNK_LINKS:
                    yield chunk.row(number)
                    number, chunk = number + 1, None
        if chunk is not None:
            yield chunk.row(number)

    schema = (
        f"chunk long, keys array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups array<string>, "
        "ids_a binary, ids_b binary, link_a binary, link_b binary, linked binary, pairs array<bigint>, times array<bigint>")
    return written_once(docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema), "aligned-chunks")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair`` (the id of A times 2^32 plus that of B), ``n`` (links that hold it) and ``best`` (no pair of that B id has more)."""
    single = chunks.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    summed = written_once(single.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    other = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = summed.groupBy(other.alias("b")).agg(F.max("n").alias("most"))
    return summed.join(most, other == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def document_scores(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups`` of every document."""
    held = chunks.select(F.col("chunk").alias("holder"), F.posexplode("pairs").alias("place", "pair"))
    told = held.join(pair_counts(chunks), "pair").select("holder", "place", "n", "best")
    kind = chunks.schema["keys"].dataType.elementType.simpleString()

    def run(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        chunk = chunk.to_batches()[0]
        size = len(chunk.column("pairs")[0])
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = counted.column("place").to_numpy()
        n[place], best[place] = counted.column("n").to_numpy(), counted.column("best").to_numpy()
        lists = {name: chunk.column(name)[0].values for name in ("keys", "n_a", "n_b", "n_groups", "n_links", "groups")}
        linked = np.frombuffer(chunk.column("linked")[0].as_py(), "<u2" if size <= 1 << 16 else "<u4")
        sums = [np.concatenate([[0], np.cumsum(x[linked])]) for x in (best, n)]
        last = np.cumsum(lists["n_links"].to_numpy())
        first = last - lists["n_links"].to_numpy()
        n_best, count_sum = (s[last] - s[first] for s in sums)
        return pa.table({
            key: lists["keys"], **{c: lists[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": n_best, "count_sum": count_sum, "groups": lists["groups"]})

    slim = chunks.select("chunk", "keys", "n_a", "n_b", "n_groups", "n_links", "groups", "linked", "pairs")
    return slim.groupBy("chunk").cogroup(told.groupBy("holder")).applyInArrow(
        run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def document_links(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids_a``, ``ids_b``, ``links`` (places of a token of each side) and ``groups`` of every document; needs ``whole`` chunks."""
    kind = chunks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                arrays = [np.frombuffer(r[name], "<u4").astype(np.int64) for name in ("ids_a", "ids_b", "link_a", "link_b")]
                cuts = [np.cumsum(r[name])[:-1] for name in ("n_a", "n_b", "n_links", "n_links")]
                a, b, one, other = (np.split(x, at) for x, at in zip(arrays, cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["keys"]), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())),
                    pa.array([[{"a": x, "b": y} for x, y in zip(p.tolist(), q.tolist())] for p, q in zip(one, other)], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    pa.array(r["groups"])], [key, "ids_a", "ids_b", "links", "groups"])

    return chunks.mapInArrow(
        run, f"`{key}` {kind}, ids_a array<bigint>, ids_b array<bigint>, links array<struct<a:bigint,b:bigint>>, groups string")
