from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from moundwork.llm import alignment, queries
from moundwork.llm.tokens import PLAIN

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(queries.tokenizer_path(A))
    one.encode_special_tokens = True
    odd = [b for b in range(256) if b not in PLAIN]
    byte_of = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(odd)}
    other = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(B))

    def encode(text):
        """(id, bytes) of the tokens of both sides; nothing where they do not spell the text."""
        if not text:
            return [], []
        a = [(i, bytes(byte_of[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in other.encode(text):
            piece = other.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if other.is_byte(i) else piece.replace("\u2581", " ").encode()))
        same = all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b))
        return (a, b) if same else ([], [])

    return encode


def spans(tokens):
    at, out = 0, []
    for i, spelt in tokens:
        out.append((i, at, at + len(spelt)))
        at += len(spelt)
    return out


def brute(texts, encode):
    """Links by comparing every token of A with every token of B near it, in plain loops."""
    links, groups, sizes = [], [], []
    for text in texts:
        a, b = map(spans, encode(text))
        own, low = [], 0
        for i, (_, s, e) in enumerate(a):
            while low < len(b) and b[low][2] <= s:
                low += 1
            j = low
            while j < len(b) and b[j][1] < e:
                own.append((i, j))
                j += 1
        links.append([(a[i][0], b[j][0], i, j) for i, j in own])
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        parts, start = [], 0
        for cut in cuts:
            parts.append("|".join(",".join(str(i) for i, s, _ in side if start <= s < cut) for side in (a, b)))
            start = cut
        groups.append(";".join(parts))
        sizes.append((len(a), len(b), len(cuts)))
    counts = Counter((a, b) for own in links for a, b, *_ in own)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (*size, len(own), sum(counts[a, b] == most[b] for a, b, *_ in own), sum(counts[a, b] for a, b, *_ in own), text)
        for size, own, text in zip(sizes, links, groups)], [[(i, j) for *_, i, j in own] for own in links]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


EDGES = [
    None, "", " ", "a", "plain words of text", " leading and  double  spaces ", "tabs\tand\nlines\r\n", "<|endoftext|> in </s> the <s> text <unk>", "<0x41>",
    "déjà vu Ünïcödé", "\u2581under\u2581", "\U0001F600\U0001F680 emoji", "\u00A0nbsp\u3000", "ﬁ ligature ①", "한국어 日本語", "e\u0301", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000,
    "word " * 3000, "plain words of text", "\x00 zero", "0123456789" * 50]


def test_edges_against_all_pairs(spark, docs_of, tokenizers):
    rows = [(i, t, "en", "s") for i, t in enumerate(EDGES)] + [(None, "without an id", "en", None), (4, EDGES[4], "en", "s")]
    docs = docs_of(rows, extra=("chunk", "pairs", "keys", "n", "place"))
    chunks = alignment.aligned_chunks(docs, queries.tokenizer_path(A), queries.tokenizer_path(B), whole=True)
    want, links = brute([r[1] for r in rows], tokenizers)
    got = alignment.document_scores(chunks).collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *w) for r, w in zip(rows, want))
    assert sum(w[0] > 0 for w in want) >= 12
    whole = {r.doc_id: r for r in alignment.document_links(chunks).collect()}
    for i in range(len(EDGES)):
        assert [(x.a, x.b) for x in whole[i].links] == links[i] and whole[i].groups == want[i][-1]
    empty = alignment.aligned_chunks(docs.where("false"), queries.tokenizer_path(A), queries.tokenizer_path(B))
    assert alignment.document_scores(empty).count() == 0


def test_query_over_the_table(spark, folder, documents, tokenizers):
    rows = queries.op11_alignment(spark, folder).collect()
    keys = sorted(documents)
    want, _ = brute([documents[k].text for k in keys], tokenizers)
    assert {tuple(r) for r in rows} == {(k, *w[:-1], digest(w[-1])) for k, w in zip(keys, want)}
    assert len(rows) == len(keys)


def test_small_chunks_give_the_same(spark, docs_of, monkeypatch):
    docs = docs_of([t for t in EDGES if t] * 3)
    paths = queries.tokenizer_path(A), queries.tokenizer_path(B)
    one = Counter(map(tuple, alignment.document_scores(alignment.aligned_chunks(docs, *paths)).collect()))
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 50)
    monkeypatch.setattr(alignment, "ROWS_AT_ONCE", 2)
    assert Counter(map(tuple, alignment.document_scores(alignment.aligned_chunks(docs, *paths)).collect())) == one
