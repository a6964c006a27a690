from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from moundwork.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counts(rows):
    seen = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words):
    """Words that are near share a string of one with a character left out, so only those are compared."""
    by = {}
    for w in words:
        for cut in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by.setdefault(cut, []).append(w)
    near = {w: set() for w in words}
    for group in by.values():
        for w in group:
            near[w] |= {v for v in group if one_edit(w, v)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_whole_table(spark, folder, documents):
    want = grouped(counts((k, r.text) for k, r in documents.items()))
    rows = queries.op13_spelling(spark, folder).collect()
    assert len(rows) == len(want)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dense_vocabularies(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed < 3 else "abcdéÿ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 9))): rng.choice([2, 3, 30, 400, 5000]) for _ in range(250)}
    words |= {"a" * n: 2 ** n for n in range(7, 16)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {(r.word, r.near, r.near_n) for r in spelling.near_words(frame).collect()}
    assert near == {(a, b, words[b]) for a in words for b in words if one_edit(a, b)}


def test_chains_of_forms_end_at_the_most_frequent(spark, docs_of):
    texts = ["misspeling " * 2, "misspelling " * 40, "misspellings " * 900]
    rows = {r.word: r for r in spelling.spelling_groups(docs_of(texts)).collect()}
    want = {w: (f, r) for w, f, r, *_ in grouped(counts(enumerate(texts)))}
    assert {w: (r.form, r.root) for w, r in rows.items()} == want
    assert len({r.root for r in rows.values()}) < len(rows)


def test_edges(spark, docs_of):
    long = "pneumono" * 2000
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, "short words only here", "en", "s"), (None, "Keyless Keyless", "en", "s"),
        (4, long + " " + long, "en", "s"), (4, long + " " + long, "en", "s"), (5, long[:-1] + " " + long[:-1] + "x " * 3, "en", None),
        (6, "Étudiant étudiant ×÷×÷×÷× ×÷×÷×÷×", "fr", "s")]
    docs = docs_of(rows, extra=("word", "n", "run", "id", "step"))
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(docs).collect()}
    assert got == grouped(counts((r[0], r[1]) for r in rows))
    assert spelling.spelling_groups(docs.where("false")).count() == 0
