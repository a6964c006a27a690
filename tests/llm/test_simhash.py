from __future__ import annotations

import itertools
import random

import brute
import xxhash

from moundwork.llm import queries
from moundwork.llm import simhash as s
from moundwork.llm.components import components


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint_by_bits():
    for text in (None, "", "One", "a b c", "Hello WORLD foo bar Baz éÉ", "x " * 400, "the quick brown fox jumps over the lazy dog again and again"):
        assert s.fingerprint(text, 4) & (1 << 64) - 1 == plain_fingerprint(text)


def test_query_equals_all_pairs(spark, folder, documents):
    rows = queries.op3_simhash(spark, folder).collect()
    fps = {k: plain_fingerprint(d.text) for k, d in documents.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = brute.components(links, sorted(fps))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}


def test_links_of_dense_families(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    family = [base[0] ^ sum(1 << b for b in rng.sample(range(14), rng.randrange(6))) for _ in range(300)]
    fps = sorted(set(base + family + [0, 1, (1 << 64) - 1]))
    monkeypatch.setattr(s, "ROUTED", 100_000)  # many shares
    monkeypatch.setattr(s, "SHARE", 10_000)  # and each halved in memory
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = s.ball_links(spark.createDataFrame([(0, f) for f in signed], "tab int, fp long"))
    roots = {r.node: r.root for r in components(links.select("a", "b")).collect()}
    got = {f: roots.get(v, v) for f, v in zip(fps, signed)}
    want = brute.components([(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4], fps)
    same = lambda m: {frozenset(f for f in fps if m[f] == m[g]) for g in fps}
    assert same(got) == same(want)


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(900, 901), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert {found[i] for i in range(n)} == {0} and found[901] == found[900] == 900
    assert components(links.where("false")).count() == 0


def test_one_of_each(docs_of):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
    edited = text.replace(text.split()[200], "changed", 1)
    other = " ".join(f"v{rng.randrange(5000)}" for _ in range(400))
    docs = docs_of([
        (5, text, "en", "s"), (3, text, "en", "s"), (9, edited, "en", "s"), (4, other, "en", "s"), (4, other, "en", "s"),
        (7, None, "en", "s"), (8, "", "en", "s"), (None, text, "en", "s"), (None, text, "en", "s")], extra=("fp0", "mark", "keeper", "least"))
    kept = s.one_of_each(docs)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 4, 7] and kept.columns == docs.columns
    assert s.one_of_each(docs.where("false")).count() == 0


def planted(rng, low, high):
    """Two texts whose 5-word similarity lies in the half-open range."""
    runs = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    while True:
        old = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([100, 200, 400]))]
        new, alike = list(old), 1.0
        while alike >= high:
            new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            a, b = runs(old), runs(new)
            alike = len(a & b) / len(a | b)
        if alike >= low:
            return " ".join(old), " ".join(new)


def test_pairs_just_above_and_below_the_threshold(docs_of):
    rng = random.Random(4)
    pairs = [planted(rng, 0.80, 0.85) for _ in range(60)] + [planted(rng, 0.70, 0.80) for _ in range(60)]
    kept = s.one_of_each(docs_of([text for both in pairs for text in both]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(240)) - set(range(1, 120, 2)))


def test_large_families_and_neighbours_of_other_families(docs_of):
    rng = random.Random(6)
    texts, sets = [], []
    for _ in range(3):  # families around one text, whose members lie on both sides of the threshold
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(50):
            new = list(base)
            for _ in range(rng.randrange(6)):
                new[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(new))
            sets.append({tuple(new[i:i + 5]) for i in range(146)})
    links = [(a, b) for a, b in itertools.combinations(range(150), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = brute.components(links, range(150))
    assert {r.doc_id for r in s.one_of_each(docs_of(texts)).collect()} == set(want.values())


def test_other_text_under_the_same_key_stays(docs_of):
    rng = random.Random(8)
    first, other, third = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    docs = docs_of([(1, first, "en", "s"), (1, other, "en", "s"), (1, other, "en", "s"), (2, other, "en", "s"), (3, third, "en", "s"), (3, None, "en", "s"), (3, "", "en", "s")])
    kept = sorted((r.doc_id, r.text or "") for r in s.one_of_each(docs).collect())
    assert kept == sorted([(1, first), (1, other), (3, third), (3, "")])


def test_a_crowd_below_the_threshold_is_not_compared(spark):
    rng = random.Random(9)
    shared = [f"w{rng.randrange(10**6)}" for _ in range(150)]

    def compared(n):
        texts = [" ".join(shared + [f"x{rng.randrange(10**6)}" for _ in range(50)]) for _ in range(n)]
        sets = s.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "mark long, text string"), 5)
        sizes = s.rare_shingles(sets, 0.8).groupBy("bucket").count().collect()
        return sum(r["count"] * (r["count"] - 1) // 2 for r in sizes)

    few, many = compared(600), compared(1200)
    assert few <= 600 and many <= 2 * max(few, 600)


def test_near_duplicates_start_with_ball_hashing(spark, docs_of, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    family = [" ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in (5, 300, 880)]
    docs = docs_of([*family, " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))])
    linked, seen = [], s.ball_pairs
    monkeypatch.setattr(s, "ball_pairs", lambda prints: linked.append(seen(prints)) or linked[-1])
    assert sorted(r.doc_id for r in s.one_of_each(docs).collect()) == [0, 3]
    pairs = [(r.a, r.b) for r in linked[0].collect()]
    marks = {r.doc_id: r.mark for r in s.fingerprints(docs).collect()}
    assert pairs and all({a, b} <= {marks[0], marks[1], marks[2]} for a, b in pairs)


def test_parity_bits_bound_the_difference(spark):
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join([f"x{rng.randrange(10**6)}" if rng.random() < p else t for t in base]) for p in (0, 0.01, 0.1, 0.9)] + [""]
    rows = s.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "mark long, text string"), 5).collect()
    for a, b in itertools.combinations(rows, 2):
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a.bits, b.bits))
        assert len(a.bits) == 8 and bits <= len(set(a.shingles) ^ set(b.shingles))
    far = [r for r in rows if r.mark in (0, 3)]
    assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(far[0].bits, far[1].bits)) > 100
