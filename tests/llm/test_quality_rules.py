from __future__ import annotations

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from moundwork.llm import quality_rules as q
from moundwork.llm import queries

EDGES = [None, "", "\n \t", "a b a b a b a", "x y z\nx y z\n\nx y z", "a a a a", "a b c d a b c", "#|& $", "w " * 3000, "one word"]


def test_measures_equal_plain_counts(docs_of):
    rows = q.signals(docs_of(EDGES, extra=("words", "row", "stratum"))).select("row.doc_id", *q.MEASURES).collect()
    assert {r.doc_id: tuple(r[1:]) for r in rows} == {i: brute.measures(t) for i, t in enumerate(EDGES)}


def test_query_over_the_table(spark, folder, documents):
    rows = queries.op2_quality_rules(spark, folder).collect()
    assert len(rows) == len(documents)
    for r in rows:
        m = brute.measures(documents[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("k,n", [(0, 10), (2, 400), (9, 3000), (400, 400), (0, 0), (1, 100_000)])
def test_lower_tail_is_the_binomial_sum(spark, k, n):
    a = 0.01
    got = spark.range(1).select(q.lower_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), a).alias("p")).first().p
    if n == 0 or k >= n * a:
        assert got == 1.0
    else:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log1p(-a)) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-6)


def test_cutoffs_hold_the_risk_and_need_enough_labels(spark, docs_of):
    clean = " ".join(f"plain{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(80))  # both pass the base rules
    noisy = clean.replace("plain", "#$%")
    n = 2500
    docs = docs_of([(i, noisy if i % 5 == 0 else clean, "en", "s") for i in range(n)])
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    measured = q.signals(docs)
    cuts = q.select_cutoffs(measured, labels).collect()
    assert [c.stratum for c in cuts] == ["en"] and cuts[0].cut_symbols is not None
    kept = {r.doc_id for r in q.keep_good(docs, labels).collect()}
    assert not any(i % 5 == 0 for i in kept)
    assert q.least_labels() == 90
    few = labels.where("doc_id < 111")  # 88 good documents
    assert q.select_cutoffs(measured, few).count() == 0
    assert q.select_cutoffs(measured, labels.where("doc_id < 113")).count() == 1  # 90 of them
    assert q.select_cutoffs(measured, labels.where("false")).count() == 0
    assert q.keep_good(docs.where("false"), labels).columns == docs.columns


def test_query_equals_check_sql(spark, folder):
    from parity import compare, open_views

    frame = queries.op2_quality_rules(spark, folder)
    cursor = open_views(folder).execute(queries.ORACLES["op2_quality_rules"])
    names = [d[0] for d in cursor.description]
    problem, _ = compare([tuple(r) for r in frame.collect()], frame.columns, cursor.fetchall(), names)
    assert problem is None, problem


def plain_tail(k, n, share):
    return sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))


def plain_level(rows, strata=5):
    """The level of the path for (signals, good) rows, by the rules of the docstring, or None."""
    certified = []
    good = [s for s, g in rows if g]
    for level in range(q.LEVELS):
        def breaks(s):
            return any(s[rule] > cuts[level] for rule, cuts in q.RULES.items())

        k = sum(map(breaks, good))
        if not good or k >= q.RISK * len(good) or plain_tail(k, len(good), q.RISK) > q.DELTA / strata:
            break
        certified.append((sum(breaks(s) for s, g in rows if not g), -level))
    best = max(certified, default=(0, 0))
    return -best[1] if best[0] else None


@pytest.mark.parametrize("seed", range(6))
def test_levels_equal_a_plain_walk_along_the_path(spark, seed):
    rng = random.Random(seed)
    rows, signals = [], {}
    for i in range(1200):
        lang = rng.choice(["en", "en", "en", "de", "fr", None])
        good = rng.random() < 0.7
        s = {rule: round(rng.random() ** (14 + 4 * seed if good else 2), 3) for rule in q.RULES}
        words = rng.choice([40, 200])
        rows.append((i, "other" if lang is None else lang, words, 0, *s.values()))
        signals.setdefault(rows[-1][1], []).append((s, good)) if words >= 50 else None
        rows[-1] = (*rows[-1], int(good))
    names = ["doc_id", "stratum", "n_words", "n_repeat_words", *q.RULES, "quality"]
    frame = spark.createDataFrame(rows, names)
    got = {r.stratum: tuple(r[f"cut_{rule}"] for rule in q.RULES) for r in q.select_cutoffs(
        frame.withColumn("row", F.struct("doc_id")).drop("doc_id", "quality"), frame.select("doc_id", "quality")).collect()}
    want = {stratum: plain_level(found) for stratum, found in signals.items()}
    assert got == {s: tuple(cuts[level] for cuts in q.RULES.values()) for s, level in want.items() if level is not None}


def test_repeated_rows_and_odd_languages(docs_of, spark):
    docs = docs_of([(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "x " * 60, "tlh", "s"), (2, None, "", None)], extra=("cut_symbols", "good"))
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    judged = q.judge(q.signals(docs), q.select_cutoffs(q.signals(docs), labels)).collect()
    assert len(judged) == 4 and {r.stratum for r in judged} == {"other"} and all(r.base_failed and not r.kept for r in judged)
