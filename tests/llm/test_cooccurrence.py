"""Pair counts against brute force, and the null."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maldadum.llm import cooccurrence as O


def brute(rows, items, least, lift):
    words = {w for w in items if w}
    sets = [set(re.findall(O.WORD, t or "")) & words for _, t in rows]
    one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    return {(a, b): (one[a], one[b], c) for (a, b), c in two.items() if c >= least and c * len(rows) >= lift * one[a] * one[b]}


def data(spark, n=600):
    random.seed(4)
    vocabulary = [f"말{i}" for i in range(40)]
    rows = [(f"r{i}", " ".join(random.choices(vocabulary, weights=[1 / (k + 1) for k in range(40)], k=random.randint(0, 9))) + (" 가를, 나를!" if i % 9 == 0 else "")) for i in range(n)]
    rows += [("n1", None), ("n2", ""), ("n3", "말1 말1 말1 말2")]
    items = [*vocabulary[:30], "가를", "나를", None, "", "말1", "없는", "a b"]
    return rows, items, spark.createDataFrame(rows, "record STRING, cor_sentence STRING"), spark.createDataFrame([(x,) for x in items], "item STRING")


def as_dict(df):
    return {(r.term_a, r.term_b): (r.n_a, r.n_b, r.n_both) for r in df.collect()}


def test_counts(spark, monkeypatch):
    rows, items, baskets, known = data(spark)
    for least, lift in ((5, 8), (2, 0), (1, 1)):
        assert as_dict(O.pair_counts(baskets, "cor_sentence", known, least, lift)) == brute(rows, items, least, lift)
    monkeypatch.setattr(O, "BROADCAST_ITEMS", 3)  # the way for large dictionaries
    monkeypatch.setattr(O, "HELD_PAIRS", 7)  # slices and early partial counts
    assert as_dict(O.pair_counts(baskets, "cor_sentence", known, 2, 0)) == brute(rows, items, 2, 0)


def test_nothing(spark):
    _, _, baskets, known = data(spark, 5)
    assert O.pair_counts(baskets.limit(0), "cor_sentence", known).count() == 0
    assert O.pair_counts(baskets, "cor_sentence", known.limit(0)).count() == 0
    assert O.surprise(baskets.limit(0), "cor_sentence", known).count() == 0


def test_null_honours_both_margins():
    d, dm, k, km = np.array([1.0, 5, 40]), np.array([30.0, 10, 2]), np.array([1.0, 2, 4]), np.array([60.0, 30, 10])
    d = d * (k @ km) / (d @ dm)
    x, y = O.fit_null(d, dm, k, km)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ km, d, rtol=1e-6) and np.allclose(dm @ p, k, rtol=1e-6)


def test_an_item_in_all_baskets_is_refused():
    with pytest.raises(ArithmeticError):
        O.fit_null(np.array([10.0, 2.0]), np.array([1.0, 5.0]), np.array([1.0, 3.0]), np.array([5.0, 5.0]), rounds=50)


def test_ranks_count_every_pair(spark):
    """q against Benjamini-Hochberg over all possible pairs, with the p of every pair that occurs."""
    rows, items, baskets, known = data(spark)
    every = O.surprise(baskets, "cor_sentence", known, min_together=1).collect()
    n = len({x for s in rows for x in re.findall(O.WORD, s[1] or "")} & {x for x in items if x})
    p = sorted(r.log10_p for r in every)
    for r in every:
        exact = min(0.0, min(q + np.log10(n * (n - 1) / 2) - np.log10(i + 1) for i, q in enumerate(p) if q >= r.log10_p))
        assert exact - 1e-9 <= r.log10_q <= exact + 0.0201
    some = {(r.term_a, r.term_b): r.log10_q for r in O.surprise(baskets, "cor_sentence", known, min_together=5).collect()}
    assert some == {(r.term_a, r.term_b): r.log10_q for r in every if r.n_both >= 5}


def test_bins(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 1024, 1025, 2000, 10**11)], "n BIGINT").select(O.bins(F.col("n"))).collect()]
    assert got[:2] == [1.0, 1024.0] and got == sorted(got) and got[-1] < 2300


def test_tail_against_exact_convolution():
    p, many = np.array([[0.01, 0.05, 0.3]]), np.array([50, 20, 5])
    law = np.ones(1)
    for q, m in zip(p[0], many):
        for _ in range(m):
            law = np.convolve(law, [1 - q, q])
    for c in (1, 3, 5, 8, 12):
        exact = np.log10(law[c:].sum())
        assert abs(O.tail(p, many, np.array([float(c)]))[0] - exact) < 0.06


def test_surprise_finds_the_planted_pair(spark):
    _, _, baskets, known = data(spark)
    rows = O.surprise(baskets, "cor_sentence", known).orderBy("log10_p").collect()
    assert (rows[0].term_a, rows[0].term_b) == ("가를", "나를") and rows[0].log10_q < -10
    assert all(r.log10_q >= r.log10_p - 1e-9 for r in rows)
