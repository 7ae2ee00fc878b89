"""Controlled rounding and exact quotas."""

import math
import random
import time
from collections import Counter
from fractions import Fraction

from hypothesis import given, settings, strategies as st

from maldadum.llm import sampling as M


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_rounding_keeps_both_margins(n_rows, n_columns, data):
    cells = [(r, c) for r in range(n_rows) for c in range(n_columns) if data.draw(st.booleans())]
    values = [Fraction(data.draw(st.integers(0, 60)), data.draw(st.integers(1, 9))) for _ in cells]
    got = M.controlled_rounding([r for r, _ in cells], [c for _, c in cells], values)
    near = lambda n, x: math.floor(x) <= n <= math.ceil(x)
    assert all(near(n, v) for n, v in zip(got, values))
    for side in (0, 1):
        for k in {c[side] for c in cells}:
            assert near(sum(n for n, c in zip(got, cells) if c[side] == k), sum((v for v, c in zip(values, cells) if c[side] == k), Fraction(0)))
    assert near(sum(got), sum(values, Fraction(0)))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9), st.integers(0, 60)), min_size=1, max_size=8))
def test_scaled_table_keeps_bounds(size, rows):
    share, least, there = zip(*rows)
    cells = M.scaled_table(size, share, least, there)
    assert all(min(a, b) <= c <= b for a, b, c in zip(least, there, cells))
    low, high = sum(min(a, b) for a, b in zip(least, there)), sum(b if s else min(a, b) for s, a, b in rows)
    assert sum(cells) == min(max(size, low), high)


def plain_table(size, share, least, there):
    """All bends tried one by one."""
    lo = [min(a, b) for a, b in zip(least, there)]
    cells = lambda f: [min(Fraction(b), max(Fraction(a), f * s)) for a, b, s in zip(lo, there, share)]
    want = max(min(size, sum(b for b, s in zip(there, share) if s > 0) + sum(a for a, s in zip(lo, share) if not s)), sum(lo))
    below = Fraction(0)
    for bend in sorted({Fraction(b, s) for b, s in zip(there, share) if s} | {Fraction(a, s) for a, s in zip(lo, share) if s}):
        if sum(cells(bend)) >= want:
            low, high = sum(cells(below)), sum(cells(bend))
            return cells(bend if high == low else below + (bend - below) * (want - low) / (high - low))
        below = bend
    return cells(below)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9), st.integers(0, 60)), min_size=1, max_size=8))
def test_running_sums_find_the_same_table(size, rows):
    share, least, there = zip(*rows)
    assert M.scaled_table(size, share, least, there) == plain_table(size, share, least, there)


def test_twenty_thousand_categories():
    rng = random.Random(3)
    cells = [(r, c) for r in range(200) for c in range(100)]
    share, there = [rng.randint(0, 9) for _ in cells], [rng.randint(0, 5000) for _ in cells]
    least = [rng.randint(0, 20) for _ in cells]
    began = time.perf_counter()
    table = M.scaled_table(3_000_000, share, least, there)
    got = M.controlled_rounding([r for r, _ in cells], [c for _, c in cells], table)
    assert time.perf_counter() - began < 20
    assert sum(got) == 3_000_000 and all(math.floor(t) <= g <= math.ceil(t) for g, t in zip(got, table))


def frames(spark, records, targets):
    return spark.createDataFrame(records, "record STRING, error_type STRING, source STRING"), spark.createDataFrame(targets, "error_type STRING, source STRING, target_permille INT, min_rows INT")


def test_quotas_are_met_exactly(spark):
    records = [(f"r{i}", "A" if i % 3 else "B", (" web", "WEB ", "News", None)[i % 4]) for i in range(4000)]
    r, t = frames(spark, records, [("A", "web", 500, 5), ("A", "news", 300, 5), ("B", "web", 150, 700), ("B", "news", 50, 400), ("C", "web", 0, 3), ("C", "x", 0, 0)])
    report = M.quotas(r, t)
    rows = {(x.error_type, x.source): x for x in report.collect()}
    picked = M.sample(r, report).collect()
    scarce = rows["B", "web"].n_records + rows["B", "news"].n_records  # fewer than their minimum: all of them
    assert len({x.record for x in picked}) == len(picked) == sum(x.quota for x in rows.values()) == 5 + 5 + scarce > 800
    taken = Counter((x.error_type, x.source.strip().lower()) for x in picked)
    assert all(taken.get(k, 0) == x.quota for k, x in rows.items())
    assert {k for k, x in rows.items() if x.short} == {("B", "web"), ("B", "news"), ("C", "web")}
    assert rows["C", "web"].short and rows["C", "web"].quota == 0 and not rows["C", "x"].short


def test_size_and_proportions(spark):
    r, t = frames(spark, [(f"r{i}", "A" if i % 2 else "B", "s" if i % 3 else "t") for i in range(3000)], [("A", "s", 400, 0), ("A", "t", 100, 0), ("B", "s", 300, 0), ("B", "t", 200, 0)])
    report = M.quotas(r, t)
    assert {(x.error_type, x.source): x.quota for x in report.collect()} == {("A", "s"): 240, ("A", "t"): 60, ("B", "s"): 180, ("B", "t"): 120}
    assert M.sample(r, report).count() == 600 and sorted(x.record for x in M.sample(r, report).collect()) == sorted(x.record for x in M.sample(r, report).collect())


def test_one_category_of_all_rows_and_repeats(spark):
    r, t = frames(spark, [("same", "A", "s")] * 300 + [(None, "A", "s")] * 200, [("A", "s", 1000, 0)])
    report = M.quotas(r, t)
    assert M.sample(r, report).count() == 100


def test_nothing(spark):
    r, t = frames(spark, [], [("A", "s", 1000, 2)])
    report = M.quotas(r, t)
    assert [tuple(x) for x in report.select("n_records", "quota", "wanted", "short").collect()] == [(0, 0, 2, True)]
    assert M.sample(r, report).count() == 0
    r, t = frames(spark, [("r", None, "s"), ("q", "A", None)], [])
    assert M.quotas(r, t).count() == 0 and M.sample(r, M.quotas(r, t)).count() == 0
