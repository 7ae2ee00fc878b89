"""Cross-split overlap against all pairs."""

import random
import re
import tracemalloc
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from maldadum.llm import overlap as O


def plain(text):
    return "".join(c for c in text.lower() if not c.isspace() and not unicodedata.category(c).startswith("P"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(rows):
    out = set()
    for i, (ka, sa, *ta) in enumerate(rows):
        for kb, sb, *tb in rows[:i]:
            if sa is None or sb is None or sa == sb:
                continue
            for a, b in zip(ta, tb):
                if a and b and a.strip() and b.strip():
                    x, y = plain(a), plain(b)
                    if distance(x, y) * 100 <= 15 * max(len(x), len(y)):
                        out.add((min(ka, kb), max(ka, kb)))
    return out


def changed(text, n):
    for _ in range(n):
        at = random.randrange(len(text) + 1)
        kind = random.random()
        text = text[:at] + random.choice("가나다라ab") + text[at:] if kind < 0.34 else text[:at] + text[at + 1 :] if kind < 0.67 else text[:at] + random.choice("가나다라ab") + text[at + 1 :]
    return text


def table(seed, n, lengths):
    random.seed(seed)
    rows = []
    for k in range(n):
        words = ["".join(random.choices("가나다라마바사아자차카타파하", k=random.randint(1, 4))) for _ in range(60)]
        text = re.sub(r"\s+", " ", " ".join(words))[: random.choice(lengths)]
        other = changed(text, random.randint(0, 1 + len(plain(text)) * 20 // 100))
        rows += [(2 * k + 1, "train", text, None), (2 * k + 2, ("validation", "test")[k % 2], other, changed(text, 1) if k % 3 else None)]
    return rows


@pytest.mark.parametrize(("seed", "lengths"), [(1, [5, 6, 7, 8, 9, 10, 12]), (2, [15, 20, 30, 40]), (3, [60, 80, 120])])
def test_all_pairs(spark, seed, lengths):
    rows = table(seed, 60, lengths)
    df = spark.createDataFrame(rows, "ex_no BIGINT, split STRING, text STRING, corrected_text STRING")
    got = {(r.key_a, r.key_b) for r in O.cross_split_pairs(df).collect()}
    assert got == brute(rows)


def test_copies_nulls_and_extra_columns(spark):
    base = "동생이 시장에서 사과를 샀어요 그리고 집에 갔어요"
    rows = [(1, "train", base, base), (2, "train", base, None), (3, "validation", base + "!", ""), (4, None, base, base), (5, "validation", None, base), (6, "train", " ", "  "), (7, "validation", " ", ""), (8, "train", "!!", None), (9, "validation", "?", None), (1, "train", base, base)]
    df = spark.createDataFrame(rows, "ex_no BIGINT, split STRING, text STRING, corrected_text STRING").selectExpr("*", "1 AS id", "'z' AS form", "2 AS key")
    got = {(r.key_a, r.key_b) for r in O.cross_split_pairs(df).collect()}
    assert got == brute(rows) == {(1, 3), (2, 3), (1, 5), (8, 9)}
    report = {(r.split): r for r in O.split_report(df, source="form").collect()}
    assert report["validation"].n_overlapping == 3 and report["validation"].n_rows == 4
    assert O.cross_split_pairs(df.limit(0)).count() == 0
    assert O.cross_split_pairs(df.where("split = 'train'")).count() == 0


def test_hot_grams_are_sharded(spark, monkeypatch):
    """With a fair load of a few hits every key has shards, and nothing is lost."""
    rows = table(5, 40, [20, 40])
    df = spark.createDataFrame(rows, "ex_no BIGINT, split STRING, text STRING, corrected_text STRING")
    real = O._seeds
    monkeypatch.setattr(O, "_seeds", lambda texts, probing, counts, fair, *rest: real(texts, probing, counts, 2, *rest))
    assert {(r.key_a, r.key_b) for r in O.cross_split_pairs(df).collect()} == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_an_unchanged_window_selects_the_same_gram(seed):
    """The guarantee of winnowing, and that one probing window survives the edits allowed."""
    random.seed(seed)
    counts = np.random.default_rng(seed).integers(0, 9, O.COUNT_BUCKETS).astype(np.float32)
    for _ in range(300):
        a = "".join(random.choices("가나다라마바사아", k=random.randint(7, 90)))
        b = changed(a, random.randint(0, len(a) * 15 // 100))
        if a == b or distance(a, b) * 100 > 15 * max(len(a), len(b)):
            continue
        probes = {(s, h) for s, _, _, hs in O._probes(*O._characters([a]), counts, 15) for h in hs.tolist()}
        offers = {(s, h) for s, _, _, hs in O._offers(*O._characters([b]), counts, 15) for h in hs.tolist()}
        assert probes & offers


def test_chains():
    assert O.longest_chain([(1, 1), (5, 6), (9, 2), (9, 12), (13, 11)]) == 3
    assert O.longest_chain([(1, 5), (1, 7), (1, 9)]) == 1


def test_distances(spark):
    rows = table(9, 40, [30, 50])
    df = spark.createDataFrame(rows, "ex_no BIGINT, split STRING, text STRING, corrected_text STRING")
    by_key = {r[0]: r for r in rows}
    got = O.cross_split_pairs(df).collect()
    assert got and all(r.distance == distance(*(plain(by_key[k][2 if r.field == "text" else 3]) for k in (r.key_a, r.key_b))) for r in got)


def test_long_texts(spark):
    """Texts of 5,000 and more characters, many of one length, in bounded tables."""
    random.seed(3)
    words = ["".join(random.choices("가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허", k=3)) for _ in range(4000)]
    rows = []
    for k, n in enumerate([5000] * 3 + [15_000]):
        base = "".join(random.choices(words, k=n // 3 + 1))[:n]
        rows += [(2 * k, "train", base, None), (2 * k + 1, "validation", changed(base, n * 5 // 100), None)]
    df = spark.createDataFrame(rows, "ex_no BIGINT, split STRING, text STRING, corrected_text STRING")
    assert sorted((r.key_a, r.key_b) for r in O.cross_split_pairs(df).collect()) == [(2 * k, 2 * k + 1) for k in range(4)]
    codes, lengths = O._characters([r[2] for r in rows[:6]] * 8 + ["".join(random.choices(words, k=17_000))])
    tracemalloc.start()
    n = sum(len(t) for _, t, _, _ in O._probes(codes, lengths, np.ones(O.COUNT_BUCKETS, np.float32), 15))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 48 * 883 and peak < 300e6


def test_report_counts_rows_of_classes(spark):
    rows = table(7, 30, [20, 40])
    rows += [(1000 + i, ("train", "validation")[i % 2], rows[0][2], None) for i in range(40)]
    df = spark.createDataFrame(rows, "ex_no BIGINT, split STRING, text STRING, corrected_text STRING").withColumn("source", F.lit("s"))
    pairs = O.cross_split_pairs(df).collect()
    best = {}
    for r in pairs:
        for k in (r.key_a, r.key_b):
            best[k] = max(best.get(k, 0), r.coverage)
    report = {r.split: r for r in O.split_report(df).collect()}
    for split in ("train", "validation", "test"):
        mine = [best[r[0]] for r in rows if r[1] == split and r[0] in best]
        assert (report[split].n_overlapping, report[split].n_exact) == (len(mine), sum(c == 1 for c in mine))
        assert abs(report[split].mean_coverage - sum(mine) / len(mine)) < 1e-9
