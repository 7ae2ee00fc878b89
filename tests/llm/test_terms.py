"""Term frequencies against counters."""

from collections import Counter

from pyspark.sql import functions as F

from maldadum.llm import terms as T


def run(spark, rows):
    df = spark.createDataFrame(rows, "record STRING, a ARRAY<STRING>, b ARRAY<STRING>, term INT, id INT")
    return {(r.field, r.term): (r.occ, r.rec, r.mark) for r in T.marked(T.term_counts(T.occurrences(df, {"a": F.col("a"), "b": F.col("b")})), df.count()).collect()}


def test_counts(spark):
    rows = [(f"r{i}", ["hot", "hot", f"t{i % 50}", None, ""], ["hot"] if i % 3 else None, 1, 1) for i in range(900)] + [("x", ["once", "once"], [], 1, 1)]
    got = run(spark, rows)
    occ, rec = Counter(), Counter()
    for _, a, b, *_ in rows:
        for field, values in (("a", a), ("b", b)):
            values = [v for v in values or [] if v]
            occ.update((field, v) for v in values)
            rec.update((field, v) for v in set(values))
    assert {k: v[:2] for k, v in got.items()} == {k: (occ[k], rec[k]) for k in occ}
    assert got["a", "once"] == (2, 1, "rare") and got["a", "hot"][2] == "common" and got["a", "t3"][2] is None


def test_ranges_and_ids(spark, monkeypatch):
    monkeypatch.setattr(T, "RANGE", 16)
    df = spark.createDataFrame([(f"r{i}", [f"t{i % 100}"]) for i in range(300)], "record STRING, a ARRAY<STRING>")
    rows = T.term_counts(T.occurrences(df, {"a": F.col("a")})).collect()
    assert sorted(r.id for r in rows) == list(range(100)) and all(r.occ == 3 == r.rec for r in rows)


def test_small_and_empty(spark):
    assert run(spark, [("r", ["v"], ["v"], None, None)]) == {("a", "v"): (1, 1, "rare"), ("b", "v"): (1, 1, "rare")}
    assert run(spark, []) == {}
    assert run(spark, [(None, None, [None, ""], 1, 2)]) == {}
