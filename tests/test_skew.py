"""Fragment-replicate grouping: whole results and even tasks."""

from collections import Counter

from maldadum.operators import skew


def entries(spark, rows):
    return spark.createDataFrame(rows, "record STRING, source STRING, err_text STRING, cor_text STRING, edit_distance INT, kind STRING")


def test_results_with_one_key_of_a_third_of_all_rows(spark):
    rows = [(f"r{i % 700}", f"S{i % 3}" if i % 5 else None, *(("hot", "HOT") if i % 3 == 0 else (f"e{i % 97}", f"c{i % 89}")), i % 4, ("tags", "counts", "raw", None)[i % 4]) for i in range(6000)]
    edges = spark.createDataFrame([("hot", "HOT", 5), ("hot", "HOT", 7), ("e1", "c1", 1), ("none", "none", 2)], "src STRING, replacement STRING, frequency BIGINT")
    got = {(r.err_text, r.cor_text): r for r in skew.pair_details(entries(spark, rows), edges, 8).collect()}
    n = Counter((r[2], r[3]) for r in rows)
    assert {k: r.n_entries for k, r in got.items()} == n and len(got) == len(n)
    for key, r in got.items():
        mine = [x for x in rows if (x[2], x[3]) == key]
        assert r.n_records == len({x[0] for x in mine}) and r.sum_distance == sum(x[4] for x in mine) and r.n_total == 6000
        assert r.n_tags == sum(x[5] == "tags" for x in mine)
    assert (got["hot", "HOT"].n_edges, got["hot", "HOT"].edge_frequency) == (2, 12)


def test_tasks_are_even(spark):
    rows = [(f"r{i}", None, *(("hot", "x") if i % 2 else (f"e{i % 500}", "y")), 0, None) for i in range(20000)]
    df = entries(spark, rows)
    plan = skew.plan_shards(df, ("err_text", "cor_text"), 8)
    assert plan.total == 20000 and max(plan.task_load) <= 1.3 * 20000 / 8
    from pyspark.sql import functions as F

    sizes = [r[1] for r in plan.scatter(df, F.xxhash64("record")).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20000 and max(sizes) <= 1.6 * 20000 / 8


def test_nulls_empties_and_nothing(spark):
    rows = [("r1", None, None, "a", None, None), ("r1", None, None, "a", None, None), ("r2", "s", "", None, 1, "raw"), (None, None, "b", "c", 2, None)]
    got = {(r.err_text, r.cor_text): (r.n_entries, r.n_records, r.n_sources, r.sum_distance) for r in skew.pair_details(entries(spark, rows), None, 4).collect()}
    assert got == {(None, "a"): (2, 1, 0, None), ("", None): (1, 1, 1, 1), ("b", "c"): (1, 1, 0, 2)}
    assert skew.pair_details(entries(spark, []), None, 4).count() == 0
