"""One row per record."""

from maldadum.sources import tables
from maldadum.sources.tables import one_row_per_id


def test_one_row_per_id(spark, monkeypatch):
    rows = [(3, "a", "later"), (1, "a", "first"), (2, "b", None), (4, None, "own"), (5, None, "own too"), (None, "c", "no number"), (None, None, "nothing"), (6, "", "empty id"), (1, "a", "first")]
    df = spark.createDataFrame(rows, "rec_no BIGINT, id STRING, source STRING").selectExpr("*", "'x' AS record", "1 AS r")
    got = sorted((r.record, r.source) for r in one_row_per_id(df, "source").collect())
    assert got == [("i", "empty id"), ("ia", "first"), ("ib", None), ("ic", "no number"), ("n", "nothing"), ("n4", "own"), ("n5", "own too")]
    assert one_row_per_id(df.limit(0), "source").columns == ["record", "rec_no", "source"]
    once = df.where("not (id <=> 'a' and source = 'first')").unionByName(df.where("source = 'first'").limit(1))
    assert sorted((r.record, r.source) for r in one_row_per_id(once, "source").collect()) == got  # no number repeats: rows are told by a join
    monkeypatch.setattr(tables, "BROADCAST_IDS", 0)
    assert sorted((r.record, r.source) for r in one_row_per_id(once, "source").collect()) == got
    assert one_row_per_id(df.where("source = 'own'"), "source").count() == 1


def test_scratch_is_read_back_and_cleared(spark):
    import os

    from maldadum import session

    df = session.materialize(spark.range(5), "five")
    folder = session._application_folder(spark).removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(folder)
    assert session.clear_scratch(spark) and not os.path.exists(folder)
    with session.scratch(spark):
        kept = session.materialize(spark.range(3), "three")
        assert kept.count() == 3 and os.listdir(folder)
    assert not os.path.exists(folder) or not os.listdir(folder)
    assert session.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
