"""The named Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maldadum.session import materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Repeated ids up to this number go to the executors as a broadcast table (some 40 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_LAST = 2**63 - 1


def one_row_per_id(records: DataFrame, *keep: str) -> DataFrame:
    """One row per record ``id`` with the columns ``keep``.

    A record delivered again carries the same content under a larger ``rec_no``; the smallest ``rec_no`` is kept. A row
    whose ``id`` is null is a record of its own (those without a ``rec_no`` too are one). Ids that are there more than once are found on ids and numbers
    alone, and the rows to be left out are told by a join with those few; all others stay where they are. Only where a number itself repeats within
    an id are whole rows shuffled, to keep one of them."""
    record = F.coalesce(F.concat(F.lit("i"), F.col("id")), F.concat(F.lit("n"), F.coalesce(F.col("rec_no").cast("string"), F.lit("")))).alias("record")
    number = F.coalesce(F.col("rec_no"), F.lit(_LAST)).alias("_no")
    names = ["rec_no", *[k for k in keep if k != "rec_no"]]
    rows = records.select(record, *[F.col(c) for c in names], number)
    keys = records.select(record, number)
    again = materialize(keys.groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.min("_no").alias("_first")).where("n > 1").select("record", "_first"), "again")
    n = again.count()
    if not n:
        return rows.drop("_no")
    few = F.broadcast(again) if n <= BROADCAST_IDS else again
    if not keys.join(few, "record", "left_semi").groupBy("record", "_no").count().where("count > 1").isEmpty():
        packed = rows.groupBy("record").agg(F.min_by(F.struct(*names), "_no").alias("r"))
        return packed.select("record", *[F.col(f"r.{c}").alias(c) for c in names])
    return rows.join(few, "record", "left").where("_first is null or _no = _first").drop("_no", "_first")
