"""Occurrences and records of every distinct term, by a global integer dictionary and block-wise count arrays (p7).

Distinct terms get dense integer ids: hash buckets give each term a place, prefix sums over the buckets a number. Tasks count their rows
block by block before anything is shuffled, so that a term that fills a third of the rows is shuffled once per block; the partial
counts are encoded by a join with the dictionary and routed by identifier range, where streams of (id, counts) are added into count
arrays. Ids then lead back to the terms without another exchange.

Defined results: terms are compared as stored; null and empty ones are left out; a term is present once per record however
often it occurs there; no terms give no rows. Of a collection so small that one record is more than the common share, a term
found in only one record is 'rare'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum.session import materialize

#: Identifiers of one count array.
RANGE = 1 << 16
_BUCKETS = 4096


def occurrences(records: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """Rows ``field``, ``term``, ``occ``, ``rec``: (1, 0) per occurrence, (0, 1) per distinct term of a record.

    :param terms: for each field an array of the record's terms."""

    def both(name: str, values: Column) -> Column:
        values = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
        each = F.transform(values, lambda x: F.struct(F.lit(name).alias("field"), x.alias("term"), F.lit(1).cast("bigint").alias("occ"), F.lit(0).cast("bigint").alias("rec")))
        once = F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(name).alias("field"), x.alias("term"), F.lit(0).cast("bigint").alias("occ"), F.lit(1).cast("bigint").alias("rec")))
        return F.concat(each, once)

    return records.select(F.explode(F.concat(*[both(k, v) for k, v in terms.items()])).alias("t")).select("t.*")


def _blocks(rows: DataFrame) -> DataFrame:
    """Counts per block of rows of a task: the same columns, fewer rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 200_000:
                yield from add(held)
                held, n = [], 0
        if held:
            yield from add(held)

    def add(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = pa.Table.from_batches(held).group_by(["field", "term"]).aggregate([("occ", "sum"), ("rec", "sum")])
        yield from sums.select(["field", "term", "occ_sum", "rec_sum"]).rename_columns(["field", "term", "occ", "rec"]).to_batches(max_chunksize=50_000)

    return rows.mapInArrow(run, "field STRING, term STRING, occ BIGINT, rec BIGINT")


def dictionary(terms: DataFrame) -> DataFrame:
    """``field``, ``term``, ``id``: 0 .. n - 1 over the distinct (field, term) of ``terms``, the same for the same set of terms."""
    distinct = terms.select("field", "term").distinct().withColumn("bucket", F.pmod(F.xxhash64("field", "term"), F.lit(_BUCKETS)))
    counts = distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("base"))  # _BUCKETS rows
    place = F.row_number().over(W.partitionBy("bucket").orderBy("field", "term")) - 1
    return distinct.withColumn("place", place).join(F.broadcast(base), "bucket").select("field", "term", (F.col("base") + F.col("place")).alias("id"))


def _summed(encoded: DataFrame) -> DataFrame:
    """``id``, ``occ``, ``rec`` summed: every task adds its ranges' partial counts into arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for r in np.unique(ids // RANGE).tolist():
                hit = ids // RANGE == r
                counts = arrays.setdefault(r, np.zeros((2, RANGE), np.int64))
                for row, column in enumerate((2, 3)):
                    np.add.at(counts[row], ids[hit] % RANGE, batch.column(column).to_numpy()[hit])
        for r, counts in arrays.items():
            at = np.flatnonzero(counts[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), int(slot_of(r)), np.int32)), pa.array(at + r * RANGE), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["slot", "id", "occ", "rec"])

    slots = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def slot_of(r: int) -> int:
        return r % slots

    routed = encoded.select((F.expr(f"id div {RANGE}") % slots).cast("int").alias("slot"), "id", "occ", "rec").repartitionById(slots, F.col("slot"))
    return routed.mapInArrow(run, "slot INT, id BIGINT, occ BIGINT, rec BIGINT")


def term_counts(rows: DataFrame) -> DataFrame:
    """``field``, ``term``, ``id``, ``occ``, ``rec`` of every term of :func:`occurrences`."""
    partial = materialize(_blocks(rows), "term-blocks")
    ids = materialize(dictionary(partial), "dictionary")
    encoded = partial.join(ids, ["field", "term"]).select("id", "occ", "rec")
    return _summed(encoded).select("id", "occ", "rec").join(ids, "id").select("field", "term", "id", "occ", "rec")


def marked(counts: DataFrame, n_records: int, common_percent: int = 2) -> DataFrame:
    """``counts`` with ``mark``: 'rare' for one record, 'common' for more than ``common_percent`` percent of all records, else null."""
    mark = F.when(F.col("rec") == 1, "rare").when(F.col("rec") * 100 > common_percent * n_records, "common")
    return counts.withColumn("mark", mark)
