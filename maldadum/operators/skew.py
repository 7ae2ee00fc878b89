"""Per-key work without the imbalance of a few keys that hold most rows: fragment-replicate by estimated load.

The load of every key is counted with map-side partial aggregates. Keys above a fair share are *large*: there are at most
``LARGE_PER_TASK`` x tasks of them, whatever the data, so their list may be held by the driver. All other keys fall into a
fixed number of hash buckets. Large keys are cut into shards in proportion to their load, and shards and buckets are packed
to tasks, heaviest first onto the least loaded. Rows go to the task of their key or shard by ``repartitionById``; the other
side of a join is replicated to just the tasks of its key's shards. Grouping and joining then need no further exchange of rows,
only of one partial result per key and shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

LARGE_PER_TASK = 4
BUCKETS_PER_TASK = 16


@dataclass(frozen=True)
class ShardPlan:
    """Where the rows of each key go. ``large`` maps key values to (tasks of the shards); ``bucket_task`` the rest."""

    keys: tuple[str, ...]
    tasks: int
    total: int
    large: dict[tuple, list[int]]
    bucket_task: list[int]
    task_load: list[float]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(len(self.bucket_task))).cast("int")

    def _shards(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        spark = df.sparkSession
        fields = [T.StructField(f"_k{i}", schema[k].dataType) for i, k in enumerate(self.keys)]
        rows = [(*key, tasks) for key, tasks in self.large.items()]
        known = spark.createDataFrame(rows, T.StructType([*fields, T.StructField("_tasks", T.ArrayType(T.IntegerType()))]))
        same = [F.col(f"_k{i}").eqNullSafe(df[k]) for i, k in enumerate(self.keys)]
        on = same[0]
        for x in same[1:]:
            on = on & x
        joined = df.join(F.broadcast(known), on, "left").drop(*[f"_k{i}" for i in range(len(self.keys))])
        of_bucket = F.split(F.lit(",".join(map(str, self.bucket_task))), ",").cast("array<int>")  # folded into one constant
        return joined.withColumn("_bucket_task", F.get(of_bucket, self._bucket()))

    def scatter(self, df: DataFrame, spread: Column) -> DataFrame:
        """Rows of the large side, each on one task: ``_task``. Rows with equal ``spread`` and key stay together."""
        shard = F.get(F.col("_tasks"), F.pmod(spread, F.size("_tasks")).cast("int"))
        return self._shards(df, df.schema).withColumn("_task", F.coalesce(shard, F.col("_bucket_task"))).drop("_tasks", "_bucket_task").repartitionById(self.tasks, F.col("_task"))

    def replicate(self, df: DataFrame) -> DataFrame:
        """Rows of the matching side, once on every task that holds a shard of their key."""
        to = F.when(F.col("_tasks").isNull(), F.array("_bucket_task")).otherwise(F.array_distinct("_tasks"))
        return self._shards(df, df.schema).withColumn("_task", F.explode(to)).drop("_tasks", "_bucket_task").repartitionById(self.tasks, F.col("_task"))


def plan_shards(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> ShardPlan:
    """Count the loads of ``keys`` in ``df`` and pack them to ``tasks`` (the session's shuffle partitions unless given)."""
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_TASK * tasks
    cols = [F.col(k) for k in keys]
    loads = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_load"))
    bucket = F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")
    # one pass over the loads: bucket sums, and the keys above a fair share of the rows, at most ``fair`` of them
    fair = LARGE_PER_TASK * tasks
    rows = df.count()
    at_least = max(2, rows // fair)
    keyed = loads.select(bucket.alias("b"), F.col("_load"), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
    sums = keyed.groupBy("b").agg(F.sum("_load").alias("load"), F.collect_list(F.when(F.col("_load") >= at_least, F.struct("key", "_load"))).alias("large")).collect()
    total = sum(r.load for r in sums)
    bucket_load = [0.0] * buckets
    large: dict[tuple, int] = {}
    for r in sums:
        bucket_load[r.b] = float(r.load - sum(x._load for x in r.large))
        large |= {tuple(x.key): int(x._load) for x in r.large}
    share = max(1.0, total / tasks)
    pieces: list[tuple[float, tuple | None, int]] = [(load, None, b) for b, load in enumerate(bucket_load)]
    shard_tasks: dict[tuple, list[int]] = {k: [] for k in large}
    for key, load in large.items():
        n = max(1, min(tasks, -(-2 * load // int(share))))
        pieces += [(load / n, key, -1)] * n
    heap = [(0.0, t) for t in range(tasks)]
    bucket_task, task_load = [0] * buckets, [0.0] * tasks
    for load, key, b in sorted(pieces, key=lambda p: -p[0]):
        have, t = heapq.heappop(heap)
        heapq.heappush(heap, (have + load, t))
        task_load[t] += load
        if key is None:
            bucket_task[b] = t
        else:
            shard_tasks[key].append(t)
    return ShardPlan(tuple(keys), tasks, int(total), shard_tasks, bucket_task, task_load)


def pair_details(entries: DataFrame, edges: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Counts and details of every (``err_text``, ``cor_text``) pair of error entries.

    :param entries: one row per entry: ``record``, ``err_text``, ``cor_text``, ``edit_distance``, ``kind``, ``source``; texts are
        compared as stored, and null and empty ones are kept as values of their own, so that totals are whole.
    :param edges: confusion edges (``src``, ``replacement``, ``frequency``), the matching side; may hold a pair many times.

    Result, one row per pair: ``n_entries``, ``n_records``, ``n_tags``, ``n_counts``, ``n_raw``, ``sum_distance``, ``n_sources``,
    ``n_edges`` and ``edge_frequency`` BIGINT, and ``n_total`` BIGINT, the number of all entries. No rows for no entries."""
    plan = plan_shards(entries, ("err_text", "cor_text"), tasks)
    rows = plan.scatter(entries, F.xxhash64("record"))  # one record's entries of a pair stay together
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("tags", "counts", "raw")]
    per_record = rows.groupBy("_task", "err_text", "cor_text", "record").agg(
        F.count(F.lit(1)).alias("n"), *kinds, F.sum(F.col("edit_distance").cast("bigint")).alias("distance"), F.min("source").alias("source"))
    per_source = per_record.groupBy("_task", "err_text", "cor_text", "source").agg(
        F.sum("n").alias("n_entries"), F.count(F.lit(1)).alias("n_records"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in ("tags", "counts", "raw")], F.sum("distance").alias("sum_distance"))
    sums = ("n_entries", "n_records", "n_tags", "n_counts", "n_raw", "sum_distance")
    if edges is not None:
        # the pair's edges are wanted once, though every shard of the pair holds them
        by_pair = edges.groupBy(F.col("src").alias("err_text"), F.col("replacement").alias("cor_text")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("frequency").alias("edge_frequency"))
        per_source = per_source.join(plan.replicate(by_pair.where("err_text is not null and cor_text is not null")), ["_task", "err_text", "cor_text"], "left")
    else:
        per_source = per_source.withColumns({"n_edges": F.lit(None).cast("bigint"), "edge_frequency": F.lit(None).cast("bigint")})
    # what is left is one row per pair, source and shard
    sums = [F.sum(c).alias(c) for c in ("n_entries", "n_records", "n_tags", "n_counts", "n_raw", "sum_distance")]
    once = [F.max(c).alias(c) for c in ("n_edges", "edge_frequency")]
    by_source = per_source.groupBy("err_text", "cor_text", "source").agg(*sums, *once)
    return by_source.groupBy("err_text", "cor_text").agg(*sums, F.count("source").alias("n_sources"), *once).withColumns(
        {"n_edges": F.coalesce("n_edges", F.lit(0)).cast("bigint"), "n_total": F.lit(plan.total).cast("bigint")})


def error_entries(records: DataFrame) -> DataFrame:
    """One row per entry of ``errors`` of a table with one row per record: ``record``, ``source``, ``err_pos``, the texts, ``edit_distance``, ``kind``."""
    exploded = records.select("record", F.trim(F.upper("source")).alias("source"), F.posexplode("errors").alias("err_pos", "e"))
    return exploded.select("record", "source", "err_pos", *[F.col(f"e.{c}").alias(c) for c in ("err_text", "cor_text", "edit_distance")], F.col("e.err_details.kind").alias("kind"))
