"""Mixtures of sources with target shares, by packed token blocks and permuted indices (p9).

Tokens of each source are packed into blocks of fixed length, task by task in the order in which documents are read: a task counts the tokens of each source while it
encodes, and a prefix sum over tasks gives every document its place, without sorting or moving documents. Tokens move once, to their block. For each output
shard the numbers of slots per source are drawn from a multinomial of the target shares. A source's slots run through all of its
blocks in the order of a pseudorandom permutation before any block comes again, then in the order of another one, and at most
``max_repeats`` times; slots beyond that stay open and are reported. Slots and blocks meet in one equi-join on (source, block), whose rows hold the
tokens. Shares are of tokens: a source's last block may be partly filled.

Defined results: sources are compared without outer blanks and in lower case; documents of unlisted or null sources are left out; null and
empty texts have no tokens; a listed source without documents has size 0; a null share or repeat limit counts as 0; with no
tokens at all nothing is short; a source listed twice counts once in the total. Repeated rows are documents of their own, whatever their keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum.llm.tokens import encode_batch, rank_file, text_runs, token_counts
from maldadum.session import materialize

BLOCK_TOKENS = 2048
#: Listed sources; their table is held by the driver and broadcast.
MAX_SOURCES = 10_000
_FEISTEL_ROUNDS = 4


def plain_source(source: str) -> Column:
    return F.lower(F.regexp_replace(F.col(source), r"(?U)^\s+|\s+$", ""))


def _targets(targets: DataFrame) -> list:
    rows = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats")).where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources")
    return rows


def sized_documents(docs: DataFrame, key: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``key``, plain ``source`` and ``n_tokens`` of every document."""
    named = docs.select(F.col(key), plain_source("source").alias("source"), F.col("text"))
    return token_counts(named, "text", key, "source", vocabulary=vocabulary, folder=folder)


def mix_plan(sized: DataFrame, targets: DataFrame, shards: int = 64, block: int = BLOCK_TOKENS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(report, draws).

    report, one row per listed source: ``source``, ``n_docs``, ``n_tokens``, ``n_blocks``, ``target_share``, ``max_repeats``, ``slots_drawn``,
    ``slots_granted``, ``tokens_granted``, ``actual_share`` (of all granted tokens) and ``short``, whether even all repeats fall below the share.
    draws, one row per shard and source: the first slot number, how many, and the source's blocks. The mixture has as many blocks as
    all listed sources together would fill."""
    spark = sized.sparkSession
    listed = _targets(targets)
    rank = {r.source.strip().lower(): i for i, r in enumerate(listed)}
    wanted = spark.createDataFrame([(k,) for k in rank] or [("",)], "source STRING").where("source <> ''")
    sums = {r.source: r for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).join(F.broadcast(wanted), "source", "left_semi").collect()}
    size = [int(sums[r.source.strip().lower()].t or 0) if r.source.strip().lower() in sums else 0 for r in listed]
    docs = [int(sums[r.source.strip().lower()].n) if r.source.strip().lower() in sums else 0 for r in listed]
    total = sum({r.source.strip().lower(): t for r, t in zip(listed, size)}.values())
    blocks = [-(-t // block) for t in size]
    share = np.array([float(r.share) for r in listed])
    slots = -(-total // block) if share.sum() > 0 else 0
    per_shard = [slots // shards + (i < slots % shards) for i in range(shards)]
    drawn = np.array([np.random.default_rng((seed, i)).multinomial(n, share / share.sum()) for i, n in enumerate(per_shard)]) if slots else np.zeros((shards, len(listed)), int)
    begin = np.cumsum(drawn, axis=0) - drawn
    limit = np.array([b * int(r.repeats) for b, r in zip(blocks, listed)])
    granted = np.clip(limit - begin, 0, drawn) if len(listed) else drawn
    tokens = [_tokens(int(granted[:, i].sum()), size[i], blocks[i], block, _source_key(seed, i)) for i in range(len(listed))]
    report = [(r.source, docs[i], size[i], blocks[i], float(r.share), int(r.repeats), int(drawn[:, i].sum()), int(granted[:, i].sum()), tokens[i],
               tokens[i] / sum(tokens) if sum(tokens) else 0.0, bool(size[i] * int(r.repeats) < float(r.share) * total)) for i, r in enumerate(listed)]
    draws = [(s, r.source.strip().lower(), int(begin[s, i]), int(granted[s, i]), blocks[i], i) for i, r in enumerate(listed) for s in range(shards) if granted[s, i]]
    return (
        spark.createDataFrame(report, "source STRING, n_docs BIGINT, n_tokens BIGINT, n_blocks BIGINT, target_share DOUBLE, max_repeats INT, slots_drawn BIGINT, slots_granted BIGINT, tokens_granted BIGINT, actual_share DOUBLE, short BOOLEAN"),
        spark.createDataFrame(draws, "shard INT, source STRING, first_slot BIGINT, n_slots BIGINT, n_blocks BIGINT, source_no INT"))


def _source_key(seed: int, number: int) -> int:
    return (seed * 1_000_003 + number) * 1_000_003


def _tokens(slots: int, size: int, blocks: int, block: int, key: int) -> int:
    """Tokens in the first ``slots`` slots of a source: all of its blocks are full but the last, which comes once in every full turn."""
    if not blocks:
        return 0
    turns, rest = divmod(slots, blocks)
    last = int(permute(np.array([blocks - 1]), blocks, key + turns, back=True)[0])  # where the last block stands in the turn that is not complete
    missing = blocks * block - size
    return turns * size + rest * block - (missing if last < rest else 0)


def permute(index: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1, or its inverse: a Feistel network over the next even number of bits, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))

    def mixed(x: np.ndarray, r: int) -> np.ndarray:
        h = (x + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) & (2**64 - 1))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(32)) & mask

    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for r in range(_FEISTEL_ROUNDS):
                if back:
                    left, right = right ^ mixed(left, _FEISTEL_ROUNDS - 1 - r), left
                else:
                    left, right = right, left ^ mixed(right, r)
            out[todo] = (left << np.uint64(half)) | right
            todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


#: Slots made in one step.
_STEP = 100_000


def _slots(draws: DataFrame, seed: int) -> DataFrame:
    """``shard``, ``source``, ``slot``, ``turn``, ``block``: ranges of slots are spread over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = min(_STEP, row["n_slots"] - row["lo"])
                slot = row["first_slot"] + row["lo"] + np.arange(n)
                turn = slot // row["n_blocks"]
                at = np.empty(n, np.int64)
                for t in np.unique(turn).tolist():
                    hit = turn == t
                    at[hit] = permute(slot[hit] % row["n_blocks"], row["n_blocks"], _source_key(seed, row["source_no"]) + t)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["source"]] * n), pa.array(slot), pa.array(turn), pa.array(at)], names=["shard", "source", "slot", "turn", "block"])

    ranges = draws.withColumn("lo", F.explode(F.expr(f"sequence(0L, n_slots - 1, {_STEP}L)")))
    return ranges.repartition("shard", "source", "lo").mapInArrow(run, "shard INT, source STRING, slot BIGINT, turn BIGINT, block BIGINT")


#: Places of tasks and sources that go to the executors as a broadcast table (some 30 bytes each); more are joined by a shuffle.
BROADCAST_PLACES = 1_000_000

def encoded_documents(docs: DataFrame, key: str, targets: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``task``, ``key``, plain ``source``, ``n_tokens``, ``begin`` (tokens of the source that the task met before) and ``ids`` of every document of a listed source,
    written once."""
    spark = docs.sparkSession
    listed = spark.createDataFrame([(r.source.strip().lower(),) for r in _targets(targets)] or [("",)], "source STRING").distinct()
    named = docs.select(F.col(key).alias("key"), plain_source("source").alias("source"), F.col("text")).join(F.broadcast(listed), "source", "left_semi").select("key", "source", "text")
    path = rank_file(spark, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get().partitionId(), {}
        for batch in batches:
            texts, sources = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_runs(texts):
                ids = encode_batch(texts[lo:hi], path)
                n = np.diff(np.asarray(ids.offsets))
                begin = []
                for source, size in zip(sources[lo:hi], n.tolist()):
                    begin.append(met.get(source, 0))
                    met[source] = begin[-1] + size
                yield pa.RecordBatch.from_arrays([pa.array([task] * (hi - lo), pa.int32()), batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(begin, pa.int64()), ids],
                                                 names=["task", "key", "source", "n_tokens", "begin", "ids"])

    kind_of_key = named.schema["key"].dataType.simpleString()
    return materialize(named.mapInArrow(run, f"task INT, key {kind_of_key}, source STRING, n_tokens BIGINT, begin BIGINT, ids ARRAY<INT>"), "encoded")


def packed(encoded: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """Which tokens of which document fill each block: the columns of ``encoded`` but its place, ``block``, ``token_from``, ``token_to`` (exclusive) and ``at``, where in the block."""
    sums = encoded.groupBy("task", "source").agg(F.sum("n_tokens").alias("t"))
    base = materialize(sums.select("task", "source", (F.sum("t").over(W.partitionBy("source").orderBy("task")) - F.col("t")).alias("base")), "places")  # a row per task and source
    base = F.broadcast(base) if base.count() <= BROADCAST_PLACES else base
    placed = encoded.where("n_tokens > 0").join(base, ["task", "source"]).withColumn("lo", F.col("base") + F.col("begin")).withColumn("hi", F.col("lo") + F.col("n_tokens"))
    b = F.lit(block)
    parts = placed.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    begin = F.greatest(F.col("lo"), F.col("block") * b)
    return parts.select(*[c for c in encoded.columns if c not in ("task", "begin", "n_tokens")], "block", (begin - F.col("lo")).alias("token_from"), (F.least(F.col("hi"), (F.col("block") + 1) * b) - F.col("lo")).alias("token_to"), (begin - F.col("block") * b).cast("int").alias("at"))


def filled(encoded: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """The blocks of all sources: ``source``, ``block``, ``ids`` and ``parts``, which tokens of which documents they are."""
    n = (F.col("token_to") - F.col("token_from")).cast("int")
    cut = packed(encoded, block).withColumn("ids", F.slice("ids", F.col("token_from").cast("int") + 1, n))
    whole = cut.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "key", "token_from", "token_to", "ids"))).alias("p"))  # at most ``block`` tokens
    return whole.select("source", "block", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["key"].alias("key"), x["token_from"].alias("token_from"), x["token_to"].alias("token_to"))).alias("parts"))


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", shards: int = 64, block: int = BLOCK_TOKENS, seed: int = 42, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report): the mixture has one row per granted slot: ``shard``, ``source``, ``slot``, ``turn`` (repeats so far), ``block``, its tokens ``ids`` and
    ``parts``, which tokens of which documents they are (``key``, ``token_from``, ``token_to``)."""
    encoded = encoded_documents(docs, key, targets, vocabulary, folder)
    report, draws = mix_plan(encoded.select("source", "n_tokens"), targets, shards, block, seed)
    return _slots(draws, seed).join(filled(encoded, block), ["source", "block"]).select("shard", "source", "slot", "turn", "block", "ids", "parts"), report
