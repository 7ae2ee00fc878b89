"""Items that appear together: exact pair counts against a fitted bipartite null (p5).

Pairs are counted inside tasks: a basket's item ids make all of its pairs as integers, counted in arrays over many baskets before
anything is shuffled. Items that cannot be part of a wanted pair are left out first, which changes no count: with c together, c is at
most each item's own count, so c >= m and c*N >= L*a*b imply a >= m and a <= N / L.

The null keeps each item's expected frequency and each basket's expected size: item i is in basket k with probability
x_i y_k / (1 + x_i y_k), fitted so that both margins hold. Items of one frequency share x and baskets of one size share y, so the
fit works on bins of frequencies and sizes only, exact ones up to 1,024. The count of a pair is then a sum of independent Bernoulli variables, and
the tail of that Poisson-binomial law is taken by a saddlepoint; Benjamini-Hochberg over all possible pairs gives q-values.

Defined results: an item counts once per basket; null items, null and empty texts hold nothing; all baskets count in N, empty ones too;
no items or baskets give no rows. Texts are taken whole, and a very long basket's pairs are made in slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum.session import materialize

#: Items up to this number go to the executors as a broadcast table; more are joined by a salted shuffle.
BROADCAST_ITEMS = 1_000_000
#: Distinct pairs counted in a task before partial counts leave it.
HELD_PAIRS = 2_000_000
_SALTS = 32
WORD = "[가-힣A-Za-z0-9]+"


def memberships(baskets: DataFrame, text: str, items: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(baskets with their items, item frequencies, number of all baskets).

    The first has one row per basket that holds an item (``record``, ``items``); words that are no items are left out before anything is shuffled. Both are
    written once."""
    words = baskets.select("record", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))).alias("item"))
    items = materialize(items.where("item is not null").select("item").distinct(), "items")
    if items.count() <= BROADCAST_ITEMS:
        known = words.join(F.broadcast(items), "item")
    else:
        salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        known = words.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(_SALTS)).cast("int")).join(salted, ["item", "salt"])
    held = materialize(known.groupBy("record").agg(F.array_sort(F.collect_set("item")).alias("items")), "baskets")
    frequency = held.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return held, materialize(frequency, "frequency"), baskets.select("record").distinct().count()


def _pairs(held: DataFrame, numbered: DataFrame) -> DataFrame:
    """``a``, ``b`` (item numbers, a < b), ``c``: exact counts over all baskets of ``record``, ``items``."""
    ids = held.select("record", F.explode("items").alias("item"))
    if numbered.count() <= BROADCAST_ITEMS:
        coded = ids.join(F.broadcast(numbered), "item")
    else:
        salted = numbered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        coded = ids.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(_SALTS)).cast("int")).join(salted, ["item", "salt"])
    lists = coded.groupBy("record").agg(F.array_sort(F.collect_list("no")).alias("nos")).where("size(nos) > 1").select("nos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        n = 0

        def merge() -> None:
            nonlocal keys, counts, fresh, n
            new, add = np.unique(np.concatenate(fresh), return_counts=True)
            both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, add]).astype(np.float64), len(both)).astype(np.int64)
            keys, fresh, n = both, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), 100_000):
                k = keys[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), pa.array(counts[lo : lo + 100_000])], names=["a", "b", "c"])

        for batch in batches:
            column = batch.column(0)
            ends = np.asarray(column.offsets)
            flat = column.values.to_numpy(zero_copy_only=False)
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                row = flat[lo:hi]
                step = max(1, HELD_PAIRS // len(row))
                for s in range(0, len(row), step):  # a slice of firsts against all that follow them
                    first = np.arange(s, min(len(row), s + step))
                    n_after = len(row) - 1 - first
                    i = np.repeat(first, n_after)
                    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n_after) - n_after, n_after)
                    fresh.append((row[i] << 32) | row[j])
                    n += len(i)
                    if n >= HELD_PAIRS:
                        merge()
                        if len(keys) > HELD_PAIRS:
                            yield from flush()
                            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if fresh:
            merge()
        yield from flush()

    partial = lists.mapInArrow(run, "a BIGINT, b BIGINT, c BIGINT")
    return partial.groupBy("a", "b").agg(F.sum("c").alias("c"))


def _counted(held: DataFrame, frequency: DataFrame, total: int, min_together: int, min_lift: int) -> DataFrame:
    eligible = frequency.where((F.col("n") >= min_together) & (F.col("n") * min_lift <= total))
    bucket = F.pmod(F.xxhash64("item"), F.lit(1024))
    counts = eligible.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("size"))
    base = counts.select("bucket", (F.sum("size").over(W.orderBy("bucket")) - F.col("size")).alias("base"))  # 1,024 rows
    place = F.row_number().over(W.partitionBy("bucket").orderBy("item")) - 1
    numbered = materialize(eligible.withColumn("bucket", bucket).withColumn("place", place).join(F.broadcast(base), "bucket").select("item", "n", (F.col("base") + F.col("place")).cast("bigint").alias("no")), "numbered")
    pairs = _pairs(held, numbered.select("item", "no")).where(F.col("c") >= min_together)
    a = numbered.select(F.col("no").alias("a"), F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = numbered.select(F.col("no").alias("b"), F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    wide = lambda x: x.cast("decimal(19,0)")  # noqa: E731 - products beyond 64 bits
    enough = wide(F.col("c")) * wide(F.lit(total)) >= wide(F.lit(min_lift) * F.col("n_a")) * wide(F.col("n_b"))
    named = pairs.join(a, "a").join(b, "b").where(enough)
    smaller = F.col("item_a") < F.col("item_b")
    return named.select(
        F.least("item_a", "item_b").alias("term_a"), F.greatest("item_a", "item_b").alias("term_b"),
        F.when(smaller, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(smaller, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
        F.col("c").alias("n_both"), F.lit(total).cast("bigint").alias("n_total"))


def pair_counts(baskets: DataFrame, text: str, items: DataFrame, min_together: int = 5, min_lift: int = 8) -> DataFrame:
    """``term_a`` < ``term_b`` found together in c >= ``min_together`` baskets with c*N >= ``min_lift``*a*b, and ``n_a``, ``n_b``, ``n_both``, ``n_total``."""
    held, frequency, total = memberships(baskets, text, items)
    return _counted(held, frequency, total, min_together, min_lift)


#: Frequencies and sizes up to this are told apart; larger ones share a bin if they differ by less than one part in _FINE.
_EXACT, _FINE = 1024, 64


def bins(n: Column) -> Column:
    """The bin of a frequency or size: about 2,000 bins for counts up to 10^11."""
    return F.when(n <= _EXACT, n.cast("double")).otherwise(_EXACT + F.ceil(F.log(n / F.lit(float(_EXACT))) * _FINE))


def _margins(counts: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, mean of the bin, how many are in it), by bin; a row per bin comes to the driver."""
    rows = counts.groupBy(bins(F.col(column)).alias("bin")).agg(F.avg(column).alias("mean"), F.count(F.lit(1)).alias("many")).orderBy("bin").collect()
    return tuple(np.array([float(r[i]) for r in rows]) for i in range(3))


def fit_null(item_degree: np.ndarray, item_many: np.ndarray, basket_size: np.ndarray, basket_many: np.ndarray, rounds: int = 2000, near: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """x of each item frequency and y of each basket size, such that expected frequencies and sizes equal the given ones.

    Refused with an error if the margins are not met to one part in a thousand after ``rounds``, as where an item is in all baskets."""
    incidences = max(1.0, float((item_degree * item_many).sum()))
    x, y = item_degree / math.sqrt(incidences), basket_size / math.sqrt(incidences)
    for _ in range(rounds):
        new_x = item_degree / (basket_many * y / (1 + np.outer(x, y))).sum(axis=1)
        new_y = basket_size / (item_many[:, None] * new_x[:, None] / (1 + np.outer(new_x, y))).sum(axis=0)
        done = max(np.abs(new_x / x - 1).max(), np.abs(new_y / y - 1).max()) < near
        x, y = new_x, new_y
        if done:
            break
    p = np.outer(x, y) / (1 + np.outer(x, y))
    off = max(np.abs(p @ basket_many / item_degree - 1).max(), np.abs(item_many @ p / basket_size - 1).max())
    if not off < 1e-3:
        raise ArithmeticError(f"the null does not meet the margins: off by {off:.3g} after {rounds} rounds")
    return x, y


def tail(p: np.ndarray, many: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 of P(X >= c) for X a sum of independent Bernoulli(p[r, k]), each ``many[k]`` times, by the Lugannani-Rice saddlepoint."""
    mean = p @ many
    point = c - 0.5  # continuity
    s = np.log(np.maximum(point, 0.5) / np.maximum(mean, 1e-12))
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(60):
            q = p * np.exp(s)[:, None]
            q = q / (1 - p + q)
            gap, slope = q @ many - point, (q * (1 - q)) @ many
            step = np.clip(gap / np.maximum(slope, 1e-12), -1, 1)
            s = s - step
            if np.abs(step).max(initial=0) < 1e-10:
                break
        k = np.log1p(p * np.expm1(s)[:, None]) @ many
        w = np.sign(s) * np.sqrt(np.maximum(2 * (s * point - k), 0))
        u = 2 * np.sinh(s / 2) * np.sqrt(np.maximum(slope, 1e-300))
    near = np.abs(w) < 1e-4
    w_, u_ = np.where(near, 1.0, w), np.where(near, 1.0, u)
    upper = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in w_])
    density = np.exp(-w_ * w_ / 2) / math.sqrt(2 * math.pi)
    value = np.where(near, 0.5, upper + density * (1 / u_ - 1 / w_))
    # far out both terms underflow: log of the density and the leading term of the bracket
    far = -w_ * w_ / 2 / math.log(10) - math.log10(math.sqrt(2 * math.pi)) - np.log10(np.maximum(u_, 1e-300))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w_ > 25, far, np.log10(np.clip(value, 1e-300, 1.0)))


def surprise(baskets: DataFrame, text: str, items: DataFrame, min_together: int = 5) -> DataFrame:
    """Pairs as :func:`pair_counts` without a lift limit, with ``expected`` under the null, ``lift`` (observed by expected), ``log10_p`` of the upper
    tail and ``log10_q`` after Benjamini-Hochberg over all pairs of items that occur: every pair found together at all has its rank, and those
    found together ``min_together`` times are returned."""
    held, frequency, total = memberships(baskets, text, items)
    d_bin, d, dm = _margins(frequency, "n")
    _, k, km = _margins(held.select(F.size("items").alias("k")).where("k > 0"), "k")
    pairs = _counted(held, frequency, total, 1, 0)
    x, y = fit_null(d, dm, k, km) if len(d) else (d, k)
    n_items = int(dm.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                a, b, c, at_a, at_b = (part.column(part.schema.get_field_index(n)).to_numpy() for n in ("n_a", "n_b", "n_both", "bin_a", "bin_b"))
                of = lambda n, at: (x / d)[np.searchsorted(d_bin, at)] * n  # noqa: E731 - in a bin x goes with the frequency
                xa, xb = of(a, at_a), of(b, at_b)
                p = (np.outer(xa, y) / (1 + np.outer(xa, y))) * (np.outer(xb, y) / (1 + np.outer(xb, y)))
                expected = p @ km
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(expected), pa.array(c / expected), pa.array(tail(p, km, c.astype(float)))], names=[*part.schema.names[:6], "expected", "lift", "log10_p"])

    schema = "term_a STRING, term_b STRING, n_a BIGINT, n_b BIGINT, n_both BIGINT, n_total BIGINT, expected DOUBLE, lift DOUBLE, log10_p DOUBLE"
    scored = materialize(pairs.withColumns({"bin_a": bins(F.col("n_a")), "bin_b": bins(F.col("n_b"))}).mapInArrow(run, schema), "surprise")
    # Benjamini-Hochberg by a histogram of log10 p: its ranks are sums over bins, exact at the bins' upper edges
    found = scored.groupBy(F.ceil(F.col("log10_p") * 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.sum("n").over(W.orderBy("bin"))
    at = found.withColumn("q", F.least(F.lit(0.0), F.col("bin") / 100 + F.log10(F.lit(max(1.0, n_items * (n_items - 1) / 2))) - F.log10(rank)))
    q = at.withColumn("log10_q", F.min("q").over(W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))).select("bin", "log10_q")
    return scored.where(F.col("n_both") >= min_together).withColumn("bin", F.ceil(F.col("log10_p") * 100)).join(q, "bin").drop("bin")
