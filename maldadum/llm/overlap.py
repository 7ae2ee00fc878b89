"""Same and almost the same records across splits: winnowed fingerprints, seeds, chains and alignment (p6).

Texts are compared in lower case without white space and punctuation. Two texts are almost the same if the longer one becomes the other
by at most ``percent`` percent of its length in single-character edits.

Fingerprints (winnowing): of all windows of ``span`` characters the smallest gram is selected, in one order of all grams, rarer ones first,
then by rolling hash. A text of ``span * (edits + 1)`` characters keeps at least one of that many disjoint windows unchanged in every text that
is close enough, and an unchanged window selects the same gram in both. So each text is cut by the widest span that its length allows; one
side of a join offers the selected grams of all of its windows, the other probes with those of ``edits + 1`` disjoint windows only, the cheapest
ones by dynamic programming over pieces of bounded size.

Seeds are joined across splits where offset, length and character sets allow the distance. The seeds of a pair are chained: windows that no
collinear chain passes have an edit of their own, so a pair whose longest chain leaves out more windows than there are edits is no match. Those that stay are
extended by alignment from their seeds to both ends of the two texts, within the edits that are left; since one window is unchanged, the best seed gives
the exact distance.

Skew: expected hits come from a count table of fixed size. Keys above a fair load are cut into shards on the offering side and
replicated on the probing side. Copies of a text are one class and compared once; rows of hot classes are sharded when row pairs are wanted, and reports
are made from classes without row pairs.

Defined results: null, empty and blank texts match nothing; a text of punctuation only equals others such; rows with a null split
match nothing; rows of one split are never paired; repeated rows give a pair each; no rows give no rows. Whole texts are compared. Texts are
told apart by a 64-bit hash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum.operators.skew import plan_shards
from maldadum.session import materialize

#: Buckets of the gram count table; it is 4 bytes a bucket in every task and 8 on the driver, whatever the data.
COUNT_BUCKETS = 1 << 20
#: Characters of a text for which windows are chosen together, and cells of the table in which they are.
PIECE, CELLS = 160, 4_000_000
#: Seeds of a pair from which it is extended; a pair of more seeds is aligned as a whole, which gives the same distance.
SEEDS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64(COUNT_BUCKETS - 1)


def plain_text(text: str) -> Column:
    return F.regexp_replace(F.lower(F.col(text)), r"(?U)[\s\p{P}]+", "")


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.fromiter(map(len, texts), np.int64, len(texts))


def _signatures(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Two 64-bit words per text: which of 128 bins its characters fall into."""
    with np.errstate(over="ignore"):
        bins = ((codes * _MIX) >> np.uint64(57)).astype(np.int64)
    seen = np.zeros((len(lengths), 128), bool)
    seen[np.repeat(np.arange(len(lengths)), lengths), bins] = True
    return np.packbits(seen, axis=1).view(np.int64)


def _allowed(length: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Edits allowed between a text of this length and the longest text that it may match."""
    return (length * 100 // (100 - percent)) * percent // 100


def _span(length: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Characters of a window, so that one more window than edits fit into the text; 0 where only equal texts match."""
    edits = _allowed(length, percent)
    return np.where(edits > 0, np.minimum(length // (edits + 1), 12), 0)


def _gram(span: int) -> int:
    """Characters of a gram in windows of ``span`` characters."""
    return span if span <= 3 else span - span // 3


@dataclass(frozen=True)
class Fingerprints:
    """Windows of one span in texts laid end to end: where each begins, where its smallest gram begins, and that gram's hash and count."""

    window: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    cost: np.ndarray


def _grams(codes: np.ndarray, span: int) -> np.ndarray:
    """Rolling hash of the gram from each place on; the last places are cut off."""
    size = _gram(span)
    n = max(0, len(codes) - size + 1)
    h = np.full(n, span, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = (h ^ codes[i : i + n]) * _MIX
            h ^= h >> np.uint64(31)
    return h


def _windows(codes: np.ndarray, lengths: np.ndarray, which: np.ndarray, span: int) -> np.ndarray:
    """Places at which a window of the texts ``which`` begins."""
    ends = np.cumsum(lengths)
    room = np.repeat(np.where(which, ends, 0), lengths) - np.arange(len(codes))
    return np.flatnonzero(room >= span)


def winnowed(codes: np.ndarray, lengths: np.ndarray, which: np.ndarray, span: int, counts: np.ndarray) -> Fingerprints:
    """The smallest gram of every window; of equal ones the last."""
    h = _grams(codes, span)
    load = counts[(h & _MASK).astype(np.int64)]
    window = _windows(codes, lengths, which, span)
    place = window.copy()
    for step in range(1, span - _gram(span) + 1):
        other = window + step
        smaller = (load[other] < load[place]) | (load[other] == load[place]) & (h[other] <= h[place])
        place = np.where(smaller, other, place)
    return Fingerprints(window, place, h[place], load[place])


def _offered_spans(lengths: np.ndarray, percent: int) -> dict[int, np.ndarray]:
    """For each span the texts that a text cut by it may match."""
    out: dict[int, np.ndarray] = {}
    for length in np.unique(lengths).tolist():
        edits = int(_allowed(length, percent))
        partners = np.arange(max(1, length - edits), length + edits + 1)
        for span in np.unique(_span(partners, percent)).tolist():
            if span:
                out.setdefault(span, np.zeros(len(lengths), bool))[lengths == length] = True
    return out


def _cheapest(cost: np.ndarray, span: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of ``need`` disjoint windows per row whose costs add up to the least; ``cost`` has a row per text and a column per window."""
    rows, n = cost.shape
    length = n + span - 1
    best = np.full((length + 1, need + 1, rows), np.inf, np.float32)
    best[:, 0] = 0
    for end in range(1, length + 1):
        best[end, 1:] = best[end - 1, 1:]
        if end >= span:
            np.minimum(best[end, 1:], best[end - span, :-1] + cost[:, end - span], out=best[end, 1:])
    at, end, left = np.arange(rows), np.full(rows, length), np.full(rows, need)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while (left > 0).any():
        todo = left > 0
        skip = todo & (best[np.maximum(end - 1, 0), left, at] <= best[end, left, at])
        take = todo & ~skip
        found.append((at[take], end[take] - span))
        end = np.where(skip, end - 1, np.where(take, end - span, end))
        left = left - take
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _probes(codes: np.ndarray, lengths: np.ndarray, counts: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(span, text, place, hash) of the windows that texts probe with, one more than edits are allowed."""
    starts = np.cumsum(lengths) - lengths
    spans = _span(lengths, percent)
    for span in np.unique(spans[spans > 0]).tolist():
        which = spans == span
        prints = winnowed(codes, lengths, which, span, counts)
        row_of = np.full(len(codes) + 1, -1, np.int64)
        row_of[prints.window] = np.arange(len(prints.window))
        pieces: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (length, windows wanted): text and begin of each piece
        for t in np.flatnonzero(which).tolist():
            length, need = int(lengths[t]), int(_allowed(int(lengths[t]), percent)) + 1
            n = -(-length // PIECE)
            cuts = [length * i // n for i in range(n + 1)]
            shares = [-(-need * (b - a) // length) for a, b in zip(cuts, cuts[1:])]
            if any(s * span > b - a for s, a, b in zip(shares, cuts, cuts[1:])):
                cuts, shares = [0, length], [need]
            for share, a, b in zip(shares, cuts, cuts[1:]):
                pieces.setdefault((b - a, share), []).append((t, a))
        for (length, need), some in pieces.items():
            step = max(1, CELLS // ((length + 1) * (need + 1)))
            for lo in range(0, len(some), step):
                text = np.array([x[0] for x in some[lo : lo + step]])
                begin = starts[text] + np.array([x[1] for x in some[lo : lo + step]])
                cost = prints.cost[row_of[begin[:, None] + np.arange(length - span + 1)]].astype(np.float32) + 1
                row, window = _cheapest(cost, span, need)
                chosen = row_of[begin[row] + window]
                yield span, text[row], prints.place[chosen] - starts[text[row]], prints.hash[chosen]


def _offers(codes: np.ndarray, lengths: np.ndarray, counts: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(span, text, place, hash) of the smallest grams of all windows."""
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for span, which in _offered_spans(lengths, percent).items():
        prints = winnowed(codes, lengths, which, span, counts)
        place, first = np.unique(prints.place, return_index=True)
        if len(place):
            text = owner[place]
            yield span, text, place - starts[text], prints.hash[first]


def _slices(batch: pa.RecordBatch, chars: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of about ``chars`` characters, and their texts."""
    texts = batch.column(batch.schema.get_field_index("form")).to_pylist()
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, total = i + 1, 0


def _count_table(texts: DataFrame, percent: int) -> np.ndarray:
    """How many offered grams fall into each bucket; summed in the tasks, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            for _, forms in _slices(batch):
                codes, lengths = _characters(forms)
                for span, which in _offered_spans(lengths, percent).items():
                    h = _grams(codes, span)
                    at = _windows(codes, lengths, which, _gram(span))
                    counts += np.bincount((h[at] & _MASK).astype(np.int64), minlength=COUNT_BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    rows = texts.select("form").mapInArrow(run, "bucket BIGINT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(COUNT_BUCKETS, np.int64)
    got = rows.toPandas()  # at most COUNT_BUCKETS rows
    table[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return table


def _seeds(texts: DataFrame, probing: bool, counts: np.ndarray, fair: int, percent: int, probed: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of one side: ``key`` (gram and shard), ``bucket``, ``id``, ``place``, ``length``, ``s0``, ``s1``, ``rank``.

    :param probed: whether any text probes with a gram of the bucket; the offering side leaves out grams of all other buckets."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(counts.astype(np.float32))  # COUNT_BUCKETS x 4 bytes
    asked = spark.sparkContext.broadcast(probed)  # COUNT_BUCKETS x 1 byte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = shared.value
        shards_of = np.maximum(1, np.ceil(load.astype(np.float64) / fair)).astype(np.int64)
        for batch in batches:
            for part, forms in _slices(batch):
                codes, lengths = _characters(forms)
                signatures = _signatures(codes, lengths)
                ids, ranks = part.column(0).to_numpy(), part.column(2).to_numpy()
                for _, t, place, h in (_probes if probing else _offers)(codes, lengths, load, percent):
                    if not probing:
                        keep = asked.value[(h & _MASK).astype(np.int64)]
                        t, place, h = t[keep], place[keep], h[keep]
                    if not len(t):
                        continue
                    shards = shards_of[(h & _MASK).astype(np.int64)]
                    if probing:  # once per shard of the key
                        again = np.repeat(np.arange(len(t)), shards)
                        shard = np.arange(len(again)) - np.repeat(np.cumsum(shards) - shards, shards)
                        t, place, h = t[again], place[again], h[again]
                    else:
                        shard = (ids[t] & 0x7FFFFFFF) % shards
                    bucket = (h & _MASK).astype(np.int32)
                    with np.errstate(over="ignore"):
                        key = ((h ^ shard.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * _MIX).view(np.int64)
                    for lo in range(0, len(t), 200_000):
                        x, s = t[lo : lo + 200_000], slice(lo, lo + 200_000)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(key[s]), pa.array(bucket[s]), pa.array(ids[x]), pa.array(place[s].astype(np.int32)), pa.array(lengths[x].astype(np.int32)),
                            pa.array(signatures[x, 0]), pa.array(signatures[x, 1]), pa.array(ranks[x])], names=["key", "bucket", "id", "place", "length", "s0", "s1", "rank"])

    side = texts.select("id", "form", F.col("low" if probing else "high").alias("rank"))
    return side.mapInArrow(run, "key BIGINT, bucket INT, id BIGINT, place INT, length INT, s0 BIGINT, s1 BIGINT, rank INT")


def longest_chain(seeds: list[tuple[int, int]]) -> int:
    """Seeds (place, other place) of the longest collinear chain, in which both places grow."""
    ends: list[int] = []
    for _, other in sorted(seeds, key=lambda s: (s[0], -s[1])):
        at = bisect_left(ends, other)
        ends[at : at + 1] = [other]
    return len(ends)


def _chained(seeds: DataFrame, percent: int) -> DataFrame:
    """``id_a``, ``id_b``, ``edits`` (allowed), ``chain`` and ``seeds`` of the pairs whose windows outside of the longest chain are no more than the edits."""
    pairs = seeds.groupBy(F.col("id").alias("id_a"), F.col("o_id").alias("id_b")).agg(F.first("length").alias("length"), F.first("o_length").alias("o_length"), F.collect_set(F.struct("place", "o_place")).alias("seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy().astype(np.int64)
            edits = np.maximum(lengths, batch.column(3).to_numpy()) * percent // 100
            windows = _allowed(lengths, percent) + 1
            column = batch.column(4)
            at, flat = np.asarray(column.offsets), column.values
            places, others = flat.field(0).to_numpy().tolist(), flat.field(1).to_numpy().tolist()
            chain = np.array([1 if b - a == 1 else longest_chain(list(zip(places[a:b], others[a:b]))) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.int64)
            keep = pa.array(np.flatnonzero(windows - chain <= edits))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(edits.astype(np.int32)).take(keep), pa.array(chain.astype(np.int32)).take(keep), column.take(keep)], names=["id_a", "id_b", "edits", "chain", "seeds"])

    return pairs.mapInArrow(run, "id_a BIGINT, id_b BIGINT, edits INT, chain INT, seeds ARRAY<STRUCT<place: INT, o_place: INT>>")


def _extended(pairs: DataFrame) -> Column:
    """Distance of the two forms by alignment from each seed to both ends, the best of them; null beyond ``edits``."""
    a, b, edits = F.col("form_a"), F.col("form_b"), F.col("edits")
    within = lambda x, y: F.call_function("levenshtein", x, y, edits)  # noqa: E731 - -1 beyond the edits

    def through(seed: Column) -> Column:
        before = within(F.substring(a, F.lit(1), seed["place"]), F.substring(b, F.lit(1), seed["o_place"]))
        after = within(F.substring(a, seed["place"] + 1, F.length(a)), F.substring(b, seed["o_place"] + 1, F.length(b)))
        return F.when((before >= 0) & (after >= 0), before + after)

    whole = within(a, b)
    return F.when(F.size("seeds") <= SEEDS, F.array_min(F.transform("seeds", through))).otherwise(F.when(whole >= 0, whole))


def members(rows: DataFrame, key: str, split: str, fields: tuple[str, ...], *keep: str) -> DataFrame:
    """``key``, ``split``, the columns ``keep``, ``field``, ``form`` and ``id``, its class, of every text that is there."""
    forms = F.array(*[F.struct(F.lit(f).alias("field"), plain_text(f).alias("form"), F.col(f).rlike(r"(?U)\S").alias("there")) for f in fields])
    each = rows.where(F.col(split).isNotNull()).select(F.col(key).alias("key"), F.col(split).alias("split"), *[F.col(c).alias(f"_{c}") for c in keep], F.explode(forms).alias("m"))
    return each.where("m.there").select("key", "split", *[f"_{c}" for c in keep], "m.field", "m.form", F.xxhash64("m.form").alias("id"))


def close_texts(held: DataFrame, percent: int = 15) -> DataFrame:
    """Pairs of different classes of :func:`members` of different splits that are almost the same: ``id_a`` < ``id_b``, ``distance``, ``longer`` (length), ``chain``."""
    spark = held.sparkSession
    ranks = held.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.row_number().over(W.orderBy("n", "split")).alias("rank"))  # the smallest split probes; a row per split
    texts = held.join(F.broadcast(ranks), "split").groupBy("id", "form").agg(F.min("rank").cast("int").alias("low"), F.max("rank").cast("int").alias("high"))
    texts = materialize(texts.where("form <> ''").select("id", "form", "low", "high"), "texts")
    ends = texts.agg(F.min("low"), F.max("high")).first()
    offering, probing = texts.where(F.col("high") > F.lit(ends[0])), texts.where(F.col("low") < F.lit(ends[1]))
    counts = _count_table(offering, percent)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fair = max(2_000, int(counts.sum()) // (8 * slots))
    a = materialize(_seeds(probing, True, counts, fair, percent), "probes")
    probed = np.zeros(COUNT_BUCKETS, bool)
    probed[a.select("bucket").distinct().toPandas()["bucket"].to_numpy(np.int64)] = True  # at most COUNT_BUCKETS rows
    b = _seeds(offering, False, counts, fair, percent, probed).select("key", *[F.col(c).alias(f"o_{c}") for c in ("id", "place", "length", "s0", "s1", "rank")])
    edits = F.expr(f"(greatest(length, o_length) * {percent}) div 100")
    lost = lambda x, y: F.bit_count(F.col(f"{x}s0").bitwiseAND(F.bitwise_not(f"{y}s0"))) + F.bit_count(F.col(f"{x}s1").bitwiseAND(F.bitwise_not(f"{y}s1")))
    near = (a["key"] == b["key"]) & (F.col("rank") < F.col("o_rank")) & (F.col("id") != F.col("o_id")) & (F.abs(F.col("place") - F.col("o_place")) <= edits) & (F.abs(F.col("length") - F.col("o_length")) <= edits) & (lost("", "o_") <= edits) & (lost("o_", "") <= edits)
    seeds = a.join(b, near).select("id", "o_id", "length", "o_length", "place", "o_place")
    side = lambda x: texts.select(F.col("id").alias(f"id_{x}"), F.col("form").alias(f"form_{x}"))
    pairs = _chained(seeds, percent).join(side("a"), "id_a").join(side("b"), "id_b")
    aligned = pairs.withColumn("distance", _extended(pairs)).where(F.col("distance") <= F.col("edits"))
    longer = F.greatest(F.length("form_a"), F.length("form_b"))
    found = aligned.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))  # a pair of texts that are in both splits is met twice
    return found.agg(F.min("distance").alias("distance"), F.max(longer).alias("longer"), F.max("chain").alias("chain"))


def _linked(held: DataFrame, percent: int) -> DataFrame:
    """Links between classes in both directions, and of each class that two splits hold with itself: ``id``, ``o_id``, ``distance``, ``coverage``."""
    ways = F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("o_id")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("o_id"))))
    close = close_texts(held, percent).select(ways.alias("w"), "distance", (1 - F.col("distance") / F.col("longer")).alias("coverage")).select("w.*", "distance", "coverage")
    own = held.groupBy("id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("id", F.col("id").alias("o_id"), F.lit(0).alias("distance"), F.lit(1.0).alias("coverage"))
    return close.unionByName(own)


def cross_split_pairs(rows: DataFrame, key: str = "ex_no", split: str = "split", fields: tuple[str, ...] = ("text", "corrected_text"), percent: int = 15) -> DataFrame:
    """Row pairs of different splits that agree, exactly or almost, in one of ``fields``: ``key_a`` < ``key_b``, ``field``, ``distance``, ``coverage``.

    ``coverage`` is the share of the longer text that the alignment leaves unchanged. Rows of classes that many rows hold are spread over shards."""
    held = materialize(members(rows, key, split, fields), "members")
    a = held.select(F.col("key").alias("a"), F.col("split").alias("split_a"), "field", "id")
    b = held.select(F.col("key").alias("b"), F.col("split").alias("split_b"), F.col("field").alias("field_b"), F.col("id").alias("o_id"))
    met = materialize(a.join(_linked(held, percent), "id").drop("id"), "linked")
    plan = plan_shards(met, ("o_id",))
    both = plan.scatter(met, F.xxhash64("a")).join(plan.replicate(b), ["_task", "o_id"]).where((F.col("field") == F.col("field_b")) & (F.col("split_a") < F.col("split_b")))
    return both.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), "field", F.col("distance").cast("int").alias("distance"), "coverage")


def split_report(rows: DataFrame, key: str = "ex_no", split: str = "split", source: str = "source", fields: tuple[str, ...] = ("text", "corrected_text"), percent: int = 15) -> DataFrame:
    """Per split and source: ``n_rows``, ``n_overlapping`` rows with a partner in another split, ``n_exact`` of them with an equal text, ``mean_coverage``.

    Made from classes: how well a class is covered by each other split is found once, however many rows hold it. Rows of equal keys count each."""
    numbered = materialize(rows.select(F.col(split).alias("split"), F.col(source).alias("source"), *[F.col(f).alias(f"t{i}") for i, f in enumerate(fields)]).withColumn("row", F.monotonically_increasing_id()), "rows")
    held = materialize(members(numbered, "row", "split", tuple(f"t{i}" for i in range(len(fields)))), "members")
    where = held.select("id", "field", "split").distinct()
    # the best link of a class to each other split, then of the classes of a split to any other
    reached = _linked(held, percent).join(where.select(F.col("id").alias("o_id"), "field", F.col("split").alias("o_split")), "o_id").groupBy("id", "field", "o_split").agg(F.max("coverage").alias("coverage"))
    best = where.join(reached, ["id", "field"]).where(F.col("split") != F.col("o_split")).groupBy("id", "field", "split").agg(F.max("coverage").alias("coverage"))
    found = held.select("key", "id", "field", "split").join(best, ["id", "field", "split"]).groupBy(F.col("key").alias("row")).agg(F.max("coverage").alias("coverage"))
    both = numbered.select("row", "split", "source").join(found, "row", "left")
    return both.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("coverage").alias("n_overlapping"), F.count_if(F.col("coverage") == 1).alias("n_exact"), F.avg("coverage").alias("mean_coverage"))
