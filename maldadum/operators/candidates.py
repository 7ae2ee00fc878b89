"""Replacement candidates for tokens: dictionary joins, blocked similarity joins, scores and per-token top lists.

Every join has an equality key: the token itself, its first token, its first character, its lemma or one of its endings; similarity is tested on
what the key brings together. Dictionaries are joined as tables, so that Spark broadcasts them only while they are small.

Defined results: null and empty tokens have no candidates; a dictionary that holds a key many times gives each of its rows; ties go to
the smaller replacement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum import vocab
from maldadum.functions import similarity as S, text as T
from maldadum.session import materialize

#: Phrases of up to this many bytes go to the executors as a broadcast table; more are joined by a shuffle of both sides.
BROADCAST_BYTES = 16 << 20


def exact(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens (``tok``) that a dictionary (``src``, ``dst``, ...) holds as they are."""
    return tokens.join(dictionary, F.col("tok") == F.col("src")).drop("src")


def valid_surface(original: Column, candidate: Column) -> Column:
    """Whether a word that a language model offers could be a misspelling's right form: one Hangul word, a length within one, one edit (two from five letters on)."""
    word = (candidate != "") & (candidate != original) & ~candidate.rlike(r"[ \n\t]|^[\[#]") & (T.hangul_ratio(candidate) >= 0.5)
    return F.coalesce(word & (F.abs(F.length(candidate) - F.length(original)) <= 1) & (F.levenshtein(original, candidate) <= F.when(F.length(original) <= 4, 1).otherwise(2)), F.lit(False))


def with_head(df: DataFrame, text: str, name: str) -> DataFrame:
    """The first token of a phrase as ``name``, to join on."""
    return df.withColumn(name, F.get(F.regexp_extract_all(F.col(text), F.lit(vocab.JVM_TOKEN), F.lit(0)), F.lit(0)))


def phrases(rows: DataFrame, key: str, text: str, memory: DataFrame) -> DataFrame:
    """Places where a phrase of ``memory`` (``src``, ``dst``, ``confidence``) stands in a row's tokens, the longest and most confident one per place:
    ``key``, ``first`` (token index), ``n_tokens``, ``src``, ``dst``, ``confidence``. Joined on the first token, then compared whole.

    Places are a row per token of files that Spark takes for small, and a memory made of rows counts as endless to it: without a hint it broadcasts the places, through the driver."""
    toks = F.regexp_extract_all(F.col(text), F.lit(vocab.JVM_TOKEN), F.lit(0))
    held = F.lit(100) + 3 * F.coalesce(F.octet_length("src"), F.lit(0)) + F.coalesce(F.octet_length("dst"), F.lit(0))  # src, form and head are kept
    longest, size = memory.agg(F.max(F.size(F.split(T.phrase(F.col("src")), " "))), F.sum(held)).first()
    longest = longest or 1
    starts = F.transform(toks, lambda t, i: F.struct(t.alias("head"), F.slice(toks, i + 1, F.lit(longest)).alias("run")))  # no token carries more of its text
    places = rows.select(key, F.posexplode(starts).alias("first", "x")).select(key, "first", "x.head", "x.run")
    known = with_head(memory.select("src", "dst", "confidence"), "src", "head").withColumn("form", T.phrase(F.col("src"))).withColumn("n_tokens", F.size(F.split("form", " ")))
    known = F.broadcast(known) if (size or 0) <= BROADCAST_BYTES else known.hint("merge")
    met = places.join(known, "head").where(F.array_join(F.slice("run", F.lit(1), F.col("n_tokens")), " ") == F.col("form"))
    best = W.partitionBy(key, "first").orderBy(F.desc("n_tokens"), F.desc("confidence"), "dst")
    return met.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(key, "first", "n_tokens", "src", "dst", "confidence")


def _near_keys(word: Column, least: float, most_edits: int) -> Column:
    """Keys of which two words share one wherever :func:`similar` may pair them.

    With a similarity of .74 and two edits, words of up to 18 letters have equal lengths and differ in letters of a third of the word or in two places. A word is
    cut in three: up to nine letters one part is touched and two stay as they are, up to 18 one stays. Longer words, and other bounds, meet by length."""
    n = F.length(word)
    cut = lambda a, b: F.substring(word, a + 1, b - a)
    first, second = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    x, y, z = cut(F.lit(0), first), cut(first, second), cut(second, n)
    key = lambda kind, *parts: F.concat_ws("\x1f", F.lit(kind), n.cast("string"), *parts)
    by_length = F.array(*[F.concat_ws("\x1f", F.lit("n"), (n + d).cast("string"), F.substring(word, 1, 1)) for d in (-1, 0, 1)])
    if least < 0.74 or most_edits > 2:
        return by_length
    two, one = F.array(key("xy", x, y), key("xz", x, z), key("yz", y, z)), F.array(key("x", x), key("y", y), key("z", z))
    return F.when(n > 19, by_length).when(n > 17, F.concat(one, by_length)).when(n > 9, one).otherwise(two)


def similar(tokens: DataFrame, dictionary: DataFrame, least: float = 0.74, most_edits: int = 2, limit: int = 4) -> DataFrame:
    """Dictionary words close to a token: the same first character, a length within one, few edits and ``typo_similarity`` of at least ``least``; the
    ``limit`` closest. ``tok``, ``src``, ``edits``, ``similarity``, ``rank``. Distinct tokens and words meet on equal parts, not all of a length with all others."""
    keyed = lambda df, name: df.select(name).where(F.col(name) != "").distinct().select(name, F.explode(_near_keys(F.col(name), least, most_edits)).alias("key"))
    met = keyed(tokens, "tok").join(keyed(dictionary, "src"), "key").where((F.col("tok") != F.col("src")) & (F.substring("tok", 1, 1) == F.substring("src", 1, 1)) & (F.abs(F.length("tok") - F.length("src")) <= 1))
    near = met.withColumn("edits", F.levenshtein("tok", "src")).where(F.col("edits") <= most_edits).select("tok", "src", "edits").distinct()
    rated = near.withColumn("similarity", S.typo_similarity(F.col("tok"), F.col("src"))).where(F.col("similarity") >= least)
    rank = F.row_number().over(W.partitionBy("tok").orderBy(F.desc("similarity"), "src"))
    return rated.withColumn("rank", rank).where(F.col("rank") <= limit).select("tok", "src", "edits", "similarity", "rank")


def slots_fit(a: Column, b: Column) -> Column:
    """Suffix slots are equal, or one is the other's beginning up to a plus sign; absent ones fit anything."""
    return a.isNull() | b.isNull() | (a == b) | F.startswith(a, F.concat(b, F.lit("+"))) | F.startswith(b, F.concat(a, F.lit("+")))


def by_suffix(lemmas: DataFrame, rules: DataFrame) -> DataFrame:
    """Lemmas (``lemma``, ``pos``) rewritten by ending rules (``source_suffix``, ``target_suffix``, ``pos``, ``score``): the suffix join as an equality join on
    each of a stem's last one to four characters."""
    stems = lemmas.select("lemma", "pos", T.stem(F.col("lemma")).alias("stem"))
    ends = stems.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).where(F.col("n") < F.length("stem"))
    ends = ends.withColumn("source_suffix", F.substring("stem", F.length("stem") - F.col("n") + 1, F.col("n")))
    return ends.join(rules, ["source_suffix", "pos"]).select("lemma", "pos", "source_suffix", "target_suffix", F.concat(F.substring("stem", F.lit(1), F.length("stem") - F.col("n")), F.col("target_suffix"), F.lit("다")).alias("target"), "score")


_HINTS = "array<struct<term:string,count:bigint>>"


def plain_hints(hints: Column) -> Column:
    """Hints (``array<struct<term, count>>``) with terms as context terms are, without particles; empty and null terms are left out, equal ones may stay."""
    bare = F.transform(hints, lambda h: F.struct(T.strip_particle(h["term"]).alias("term"), F.coalesce(h["count"], F.lit(0)).cast("bigint").alias("count")))
    return F.coalesce(F.filter(bare.cast(_HINTS), lambda h: h["term"] != ""), F.array().cast(_HINTS))


def hint_score(terms: Column, hints: Column) -> Column:
    """How well context terms meet :func:`plain_hints`: the counts of the hints that terms equal, and until a term has met any hint those of hints that begin it
    or that it begins, by all counts, at most 1; 0 without hints or terms."""
    added = lambda some: F.aggregate(some, F.lit(0).cast("bigint"), lambda a, h: a + h["count"])
    total = added(hints)

    def met(so_far: Column, term: Column) -> Column:
        equal = so_far + added(F.filter(hints, lambda h: h["term"] == term))
        return F.when(equal > 0, equal).otherwise(added(F.filter(hints, lambda h: F.startswith(term, h["term"]) | F.startswith(h["term"], term))))

    matched = F.aggregate(terms, F.lit(0).cast("bigint"), met)
    return F.coalesce(F.round(F.least(F.lit(1.0), matched / F.when(total == 0, 1).otherwise(total)), 4), F.lit(0.0))


#: Places of words that are scored together, and places of one word from which it is scored in shards.
BUCKET_PLACES, SHARD_PLACES = 1 << 14, 1 << 17
#: Meetings of a hint and a term that are held at once.
_MEETINGS = 1 << 21


def hint_scores(edges: DataFrame, sentences: DataFrame, text: str) -> DataFrame:
    """How the hints of edges (``edge_no``, ``replacement``, ``contextHints``) are met wherever their replacement stands in a sentence: ``edge_no``, ``score``
    and ``n``, the places with that score.

    Places are written once; those of some words and their edges meet in a task, where only terms that meet a hint are looked at: the score 0 is what remains of
    all places. Words of many places are dealt in shards, whose counts add up."""
    hinted = edges.where(F.col("replacement").isNotNull()).select("edge_no", "replacement", plain_hints(F.col("contextHints")).alias("hints"))
    near = T.explode_near_words(sentences, text).select(F.col("tok").alias("replacement"), "terms")
    places = materialize(near.join(hinted.select("replacement").distinct(), "replacement", "left_semi"), "places")
    counts = places.groupBy("replacement").agg(F.count(F.lit(1)).alias("n"))
    shards = materialize(counts.select("replacement", "n", F.ceil(F.col("n") / SHARD_PLACES).cast("int").alias("shards")), "shards")
    buckets = max(1, -(-(shards.agg(F.sum("n")).first()[0] or 0) // BUCKET_PLACES))
    bucket = F.pmod(F.xxhash64("replacement"), F.lit(buckets)).cast("int").alias("bucket")
    large = F.broadcast(shards.where("shards > 1").select("replacement", "shards"))  # one in SHARD_PLACES places at most
    dealt = places.withColumn("_at", F.monotonically_increasing_id()).join(large, "replacement", "left")
    dealt = dealt.select(bucket, F.pmod(F.col("_at"), F.coalesce("shards", F.lit(1))).cast("int").alias("shard"), "replacement", "terms")
    copies = hinted.join(shards, "replacement").select(bucket, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "replacement", "edge_no", "hints")
    kind = edges.schema["edge_no"].dataType.simpleString()
    met = copies.groupBy("bucket", "shard").cogroup(dealt.groupBy("bucket", "shard")).applyInArrow(_meet, f"edge_no {kind}, matched BIGINT, total BIGINT, n BIGINT")
    return met.groupBy("edge_no", F.round(F.least(F.lit(1.0), F.col("matched") / F.col("total")), 4).alias("score")).agg(F.sum("n").alias("n"))


def _meet(edges: pa.Table, places: pa.Table) -> pa.Table:
    """For edges and places of some words, how many ``n`` places meet each edge's hints by ``matched`` of ``total`` counts."""
    words = edges["replacement"].unique()
    of = [pc.fill_null(pc.index_in(t["replacement"], value_set=words), -1).to_numpy() for t in (edges, places)]
    order = [np.argsort(o, kind="stable") for o in of]
    bounds = [np.searchsorted(o[by], np.arange(len(words) + 1)) for o, by in zip(of, order)]
    out: list[tuple[np.ndarray, ...]] = []
    for w in range(len(words)):
        mine, here = (by[b[w] : b[w + 1]] for by, b in zip(order, bounds))
        if len(here):
            out += [(mine[e], m, t, n) for e, m, t, n in _met(edges["hints"].take(pa.array(mine)), places["terms"].take(pa.array(here)))]
    at, *columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table([edges["edge_no"].take(pa.array(at)), *columns], names=["edge_no", "matched", "total", "n"])


def _met(hints: pa.ChunkedArray, terms: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of one word: (edge, matched, total, places) as arrays, for lists of hints and the context terms of places, joined by blanks."""
    by_term: dict[str, dict[int, int]] = {}
    total = np.zeros(len(hints), np.int64)
    for e, some in enumerate(hints.to_pylist()):
        for h in some:
            total[e] += h["count"]
            known = by_term.setdefault(h["term"], {})
            known[e] = known.get(e, 0) + h["count"]
    total = np.maximum(total, 1)
    longer: dict[str, list[str]] = {}
    for h in by_term:
        for i in range(1, len(h)):
            longer.setdefault(h[:i], []).append(h)

    lists = [t.split(" ") if t else [] for t in terms.to_pylist()]
    place = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(t, len(ids)) for some in lists for t in some], np.int64)
    by_id = np.argsort(flat, kind="stable")  # the places of each term, in order
    first = np.searchsorted(flat[by_id], np.arange(len(ids) + 1))
    rows: list[tuple[int, int, int, int]] = []  # edge, term, counts of equal hints, counts of hints that one begins the other
    for t, i in ids.items():
        same = by_term.get(t, {})
        others = [by_term[t[:k]] for k in range(1, len(t)) if t[:k] in by_term] + [by_term[h] for h in longer.get(t, ())]
        begun = dict(same)
        for some in others:
            for e, n in some.items():
                begun[e] = begun.get(e, 0) + n
        rows += [(e, i, same.get(e, 0), n) for e, n in begun.items() if n > 0 or same.get(e, 0)]
    zero = np.full(len(hints), len(lists), np.int64)
    edge, term, same, begun = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    many = first[term + 1] - first[term]
    ends = np.cumsum(many)
    at = 0
    while at < len(edge):
        to = max(np.searchsorted(ends, ends[at] - many[at] + _MEETINGS), at + 1)
        to = np.searchsorted(edge, edge[to - 1], "right")  # whole edges
        row = np.repeat(np.arange(at, to), many[at:to])
        where = by_id[first[term[row]] + np.arange(len(row)) - np.repeat(ends[at:to] - many[at:to] - (ends[at] - many[at]), many[at:to])]
        sort = np.argsort(edge[row] * len(flat) + where, kind="stable")
        row, where = row[sort], place[where[sort]]
        new = np.flatnonzero(np.diff(edge[row] * len(lists) + where, prepend=-1))  # a place of an edge begins
        begins = (same[row] > 0) | (begun[row] > 0)
        so_far = np.cumsum(begins)
        so_far -= np.repeat(so_far[new] - begins[new], np.diff(new, append=len(row)))
        value = np.where(so_far == 0, 0, np.where(begins & (so_far == 1) & (same[row] <= 0), begun[row], same[row]))
        levels, level = np.unique(np.add.reduceat(value, new), return_inverse=True)
        pairs, n = np.unique(edge[row[new]] * len(levels) + level, return_counts=True)
        e = pairs // len(levels)
        np.subtract.at(zero, e, n)
        yield e, levels[pairs % len(levels)], total[e], n
        at = to
    rest = np.flatnonzero(zero)
    yield rest, np.zeros(len(rest), np.int64), total[rest], zero[rest]


def interface_score(stats: Column, channel: Column, kind: Column | None = None) -> Column:
    """How well a candidate's counts per channel fit the channel at hand, within [.2, 1], to four places.

    :param kind: the candidate's channel, which counts where it has no counts; .86 without either."""
    total = F.greatest(support(stats), F.lit(1))
    g, k, v = (F.coalesce(F.try_element_at(stats, F.lit(x)), F.lit(0)) / total for x in ("generic", "keyboard", "voice"))
    raw = F.when(channel == "voice", 0.92 * v + 0.55 * g + 0.35 * k).when(channel == "keyboard", 0.9 * k + 0.7 * g + 0.3 * v).otherwise(0.92 * g + 0.82 * k + 0.22 * v)
    none = F.lit(0.86) if kind is None else F.when(kind == "voice", F.when(channel == "generic", 0.32).otherwise(0.9)).when(kind == "keyboard", F.when(channel.isin("generic", "keyboard"), 0.94).otherwise(0.72)).otherwise(0.86)
    return F.when(F.size(F.coalesce(F.map_keys(stats), F.array())) > 0, S.rounded(F.greatest(F.lit(0.2), F.least(F.lit(1.0), raw)))).otherwise(none)


def enriched(candidates: DataFrame) -> DataFrame:
    """Candidates (``terms``, ``channel``, ``hints``, ``stats``, ``kind``) with ``context`` and ``interface``: voice candidates of generic texts count little without context."""
    scored = candidates.withColumns({"context": hint_score(F.col("terms"), F.col("hints")), "interface": interface_score(F.col("stats"), F.col("channel"), F.col("kind"))})
    quiet = (F.col("channel") == "generic") & F.coalesce(F.col("kind") == "voice", F.lit(False)) & (F.col("context") < 0.12)
    return scored.withColumn("interface", F.when(quiet, F.least(F.col("interface"), F.lit(0.3))).otherwise(F.col("interface")))


def support(stats: Column) -> Column:
    """All counts of a map together; null counts as empty."""
    return F.coalesce(F.aggregate(F.map_values(stats), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0))), F.lit(0))


def source_prior(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in vocab.SOURCE_PRIOR.items() for x in pair])
    return F.coalesce(F.try_element_at(known, source), F.lit(vocab.OTHER_PRIOR))


def curated(source: Column) -> Column:
    return F.coalesce(source.isin(*vocab.CURATED_SOURCES), F.lit(False))


def supported(source: Column, context: Column, support: Column, typo: Column) -> Column:
    """Whether a candidate of seeds or of mined data meets its context, or else was seen often enough."""
    weak = F.coalesce(context, F.lit(0.0)) < 0.08
    n = F.coalesce(support, F.lit(0))
    return ~(F.coalesce(source.isin("FAMILY_SEED", "AUTO_FAMILY_SEED"), F.lit(False)) & weak & (n < 14)) & ~(F.coalesce(source.isin("DATA_CONFUSION", "LEMMA_DATA_CONFUSION"), F.lit(False)) & weak & (n < 8) & (typo < 0.62))


def prefilter(candidates: DataFrame, limit: int = 4, least_similarity: float = 0.55, curated_similarity: float = 0.48, keys: Sequence[str] = ("tok",)) -> DataFrame:
    """Candidates (``tok``, ``dst``, ``source``, ``generator``, ``context``, ``interface``, ``support``, ``family``) with ``typo``, ``norm`` (generator within [0, 1]) and ``score``, the best ``limit`` per ``keys``.

    ``curated_similarity`` is enough for curated sources with lemmas of a family, a context of .1 or a generator of .72; ``support`` is the sum of the interface counts."""
    typo, generator = F.col("typo"), S.unit_score(F.col("generator"))
    trusted = curated(F.col("source")) & ((F.size("family") > 0) | (F.col("context") >= 0.1) | (generator >= 0.72))
    rated = candidates.withColumn("typo", S.typo_similarity(F.col("tok"), F.col("dst"))).where(typo >= F.when(trusted, curated_similarity).otherwise(least_similarity)).where(supported(F.col("source"), F.col("context"), F.col("support"), typo))
    score = S.rounded(0.40 * typo + 0.22 * generator + 0.12 * source_prior(F.col("source")) + 0.16 * F.col("context") + 0.10 * F.col("interface"))
    rated = rated.withColumns({"score": score, "norm": S.rounded(generator)})
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("context"), F.desc("typo"), F.desc("norm"), "dst"))
    return rated.withColumn("rank", rank).where(F.col("rank") <= limit)


def best_per_replacement(candidates: DataFrame, keys: Sequence[str] = ("tok",)) -> DataFrame:
    """One candidate per ``keys`` and replacement: the highest generator score within [0, 1], then prior, then the smaller source name."""
    order = W.partitionBy(*keys, "dst").orderBy(F.desc(S.unit_score(F.col("generator"))), F.desc(source_prior(F.col("source"))), "source")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def added_edges(edges: DataFrame) -> DataFrame:
    """One row per (``src``, ``dst``, ``source``) of edges that may be mined many times: the best ``generator``, the smallest ``kind`` (channel) and ``pos``, ``family`` (all lemmas,
    sorted), ``slots`` (sorted union), and ``hints`` and ``stats``, whose counts are added term by term, as :func:`plain_hints` has them, and channel by channel."""
    keys = ["src", "dst", "source"]
    text = F.lit(None).cast("string")
    part = lambda kind, name, n: F.struct(F.lit(kind).alias("part"), name.alias("name"), n.cast("bigint").alias("n"))
    none = F.array().cast("array<struct<part:string,name:string,n:bigint>>")
    parts = F.concat(
        F.array(part("e", text, F.lit(0)), part("l", F.col("lemma"), F.lit(0)), part("l", F.col("targetLemma"), F.lit(0))),
        F.coalesce(F.transform(plain_hints(F.col("contextHints")), lambda h: part("h", h["term"], h["count"])), none),
        F.coalesce(F.transform("suffixSlots", lambda x: part("x", x, F.lit(0))), none),
        F.coalesce(F.transform(F.map_entries("interfaceStats"), lambda m: part("s", m["key"], m["value"])), none))
    each = edges.select(*keys, F.col("generatorScore").alias("generator"), F.col("interfaceType").alias("kind"), "pos", F.explode(parts).alias("p"))
    best = [F.max("generator").alias("generator"), F.min("kind").alias("kind"), F.min("pos").alias("pos")]
    sums = each.groupBy(*keys, "p.part", "p.name").agg(*best, F.coalesce(F.sum("p.n"), F.lit(0)).alias("n"))
    of = lambda kind, value: F.array_sort(F.collect_list(F.when((F.col("part") == kind) & F.col("name").isNotNull(), value)))
    return sums.groupBy(*keys).agg(*best, of("l", F.col("name")).alias("family"), of("x", F.col("name")).alias("slots"), of("h", F.struct(F.col("name").alias("term"), F.col("n").alias("count"))).alias("hints"), F.map_from_entries(of("s", F.struct(F.col("name").alias("key"), F.col("n").alias("value")))).alias("stats"))


def scored(occurrences: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best candidates of every occurrence of a token (``keys``, with ``tok``, ``terms`` of its context and its ``channel``) among :func:`added_edges`; ranks within ``keys``."""
    rated = enriched(exact(occurrences, edges)).withColumn("support", support(F.col("stats")))
    return prefilter(best_per_replacement(rated.drop("hints", "stats"), keys), keys=keys)


def hits_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Of gold pairs (``tok``, ``dst``), how many are among the first k candidates (``tok``, ``dst``, ``rank``): ``n``, ``hit_<k>`` and ``rate_<k>``."""
    found = gold.select("tok", "dst").join(ranked.select("tok", "dst", "rank"), ["tok", "dst"], "left")
    out = found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in ks])
    return out.withColumns({f"rate_{k}": F.round(F.coalesce(F.try_divide(f"hit_{k}", "n"), F.lit(0.0)), 6) for k in ks})


def merge_counts(a: Column, b: Column) -> Column:
    """Two count maps added key by key; null counts as empty."""
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def next_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Neighbouring tokens that are both KEEP, joined without the blank: ``key``, ``idx``, ``joined``; inside the row's arrays."""
    at = F.sequence(F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(1)))
    pairs = F.transform(F.filter(at, lambda i: (F.get("labels", i - 1) == "KEEP") & (F.get("labels", i) == "KEEP")), lambda i: F.struct((i - 1).alias("idx"), F.concat(F.get("tokens", i - 1), F.get("tokens", i)).alias("joined")))
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.idx", "p.joined")


#: Labels of which prototypes are held by the driver.
MAX_LABELS = 10_000


def nearest_prototypes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``key``, ``label`` and ``cosine`` (4 decimals) of the label whose mean vector is nearest; of equal ones the smaller label.

    Null vectors and vectors of length zero have none. The prototypes, at most MAX_LABELS, go to the executors; vectors are not shuffled for the search."""
    each = vectors.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"))
    rows = each.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).orderBy(label).limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    names = [r[0] for r in rows]
    matrix = np.array([[x.v for x in r.p] for r in rows])
    if len(rows):
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(matrix) or not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), np.float64)
            norm = np.linalg.norm(x, axis=1)
            near = (x @ matrix.T) / np.where(norm > 0, norm, 1)[:, None]
            best = near.argmax(axis=1)
            ok = np.flatnonzero(norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array([names[i] for i in best[ok]], kind), pa.array(np.round(near[ok, best[ok]], 4))], names=[key, label, "cosine"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(vectors.schema[label].dataType)
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, `{label}` {vectors.schema[label].dataType.simpleString()}, cosine DOUBLE"
    return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)
