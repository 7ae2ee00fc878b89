"""Rule tables mined from pairs of erroneous and corrected texts.

All counters are two-level aggregations (per key and value, then per key) with map-side partial counts; where only the most frequent values
are wanted they are ranked before they are gathered, so no key gathers more than its limit. Ties go to the smaller value.

Defined results: null, empty and equal texts make no pair; an entry without details keeps its pair; no rows give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum import vocab
from maldadum.functions import features as X, similarity as S, text as T

RECORD_COLUMNS = ("error_type", "source", "interface", "keyboard", "cor_sentence", "errors")


def entries(records: DataFrame) -> DataFrame:
    """One row per error entry with trimmed texts that differ, its record's ``channel``, ``error_type``, ``source`` and ``cor_sentence``."""
    rows = records.select("record", "error_type", "source", "cor_sentence", T.channel(F.col("error_type"), F.col("source"), F.col("interface"), F.col("keyboard")).alias("channel"), F.explode("errors").alias("e"))
    rows = rows.select("record", "error_type", "source", "cor_sentence", "channel", F.trim("e.err_text").alias("err"), F.trim("e.cor_text").alias("cor"))
    return rows.where((F.col("err") != "") & (F.col("cor") != "") & (F.col("err") != F.col("cor")))


def word_pairs(rows: DataFrame) -> DataFrame:
    """Entries whose texts are one short Hangul word each and close to one another, with ``similarity``."""
    e, c = F.col("err"), F.col("cor")
    x, y = T.strip_noise(e), T.strip_noise(c)
    longest = F.greatest(F.length(e), F.length(c))
    cheap = rows.where(~F.contains(e, F.lit(" ")) & ~F.contains(c, F.lit(" ")) & F.concat(e, c).rlike("[가-힣]") & (longest <= 16) & (x != y))
    close = cheap.where(F.levenshtein(x, y) <= F.when(longest <= 6, 2).otherwise(3))
    return close.withColumn("similarity", S.surface_similarity(e, c)).where("similarity >= 0.45")


def top_values(rows: DataFrame, keys: list[str], value: str, limit: int, weight: Column | None = None) -> DataFrame:
    """The ``limit`` most frequent values per key: ``keys``, ``value``, ``count``, ``rank``."""
    counts = rows.groupBy(*keys, value).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).cast("bigint").alias("count"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("count"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit)


def confusion_edges(pairs: DataFrame, min_frequency: int = 2, per_key: int = 8) -> DataFrame:
    """Edges err -> cor: ``frequency``, ``similarity``, ``score``, dominant ``channel`` and ``rank`` within err."""
    freq = pairs.groupBy("err", "cor", "similarity").agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= min_frequency)
    dominant = top_values(pairs, ["err", "cor"], "channel", 1).select("err", "cor", "channel")
    edges = freq.join(dominant, ["err", "cor"]).withColumn("score", S.score_from_frequency(F.col("frequency"), F.col("similarity")))
    rank = F.row_number().over(W.partitionBy("err").orderBy(F.desc("frequency"), F.desc("score"), F.desc("cor")))
    return edges.withColumn("rank", rank).where(F.col("rank") <= per_key)


def context_hints(pairs: DataFrame, limit: int = 8) -> DataFrame:
    """The most frequent terms near the corrected word: ``err``, ``cor``, ``term``, ``count``, ``rank``."""
    terms = pairs.select("err", "cor", F.explode(T.context_terms(F.col("cor_sentence"), F.col("cor"))).alias("term"))
    return top_values(terms, ["err", "cor"], "term", limit)


def counters(pairs: DataFrame) -> DataFrame:
    """``interface_stats``, ``error_types``, ``source_stats`` MAP<STRING, BIGINT> per pair, null values left out."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("i", "channel"), ("e", "error_type"), ("s", "source"))]))
    each = pairs.select("err", "cor", kinds.alias("k")).where("k.name is not null").groupBy("err", "cor", "k.kind", "k.name").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind, name: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n"))))).alias(name)
    return each.groupBy("err", "cor").agg(of("i", "interface_stats"), of("e", "error_types"), of("s", "source_stats"))


def fix_candidates(rows: DataFrame) -> DataFrame:
    """Entries that could become a spelling fix: no blanks, quotes or control characters, short, mostly Hangul, more than punctuation changed."""
    e, c = F.col("err"), F.col("cor")
    both = F.concat(e, c)
    return rows.where(
        ~F.contains(both, F.lit(" ")) & (F.length(e) <= 12) & (F.length(c) <= 12) & (T.hangul_ratio(both) >= 0.7)
        & ~T.punctuation_only(e, c) & ~T.has_control(both) & ~both.rlike("[\"'“”‘’`]"))


def dominant_targets(rows: DataFrame, min_count: int = 30, min_dominance: float = 0.95) -> DataFrame:
    """Per err its most frequent cor, if frequent and dominant enough: ``err``, ``cor``, ``count``, ``total``, ``dominance``."""
    counts = rows.groupBy("err", "cor").agg(F.count(F.lit(1)).alias("count"))
    of_err = W.partitionBy("err")
    ranked = counts.withColumn("total", F.sum("count").over(of_err)).withColumn("rank", F.row_number().over(of_err.orderBy(F.desc("count"), "cor")))
    top = ranked.where("rank = 1").withColumn("dominance", F.round(F.col("count") / F.col("total"), 4))
    return top.where((F.col("count") >= min_count) & (F.col("count") >= min_dominance * F.col("total"))).drop("rank")


def surface_fixes(rows: DataFrame, min_count: int = 30, min_dominance: float = 0.95, min_similarity: float = 0.74) -> DataFrame:
    """Spelling fixes with ``similarity`` and ``confidence``; the Python similarity is taken of the few dominant pairs only."""
    top = dominant_targets(fix_candidates(rows), min_count, min_dominance)
    rated = top.withColumn("similarity", F.round(S.matcher_ratio("err", "cor"), 4)).where(F.col("similarity") >= min_similarity)
    return rated.withColumn("confidence", S.fix_confidence(F.col("count"), F.col("similarity")))


def merged_rules(*tables: DataFrame) -> DataFrame:
    """Rules (``src``, ``dst``, ``confidence``) of several tables, one per ``src``: the most confident, of equal ones that of the later table."""
    all_rules = tables[0].select("src", "dst", "confidence", F.lit(0).alias("age"))
    for age, rules in enumerate(tables[1:], 1):
        all_rules = all_rules.unionByName(rules.select("src", "dst", "confidence", F.lit(age).alias("age")))
    best = all_rules.groupBy("src").agg(F.max_by(F.struct("dst", "confidence"), F.struct("confidence", "age", "dst")).alias("r"))
    return best.select("src", "r.dst", "r.confidence")


def manual_rules(df: DataFrame) -> DataFrame:
    """The rules given by hand as a table of ``df``'s session."""
    return df.sparkSession.createDataFrame(list(vocab.MANUAL_FIXES), "src STRING, dst STRING, confidence DOUBLE")


def phrase_pairs(rows: DataFrame) -> DataFrame:
    """Entries where words are split, joined or replaced in short phrases, with ``err`` and ``cor`` in phrase form and ``similarity``."""
    forms = rows.select("channel", "error_type", "cor_sentence", T.phrase(F.col("err")).alias("err"), T.phrase(F.col("cor")).alias("cor"))
    e, c = F.col("err"), F.col("cor")
    a, b = F.split(e, " "), F.split(c, " ")
    both = F.concat(a, b)
    kept = forms.where(
        (e != "") & (c != "") & (e != c) & F.concat(e, c).rlike("[가-힣]") & (F.size(a) <= 3) & (F.size(b) <= 3) & (F.length(e) <= 14) & (F.length(c) <= 14)
        & ((F.size(a) > 1) | (F.size(b) > 1)) & ~F.concat(e, c).rlike("[ㄱ-ㅎㅏ-ㅣ]") & F.forall(both, lambda w: w.rlike(f"^(?:{vocab.WORD})$") & (F.length(w) <= 5)))
    return kept.withColumn("similarity", S.phrase_similarity(e, c)).where("similarity >= 0.74")


def phrase_memory(pairs: DataFrame, min_frequency: int = 3, min_dominance: float = 0.86) -> DataFrame:
    """Phrases with one dominant target: ``err``, ``cor``, ``frequency``, ``total``, ``dominance``, ``similarity``, ``confidence``."""
    counts = pairs.groupBy("err", "cor").agg(F.count(F.lit(1)).alias("frequency"), F.round(F.avg("similarity"), 4).alias("similarity"), F.count_if(F.col("channel") == "voice").alias("voice"))
    of_err = W.partitionBy("err")
    ranked = counts.withColumns({"total": F.sum("frequency").over(of_err), "voices": F.sum("voice").over(of_err), "rank": F.row_number().over(of_err.orderBy(F.desc("frequency"), "cor"))})
    f, total = F.col("frequency"), F.col("total")
    kept = ranked.where((F.col("rank") == 1) & (total >= min_frequency) & (f >= min_dominance * total) & (F.col("similarity") >= 0.82)
                        & ~((F.col("voices") > 0.5 * total) & (f < max(min_frequency + 2, 6))) & ~((f != total) & (total >= 8)))
    return kept.select("err", "cor", "frequency", "total", F.round(f / total, 4).alias("dominance"), "similarity", S.phrase_confidence(f, F.col("similarity")).alias("confidence"))


def lemma_edges(graph: DataFrame) -> DataFrame:
    """Edges between different lemmas of predicates, added up: ``lemma``, ``target``, ``pos``, ``frequency``, ``similarity`` (mean), ``slots`` (sorted union)
    and ``interface_stats`` (maps added key by key). Broad lemmas only by the list of allowed pairs."""
    allowed = F.struct(F.col("lemma"), F.col("targetLemma")).isin([F.struct(F.lit(a).alias("lemma"), F.lit(b).alias("targetLemma")) for a, b in vocab.BROAD_ALLOWED])
    broad = F.col("lemma").isin(*vocab.BROAD_LEMMAS) | F.col("targetLemma").isin(*vocab.BROAD_LEMMAS)
    kept = graph.where((F.col("lemma") != F.col("targetLemma")) & T.coarse_pos(F.col("pos")).isin(*vocab.PREDICATE_TAGS) & (~broad | allowed))
    keyed = kept.select("lemma", F.col("targetLemma").alias("target"), T.coarse_pos(F.col("pos")).alias("pos"), "frequency", "surfaceSimilarity", "suffixSlots", "interfaceStats")
    sums = keyed.groupBy("lemma", "target", "pos").agg(F.sum("frequency").alias("frequency"), F.round(F.avg("surfaceSimilarity"), 4).alias("similarity"))
    slots = keyed.select("lemma", "target", "pos", F.explode("suffixSlots").alias("slot")).where("slot is not null").distinct().groupBy("lemma", "target", "pos").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    channels = keyed.select("lemma", "target", "pos", F.explode("interfaceStats").alias("name", "n")).groupBy("lemma", "target", "pos", "name").agg(F.sum("n").alias("n"))
    stats = channels.groupBy("lemma", "target", "pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("interface_stats"))
    keys = ["lemma", "target", "pos"]
    return sums.join(slots, keys, "left").join(stats, keys, "left")


def kept_lemma_edges(edges: DataFrame, min_frequency: int = 2, per_lemma: int = 8) -> DataFrame:
    """Edges of :func:`lemma_edges` that are frequent and alike enough for how they were put in: those heard need more similarity or frequency than those typed; with ``score`` and ``rank``."""
    total = F.aggregate(F.map_values("interface_stats"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    voice = F.coalesce(F.try_divide(F.try_element_at("interface_stats", F.lit("voice")), total), F.lit(0.0))
    f, sim = F.col("frequency"), F.col("similarity")
    kept = edges.where((f >= min_frequency) & ~((sim < 0.56) & (voice < 0.5)) & ~((voice >= 0.5) & (f < max(min_frequency + 2, 5)))).withColumn("score", X.lemma_score(f, sim))
    rank = F.row_number().over(W.partitionBy("lemma").orderBy(F.desc("frequency"), F.desc("score"), "target", "pos"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= per_lemma)


def _cut(edges: DataFrame) -> DataFrame:
    """Edges between lemmas with what differs at the ends of their stems, one to four characters on either side, and the irregular class of the target or else the source."""
    a, b = T.stem(F.col("lemma")), T.stem(F.col("target"))
    p = S.shared_prefix(a, b)
    kind = F.coalesce(X.irregular_class(F.col("target")), X.irregular_class(F.col("lemma")))
    cut = edges.select("lemma", "target", "pos", "frequency", F.substring(a, p + 1, F.length(a)).alias("source_suffix"), F.substring(b, p + 1, F.length(b)).alias("target_suffix"), kind.alias("irregular"))
    return cut.where("length(source_suffix) between 1 and 4 and length(target_suffix) between 1 and 4")


def suffix_rules(edges: DataFrame, min_support: int = 2, limit: int | None = 160) -> DataFrame:
    """What differs at the ends of two lemmas' stems, weighted by frequency: ``source_suffix``, ``target_suffix``, ``pos``, ``frequency``, ``score``, ``n_lemmas`` and ``n_irregular``
    classes (two at most).

    :param limit: length of a ranked report; None gives all rules, unordered."""
    sums = _cut(edges).groupBy("source_suffix", "target_suffix", "pos").agg(F.sum("frequency").alias("frequency"), F.count_distinct("lemma").alias("n_lemmas"), F.least(F.count_distinct("irregular"), F.lit(2)).alias("n_irregular"))
    score = S.rounded(F.least(F.lit(0.965), 0.58 + 0.07 * F.least(F.lit(5), F.col("frequency")) / 5 + 0.03 * F.col("n_irregular")))
    rules = sums.where(F.col("frequency") >= min_support).withColumn("score", score)
    return rules if limit is None else rules.orderBy(F.desc("frequency"), F.desc("score"), "source_suffix", "target_suffix", "pos").limit(limit)


def suffix_examples(edges: DataFrame, limit: int = 6) -> DataFrame:
    """The lemmas that speak most for each rule of :func:`suffix_rules`: ``source_suffix``, ``target_suffix``, ``pos``, ``side`` ('source' or 'target'), ``lemma``, ``count``, ``rank``."""
    sides = F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("lemma").alias("name")), F.struct(F.lit("target").alias("side"), F.col("target").alias("name"))))
    each = _cut(edges).select("source_suffix", "target_suffix", "pos", "frequency", sides.alias("s")).select("source_suffix", "target_suffix", "pos", "s.side", F.col("s.name").alias("lemma"), "frequency")
    return top_values(each, ["source_suffix", "target_suffix", "pos", "side"], "lemma", limit, F.col("frequency"))


def near_inverse(rules: DataFrame) -> DataFrame:
    """Pairs of rules that undo each other: ``src``, ``dst`` and both confidences."""
    back = rules.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("confidence").alias("back_confidence"))
    return rules.join(back, ["src", "dst"]).where("src < dst").select("src", "dst", "confidence", "back_confidence")
