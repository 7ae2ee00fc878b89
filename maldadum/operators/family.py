"""Families of lemmas: edges with all their counters, seeds, and the merge of mined and given edges.

Aggregations run per edge with partial counts; what an edge gathers is limited by rank before it is gathered. Null lemmas and edges to
themselves are left out; no edges give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from maldadum import vocab
from maldadum.functions import features as X, similarity as S, text as T
from maldadum.operators.candidates import merge_counts
from maldadum.operators.mining import top_values


def family_edges(graph: DataFrame, min_frequency: int = 2, per_lemma: int = 12) -> DataFrame:
    """Per (``src``, ``dst``) of surface edges: ``frequency``, ``similarity`` (the best of its edges), dominant ``channel``, ``n_terms``, ``score`` and ``rank`` within src."""
    keyed = graph.where("src <> replacement").select("src", F.col("replacement").alias("dst"), "frequency", "surfaceSimilarity", "interfaceStats", "contextHints")
    sums = keyed.groupBy("src", "dst").agg(F.sum("frequency").alias("frequency"), F.max("surfaceSimilarity").alias("mined"))
    channel = top_values(keyed.select("src", "dst", F.explode("interfaceStats").alias("channel", "n")), ["src", "dst"], "channel", 1, F.col("n")).select("src", "dst", "channel")
    terms = keyed.select("src", "dst", F.explode("contextHints.term").alias("term")).where("term is not null").groupBy("src", "dst").agg(F.count_distinct("term").alias("n_terms"))
    rated = sums.join(channel, ["src", "dst"], "left").join(terms, ["src", "dst"], "left").select(
        "src", "dst", "frequency", F.round(F.greatest(F.col("mined"), S.preserved(F.col("src"), F.col("dst"))), 4).alias("similarity"), F.coalesce("channel", F.lit("generic")).alias("channel"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    sim, f = F.col("similarity"), F.col("frequency")
    kept = rated.where((f >= min_frequency) & (sim >= 0.52) & ~((f <= 2) & (sim < 0.62)) & ~((F.col("channel") == "voice") & (sim < 0.72))
                       & ~((F.substring("src", 1, 1) != F.substring("dst", 1, 1)) & (sim < 0.7)) & ~((sim < 0.58) & (F.col("n_terms") == 0))).withColumn("score", X.lemma_score(f, sim))
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("frequency"), F.desc("score"), "dst"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= per_lemma)


def auto_seeds(graph: DataFrame, per_lemma: int = 6) -> DataFrame:
    """Edges between different lemmas of predicates good enough to be seeds, rescored: ``src``, ``dst``, ``score``, ``frequency``, ``typo``, ``rank``.

    :param graph: ``lemma``, ``targetLemma``, ``pos``, ``frequency``, ``generatorScore``, ``interfaceStats``, ``suffixSlots``, ``contextHints`` and maybe ``surfaceExamples``."""
    at = lambda k: F.coalesce(F.try_element_at("interfaceStats", F.lit(k)), F.lit(0))
    many = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) if c in graph.columns else F.lit(0)
    edges = graph.select(F.col("lemma").alias("src"), F.col("targetLemma").alias("dst"), "pos", "frequency", F.col("generatorScore").alias("base"), at("voice").alias("voice"), (at("generic") + at("keyboard")).alias("typed"), (many("suffixSlots") + many("surfaceExamples")).alias("n_shown"), many("contextHints").alias("n_hints"))
    allowed = F.concat_ws(">", "src", "dst").isin([f"{a}>{b}" for a, b in vocab.BROAD_ALLOWED])
    broad_source, broad_target = F.col("src").isin(*vocab.BROAD_LEMMAS), F.col("dst").isin(*vocab.BROAD_LEMMAS)
    fit = (F.col("src") != F.col("dst")) & F.concat("src", "dst").rlike("[가-힣]") & T.coarse_pos(F.col("pos")).isin(*vocab.PREDICATE_TAGS) & (F.col("frequency") >= 2) & (F.col("n_shown") > 0)
    rated = edges.where(fit & (~(broad_source | broad_target) | allowed) & ~(broad_target & (F.col("typed") < 2))).withColumn("typo", S.typo_similarity(F.col("src"), F.col("dst")))
    t, f = F.col("typo"), F.col("frequency")
    kept = rated.where((t >= 0.48) & ~((F.substring("src", 1, 1) != F.substring("dst", 1, 1)) & (t < 0.7)) & ~((F.col("voice") > 0) & (F.col("typed") == 0) & ((t < 0.72) | (f < 6))) & ~((t < 0.58) & (F.col("n_hints") <= 0)))
    scored = kept.withColumn("score", X.seed_score(F.col("base"), f, t)).groupBy("src", "dst").agg(F.max(F.struct("score", "frequency", "typo")).alias("b")).select("src", "dst", "b.*")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), F.desc("frequency"), F.desc("typo"), "dst"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= per_lemma)


def summed_edges(graph: DataFrame) -> DataFrame:
    """One edge per (``src``, ``dst``) of a graph that may hold it many times: the best ``score``, and ``stats``, the interface counts of all its rows added key by key."""
    each = graph.select("src", F.col("replacement").alias("dst"), F.col("generatorScore").alias("score"), F.explode_outer("interfaceStats").alias("channel", "n"))
    sums = each.groupBy("src", "dst", "channel").agg(F.max("score").alias("score"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
    counts = F.array_sort(F.collect_list(F.when(F.col("channel").isNotNull(), F.struct("channel", "n"))))
    return sums.groupBy("src", "dst").agg(F.max("score").alias("score"), F.map_from_entries(counts).alias("stats"))


def merged_edges(mined: DataFrame, given: DataFrame) -> DataFrame:
    """Mined and given edges (``src``, ``dst``, ``score``, ``stats`` MAP<STRING, BIGINT>) as one: the better score, counts added key by key, and where it is from."""
    a = mined.select("src", "dst", F.col("score").alias("score_a"), F.col("stats").alias("stats_a"), F.lit(True).alias("in_a"))
    b = given.select("src", "dst", F.col("score").alias("score_b"), F.col("stats").alias("stats_b"), F.lit(True).alias("in_b"))
    both = a.join(b, ["src", "dst"], "full")
    origin = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "mined").otherwise("given")
    return both.select("src", "dst", F.greatest("score_a", "score_b").alias("score"), merge_counts(F.col("stats_a"), F.col("stats_b")).alias("stats"), origin.alias("origin"))
