"""From candidate lists to decisions: family prior, verifier, reranker, guardrail options and policy.

A group is what shares ``keys``: a token in its context. A group holds few candidates (:func:`candidates.prefilter` leaves four), so each step is one window
over the group that keeps its rows where they are; all steps partition alike and need one exchange.

Candidate rows have ``dst``, ``source``, ``generator``, ``norm`` (generator within [0, 1]), ``score`` (prefilter), ``typo``, ``context``, ``interface``, ``family`` (lemmas), ``pos``,
``slots``. Model scores are differences to the unchanged sentence; absent ones count as no difference.

Defined results: absent hints, tags and slots fit anything; a group without candidates has only the choice to keep; ties go to the smaller replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum.functions import features as X, similarity as S, text as T
from maldadum.operators.candidates import curated, slots_fit, source_prior

_LEAST_VERIFIED = 3
KEEP_SCORE = 0.2


def _over(keys: Sequence[str], *order: Column | str) -> W:
    return W.partitionBy(*keys).orderBy(*order) if order else W.partitionBy(*keys)


def _beyond(score: Column, other: Column, gap: float) -> Column:
    """Whether a score of four places is at least ``gap`` above another, without the noise of their difference."""
    return F.round(score * 10000) >= F.round(other * 10000) + round(gap * 10000)


def family_prior(candidates: DataFrame, keys: Sequence[str], lemmas: str | None = None) -> DataFrame:
    """Candidates with ``family_match``: those that share a lemma with the best one (or with the array ``lemmas`` of the token's own family), and the best one itself.
    Of the others the best stays if it is .08 above all that match."""
    order = [F.desc("score"), F.desc("context"), F.desc("typo"), F.desc("norm"), "dst"]
    placed = candidates.withColumn("_place", F.row_number().over(_over(keys, *order)))
    first = lambda c: F.max(F.when(F.col("_place") == 1, F.col(c))).over(_over(keys))
    known = F.array_union(first("family"), F.coalesce(F.col(lemmas), F.array().cast("array<string>"))) if lemmas else first("family")
    rated = placed.withColumn("family_match", F.coalesce(F.arrays_overlap("family", known), F.lit(False)) | (F.col("dst") == first("dst")))
    leader = F.max(F.when(F.col("family_match"), F.col("score"))).over(_over(keys))
    among = F.row_number().over(_over([*keys, "family_match"], F.desc("score"), F.desc("typo"), F.desc("norm"), "dst"))
    kept = rated.withColumns({"_leader": leader, "_among": among}).where(F.col("family_match") | (F.col("_among") == 1) & _beyond(F.col("score"), F.col("_leader"), 0.08))
    return kept.drop("_place", "_leader", "_among")


def pos_fits(pos: Column, hints: Column) -> Column:
    return F.coalesce(F.size(hints), F.lit(0)).cast("int").isin(0, -1) | F.coalesce(pos == "", F.lit(True)) | F.array_contains(hints, T.coarse_pos(pos))


def any_slot_fits(slots: Column, hints: Column) -> Column:
    absent = lambda x: F.coalesce(F.size(x), F.lit(0)).isin(0, -1)
    return absent(slots) | absent(hints) | F.exists(slots, lambda a: F.exists(hints, lambda b: slots_fit(a, b)))


def verified(candidates: DataFrame, keys: Sequence[str], pos_hints: str | None = None, slot_hints: str | None = None) -> DataFrame:
    """The candidates that pass the gates, with ``verifier`` and ``place``: at most two curated ones and one other if it is .08 above, or three where none is curated;
    ``fast`` tells whether the group's leader is so clear that no model needs to be asked.

    :param pos_hints: array of tags that the token's analyses allow; ``slot_hints`` their suffix slots."""
    none = F.array().cast("array<string>")
    rows = candidates.withColumns({"_pos": pos_fits(F.col("pos"), F.col(pos_hints) if pos_hints else none), "_slot": any_slot_fits(F.col("slots"), F.col(slot_hints) if slot_hints else none), "_cur": curated(F.col("source"))})
    group = _over(keys)
    rows = rows.withColumns({
        "_curated": F.max(F.col("_cur").cast("int")).over(group) == 1, "_matched": F.max(F.col("family_match").cast("int")).over(group) == 1,
        "_best": F.coalesce(F.max(F.when(F.col("_cur"), F.col("score"))).over(group), F.lit(0.0))})
    c, fm, ctx, score, t = F.col("_cur"), F.col("family_match"), F.col("context"), F.col("score"), F.col("typo")
    gates = F.col("_pos") & (F.col("_slot") | c) & ~(F.col("_matched") & ~fm & ~c & (ctx < 0.18) & ~_beyond(score, F.col("_best"), 0.04)) & ~(F.col("_curated") & ~c & (ctx < 0.12) & ~_beyond(score, F.col("_best"), 0.05)) & ~((t < 0.56) & ~fm & (ctx < 0.2))
    bonus = F.when(fm, 0.08).otherwise(0.0) + F.when(c, 0.05).otherwise(0.0) + F.when(F.col("_slot"), 0.03).otherwise(0.0)
    passed = rows.where(gates).withColumn("verifier", S.rounded(0.42 * t + 0.24 * F.col("norm") + 0.2 * score + 0.06 * ctx + 0.04 * F.col("interface") + bonus))
    placed = passed.withColumn("_of", F.row_number().over(_over([*keys, "_cur"], F.desc("verifier"), F.desc("score"), F.desc("typo"), "dst")))
    top = F.max(F.when(F.col("_cur"), F.col("verifier"))).over(group)
    kept = placed.withColumn("_top", top).where(F.when(~F.col("_curated"), F.col("_of") <= _LEAST_VERIFIED).when(c, F.col("_of") <= 2).otherwise((F.col("_of") == 1) & (F.col("_top").isNull() | _beyond(F.col("verifier"), F.col("_top"), 0.08))))
    place = F.row_number().over(_over(keys, F.desc("verifier"), F.desc("context"), F.desc("score"), F.desc("typo"), "dst"))
    kept = kept.withColumn("place", place)
    at = lambda value, n: F.max(F.when(F.col("place") == n, value)).over(group)
    lead = {"_l_cur": at(c.cast("int"), 1) == 1, "_l_v": at(F.col("verifier"), 1), "_l_ctx": at(ctx, 1), "_l_score": at(score, 1), "_second": F.coalesce(at(F.col("verifier"), 2), F.lit(0.0)), "_n": F.count(F.lit(1)).over(group)}
    kept = kept.withColumns(lead)
    v, second = F.col("_l_v"), F.col("_second")
    clear = (v >= 0.76) & _beyond(v, second, 0.08) & ((F.col("_l_ctx") >= 0.05) | (F.col("_l_score") >= 0.78))
    sure = (v >= 0.82) & _beyond(v, second, 0.14) & ((F.col("_l_ctx") >= 0.08) | (F.col("_l_score") >= 0.9))
    fast = F.col("_l_cur") & ((F.col("_n") == 1) & (v >= 0.72) | sure | clear)
    return kept.withColumn("fast", F.coalesce(fast, F.lit(False))).drop(*[x for x in kept.columns if x.startswith("_")])


def reranked(candidates: DataFrame, keys: Sequence[str], token: str = "tok", mlm: str | None = None, electra: str | None = None, morph: str | None = None) -> DataFrame:
    """Verified candidates with ``final``, by which they are decided, and ``verdict`` (the context verifier): the verifier's score in fast groups, else models, closeness and priors together.

    Of two or more curated ones, where the leader by meaning is not the leader by closeness and models set it clearly apart, the former gains and the latter loses.

    :param mlm: columns of score differences to the unchanged sentence; a model that is absent counts as no difference."""
    delta = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name else F.lit(0.0)
    m, e, k = delta(mlm), delta(electra), delta(morph)
    t = F.col("typo")
    verdict = X.verifier(e, k, t, F.col("context"), F.col("interface"))
    gain = 0.24 * S.sigmoid(m) + 0.28 * S.sigmoid(e * 8) + 0.12 * S.sigmoid(k / 3) + 0.22 * verdict + 0.1 * S.sigmoid(F.col("generator"))
    priors = 0.08 * t + 0.04 * source_prior(F.col("source")) + 0.04 * F.col("context") + 0.02 * F.col("interface") + F.when(F.col("family_match"), 0.04).otherwise(0.0)
    minus = F.least(F.lit(0.18), 0.06 * F.levenshtein(F.col(token), F.col("dst"))) + F.when(t < 0.6, 0.16).otherwise(0.0)
    slow = S.rounded(F.greatest(F.lit(0.01), F.least(F.lit(0.99), gain + priors - minus)))
    rows = candidates.withColumns({"verdict": S.rounded(verdict), "_e": F.round(e, 4), "_k": F.round(k, 4), "final": F.when(F.col("fast"), F.col("verifier")).otherwise(slow)})
    open_curated = curated(F.col("source")) & ~F.col("fast")
    value = lambda *parts: F.when(open_curated, F.struct(*[F.col(p).alias(f"p{i}") for i, p in enumerate(parts)], F.col("final").alias("f"), (-F.col("place")).alias("q")))
    group = _over(keys)
    carried = F.struct("place", "verdict", "_k", "_e")
    rows = rows.withColumns({"_meaning": F.max_by(carried, value("verdict", "_k", "_e")).over(group), "_close": F.max_by(carried, value("typo", "score", "norm")).over(group), "_n": F.count_if(open_curated).over(group)})
    gap = lambda c: F.col(f"_meaning.{c}") - F.col(f"_close.{c}")
    apart = (F.col("_n") >= 2) & (F.col("_meaning.place") != F.col("_close.place")) & (gap("verdict") >= 0.015) & ((gap("_k") >= 1.5) | (gap("_e") >= 0.01))
    moved = F.when(apart & (F.col("place") == F.col("_meaning.place")), F.least(F.lit(0.99), F.col("final") + 0.14)).when(apart & (F.col("place") == F.col("_close.place")), F.greatest(F.lit(0.01), F.col("final") - 0.12)).otherwise(F.col("final"))
    return rows.withColumn("final", S.rounded(F.when(F.col("fast"), F.col("final")).otherwise(F.coalesce(moved, F.col("final"))))).drop("_e", "_k", "_meaning", "_close", "_n")


def guardrail(original: Column, replacement: Column, guarded: Column, chat: Column, score: Column) -> Column:
    """``struct<decision, reasons, score>`` of a replacement: rejected in guarded spans and where Latin letters or digits are touched, else a suggestion."""
    risky = original.rlike("[A-Za-z0-9]") | replacement.rlike("[A-Za-z0-9]")
    long = F.abs(F.length(replacement) - F.length(original)) / F.greatest(F.length(original), F.lit(1)) > 0.25
    reasons = F.array_compact(F.array(F.when(long, "EDIT_RATIO_HIGH"), F.when(chat, "CHAT_PROFILE"), F.lit("LEXICAL_REPLACEMENT")))
    made = lambda d, r, s: F.struct(F.lit(d).alias("decision"), r.alias("reasons"), s.cast("double").alias("score"))
    return F.when(guarded, made("REJECT", F.array(F.lit("PROTECTED_SPAN")), F.lit(0.01))).when(risky, made("REJECT", F.array(F.lit("ALNUM_RISK")), F.lit(0.05))).otherwise(made("SUGGEST_ONLY", reasons, score))


def option_score(score: Column, reasons: Column, curated: Column, family: Column | None = None) -> Column:
    """A candidate's score less what speaks against it, .02 more for one of the token's family, at least that of keeping the token."""
    minus = 0.08 + F.when(curated, 0.0).otherwise(0.03) + F.when(F.array_contains(reasons, "EDIT_RATIO_HIGH"), 0.05).otherwise(0.0) + F.when(F.array_contains(reasons, "CHAT_PROFILE"), 0.02).otherwise(0.0)
    plus = F.lit(0.0) if family is None else F.when(family, 0.02).otherwise(0.0)
    return S.rounded(F.greatest(F.lit(0.2), score - minus + plus))


def policy(kind: Column, decision: Column, confidence: Column) -> Column:
    """What becomes of an edit of a kind: rejected stays rejected, sure spelling and spacing edits are applied, open replacements are only suggested."""
    return (F.when(decision == "REJECT", "REJECT").when(kind.isin("SPACE_INSERT", "SPACE_DELETE", "SPELL") & (confidence >= 0.95), "AUTO_APPLY").when(kind == "OPEN_REPLACE", "SUGGEST_ONLY").otherwise(decision))


def overall(decisions: Column) -> Column:
    """One decision for an array of them: REJECT if any is, else SUGGEST_ONLY if any is, else AUTO_APPLY."""
    return F.when(F.array_contains(decisions, "REJECT"), "REJECT").when(F.array_contains(decisions, "SUGGEST_ONLY"), "SUGGEST_ONLY").otherwise("AUTO_APPLY")


def options(ranked: DataFrame, keys: Sequence[str], token: str, guarded: Column, chat: Column, limit: int = 3) -> DataFrame:
    """What a proposal may choose for each group: the ``limit`` best candidates by ``final``, judged, and to keep the token: ``replacement``, ``source``, ``decision``,
    ``reasons``, ``final``, ``option`` and ``rank``."""
    best = ranked.withColumn("_n", F.row_number().over(_over(keys, F.desc("final"), "place"))).where(F.col("_n") <= limit)
    judged = best.withColumn("_g", guardrail(F.col(token), F.col("dst"), guarded, chat, F.col("final")))
    score = option_score(F.col("final"), F.col("_g.reasons"), curated(F.col("source")), F.col("family_match"))
    some = judged.select(*keys, F.col("dst").alias("replacement"), "source", policy(F.lit("OPEN_REPLACE"), F.col("_g.decision"), F.col("final")).alias("decision"), F.col("_g.reasons").alias("reasons"), "final", score.alias("option"))
    keep = ranked.select(*keys, F.col(token).alias("replacement")).distinct().select(*keys, "replacement", F.lit("ORIGINAL").alias("source"), F.lit("KEEP").alias("decision"), F.array(F.lit("KEEP_ORIGINAL")).alias("reasons"), F.lit(KEEP_SCORE).alias("final"), F.lit(KEEP_SCORE).alias("option"))
    both = some.unionByName(keep)
    return both.withColumn("rank", F.row_number().over(_over(keys, F.desc("option"), F.desc("final"), (F.col("decision") == "KEEP").cast("int"), "replacement")))
