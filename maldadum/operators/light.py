"""The light variants, which need no model and no analyses: profile, spacing by hint words, candidates, verifier and reranker of short lists, and previews of edits.

Candidates are rows (``key``, ``st``, ``ed``, ``original``, ``replacement``, ``source``, ``generator``) with whatever is known of ``edits``, ``pos_hint``, ``slot_hints``, ``family``, ``hint_terms``.

Defined results: what is absent gives neither bonus nor malus; ties go to the smaller replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum.functions import similarity as S, spans as P, text as T

# Words whose beginnings and ends tell a missing blank.
_HINTS = ("오늘", "날씨가", "너무", "좋은데", "산책", "가도", "할", "수")


def profile(text: Column) -> Column:
    """As :func:`text.profile`, with two more marks of chat and any white space as a blank."""
    chat = text.rlike(r"(?<![A-Za-z0-9_])ㄹㅇ(?![A-Za-z0-9_])|개좋")
    base = T.profile(text)
    return F.when((base != "MIXED") & chat, "CHAT").when((base == "NOISY") & text.rlike(r"\s"), "NORMAL").otherwise(base)


def spacing_points(rows: DataFrame, key: str, text: str, profile: str = "profile", guarded: str = "spans") -> DataFrame:
    """Places between two Hangul letters where hint words around speak for a blank: ``key``, ``place``, ``score`` of .8 at least."""
    t = F.col(text)
    places = rows.where(F.length(t) > 1).select(key, t.alias("t"), F.col(profile).alias("p"), F.col(guarded).alias("g"), F.explode(F.sequence(F.lit(1), F.length(t) - 1)).alias("place"))
    near = F.substring("t", F.greatest(F.col("place") - 4, F.lit(0)) + 1, F.least(F.col("place") + 4, F.length("t")) - F.greatest(F.col("place") - 4, F.lit(0)))
    score = F.lit(0.42)
    for hint in _HINTS:
        score = score + F.when(F.contains("near", F.lit(hint[:2])) | F.contains("near", F.lit(hint[-2:])), 0.1).otherwise(0.0)
    score = score + F.when(F.col("near").rlike("가도|는데|어요|했다|하면"), 0.15).otherwise(0.0) + F.when(F.col("p") == "NOISY", 0.03).otherwise(0.0)
    free = places.where(F.substring("t", F.col("place"), F.lit(2)).rlike("^[가-힣]{2}$") & ~P.overlaps_any(F.col("place") - 1, F.col("place") + 1, F.col("g")))
    rated = free.withColumn("near", near).withColumn("score", F.round(F.least(F.lit(0.99), score), 4))
    return rated.where(F.round(score, 6) >= 0.8).select(key, "place", "score")


def candidates(found: DataFrame, limit: int = 6) -> DataFrame:
    """One candidate per place and replacement, the best, with ``edits``; those too far away are left out and the best ``limit`` per place stay, beside the original with .2."""
    near = found.where((F.col("replacement") != "") & (F.col("replacement") != F.col("original"))).withColumn("edits", F.levenshtein("original", "replacement"))
    near = near.where(F.col("edits") <= F.greatest(F.lit(3), F.ceil(F.length("original") * 0.5)))
    one = near.withColumn("_n", F.row_number().over(W.partitionBy("key", "st", "ed", "replacement").orderBy(F.desc("generator"), "source"))).where("_n = 1")
    best = one.withColumn("_n", F.row_number().over(W.partitionBy("key", "st", "ed").orderBy(F.desc("generator"), "replacement"))).where(F.col("_n") <= limit).drop("_n")
    kept = found.select("key", "st", "ed", "original").distinct().withColumns({"replacement": F.col("original"), "source": F.lit("ORIGINAL"), "generator": F.lit(0.2)})
    return best.unionByName(kept, allowMissingColumns=True)


def one_edit(tokens: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Known surfaces (``src``) at most one edit from a token (``tok``), whatever they begin with: both meet on what is left when at most one letter is taken away."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        w = F.col(name)
        less = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return df.select(name).where(F.length(name) > 0).distinct().select(name, F.explode(F.array_distinct(F.concat(F.array(w), less))).alias("key"))

    met = keyed(tokens.where(F.length("tok") >= 2), "tok").join(keyed(surfaces, "src"), "key").where(F.col("tok") != F.col("src")).select("tok", "src").distinct()
    return met.where(F.levenshtein("tok", "src") <= 1)


def verified(rows: DataFrame, text: str, canonical: DataFrame | None = None) -> DataFrame:
    """Candidates with ``verify`` of at least .36, and the originals with .25. ``canonical`` (``key``, ``st``, ``ed``, ``lemma_key``, ``pos``, ``slots``) is what is known of the places by analysis."""
    joined = rows if canonical is None else rows.join(canonical.select("key", "st", "ed", F.col("lemma_key").alias("_lemma"), F.col("pos").alias("_pos"), F.array_join("slots", "+").alias("_slot")), ["key", "st", "ed"], "left")
    for name, kind in (("edits", "int"), ("pos_hint", "string"), ("slot_hints", "array<string>"), ("family", "string"), ("hint_terms", "array<string>"), ("_lemma", "string"), ("_pos", "string"), ("_slot", "string")):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(kind))
    when = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    hinted = F.coalesce(F.exists("hint_terms", lambda h: (h != "") & F.contains(F.col(text), h)), F.lit(False))
    slot_known = (F.size("slot_hints") > 0) & (F.col("_slot") != "")
    score = (0.35 + F.col("generator") * 0.35 + when(F.col("edits") <= 1, 0.18) - when(F.col("edits") >= 4, 0.25)
             + when(F.col("pos_hint") == F.col("_pos"), 0.12) - when(F.col("pos_hint") != F.col("_pos"), 0.2)
             + when(slot_known & F.array_contains("slot_hints", F.col("_slot")), 0.14) - when(slot_known & ~F.array_contains("slot_hints", F.col("_slot")), 0.18)
             - when(F.col("family") == F.col("_lemma"), 0.08) + when(F.col("family") != F.col("_lemma"), 0.06)
             + F.when(hinted, 0.12).when(F.col("source") == "AUTO_FAMILY_SEED", -0.08).otherwise(0.0) - when(F.col("source") == "GEN_BACKOFF", 0.1))
    original = F.col("source") == "ORIGINAL"
    rated = joined.withColumn("verify", F.when(original, 0.25).otherwise(S.rounded(F.greatest(F.lit(0.01), F.least(F.lit(0.99), score)), 6)))
    return rated.where(original | (F.col("verify") >= 0.36)).drop("_lemma", "_pos", "_slot")


def reranked(rows: DataFrame, text: str, chat: Column, tagger: Column) -> DataFrame:
    """Verified candidates with ``rerank`` and ``final``. ``tagger`` is the confidence of the place's label, .8 where it is null."""
    said = F.concat(F.substring(text, F.lit(1), F.col("st")), F.col("replacement"), F.substring(F.col(text), F.col("ed") + 1, F.length(text)))
    when = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    # fixed values: words that speak for or against a replacement
    score = 0.28 + F.col("verify") * 0.18 + when(F.contains(said, F.lit("아기")) & F.contains(said, F.lit("낳")), 0.55) - when(F.contains(said, F.lit("놓")), 0.2) - when(F.col("replacement") == F.col("original"), 0.08) - when(chat, 0.04)
    final = F.least(F.lit(0.99), F.greatest(F.lit(0.01), score) + 0.12 * F.col("generator") + 0.12 * F.col("verify") + 0.08 * F.coalesce(tagger, F.lit(0.8)))
    return rows.withColumns({"rerank": S.rounded(F.greatest(F.lit(0.01), F.least(F.lit(0.99), score)), 6), "final": S.rounded(final, 6)})


def best_per_place(rows: DataFrame) -> DataFrame:
    """The candidate of each place with the highest ``final``."""
    best = W.partitionBy("key", "st", "ed").orderBy(F.desc("final"), F.desc("verify"), "replacement")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def preview(text: Column, edits: Column) -> Column:
    """``struct<text, markers array<struct<st, ed>>>``: edits applied from left to right, those that begin before the last one's end passed over, and where the replacements are."""
    kind = "struct<cur:int,out:string,markers:array<struct<st:int,ed:int>>>"
    ordered = F.array_sort(F.transform(edits, lambda e: F.struct(e["st"].alias("st"), e["ed"].alias("ed"), e["dst"].alias("dst"))))

    def step(acc: Column, e: Column) -> Column:
        head = F.concat(acc["out"], F.substring(text, acc["cur"] + 1, e["st"] - acc["cur"]))
        grown = F.struct(e["ed"].alias("cur"), F.concat(head, e["dst"]).alias("out"), F.concat(acc["markers"], F.array(F.struct(F.length(head).alias("st"), (F.length(head) + F.length(e["dst"])).alias("ed")))).alias("markers"))
        return F.when(e["st"] < acc["cur"], acc).otherwise(grown.cast(kind))

    start = F.struct(F.lit(0).alias("cur"), F.lit("").alias("out"), F.array().cast("array<struct<st:int,ed:int>>").alias("markers")).cast(kind)
    return F.aggregate(ordered, start, step, lambda acc: F.struct(F.concat(acc["out"], F.substring(text, acc["cur"] + 1, F.length(text))).alias("text"), acc["markers"].alias("markers")))


def by_decision(edits: Column) -> Column:
    """``struct<auto, suggest, reject>``: edits (with ``decision``) in three arrays."""
    of = lambda d: F.filter(edits, lambda e: e["decision"] == d)
    return F.struct(of("AUTO_APPLY").alias("auto"), of("SUGGEST_ONLY").alias("suggest"), F.filter(edits, lambda e: ~e["decision"].isin("AUTO_APPLY", "SUGGEST_ONLY")).alias("reject"))
