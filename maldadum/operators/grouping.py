"""Which tokens of a sentence are taken together: routing of labels, locks, neighbours that are one word, phrases, and groups that consume tokens.

Tokens are rows (``key``, ``idx``, ``tok``, ``st``, ``ed``, ``label``, ``confidence``). What may begin at a token is found by joins on the token; the choice from left to right
is a fold over the few places of a sentence where anything may begin.

Defined results: absent labels count as KEEP; absent confidences as 0; ties go to the smaller replacement; sentences without labels have no groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum import vocab
from maldadum.functions import features as X, similarity as S, spans as P, text as T
from maldadum.operators.candidates import curated, with_head

#: Without counts per channel and without hints.
_CHANNEL = 0.1 * 0.86


def routed(label: Column, source: Column, score: Column) -> Column:
    """``struct<label, decision>`` of a label and the best candidate at hand: endings and punctuation with a good curated candidate become open replacements, spacing and
    other punctuation are left to the stages that care for them."""
    promoted = label.isin("PUNCT_FIX", "JOSA_FIX", "EOMI_FIX") & curated(source) & F.coalesce(score >= 0.55, F.lit(False))
    made = lambda to, why: F.struct(to.alias("label"), F.lit(why).alias("decision"))
    return (F.when(promoted, made(F.lit("OPEN_REPLACE"), "PROMOTE_TO_OPEN_REPLACE")).when(label == "SPACE_FIX", made(F.lit("KEEP"), "DEFER_TO_SPACING"))
            .when(label == "PUNCT_FIX", made(F.lit("KEEP"), "DEFER_TO_RULES")).otherwise(made(F.coalesce(label, F.lit("KEEP")), "PASS_TO_DOWNSTREAM")))


def locked(label: Column, st: Column, ed: Column, spans: Column, source: Column, context: Column) -> Column:
    """The label within settled spans: an open replacement there is kept as it is, unless a seed of its family has context for it."""
    strong = F.coalesce(source.isin("FAMILY_SEED", "FAMILY_SURFACE_EXAMPLE") & (context >= 0.18), F.lit(False))
    return F.when((label == "OPEN_REPLACE") & P.overlaps_any(st, ed, spans) & ~strong, "KEEP").otherwise(label)


def tagged(tokens: DataFrame, best: DataFrame) -> DataFrame:
    """Token rows with ``label`` and ``confidence`` from a model's ``predicted`` label and ``sure``ness, and from their best candidate.

    What is guarded, has Latin letters or digits, is less than half Hangul or of one character is kept. A short Hangul token that the model keeps is opened again if it may be a predicate that is
    often confused (``confusable``) and its best candidate is a curated predicate, good and supported enough.

    :param tokens: ``key``, ``idx``, ``tok``, ``st``, ``ed``, ``guard`` (spans), ``predicted``, ``sure``, ``confusable``.
    :param best: best candidate per (``key``, ``idx``): ``source``, ``score``, ``norm``, ``context``, ``family``, ``pos``."""
    met = tokens.join(best.select("key", "idx", "source", "score", "norm", "context", F.size("family").alias("_family"), "pos"), ["key", "idx"], "left")
    n, none = F.length("tok"), F.lit(0.0)
    short = F.col("tok").rlike("^[가-힣]{2,6}$") & F.coalesce("confusable", F.lit(False)) & curated(F.col("source")) & (F.coalesce(T.coarse_pos(F.col("pos")).isin(*vocab.PREDICATE_TAGS), F.lit(False)) | (F.col("_family") > 0))
    brief = n <= 4
    context = F.coalesce("context", none)
    seeded = F.col("source").isin("FAMILY_SEED", "PHRASE_MEMORY", "FAMILY_SURFACE_EXAMPLE", "AUTO_FAMILY_SEED")
    good = (F.col("score") >= F.when(brief, 0.58).otherwise(0.66)) & (F.col("norm") >= F.when(brief, 0.72).otherwise(0.82)) & (seeded | (context >= 0.18))
    again = (F.col("predicted") == "KEEP") & F.coalesce(short & good, F.lit(False))
    made = lambda label, sure: F.struct(label.alias("label"), sure.cast("double").alias("confidence"))
    keep = F.lit("KEEP")
    label = (F.when(P.overlaps_any(F.col("st"), F.col("ed"), F.col("guard")), made(keep, F.lit(1.0))).when(F.col("tok").rlike("[A-Za-z0-9]"), made(keep, F.lit(0.99)))
             .when((T.hangul_ratio(F.col("tok")) < 0.5) | (n < 2), made(keep, F.lit(0.98))).when(again, made(F.lit("OPEN_REPLACE"), F.greatest("sure", F.round("score", 4))))
             .otherwise(made(F.coalesce("predicted", keep), F.coalesce("sure", none))))
    return met.withColumn("_l", label).select(*tokens.columns, "_l.label", "_l.confidence")


def heuristic(tokens: DataFrame, best: DataFrame, least: float = 0.72) -> DataFrame:
    """Token rows with ``label`` and ``confidence`` without a model: opened where the best candidate's ``score`` is at least ``least``."""
    met = tokens.join(best.select("key", "idx", "score"), ["key", "idx"], "left")
    made = lambda label, sure: F.struct(F.lit(label).alias("label"), F.round(sure, 4).cast("double").alias("confidence"))
    plain = (T.hangul_ratio(F.col("tok")) < 0.5) | (F.length("tok") < 2) | F.col("score").isNull()
    label = (F.when(P.overlaps_any(F.col("st"), F.col("ed"), F.col("guard")), made("KEEP", F.lit(1.0))).when(plain, made("KEEP", F.lit(0.98)))
             .when(F.col("score") >= least, made("OPEN_REPLACE", F.col("score"))).otherwise(made("KEEP", 1 - F.col("score") * 0.4)))
    return met.withColumn("_l", label).select(*tokens.columns, "_l.label", "_l.confidence")


def phrase_targets(tokens: DataFrame, memory: DataFrame, least: float = 0.98) -> DataFrame:
    """Spans (``key``, ``st``, ``ed``) whose tokens already are the right form of a sure phrase of two tokens or more (``dst``, ``confidence``)."""
    forms = with_head(memory.where(F.col("confidence") >= least), "dst", "head").withColumn("form", T.phrase(F.col("dst"))).withColumn("n", F.size(F.split("form", " "))).where("n >= 2").select("head", "form", "n").distinct()
    longest = forms.agg(F.max("n")).first()[0] or 1
    ahead = W.partitionBy("key").orderBy("idx").rowsBetween(0, longest - 1)  # a sentence
    run = tokens.withColumn("run", F.collect_list(F.struct("tok", "ed")).over(ahead))
    met = run.join(forms, F.col("tok") == F.col("head")).where((F.size("run") >= F.col("n")) & (F.array_join(F.slice(F.col("run.tok"), F.lit(1), F.col("n")), " ") == F.col("form")))
    return met.select("key", "st", F.get(F.col("run.ed"), F.col("n") - 1).alias("ed")).distinct()


def pairs(tokens: DataFrame, text: str, fixes: DataFrame) -> DataFrame:
    """Neighbours kept as they are that together are a known misspelling or fit a spelling pattern: ``key``, ``idx``, ``st``, ``ed``, ``original``, ``replacement``, ``source``, ``score``,
    ``confidence``; the best replacement per place.

    :param tokens: with the whole sentence in ``text``.
    :param fixes: ``src``, ``dst``, ``confidence``."""
    order = W.partitionBy("key").orderBy("idx")
    after = {f"_{c}": F.lead(c).over(order) for c in ("label", "st", "ed", "confidence")}
    both = tokens.withColumns(after).where((F.coalesce("label", F.lit("KEEP")) == "KEEP") & (F.coalesce("_label", F.lit("KEEP")) == "KEEP") & F.col("_st").isNotNull())
    cut = lambda a, b: F.substring(F.col(text), a + 1, b - a)
    both = both.where(F.trim(cut(F.col("ed"), F.col("_st"))) == "").select("key", "idx", "st", F.col("_ed").alias("ed"), cut(F.col("st"), F.col("_ed")).alias("original"), ((F.coalesce("confidence", F.lit(0.0)) + F.coalesce("_confidence", F.lit(0.0))) / 2 * 0.78).alias("confidence"))
    both = both.withColumn("whole", F.regexp_replace("original", r"\s+", "")).where((F.length("whole") >= 2) & (T.hangul_ratio(F.col("whole")) >= 0.7))
    columns = ["key", "idx", "st", "ed", "original", "confidence", "whole"]
    known = both.join(fixes.select(F.col("src").alias("whole"), F.col("dst").alias("replacement"), F.col("confidence").cast("double").alias("generator")), "whole").select(*columns, "replacement", F.lit("SURFACE_FIX_RETOKENIZED").alias("source"), "generator")
    shaped = both.where(F.col("whole").rlike("께$|께요$|^않|^안됐")).select(*columns, T.each(X.pattern_candidates(F.col("whole"))).alias("p")).where("p is not null")
    shaped = shaped.select(*columns, F.col("p.dst").alias("replacement"), F.when(F.contains("p.dst", F.lit(" ")), "COMMON_PHRASE_PATTERN").otherwise("COMMON_SURFACE_PATTERN").alias("source"), F.col("p.score").alias("generator"))
    every = known.unionByName(shaped).where(F.col("replacement") != F.col("original")).withColumn("typo", S.typo_similarity(F.col("whole"), F.replace(F.col("replacement"), F.lit(" "))))
    sure = F.col("source").isin("COMMON_PHRASE_PATTERN", "SURFACE_FIX_RETOKENIZED")
    rated = every.where(F.col("typo") >= F.when(sure, 0.62).otherwise(0.72)).withColumn("score", S.rounded(0.46 * S.unit_score(F.col("generator")) + 0.3 * F.col("typo") + _CHANNEL))
    best = rated.withColumn("_n", F.row_number().over(W.partitionBy("key", "idx").orderBy(F.desc("score"), F.desc("generator"), F.desc("typo"), "replacement"))).where("_n = 1")
    return best.where(F.col("score") >= F.when(sure, 0.72).otherwise(0.78)).select("key", "idx", "st", "ed", "original", "replacement", "source", "score", F.round("confidence", 4).alias("confidence"))


def phrases(tokens: DataFrame, text: str, memory: DataFrame, most: int = 3) -> DataFrame:
    """Runs of two or three open replacements that are a phrase of ``memory`` (``src``, ``dst``, ``confidence``), exactly or one letter off a sure one: ``key``, ``idx``, ``n_tokens``, ``st``,
    ``ed``, ``original``, ``replacement``, ``source``, ``score``, ``confidence``; the best per place."""
    order = W.partitionBy("key").orderBy("idx")
    open_ = (F.coalesce("label", F.lit("KEEP")) == "OPEN_REPLACE").cast("int")
    ahead = order.rowsBetween(0, most - 1)
    seen = tokens.withColumns({"_run": F.collect_list(F.struct("ed", open_.alias("o"), F.coalesce("confidence", F.lit(0.0)).alias("c"))).over(ahead)}).where(open_ == 1)
    n = F.explode(F.filter(F.sequence(F.lit(2), F.lit(most)), lambda k: (k <= F.size("_run")) & F.forall(F.slice("_run", 1, k), lambda x: x["o"] == 1)))
    runs = seen.select("key", "idx", "tok", "st", "_run", text, n.alias("n_tokens"))
    end = F.get(F.col("_run.ed"), F.col("n_tokens") - 1)
    mean = F.aggregate(F.slice(F.col("_run.c"), F.lit(1), F.col("n_tokens")), F.lit(0.0), lambda a, c: a + c) / F.col("n_tokens")
    runs = runs.select("key", "idx", "tok", "st", end.alias("ed"), "n_tokens", F.substring(F.col(text), F.col("st") + 1, end - F.col("st")).alias("original"), F.round(mean, 4).alias("confidence"))
    forms = with_head(memory.where("src <> dst and dst <> ''"), "src", "tok").select("tok", T.phrase(F.col("src")).alias("form"), F.col("dst").alias("replacement"), F.col("confidence").cast("double").alias("sure")).withColumn("n_tokens", F.size(F.split("form", " ")))
    met = runs.join(forms, ["tok", "n_tokens"]).withColumn("said", T.phrase(F.col("original")))
    bare = lambda c: F.replace(F.col(c), F.lit(" "))
    same = F.col("said") == F.col("form")
    near = S.typo_similarity(bare("said"), bare("form"))
    met = met.withColumn("typo", F.when(same, 1.0).otherwise(near)).where(same | (F.col("typo") >= 0.94) & (F.levenshtein(bare("said"), bare("form")) <= 1) & (F.col("sure") >= 0.98))
    generator = F.when(same, F.col("sure")).otherwise(F.greatest(F.lit(0.72), F.col("sure") - 0.08 + (F.col("typo") - 0.86) * 0.4))
    rated = met.withColumns({"source": F.when(same, "PHRASE_MEMORY").otherwise("PHRASE_MEMORY_FUZZY"), "generator": generator, "score": S.rounded(0.48 * S.unit_score(generator) + 0.28 * F.col("typo") + _CHANNEL)})
    kept = rated.where((F.col("score") >= F.when(same, 0.76).otherwise(0.86)) & (F.col("typo") >= 0.97))  # less alike ones would need context
    best = W.partitionBy("key", "idx").orderBy(F.desc("score"), "n_tokens", F.desc("generator"), F.desc("typo"), "replacement")
    return kept.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("key", "idx", "n_tokens", "st", "ed", "original", "replacement", "source", "score", "confidence")


def groups(tokens: DataFrame, text: str, fixes: DataFrame, memory: DataFrame) -> DataFrame:
    """The groups of each sentence from left to right, each beginning after the last one: ``key``, ``idx``, ``n_tokens``, ``kind`` ('pair', 'phrase' or 'token'), ``st``, ``ed``, ``original``,
    ``replacement`` (null for a token, whose candidates are to be found), ``score``, ``confidence``.

    At one place a pair comes before a phrase and a phrase before the token alone."""
    pair = pairs(tokens, text, fixes).select("key", "idx", F.lit(0).alias("age"), F.lit("pair").alias("kind"), F.lit(2).alias("n_tokens"), "st", "ed", "original", "replacement", "score", "confidence")
    phrase = phrases(tokens, text, memory).select("key", "idx", F.lit(1).alias("age"), F.lit("phrase").alias("kind"), "n_tokens", "st", "ed", "original", "replacement", "score", "confidence")
    alone = tokens.where(F.coalesce("label", F.lit("KEEP")) == "OPEN_REPLACE").select("key", "idx", F.lit(2).alias("age"), F.lit("token").alias("kind"), F.lit(1).alias("n_tokens"), "st", "ed", F.col("tok").alias("original"), F.lit(None).cast("string").alias("replacement"), F.lit(None).cast("double").alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    first = W.partitionBy("key", "idx").orderBy("age")
    places = pair.unionByName(phrase).unionByName(alone).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    lined = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("idx", "n_tokens", "kind", "st", "ed", "original", "replacement", "score", "confidence"))).alias("p"))
    free = F.aggregate("p", F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("taken")), lambda acc, x: F.when(x["idx"] >= acc["next"], F.struct((x["idx"] + x["n_tokens"]).alias("next"), F.concat(acc["taken"], F.array(x["idx"])).alias("taken"))).otherwise(acc), lambda acc: acc["taken"])
    chosen = lined.withColumn("taken", free).select("key", F.explode(F.filter("p", lambda x: F.array_contains(F.col("taken"), x["idx"]))).alias("g"))
    return chosen.select("key", "g.*")


def labelled_tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Token rows of examples (``tokens``, ``labels``, ``token_offsets``) for the functions of this module, with the whole sentence in ``text``."""
    each = rows.select(F.col(key).alias("key"), text, F.posexplode(F.arrays_zip("tokens", "labels", "token_offsets")).alias("idx", "t"))
    return each.select("key", text, "idx", F.col("t.tokens").alias("tok"), F.get("t.token_offsets", F.lit(0)).alias("st"), F.get("t.token_offsets", F.lit(1)).alias("ed"), F.col("t.labels").alias("label"), F.lit(1.0).alias("confidence"))


def manual_phrases(df: DataFrame) -> DataFrame:
    """The phrases given by hand as a table of ``df``'s session."""
    return df.sparkSession.createDataFrame(list(vocab.MANUAL_PHRASES), "src STRING, dst STRING, confidence DOUBLE")
