"""Candidates from analyses: predicates of a span, their lemmas and suffix slots, lemma confusions, endings and their re-inflection.

Analyses are a column as ``adapters.analysed`` gives it (``adapters.ANALYSES``, the best first); without a model it is empty and nothing comes out of here. Re-inflection asks a
model once per distinct sequence of morphs (``adapters.inflected``).

Defined results: spans that no predicate overlaps have no state; absent slots fit anything; of equal states the one of the better analysis stays; a lemma is never its own target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum import adapters, vocab
from maldadum.adapters import Model
from maldadum.functions import features as X, similarity as S, text as T
from maldadum.operators import candidates as C

_PREDICATE = "^(?:VV|VA|VX)"


def _is_predicate(tag: Column) -> Column:
    return tag.rlike(_PREDICATE)


def bundles(analyses: Column, st: Column, ed: Column) -> Column:
    """Per analysis the morphs that overlap a span: ``array<struct<rank, score, morphs, head, slot, suffix>>``, its first verb or adjective, the tags that follow joined by a plus sign, and the
    morphs that follow; one per lemma, tag and slot."""

    def of(a: Column, rank: Column) -> Column:
        inside = F.filter(a["morphs"], lambda m: (m["ed"] > st) & (m["st"] < ed))
        at = F.array_position(F.transform(inside, lambda m: _is_predicate(m["tag"])), F.lit(True)).cast("int")
        suffix = F.slice(inside, at + 1, F.greatest(F.size(inside) - at, F.lit(0)))
        return F.when(at > 0, F.struct(rank.cast("int").alias("rank"), a["score"].alias("score"), inside.alias("morphs"), F.get(inside, at - 1).alias("head"), F.array_join(F.transform(suffix, lambda m: m["tag"]), "+").alias("slot"), suffix.alias("suffix")))

    found = F.filter(F.transform(analyses, of), lambda b: b.isNotNull())
    same = lambda b, c: (b["head"]["lemma"] == c["head"]["lemma"]) & (T.coarse_pos(b["head"]["tag"]) == T.coarse_pos(c["head"]["tag"])) & (b["slot"] == c["slot"])
    return F.filter(found, lambda b, i: ~F.exists(F.slice(found, F.lit(1), i), lambda c: same(b, c)))


def states(tokens: DataFrame, analyses: str = "analyses", most: int = 5) -> DataFrame:
    """The predicates that a token could be, from its sentence's first ``most`` analyses: the columns of ``tokens`` but the analyses, ``lemma``, ``pos``, ``tag``, ``slot`` (null if nothing
    follows), ``suffix`` (morphs), ``morphs``, ``rank``, ``irregular`` and ``stem``."""
    keep = [c for c in tokens.columns if c != analyses]
    each = tokens.select(*keep, T.each(bundles(F.slice(analyses, 1, most), F.col("st"), F.col("ed"))).alias("b")).where("b is not null and trim(b.head.lemma) <> ''")
    lemma = F.trim("b.head.lemma")
    stem = F.when(F.endswith(lemma, F.lit("다")), T.stem(lemma)).otherwise(F.col("b.head.form"))
    slot = F.when(F.col("b.slot") != "", F.col("b.slot"))
    return each.select(*keep, lemma.alias("lemma"), T.coarse_pos(F.col("b.head.tag")).alias("pos"), F.col("b.head.tag").alias("tag"), slot.alias("slot"), F.col("b.suffix").alias("suffix"), F.col("b.morphs").alias("morphs"), F.col("b.rank").alias("rank"), X.irregular_class(lemma).alias("irregular"), stem.alias("stem"))


def predicate_lemmas(analyses: Column, most: int = 2) -> Column:
    """Distinct lemmas of verbs and adjectives in the first analyses, in their order."""
    every = F.flatten(F.transform(F.slice(analyses, 1, most), lambda a: a["morphs"]))
    return F.array_distinct(F.transform(F.filter(every, lambda m: m["tag"].rlike("^(?:VV|VA)")), lambda m: m["lemma"]))


def lemma_tag(analyses: Column, lemma: Column, fallback: Column) -> Column:
    """The tag that a lemma's own first two analyses give it, else the fallback's coarse tag."""
    every = F.flatten(F.transform(F.slice(analyses, 1, 2), lambda a: a["morphs"]))
    own = F.get(F.filter(every, lambda m: (m["lemma"] == lemma) & m["tag"].rlike("^(?:VV|VA)")), F.lit(0))
    return F.coalesce(own["tag"], T.coarse_pos(fallback))


def looks_like_predicate(analyses: Column) -> Column:
    every = F.flatten(F.transform(F.slice(analyses, 1, 2), lambda a: a["morphs"]))
    return F.coalesce(F.exists(every, lambda m: m["tag"].rlike("^(?:VV|VA|VX|XSV|XSA)")), F.lit(False))


def word_tokens(morphs: DataFrame, text: str) -> DataFrame:
    """Words put together from morph rows (``key``, ``sent``, ``word``, ``form``, ``tag``, ``st``, ``ed``, and the sentence in ``text``): ``key``, ``st``, ``ed``, ``tok``, ``lemma_key`` (head and 다), ``pos``, ``slots``."""
    grouped = morphs.groupBy("key", "sent", "word").agg(F.first(text).alias("said"), F.min("st").alias("st"), F.max("ed").alias("ed"), F.array_sort(F.collect_list(F.struct("st", "form", "tag"))).alias("m"))  # morphs of a word
    at = F.array_position(F.transform("m", lambda x: x["tag"].rlike("^(?:VV|VA|VX|VCP|VCN)")), F.lit(True)).cast("int")
    head = F.get("m", at - 1)
    key = F.when(F.endswith(head["form"], F.lit("다")), head["form"]).otherwise(F.concat(head["form"], F.lit("다")))
    tok = F.substring("said", F.col("st") + 1, F.col("ed") - F.col("st"))
    slots = F.when(at > 0, F.transform(F.slice("m", at + 1, F.greatest(F.size("m") - at, F.lit(0))), lambda x: x["tag"])).otherwise(F.array().cast("array<string>"))
    return grouped.select("key", "st", "ed", tok.alias("tok"), F.when(at > 0, key).alias("lemma_key"), F.when(at > 0, head["tag"]).alias("pos"), slots.alias("slots")).where(F.trim("tok") != "")


def known_lemmas(found: DataFrame, lexicon: DataFrame, lemma: str = "target") -> DataFrame:
    """Rows whose ``lemma`` the lexicon (``lemma``, ``pos``) holds under their ``pos``."""
    return found.join(lexicon.select(F.col("lemma").alias(lemma), "pos").distinct(), [lemma, "pos"], "left_semi")


_TARGET = ("target", "source", "generator", "hints", "stats", "kind", "slots", "irregular_to")


def confused(state: DataFrame, edges: DataFrame) -> DataFrame:
    """States with lemmas that theirs is confused with (:func:`lemma_graph`) where a suffix slot fits: ``target``, ``source``, ``generator`` (less .03 per analysis rank, .08 at most) and counters."""
    met = state.join(edges.select(F.col("src").alias("lemma"), F.col("dst").alias("target"), "source", F.col("generator").alias("_g"), "hints", "stats", "kind", "slots"), "lemma")
    fits = (F.size("slots") == 0) | F.col("slot").isNull() | F.exists("slots", lambda s: C.slots_fit(F.col("slot"), s))
    return met.where(fits).withColumns({"generator": F.greatest(F.lit(0.0), F.col("_g") - F.least(F.lit(0.08), 0.03 * F.col("rank"))), "irregular_to": X.irregular_class(F.col("target"))}).drop("_g")


def by_endings(state: DataFrame, rules: DataFrame, lexicon: DataFrame) -> DataFrame:
    """States with lemmas that ending rules (:func:`mining.suffix_rules`, ``slots`` optional) make of theirs and the lexicon knows: an equality join on each of a stem's last characters."""
    ends = state.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(4)))).where(F.col("_n") < F.length("stem")).withColumn("source_suffix", F.substring("stem", F.length("stem") - F.col("_n") + 1, F.col("_n")))
    slots = F.col("slots") if "slots" in rules.columns else F.array().cast("array<string>")
    met = ends.join(rules.select("source_suffix", "target_suffix", "pos", "score", slots.alias("slots")), ["source_suffix", "pos"])
    made = met.withColumn("target", F.concat(F.substring("stem", F.lit(1), F.length("stem") - F.col("_n")), "target_suffix", F.lit("다"))).where((F.col("target") != F.col("lemma")) & ((F.size("slots") == 0) | F.col("slot").isNull() | F.exists("slots", lambda s: C.slots_fit(F.col("slot"), s))))
    bare = {"hints": F.array().cast(C._HINTS), "stats": F.create_map().cast("map<string,bigint>"), "kind": F.lit(None).cast("string"), "irregular_to": X.irregular_class(F.col("target"))}
    out = known_lemmas(made, lexicon).withColumns({"source": F.lit("INFLECTION_RULE"), "generator": F.greatest(F.lit(0.0), F.col("score") - F.least(F.lit(0.08), 0.02 * F.col("rank"))), **bare})
    return out.drop("_n", "source_suffix", "target_suffix", "score")


def by_similar_stems(state: DataFrame, lexicon: DataFrame, least: float = 0.72, limit: int = 3) -> DataFrame:
    """States with the lemmas of the lexicon whose stems are most like theirs."""
    stems = lexicon.select("lemma", "pos", T.stem(F.col("lemma")).alias("src"))
    near = C.similar(state.select(F.col("stem").alias("tok")).where(F.length("tok") >= 2), stems, least, 2, 1_000_000).select(F.col("tok").alias("stem"), "src", "similarity")
    met = state.join(near, "stem").join(stems.withColumnRenamed("lemma", "target"), ["src", "pos"]).where(F.col("target") != F.col("lemma"))
    keys = [c for c in ("key", "st", "ed", "lemma", "slot") if c in state.columns]
    best = met.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("similarity"), F.desc("target")))).where(F.col("_n") <= limit)
    return best.withColumns({"source": F.lit("JAMO_FALLBACK"), "generator": S.rounded(0.58 + (F.col("similarity") - least) * 0.4), "hints": F.array().cast(C._HINTS), "stats": F.create_map(F.lit("generic"), F.lit(1)).cast("map<string,bigint>"), "kind": F.lit(None).cast("string"), "slots": F.array().cast("array<string>"), "irregular_to": X.irregular_class(F.col("target"))}).drop("_n", "src", "similarity")


def reinflected(state: DataFrame, factory: Callable[[], Model] | None, token: str = "tok") -> DataFrame:
    """States with targets as candidates: ``dst``, the target's stem with the token's own endings put together by a model, and ``family``. Targets that cannot be, or give the token, are left out."""
    stem = T.stem(F.col("target"))
    sequence = F.concat(F.array(F.struct(stem.alias("form"), F.col("pos").alias("tag"))), F.transform("suffix", lambda m: F.struct(m["form"].alias("form"), m["tag"].alias("tag"))))
    said = adapters.inflected(state.withColumn("_sequence", sequence), "_sequence", "dst", factory)
    return said.where((F.col("dst") != "") & (F.col("dst") != F.col(token))).withColumn("family", F.array_sort(F.array("lemma", "target"))).drop("_sequence")


def by_examples(state: DataFrame, examples: DataFrame, token: str = "tok", least: float = 0.46) -> DataFrame:
    """Candidates from surfaces seen with a confused lemma (``lemma``, ``target``, ``from``, ``to``, ``count``, ``generator``) that the token is close to: ``dst``, ``generator``, ``family``."""
    met = state.join(examples.withColumnRenamed("generator", "_g"), "lemma").where((F.col("from") != "") & (F.col("to") != "") & (F.col("to") != F.col(token)))
    near = met.withColumn("_s", S.typo_similarity(F.col(token), F.col("from"))).where(F.col("_s") >= least)
    score = F.least(F.lit(0.985), F.col("_g") - F.least(F.lit(0.08), 0.03 * F.col("rank")) + F.least(F.lit(0.08), 0.02 * F.col("count")) + F.greatest(F.lit(0.0), F.col("_s") - 0.5) * 0.25)
    return near.withColumns({"dst": F.col("to"), "source": F.lit("FAMILY_SURFACE_EXAMPLE"), "generator": F.greatest(F.lit(0.0), score), "family": F.array_sort(F.array("lemma", "target"))}).drop("_g", "_s", "from", "to", "count")


def mended(morphs: Column) -> Column:
    """``struct<sequence, score>`` of morphs with misspelt endings put right, the best for each, and the least of their scores; null where nothing is misspelt."""
    rule = lambda m, i: F.coalesce(*[F.when((m["form"] == form) & (m["tag"] == tag), F.struct(F.lit(right).alias("form"), F.lit(score).alias("score"))) for form, tag, right, score in vocab.MORPHEME_CONFUSIONS])
    known = F.transform(morphs, rule)
    sequence = F.transform(F.arrays_zip(morphs.alias("m"), known.alias("k")), lambda z: F.struct(F.coalesce(z["k"]["form"], z["m"]["form"]).alias("form"), z["m"]["tag"].alias("tag")))
    score = F.array_min(F.transform(known, lambda k: k["score"]))
    return F.when(score.isNotNull(), F.struct(sequence.alias("sequence"), score.alias("score")))


def lemma_graph(edges: DataFrame) -> DataFrame:
    """The graph of confused lemmas: edges given by hand in both directions, stems often mistaken, and ``edges`` (:func:`candidates.added_edges` columns and ``similarity``) that are admitted.

    Pairs of the allow list always are; edges to broad lemmas never; mined ones from broad lemmas neither; those of families and mined ones need the same beginning
    or .7 of similarity, and hints or .58. Equal edges become one: of the best score, with counts added."""
    given = [(a, b, source, score) for a, b, source, score in vocab.OPEN_REPLACEMENTS if a.endswith("다") and b.endswith("다")]
    given += [(b, a, source, score * 0.9) for a, b, source, score in given]
    for wrong, right, score in vocab.STEM_CONFUSIONS:
        given += [(f"{wrong}다", f"{right}다", "LEMMA_CONFUSION", max(0.88, score)), (f"{right}다", f"{wrong}다", "LEMMA_CONFUSION", max(0.8, score - 0.05))]
    bare = {"kind": F.lit(None).cast("string"), "slots": F.array().cast("array<string>"), "hints": F.array().cast(C._HINTS), "stats": F.create_map().cast("map<string,bigint>"), "similarity": F.lit(None).cast("double")}
    names = ["src", "dst", "source", "generator", *bare]
    manual = edges.sparkSession.createDataFrame(given, "src STRING, dst STRING, source STRING, generator DOUBLE").select("src", "dst", "source", "generator", *[v.alias(k) for k, v in bare.items()])
    every = manual.unionByName(edges.select(*[F.col(n) if n in edges.columns else bare[n].alias(n) for n in names])).where(F.col("src") != F.col("dst"))
    allowed = F.concat_ws(">", "src", "dst").isin([f"{a}>{b}" for a, b in vocab.BROAD_ALLOWED])
    mined = F.col("source").isin("DATA_CONFUSION", "LEMMA_DATA_CONFUSION", "AUTO_FAMILY_SEED")
    near = F.coalesce("similarity", S.typo_similarity(F.col("src"), F.col("dst")))
    weak = F.col("source").isin("AUTO_FAMILY_SEED", "LEMMA_FAMILY_GRAPH", "LEMMA_DATA_CONFUSION") & ((F.substring("src", 1, 1) != F.substring("dst", 1, 1)) & (near < 0.7) | (near < 0.58) & (F.size("hints") == 0))
    kept = every.where(allowed | ~F.col("dst").isin(*vocab.BROAD_LEMMAS) & ~(F.col("src").isin(*vocab.BROAD_LEMMAS) & mined) & ~weak)
    # counters are added term by term and channel by channel before they are gathered; the twelve most frequent hints stay
    part = lambda name, key, n: F.struct(F.lit(name).alias("part"), key.alias("name"), n.cast("bigint").alias("n"))
    parts = F.concat(F.array(part("e", F.lit(None).cast("string"), F.lit(0))), F.transform("hints", lambda h: part("h", h["term"], h["count"])), F.transform(F.map_entries("stats"), lambda m: part("s", m["key"], m["value"])), F.transform("slots", lambda s: part("x", s, F.lit(0))))
    best = F.max(F.struct("generator", "source", "kind"))
    sums = kept.select("src", "dst", "generator", "source", "kind", F.explode(parts).alias("p")).groupBy("src", "dst", "p.part", "p.name").agg(best.alias("b"), F.coalesce(F.sum("p.n"), F.lit(0)).alias("n"))
    sums = sums.withColumn("_r", F.row_number().over(W.partitionBy("src", "dst", "part").orderBy(F.desc("n"), "name"))).where("part <> 'h' or _r <= 12")
    of = lambda name, value: F.array_sort(F.collect_list(F.when((F.col("part") == name) & F.col("name").isNotNull(), value)))
    out = sums.groupBy("src", "dst").agg(F.max("b").alias("b"), of("h", F.struct(F.col("name").alias("term"), F.col("n").alias("count"))).alias("hints"), F.map_from_entries(of("s", F.struct("name", "n"))).alias("stats"), of("x", F.col("name")).alias("slots"))
    return out.select("src", "dst", "b.source", "b.generator", "b.kind", "hints", "stats", "slots")
