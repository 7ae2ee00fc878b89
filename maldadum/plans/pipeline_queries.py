"""Queries on features, lemma families, locks and the whole correction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maldadum import vocab
from maldadum.functions import features as X, similarity as S, text as T
from maldadum.operators import candidates as C, family, mining, pipeline as L, ranking as R
from maldadum.plans import duck
from maldadum.plans.mining_queries import _ALLOWED, _BROAD, _PAIRS
from maldadum.plans.ranking_queries import graph_edges
from maldadum.session import materialize, spread
from maldadum.sources.tables import one_row_per_id, table


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "typed_confusion_graph")


def text_features(spark: SparkSession, folder: str) -> DataFrame:
    f = X.text_features(F.col("err_sentence"))
    return table(spark, folder, "corpus_records").where("err_sentence is not null").select("rec_no", *[F.round(F.get(f, F.lit(i)), 6).alias(f"f{i}") for i in range(8)])


def token_features(spark: SparkSession, folder: str) -> DataFrame:
    f = X.token_features(F.col("tok"))
    toks = table(spark, folder, "edit_tagger_v2_dataset").select(F.explode("tokens").alias("tok")).distinct()
    return toks.select("tok", *[F.round(F.get(f, F.lit(i)), 6).alias(f"f{i}") for i in range(8)])


def lemma_classes(spark: SparkSession, folder: str) -> DataFrame:
    lemmas = _graph(spark, folder).select(F.explode(F.array("lemma", "targetLemma")).alias("lemma")).where("lemma is not null")
    return lemmas.groupBy("lemma").agg(F.count(F.lit(1)).alias("n")).select("lemma", "n", T.stem(F.col("lemma")).alias("stem"), X.irregular_class(F.col("lemma")).alias("class"), X.ends_in_rieul(T.stem(F.col("lemma"))).cast("int").alias("rieul"))


def edge_scores(spark: SparkSession, folder: str) -> DataFrame:
    t = S.typo_similarity(F.col("src"), F.col("replacement"))
    return _graph(spark, folder).select("edge_no", X.lemma_score(F.col("frequency"), F.col("surfaceSimilarity")).alias("lemma_score"), X.seed_score(F.col("generatorScore"), F.col("frequency"), t).alias("seed_score"), F.round(C.source_prior(F.col("source")), 2).alias("prior"), F.round(X.edit_ratio(F.col("src"), F.col("replacement")), 6).alias("edit_ratio"),
        F.aggregate(F.map_values("interfaceStats"), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("support"))


def family_edges(spark: SparkSession, folder: str) -> DataFrame:
    return family.family_edges(_graph(spark, folder))


def auto_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return family.auto_seeds(_graph(spark, folder))


def merged_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the graph and of the corpus as one, each with its origin, better score and added counts per channel."""
    mined = family.summed_edges(_graph(spark, folder))
    rows = mining.word_pairs(mining.entries(one_row_per_id(table(spark, folder, "corpus_records"), *mining.RECORD_COLUMNS)))
    given = mining.counters(rows).select(F.col("err").alias("src"), F.col("cor").alias("dst"), F.lit(0.9).alias("score"), F.col("interface_stats").alias("stats"))
    at = lambda k: F.coalesce(F.try_element_at("stats", F.lit(k)), F.lit(0)).cast("bigint").alias(k)
    return family.merged_edges(mined, given).select("src", "dst", "origin", "score", at("generic"), at("keyboard"), at("voice"))


def hint_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How the terms around every place of an edge's replacement in distinct sentences meet the edge's hints: per edge and score the number of places, ``n``."""
    sentences = one_row_per_id(table(spark, folder, "corpus_records"), "cor_sentence").select("cor_sentence").distinct()
    return C.hint_scores(_graph(spark, folder), sentences, "cor_sentence")


def interface_scores(spark: SparkSession, folder: str) -> DataFrame:
    each = _graph(spark, folder).select("edge_no", "interfaceStats", "interfaceType", F.explode(F.array(F.lit("voice"), F.lit("keyboard"), F.lit("generic"))).alias("channel"))
    return each.select("edge_no", "channel", C.interface_score(F.col("interfaceStats"), F.col("channel"), F.col("interfaceType")).alias("score"))


def guardrail_decisions(spark: SparkSession, folder: str) -> DataFrame:
    g = R.guardrail(F.col("src"), F.col("replacement"), F.lit(False), F.lit(False), F.coalesce("generatorScore", F.lit(0.0)))
    return _graph(spark, folder).withColumn("g", g).select("edge_no", F.col("g.decision").alias("decision"), F.array_join("g.reasons", " ").alias("reasons"), R.option_score(F.col("g.score"), F.col("g.reasons"), F.lit(True)).alias("option"))


def spelling_patterns(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(F.split("text", r"\s+")).alias("tok")).distinct()
    return words.select("tok", F.explode(X.pattern_candidates(F.col("tok"))).alias("p")).select("tok", "p.dst", "p.score")


def long_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples of at least eleven tokens, and how many are left out."""
    rows = table(spark, folder, "edit_tagger_v2_dataset")
    return rows.groupBy("split", "variant").agg(F.count_if(F.size("tokens") >= 11).alias("kept"), F.count_if(F.size("tokens") < 11).alias("dropped"))


def seeded_subset(spark: SparkSession, folder: str) -> DataFrame:
    """A repeatable subset of fixed size, chosen by hash: a sampling operator."""
    rows = table(spark, folder, "edit_tagger_v2_dataset").select("ex_no", "split")
    return rows.orderBy(F.xxhash64(F.lit(42), "ex_no"), "ex_no").limit(500)


def corrected_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents corrected without models, by the graph's edges and the phrases of the corpus."""
    rows = mining.entries(one_row_per_id(table(spark, folder, "corpus_records"), *mining.RECORD_COLUMNS))
    phrases = materialize(mining.phrase_memory(mining.phrase_pairs(rows)).select(F.col("err").alias("src"), F.col("cor").alias("dst"), "confidence"), "phrases")
    out = L.correct(spread(table(spark, folder, "documents")), materialize(graph_edges(spark, folder), "edges"), phrases=phrases)
    return out.select("doc_id", "profile", "n_protected", "n_rule_edits", "n_phrase_edits", "final_text", "suggested_text", "n_suggested", "n_rejected", "decision", F.size("proposals").alias("n_proposals"))


QUERIES = {f.__name__: f for f in (text_features, token_features, lemma_classes, edge_scores, family_edges, auto_seeds, merged_edges, hint_scores, interface_scores, guardrail_decisions, spelling_patterns, long_examples, seeded_subset, corrected_documents)}

_CLASS = " ".join(f"WHEN ends_with(trim(lemma), '{e}') THEN '{c}'" for e, c in X.IRREGULAR)
_PRIOR = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in vocab.SOURCE_PRIOR.items())


def _share(x: str, cls: str) -> str:
    return f"round(length(regexp_replace({x}, '[^{cls}]', '', 'g')) / greatest(length({x}), 1), 6)"


SQL = {
    "text_features": f"""SELECT rec_no, round(greatest(length(err_sentence), 1) / 256, 6) AS f0, {_share("err_sentence", "가-힣")} AS f1, {_share("err_sentence", "A-Za-z")} AS f2, {_share("err_sentence", "0-9")} AS f3, {_share("err_sentence", chr(92) + "s")} AS f4, {_share("err_sentence", "!?.,")} AS f5,
        regexp_matches(err_sentence, '[ㅋㅎㅠ]{{2,}}|[!?]{{2,}}')::INT::DOUBLE AS f6, round(1 - length(regexp_replace(err_sentence, '[^가-힣]', '', 'g')) / greatest(length(err_sentence), 1), 6) AS f7 FROM corpus_records WHERE err_sentence IS NOT NULL""",
    "token_features": f"""WITH t AS (SELECT DISTINCT unnest(tokens) AS tok FROM edit_tagger_v2_dataset)
        SELECT tok, round(greatest(length(tok), 1) / 32, 6) AS f0, {_share("tok", "가-힣")} AS f1, regexp_matches(tok, '[0-9]')::INT::DOUBLE AS f2, regexp_matches(tok, '[A-Za-z]')::INT::DOUBLE AS f3, regexp_matches(tok, '낫|되요|할수|됬|않되|안되')::INT::DOUBLE AS f4,
        regexp_matches(tok, '[ㄱ-ㅎㅏ-ㅣ]')::INT::DOUBLE AS f5, ends_with(tok, '요')::INT::DOUBLE AS f6, ends_with(tok, '다')::INT::DOUBLE AS f7 FROM t""",
    "lemma_classes": f"""WITH l AS (SELECT lemma FROM typed_confusion_graph UNION ALL SELECT targetLemma FROM typed_confusion_graph), c AS (SELECT lemma, count(*) AS n, regexp_replace(lemma, '다$', '') AS stem FROM l WHERE lemma IS NOT NULL GROUP BY ALL)
        SELECT lemma, n, stem, CASE {_CLASS} END AS class, (CASE WHEN unicode(right(stem, 1)) BETWEEN 44032 AND 55203 THEN (unicode(right(stem, 1)) - 44032) % 28 = 8 ELSE false END)::INT AS rieul FROM c""",
    "edge_scores": f"""WITH t AS (SELECT *, {duck.typo("src", "replacement")} AS typo, coalesce(generatorScore, 0) AS base FROM typed_confusion_graph),
        s AS (SELECT *, 0.03::DOUBLE * least(frequency, 5) + greatest(0.0::DOUBLE, typo - 0.55::DOUBLE) * 0.15::DOUBLE AS bonus FROM t)
        SELECT edge_no, round(least(0.985::DOUBLE, 0.56::DOUBLE + ln(1 + frequency) / 10 + 0.22::DOUBLE * surfaceSimilarity), 4) AS lemma_score, round(least(0.985::DOUBLE, greatest(base, base + bonus))::DECIMAL(18, 10), 4)::DOUBLE AS seed_score, CASE source {_PRIOR} ELSE 0.25::DOUBLE END AS prior,
            round({duck.edits("src", "replacement")} / greatest(length(src), length(replacement), 1), 6) AS edit_ratio, list_sum(map_values(interfaceStats))::BIGINT AS support FROM s""",
    "family_edges": f"""WITH k AS (SELECT src, replacement AS dst, frequency, surfaceSimilarity, interfaceStats, contextHints FROM typed_confusion_graph WHERE src <> replacement),
        s AS (SELECT src, dst, sum(frequency)::BIGINT AS frequency, max(surfaceSimilarity) AS mined FROM k GROUP BY ALL),
        c AS (SELECT src, dst, m.key AS channel, sum(m.value) AS n FROM (SELECT src, dst, unnest(map_entries(interfaceStats)) AS m FROM k) GROUP BY ALL),
        d AS (SELECT src, dst, channel FROM c QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, channel) = 1),
        h AS (SELECT src, dst, count(DISTINCT h.term) AS n_terms FROM (SELECT src, dst, unnest(contextHints) AS h FROM k) GROUP BY ALL),
        r AS (SELECT src, dst, frequency, round(greatest(mined, {duck.preserved("src", "dst")}), 4) AS similarity, coalesce(channel, 'generic') AS channel, coalesce(n_terms, 0) AS n_terms FROM s LEFT JOIN d USING (src, dst) LEFT JOIN h USING (src, dst)),
        f AS (SELECT *, round(least(0.985::DOUBLE, 0.56::DOUBLE + ln(1 + frequency) / 10 + 0.22::DOUBLE * similarity), 4) AS score FROM r WHERE frequency >= 2 AND similarity >= 0.52 AND NOT (frequency <= 2 AND similarity < 0.62) AND NOT (channel = 'voice' AND similarity < 0.72)
            AND NOT (left(src, 1) <> left(dst, 1) AND similarity < 0.7) AND NOT (similarity < 0.58 AND n_terms = 0))
        SELECT *, row_number() OVER (PARTITION BY src ORDER BY frequency DESC, score DESC, dst)::INT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY frequency DESC, score DESC, dst) <= 12""",
    "auto_seeds": f"""WITH e AS (SELECT lemma AS src, targetLemma AS dst, frequency, coalesce(generatorScore, 0) AS base, coalesce(interfaceStats['voice'], 0) AS voice, coalesce(interfaceStats['generic'], 0) + coalesce(interfaceStats['keyboard'], 0) AS typed, coalesce(len(contextHints), 0) AS n_hints, {duck.typo("lemma", "targetLemma")} AS typo
            FROM typed_confusion_graph WHERE lemma <> targetLemma AND regexp_matches(lemma || targetLemma, '[가-힣]') AND split_part(pos, '-', 1) IN ('VV', 'VA', 'VX') AND frequency >= 2 AND coalesce(len(suffixSlots), 0) > 0
            AND (NOT (lemma IN ({_BROAD}) OR targetLemma IN ({_BROAD})) OR (lemma, targetLemma) IN ({_ALLOWED}))),
        k AS (SELECT *, round(least(0.985::DOUBLE, greatest(base, base + 0.03::DOUBLE * least(frequency, 5) + greatest(0.0::DOUBLE, typo - 0.55::DOUBLE) * 0.15::DOUBLE))::DECIMAL(18, 10), 4)::DOUBLE AS score FROM e
            WHERE NOT (dst IN ({_BROAD}) AND typed < 2) AND typo >= 0.48 AND NOT (left(src, 1) <> left(dst, 1) AND typo < 0.7) AND NOT (voice > 0 AND typed = 0 AND (typo < 0.72 OR frequency < 6)) AND NOT (typo < 0.58 AND n_hints = 0)),
        b AS (SELECT src, dst, score, frequency, typo FROM k QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, frequency DESC, typo DESC) = 1)
        SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, frequency DESC, typo DESC, dst)::INT AS rank FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, frequency DESC, typo DESC, dst) <= 6""",
    "hint_scores": f"""WITH r AS ({duck.one_per_id("cor_sentence")}), s AS (SELECT DISTINCT cor_sentence FROM r WHERE cor_sentence IS NOT NULL), t AS (SELECT {duck.all_tokens("cor_sentence")} AS tk FROM s),
        p AS (SELECT tk, unnest(tk) AS replacement, generate_subscripts(tk, 1) AS i FROM t),
        w AS (SELECT replacement, {duck.near_terms("tk", "i")} AS terms FROM p WHERE replacement IN (SELECT replacement FROM typed_confusion_graph)), c AS (SELECT replacement, terms, count(*) AS n FROM w GROUP BY ALL),
        e AS (SELECT edge_no, replacement, list_filter(list_transform(coalesce(contextHints, []), lambda h: {{'term': {duck.strip_particle("h.term")}, 'count': coalesce(h.count, 0)}}), lambda h: h.term <> '') AS hints FROM typed_confusion_graph),
        x AS (SELECT edge_no, {duck.hint_score("terms", "hints")} AS score, n FROM c JOIN e USING (replacement))
        SELECT edge_no, score, sum(n)::BIGINT AS n FROM x GROUP BY ALL""",
    "interface_scores": """WITH e AS (SELECT edge_no, c.channel, interfaceType AS kind, coalesce(len(map_keys(interfaceStats)), 0) AS size, coalesce(interfaceStats['generic'], 0) AS g, coalesce(interfaceStats['keyboard'], 0) AS k, coalesce(interfaceStats['voice'], 0) AS v,
            greatest(1, coalesce(list_sum(map_values(interfaceStats)), 0)) AS total FROM typed_confusion_graph, (VALUES ('voice'), ('keyboard'), ('generic')) c(channel))
        SELECT edge_no, channel, CASE WHEN size > 0 THEN round(greatest(0.2::DOUBLE, least(1.0::DOUBLE, CASE channel WHEN 'generic' THEN 0.92::DOUBLE * (g / total) + 0.82::DOUBLE * (k / total) + 0.22::DOUBLE * (v / total)
            WHEN 'voice' THEN 0.92::DOUBLE * (v / total) + 0.55::DOUBLE * (g / total) + 0.35::DOUBLE * (k / total) ELSE 0.9::DOUBLE * (k / total) + 0.7::DOUBLE * (g / total) + 0.3::DOUBLE * (v / total) END))::DECIMAL(18, 10), 4)::DOUBLE
            WHEN kind = 'voice' THEN CASE channel WHEN 'generic' THEN 0.32::DOUBLE ELSE 0.9::DOUBLE END WHEN kind = 'keyboard' THEN CASE channel WHEN 'voice' THEN 0.72::DOUBLE ELSE 0.94::DOUBLE END ELSE 0.86::DOUBLE END AS score FROM e""",
    "guardrail_decisions": """WITH e AS (SELECT edge_no, coalesce(generatorScore, 0) AS s, regexp_matches(src || replacement, '[A-Za-z0-9]') AS risky, abs(length(replacement) - length(src)) / greatest(length(src), 1) > 0.25 AS long FROM typed_confusion_graph)
        SELECT edge_no, CASE WHEN risky THEN 'REJECT' ELSE 'SUGGEST_ONLY' END AS decision, CASE WHEN risky THEN 'ALNUM_RISK' WHEN long THEN 'EDIT_RATIO_HIGH LEXICAL_REPLACEMENT' ELSE 'LEXICAL_REPLACEMENT' END AS reasons,
            round(greatest(0.2::DOUBLE, CASE WHEN risky THEN 0.05::DOUBLE ELSE s END - (0.08::DOUBLE + CASE WHEN NOT risky AND long THEN 0.05::DOUBLE ELSE 0 END)), 4) AS option FROM e""",
    "merged_edges": f"""WITH {_PAIRS},
        given AS (SELECT err AS src, cor AS dst, 0.9::DOUBLE AS score, count(*) FILTER (channel = 'generic') AS generic, count(*) FILTER (channel = 'keyboard') AS keyboard, count(*) FILTER (channel = 'voice') AS voice FROM pair GROUP BY ALL),
        mined AS (SELECT src, replacement AS dst, max(generatorScore) AS score, coalesce(sum(interfaceStats['generic']), 0) AS generic, coalesce(sum(interfaceStats['keyboard']), 0) AS keyboard, coalesce(sum(interfaceStats['voice']), 0) AS voice FROM typed_confusion_graph GROUP BY ALL)
        SELECT coalesce(m.src, g.src) AS src, coalesce(m.dst, g.dst) AS dst, CASE WHEN m.src IS NOT NULL AND g.src IS NOT NULL THEN 'both' WHEN m.src IS NOT NULL THEN 'mined' ELSE 'given' END AS origin,
            CASE WHEN m.score IS NULL THEN g.score WHEN g.score IS NULL THEN m.score ELSE greatest(m.score, g.score) END AS score, (coalesce(m.generic, 0) + coalesce(g.generic, 0))::BIGINT AS generic,
            (coalesce(m.keyboard, 0) + coalesce(g.keyboard, 0))::BIGINT AS keyboard, (coalesce(m.voice, 0) + coalesce(g.voice, 0))::BIGINT AS voice FROM mined m FULL JOIN given g ON g.src = m.src AND g.dst = m.dst""",
    "long_examples": "SELECT split, variant, count(*) FILTER (len(tokens) >= 11) AS kept, count(*) FILTER (len(tokens) < 11) AS dropped FROM edit_tagger_v2_dataset GROUP BY ALL",
}
