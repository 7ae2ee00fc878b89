"""Queries on candidates of error tokens in their contexts, from scoring to decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maldadum import vocab
from maldadum.functions import text as T
from maldadum.operators import candidates as C, mining, ranking as R
from maldadum.plans import duck
from maldadum.plans.mining_queries import _PAIRS
from maldadum.session import materialize
from maldadum.sources.tables import one_row_per_id, table

#: A token in its channel and context; equal ones are one group, however many records have it.
GROUP = ["tok", "channel", "context_terms"]


def _occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Error tokens with their channel and context terms, and ``n``, the records that have them so."""
    rows = mining.word_pairs(mining.entries(one_row_per_id(table(spark, folder, "corpus_records"), *mining.RECORD_COLUMNS)))
    each = rows.select("record", F.col("err").alias("tok"), "channel", F.coalesce(T.span_terms(F.col("cor_sentence"), F.col("cor")), F.array().cast("array<string>")).alias("terms"))
    return each.groupBy("tok", "channel", "terms").agg(F.count_distinct("record").alias("n")).withColumn("context_terms", F.array_join("terms", " "))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The graph's edges with all their counters added; lemmas count for edges between lemmas only."""
    graph = table(spark, folder, "typed_confusion_graph").where("generatorScore is not null")
    lemma = lambda c: F.when(F.col("source").isin(*vocab.FAMILY_SOURCES), F.col(c)).alias(c)
    return C.added_edges(graph.select("src", F.col("replacement").alias("dst"), "source", "generatorScore", "interfaceType", "pos", "suffixSlots", "contextHints", "interfaceStats", lemma("lemma"), lemma("targetLemma")))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return C.scored(_occurrences(spark, folder), graph_edges(spark, folder), GROUP)


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    return R.verified(R.family_prior(_scored(spark, folder), GROUP), GROUP)


def scored_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The best four candidates of every error token in its channel and context."""
    return _scored(spark, folder).select(*GROUP, "n", "dst", "source", "context", "interface", "support", "typo", "norm", "score", "rank")


def verifier_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _verified(spark, folder).select(*GROUP, "dst", "source", "family_match", "verifier", "place", "fast")


def reranked_options(spark: SparkSession, folder: str) -> DataFrame:
    """Final scores without models, which then make no difference."""
    return R.reranked(_verified(spark, folder), GROUP).select(*GROUP, "dst", "verdict", "final")


def policy_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What may be proposed for every error token, in order."""
    ranked = materialize(R.reranked(_verified(spark, folder), GROUP), "ranked")  # read twice
    found = R.options(ranked, GROUP, "tok", F.lit(False), F.lit(False))
    return found.select(*GROUP, "replacement", "source", "decision", F.array_join("reasons", " ").alias("reasons"), "final", "option", "rank")


QUERIES = {f.__name__: f for f in (scored_candidates, verifier_scores, reranked_options, policy_decisions)}

_PRIOR = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in vocab.SOURCE_PRIOR.items())
_CURATED = ", ".join(f"'{x}'" for x in vocab.CURATED_SOURCES)
_FAMILIES = ", ".join(f"'{x}'" for x in vocab.FAMILY_SOURCES)
_R4 = "round(({0})::DECIMAL(18, 10), 4)::DOUBLE"
_STATS = "g + k + v"
_GROUP = "tok, channel, context_terms"
_SCORED = f"""{_PAIRS},
    tk AS (SELECT id, err AS tok, channel, {duck.all_tokens("cor_sentence")} AS ts, b FROM pair),
    spot AS (SELECT *, coalesce(list_position(ts, b), 0) AS i FROM tk),
    oc AS (SELECT id, tok, channel, CASE WHEN i > 0 THEN {duck.near_terms("ts", "i")} ELSE [] END AS terms FROM spot),
    occ AS (SELECT tok, channel, terms, array_to_string(terms, ' ') AS context_terms, count(DISTINCT id) AS n FROM oc GROUP BY tok, channel, terms),
    gr AS (SELECT src, replacement AS dst, source, generatorScore, interfaceType, pos, suffixSlots, contextHints, interfaceStats, CASE WHEN source IN ({_FAMILIES}) THEN lemma END AS lemma, CASE WHEN source IN ({_FAMILIES}) THEN targetLemma END AS target
        FROM typed_confusion_graph WHERE generatorScore IS NOT NULL),
    hs AS (SELECT src, dst, source, list({{'term': term, 'count': n}}) AS hints FROM (SELECT src, dst, source, {duck.strip_particle("h.term")} AS term, sum(coalesce(h.count, 0)) AS n FROM (SELECT src, dst, source, unnest(contextHints) AS h FROM gr) GROUP BY ALL) WHERE term <> '' GROUP BY ALL),
    ed AS (SELECT src, dst, source, max(generatorScore) AS generator, min(interfaceType) AS kind, min(pos) AS pos, list_distinct(list_concat(list(lemma) FILTER (lemma IS NOT NULL), list(target) FILTER (target IS NOT NULL))) AS family,
            list_distinct(flatten(list(coalesce(suffixSlots, [])))) AS slots,
            coalesce(sum(interfaceStats['generic']), 0) AS g, coalesce(sum(interfaceStats['keyboard']), 0) AS k, coalesce(sum(interfaceStats['voice']), 0) AS v FROM gr GROUP BY ALL),
    c0 AS (SELECT tok, channel, context_terms, n, dst, source, generator, kind, pos, coalesce(family, []) AS family, slots, g, k, v, greatest(1, {_STATS}) AS total, {duck.hint_score("terms", "coalesce(hints, [])")} AS context, {_STATS} AS support
        FROM occ JOIN ed ON ed.src = occ.tok LEFT JOIN hs USING (src, dst, source)),
    c1 AS (SELECT *, CASE WHEN {_STATS} > 0 THEN {_R4.format("greatest(0.2::DOUBLE, least(1.0::DOUBLE, CASE channel WHEN 'voice' THEN 0.92::DOUBLE * (v / total) + 0.55::DOUBLE * (g / total) + 0.35::DOUBLE * (k / total) WHEN 'keyboard' THEN 0.9::DOUBLE * (k / total) + 0.7::DOUBLE * (g / total) + 0.3::DOUBLE * (v / total) ELSE 0.92::DOUBLE * (g / total) + 0.82::DOUBLE * (k / total) + 0.22::DOUBLE * (v / total) END))")}
            WHEN kind = 'voice' THEN CASE channel WHEN 'generic' THEN 0.32::DOUBLE ELSE 0.9::DOUBLE END WHEN kind = 'keyboard' THEN CASE channel WHEN 'voice' THEN 0.72::DOUBLE ELSE 0.94::DOUBLE END ELSE 0.86::DOUBLE END AS raw FROM c0),
    c2 AS (SELECT * EXCLUDE (raw), CASE WHEN channel = 'generic' AND coalesce(kind = 'voice', false) AND context < 0.12 THEN least(raw, 0.3::DOUBLE) ELSE raw END AS interface, {duck.typo("tok", "dst")} AS typo, CASE source {_PRIOR} ELSE 0.25::DOUBLE END AS prior,
            CASE WHEN generator BETWEEN 0 AND 1 THEN generator ELSE 1 / (1 + exp(-generator / 4)) END AS unit FROM c1),
    c3 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY {_GROUP}, dst ORDER BY unit DESC, prior DESC, source) = 1),
    c4 AS (SELECT *, source IN ({_CURATED}) AS cur, {_R4.format("unit")} AS norm, {_R4.format("0.40::DOUBLE * typo + 0.22::DOUBLE * unit + 0.12::DOUBLE * prior + 0.16::DOUBLE * context + 0.10::DOUBLE * interface")} AS score FROM c3),
    sc AS (SELECT *, row_number() OVER (PARTITION BY {_GROUP} ORDER BY score DESC, context DESC, typo DESC, norm DESC, dst)::INT AS rank FROM c4
        WHERE typo >= CASE WHEN cur AND (len(family) > 0 OR context >= 0.1 OR unit >= 0.72) THEN 0.48 ELSE 0.55 END
            AND NOT (source IN ('FAMILY_SEED', 'AUTO_FAMILY_SEED') AND context < 0.08 AND support < 14) AND NOT (source IN ('DATA_CONFUSION', 'LEMMA_DATA_CONFUSION') AND context < 0.08 AND support < 8 AND typo < 0.62)
        QUALIFY rank <= 4)"""
_U = lambda x: f"round({x} * 10000)"
_VERIFIED = f"""{_SCORED},
    f0 AS (SELECT *, first_value(dst) OVER o AS best, first_value(family) OVER o AS lemmas FROM sc WINDOW o AS (PARTITION BY {_GROUP} ORDER BY score DESC, context DESC, typo DESC, norm DESC, dst)),
    f1 AS (SELECT *, list_has_any(family, lemmas) OR dst = best AS family_match FROM f0),
    f2 AS (SELECT *, max(score) FILTER (family_match) OVER (PARTITION BY {_GROUP}) AS leader, row_number() OVER (PARTITION BY {_GROUP}, family_match ORDER BY score DESC, typo DESC, norm DESC, dst) AS among FROM f1),
    f3 AS (SELECT * FROM f2 WHERE family_match OR (among = 1 AND {_U("score")} >= {_U("leader")} + 800)),
    v0 AS (SELECT *, bool_or(cur) OVER w AS any_cur, coalesce(max(score) FILTER (cur) OVER w, 0) AS top_cur FROM f3 WINDOW w AS (PARTITION BY {_GROUP})),
    v1 AS (SELECT *, {_R4.format("0.42::DOUBLE * typo + 0.24::DOUBLE * norm + 0.2::DOUBLE * score + 0.06::DOUBLE * context + 0.04::DOUBLE * interface + CASE WHEN family_match THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN cur THEN 0.05::DOUBLE ELSE 0 END + 0.03::DOUBLE")} AS verifier FROM v0
        WHERE NOT (NOT family_match AND NOT cur AND context < 0.18 AND {_U("score")} < {_U("top_cur")} + 400) AND NOT (any_cur AND NOT cur AND context < 0.12 AND {_U("score")} < {_U("top_cur")} + 500) AND NOT (typo < 0.56 AND NOT family_match AND context < 0.2)),
    v2 AS (SELECT *, row_number() OVER (PARTITION BY {_GROUP}, cur ORDER BY verifier DESC, score DESC, typo DESC, dst) AS nth, max(verifier) FILTER (cur) OVER (PARTITION BY {_GROUP}) AS v_cur FROM v1),
    v3 AS (SELECT * FROM v2 WHERE CASE WHEN NOT any_cur THEN nth <= 3 WHEN cur THEN nth <= 2 ELSE nth = 1 AND (v_cur IS NULL OR {_U("verifier")} >= {_U("v_cur")} + 800) END),
    v4 AS (SELECT *, row_number() OVER (PARTITION BY {_GROUP} ORDER BY verifier DESC, context DESC, score DESC, typo DESC, dst)::INT AS place, count(*) OVER (PARTITION BY {_GROUP}) AS size FROM v3),
    v5 AS (SELECT *, first_value(cur) OVER o AS l_cur, first_value(verifier) OVER o AS l_v, first_value(context) OVER o AS l_ctx, first_value(score) OVER o AS l_score, coalesce(nth_value(verifier, 2) OVER (PARTITION BY {_GROUP} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS second
        FROM v4 WINDOW o AS (PARTITION BY {_GROUP} ORDER BY place)),
    ve AS (SELECT *, l_cur AND ((size = 1 AND l_v >= 0.72) OR (l_v >= 0.82 AND {_U("l_v")} >= {_U("second")} + 1400 AND (l_ctx >= 0.08 OR l_score >= 0.9)) OR (l_v >= 0.76 AND {_U("l_v")} >= {_U("second")} + 800 AND (l_ctx >= 0.05 OR l_score >= 0.78))) AS fast FROM v5)"""
_VERDICT = "(1 / (1 + exp(-(1.4::DOUBLE * (typo - 0.55::DOUBLE) + 1.1::DOUBLE * context + 0.55::DOUBLE * (interface - 0.5::DOUBLE)))))"
_FINAL = f"""0.24::DOUBLE * 0.5 + 0.28::DOUBLE * 0.5 + 0.12::DOUBLE * 0.5 + 0.22::DOUBLE * {_VERDICT} + 0.1::DOUBLE * (1 / (1 + exp(-generator))) + 0.08::DOUBLE * typo + 0.04::DOUBLE * prior + 0.04::DOUBLE * context + 0.02::DOUBLE * interface
    + CASE WHEN family_match THEN 0.04::DOUBLE ELSE 0 END - least(0.18::DOUBLE, 0.06::DOUBLE * {duck.edits("tok", "dst")}) - CASE WHEN typo < 0.6 THEN 0.16::DOUBLE ELSE 0 END"""
_RANKED = f"""{_VERIFIED},
    fi AS (SELECT *, {_R4.format(_VERDICT)} AS verdict, CASE WHEN fast THEN verifier ELSE {_R4.format(f"greatest(0.01::DOUBLE, least(0.99::DOUBLE, {_FINAL}))")} END AS final FROM ve)"""

SQL = {
    "scored_candidates": f"WITH {_SCORED} SELECT {_GROUP}, n, dst, source, context, interface, support::BIGINT AS support, typo, norm, score, rank FROM sc",
    "verifier_scores": f"WITH {_VERIFIED} SELECT {_GROUP}, dst, source, family_match, verifier, place, fast FROM ve",
    "reranked_options": f"WITH {_RANKED} SELECT {_GROUP}, dst, verdict, final FROM fi",
    "policy_decisions": f"""WITH {_RANKED},
        b AS (SELECT *, regexp_matches(tok || dst, '[A-Za-z0-9]') AS risky, abs(length(dst) - length(tok)) / greatest(length(tok), 1) > 0.25 AS far FROM fi QUALIFY row_number() OVER (PARTITION BY {_GROUP} ORDER BY final DESC, place) <= 3),
        o AS (SELECT {_GROUP}, dst AS replacement, source, CASE WHEN risky THEN 'REJECT' ELSE 'SUGGEST_ONLY' END AS decision, CASE WHEN risky THEN 'ALNUM_RISK' WHEN far THEN 'EDIT_RATIO_HIGH LEXICAL_REPLACEMENT' ELSE 'LEXICAL_REPLACEMENT' END AS reasons, final,
                {_R4.format("greatest(0.2::DOUBLE, final - 0.08::DOUBLE - CASE WHEN cur THEN 0 ELSE 0.03::DOUBLE END - CASE WHEN far AND NOT risky THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN family_match THEN 0.02::DOUBLE ELSE 0 END)")} AS option FROM b
            UNION ALL SELECT DISTINCT {_GROUP}, tok, 'ORIGINAL', 'KEEP', 'KEEP_ORIGINAL', 0.2::DOUBLE, 0.2::DOUBLE FROM fi)
        SELECT *, row_number() OVER (PARTITION BY {_GROUP} ORDER BY option DESC, final DESC, decision = 'KEEP', replacement)::INT AS rank FROM o""",
}
