"""Mining queries over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maldadum import vocab
from maldadum.functions import features as X
from maldadum.operators import mining
from maldadum.plans import duck
from maldadum.session import spread
from maldadum.sources.tables import one_row_per_id, table


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return mining.entries(spread(one_row_per_id(table(spark, folder, "corpus_records"), *mining.RECORD_COLUMNS)))


def error_entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = _entries(spark, folder)
    return rows.groupBy("channel", "error_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record").alias("n_records"), F.sum(F.length("err")).alias("chars"))


def confusion_edges(spark: SparkSession, folder: str) -> DataFrame:
    return mining.confusion_edges(mining.word_pairs(_entries(spark, folder)))


def context_hints(spark: SparkSession, folder: str) -> DataFrame:
    return mining.context_hints(mining.word_pairs(_entries(spark, folder)))


def pair_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The three counter maps of every pair, opened up again so that rows compare."""
    stats = mining.counters(mining.word_pairs(_entries(spark, folder)))
    maps = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("m")) for k in ("interface_stats", "error_types", "source_stats")])
    return stats.select("err", "cor", F.explode(maps).alias("x")).select("err", "cor", "x.kind", F.explode("x.m").alias("name", "n"))


def surface_fix_dominance(spark: SparkSession, folder: str) -> DataFrame:
    return mining.dominant_targets(mining.fix_candidates(_entries(spark, folder)), min_count=3)


def surface_fixes(spark: SparkSession, folder: str) -> DataFrame:
    return mining.surface_fixes(_entries(spark, folder), min_count=3)


def merged_fixes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _entries(spark, folder)
    mined = mining.dominant_targets(mining.fix_candidates(rows), min_count=3).select(F.col("err").alias("src"), F.col("cor").alias("dst"), F.lit(0.97).alias("confidence"))
    return mining.merged_rules(mined, mining.manual_rules(rows))


def inverse_fixes(spark: SparkSession, folder: str) -> DataFrame:
    rules = _entries(spark, folder).groupBy(F.col("err").alias("src"), F.col("cor").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("confidence"))
    return mining.near_inverse(rules)


def phrase_memory(spark: SparkSession, folder: str) -> DataFrame:
    return mining.phrase_memory(mining.phrase_pairs(_entries(spark, folder)))


def lemma_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = mining.lemma_edges(table(spark, folder, "typed_confusion_graph"))
    return edges.select("lemma", "target", "pos", "frequency", "similarity", F.array_join("slots", " ").alias("slots"), F.aggregate(F.map_values("interface_stats"), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("n_channels"))


def _surface_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between surfaces, whose ends differ where lemmas do not."""
    return mining.lemma_edges(table(spark, folder, "typed_confusion_graph").withColumns({"lemma": F.col("src"), "targetLemma": F.col("replacement")}))


def suffix_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The ranked report of 160 rules."""
    return mining.suffix_rules(_surface_edges(spark, folder))


def suffix_examples(spark: SparkSession, folder: str) -> DataFrame:
    return mining.suffix_examples(_surface_edges(spark, folder))


QUERIES = {f.__name__: f for f in (error_entries, confusion_edges, context_hints, pair_counters, surface_fix_dominance, surface_fixes, merged_fixes, inverse_fixes, phrase_memory, lemma_edges, suffix_rules, suffix_examples)}

_ENTRIES = f"""
    r AS ({duck.one_per_id("error_type", "source", "interface", "keyboard", "cor_sentence", "errors")}),
    x AS (SELECT id, error_type, source, cor_sentence, {duck.channel()} AS channel, unnest(errors) AS e FROM r),
    entry AS (SELECT * FROM (SELECT id, error_type, source, cor_sentence, channel, trim(e.err_text) AS err, trim(e.cor_text) AS cor FROM x) WHERE err <> '' AND cor <> '' AND err <> cor)"""
_PAIRS = f"""{_ENTRIES},
    short AS (SELECT *, {duck.strip_noise("err")} AS a, {duck.strip_noise("cor")} AS b FROM entry
        WHERE NOT contains(err || cor, ' ') AND regexp_matches(err || cor, '[가-힣]') AND greatest(length(err), length(cor)) <= 16),
    rated AS (SELECT *, {duck.edits("a", "b")} AS d FROM short WHERE a <> b),
    pair AS (SELECT * FROM (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 ELSE round(0.55::DOUBLE * {duck.preserved("a", "b")} + 0.45::DOUBLE * greatest(0.0::DOUBLE, 1 - d / greatest(length(a), length(b))), 4) END AS similarity
        FROM rated WHERE d <= CASE WHEN greatest(length(err), length(cor)) <= 6 THEN 2 ELSE 3 END) WHERE similarity >= 0.45)"""
_FIXES = f"""{_ENTRIES},
    fix AS (SELECT * FROM entry WHERE NOT contains(err || cor, ' ') AND length(err) <= 12 AND length(cor) <= 12
        AND length(regexp_replace(err || cor, '[^가-힣]', '', 'g')) / length(err || cor) >= 0.7
        AND regexp_replace(err, '[\\s\\p{{Z}}\\p{{P}}]', '', 'g') <> regexp_replace(cor, '[\\s\\p{{Z}}\\p{{P}}]', '', 'g')
        AND NOT regexp_matches(err || cor, '\\p{{C}}') AND NOT regexp_matches(err || cor, '["''“”‘’`]')),
    c AS (SELECT err, cor, count(*) AS count FROM fix GROUP BY ALL),
    top AS (SELECT *, sum(count) OVER (PARTITION BY err)::BIGINT AS total, row_number() OVER (PARTITION BY err ORDER BY count DESC, cor) AS rank FROM c),
    dominant AS (SELECT err, cor, count, total, round(count / total, 4) AS dominance FROM top WHERE rank = 1 AND count >= 3 AND count >= 0.95 * total)"""
_MANUAL = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in vocab.MANUAL_FIXES)
_BROAD = ", ".join(f"'{x}'" for x in vocab.BROAD_LEMMAS)
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in vocab.BROAD_ALLOWED)
_EDGES = f"""
    k AS (SELECT lemma, targetLemma AS target, split_part(pos, '-', 1) AS pos, frequency, surfaceSimilarity, suffixSlots, interfaceStats FROM typed_confusion_graph
        WHERE lemma <> targetLemma AND split_part(pos, '-', 1) IN ('VV', 'VA', 'VX')
        AND (NOT (lemma IN ({_BROAD}) OR targetLemma IN ({_BROAD})) OR (lemma, targetLemma) IN ({_ALLOWED}))),
    edge AS (SELECT lemma, target, pos, sum(frequency)::BIGINT AS frequency, round(avg(surfaceSimilarity), 4) AS similarity FROM k GROUP BY ALL)"""
_SURFACES = _EDGES.replace("targetLemma", "replacement").replace("lemma AS", "src AS").replace("SELECT lemma, replacement AS target", "SELECT src AS lemma, replacement AS target").replace("WHERE lemma <> replacement", "WHERE src <> replacement").replace("lemma IN (", "src IN (").replace("(lemma, replacement)", "(src, replacement)")
_IRREGULAR = lambda x: "CASE " + " ".join(f"WHEN ends_with(trim({x}), '{e}') THEN '{c}'" for e, c in X.IRREGULAR) + " END"
_SUFFIXES = f"""{_SURFACES},
    st AS (SELECT lemma, target, pos, frequency, regexp_replace(lemma, '다$', '') AS a, regexp_replace(target, '다$', '') AS b FROM edge),
    cut AS (SELECT * FROM (SELECT lemma, target, pos, frequency, a[{duck.prefix("a", "b")} + 1:] AS source_suffix, b[{duck.prefix("a", "b")} + 1:] AS target_suffix, coalesce({_IRREGULAR("target")}, {_IRREGULAR("lemma")}) AS irregular FROM st)
        WHERE length(source_suffix) BETWEEN 1 AND 4 AND length(target_suffix) BETWEEN 1 AND 4),
    rule AS (SELECT source_suffix, target_suffix, pos, sum(frequency)::BIGINT AS frequency, count(DISTINCT lemma) AS n_lemmas, least(count(DISTINCT irregular), 2) AS n_irregular,
        round(least(0.965::DOUBLE, 0.58::DOUBLE + 0.07::DOUBLE * least(5, sum(frequency)) / 5 + 0.03::DOUBLE * least(count(DISTINCT irregular), 2))::DECIMAL(18, 10), 4)::DOUBLE AS score FROM cut GROUP BY source_suffix, target_suffix, pos HAVING sum(frequency) >= 2)"""

SQL = {
    "error_entries": f"WITH {_ENTRIES} SELECT channel, error_type, count(*) AS n, count(DISTINCT id) AS n_records, sum(length(err))::BIGINT AS chars FROM entry GROUP BY ALL",
    "confusion_edges": f"""WITH {_PAIRS},
        f AS (SELECT err, cor, similarity, count(*) AS frequency FROM pair GROUP BY ALL HAVING count(*) >= 2),
        ch AS (SELECT err, cor, channel FROM (SELECT err, cor, channel, count(*) AS n FROM pair GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY err, cor ORDER BY n DESC, channel) = 1),
        s AS (SELECT f.*, channel, round(least(0.985::DOUBLE, 0.5::DOUBLE + ln(1 + frequency) / 12 + 0.28::DOUBLE * similarity), 4) AS score FROM f JOIN ch USING (err, cor))
        SELECT err, cor, similarity, frequency, channel, score, row_number() OVER (PARTITION BY err ORDER BY frequency DESC, score DESC, cor DESC)::INT AS rank FROM s
        QUALIFY row_number() OVER (PARTITION BY err ORDER BY frequency DESC, score DESC, cor DESC) <= 8""",
    "context_hints": f"""WITH {_PAIRS},
        w AS (SELECT err, cor, b, {duck.words("cor_sentence")} AS ws FROM pair WHERE b <> '' AND cor_sentence IS NOT NULL),
        p AS (SELECT *, CASE WHEN coalesce(list_position(ws, b), 0) > 0 THEN list_position(ws, b) ELSE coalesce(list_position(list_transform(ws, lambda v: contains(v, b) OR contains(b, v)), true), 0) END AS spot FROM w),
        t AS (SELECT err, cor, spot, unnest(ws) AS term, generate_subscripts(ws, 1) AS i FROM p WHERE spot > 0),
        c AS (SELECT err, cor, term, count(*) AS count FROM t WHERE i BETWEEN spot - 2 AND spot + 2 AND i <> spot AND length(term) >= 2 AND regexp_matches(term, '[가-힣]') GROUP BY ALL)
        SELECT err, cor, term, count, row_number() OVER (PARTITION BY err, cor ORDER BY count DESC, term)::INT AS rank FROM c
        QUALIFY row_number() OVER (PARTITION BY err, cor ORDER BY count DESC, term) <= 8""",
    "pair_counters": f"""WITH {_PAIRS} SELECT err, cor, 'interface_stats' AS kind, channel AS name, count(*) AS n FROM pair GROUP BY ALL
        UNION ALL SELECT err, cor, 'error_types', error_type, count(*) FROM pair WHERE error_type IS NOT NULL GROUP BY ALL
        UNION ALL SELECT err, cor, 'source_stats', source, count(*) FROM pair WHERE source IS NOT NULL GROUP BY ALL""",
    "surface_fix_dominance": f"WITH {_FIXES} SELECT * FROM dominant",
    "merged_fixes": f"""WITH {_FIXES},
        rule AS (SELECT err AS src, cor AS dst, 0.97::DOUBLE AS confidence, 0 AS age FROM dominant UNION ALL SELECT *, 1 FROM (VALUES {_MANUAL}) v(src, dst, confidence))
        SELECT src, dst, confidence FROM rule QUALIFY row_number() OVER (PARTITION BY src ORDER BY confidence DESC, age DESC, dst DESC) = 1""",
    "inverse_fixes": f"""WITH {_ENTRIES}, c AS (SELECT err AS src, cor AS dst, count(*)::DOUBLE AS confidence FROM entry GROUP BY ALL)
        SELECT a.src, a.dst, a.confidence, b.confidence AS back_confidence FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""",
    "phrase_memory": f"""WITH {_ENTRIES},
        f AS (SELECT channel, array_to_string({duck.all_tokens("err")}, ' ') AS err, array_to_string({duck.all_tokens("cor")}, ' ') AS cor FROM entry),
        g AS (SELECT *, replace(err, ' ', '') AS a, replace(cor, ' ', '') AS b, string_split(err, ' ') AS ea, string_split(cor, ' ') AS ca FROM f),
        h AS (SELECT * FROM g WHERE err <> '' AND cor <> '' AND err <> cor AND regexp_matches(err || cor, '[가-힣]') AND len(ea) <= 3 AND len(ca) <= 3 AND length(err) <= 14 AND length(cor) <= 14
            AND (len(ea) > 1 OR len(ca) > 1) AND NOT regexp_matches(err || cor, '[ㄱ-ㅎㅏ-ㅣ]')
            AND len(list_filter(list_concat(ea, ca), lambda v: NOT regexp_full_match(v, '[가-힣A-Za-z0-9]+') OR length(v) > 5)) = 0),
        s AS (SELECT *, CASE WHEN a = b THEN 1.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, 1 - {duck.edits("a", "b")} / greatest(length(a), length(b))), 4) END AS sim FROM h),
        c AS (SELECT err, cor, count(*) AS frequency, round(avg(sim), 4) AS similarity, count(*) FILTER (channel = 'voice') AS voice FROM s WHERE sim >= 0.74 GROUP BY ALL),
        t AS (SELECT *, sum(frequency) OVER (PARTITION BY err)::BIGINT AS total, sum(voice) OVER (PARTITION BY err) AS voices, row_number() OVER (PARTITION BY err ORDER BY frequency DESC, cor) AS rank FROM c)
        SELECT err, cor, frequency, total, round(frequency / total, 4) AS dominance, similarity, round(least(0.995::DOUBLE, 0.9::DOUBLE + 0.03::DOUBLE * least(frequency, 5) + 0.05::DOUBLE * similarity), 4) AS confidence
        FROM t WHERE rank = 1 AND total >= 3 AND frequency >= 0.86 * total AND similarity >= 0.82 AND NOT (voices > 0.5 * total AND frequency < 6) AND NOT (frequency <> total AND total >= 8)""",
    "lemma_edges": f"""WITH {_EDGES},
        sl AS (SELECT lemma, target, pos, string_agg(slot, ' ' ORDER BY slot) AS slots FROM (SELECT DISTINCT lemma, target, pos, unnest(suffixSlots) AS slot FROM k) WHERE slot IS NOT NULL GROUP BY ALL),
        ch AS (SELECT lemma, target, pos, sum(list_sum(map_values(interfaceStats)))::BIGINT AS n_channels FROM k GROUP BY ALL)
        SELECT edge.*, slots, n_channels FROM edge LEFT JOIN sl USING (lemma, target, pos) LEFT JOIN ch USING (lemma, target, pos)""",
    "suffix_rules": f"""WITH {_SUFFIXES} SELECT * FROM rule ORDER BY frequency DESC, score DESC, source_suffix, target_suffix, pos LIMIT 160""",
    "suffix_examples": f"""WITH {_SUFFIXES}, e AS (SELECT source_suffix, target_suffix, pos, 'source' AS side, lemma, frequency FROM cut UNION ALL SELECT source_suffix, target_suffix, pos, 'target', target, frequency FROM cut),
        n AS (SELECT source_suffix, target_suffix, pos, side, lemma, sum(frequency)::BIGINT AS count FROM e GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY source_suffix, target_suffix, pos, side ORDER BY count DESC, lemma)::INT AS rank FROM n QUALIFY rank <= 6""",
}
