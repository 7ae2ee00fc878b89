"""Queries on groups of tokens, windows, labels with punctuation, and the light variants, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maldadum import vocab
from maldadum.functions import spans as P, text as T
from maldadum.operators import grouping as G, labels, light, mining, windows as Wn
from maldadum.plans import duck
from maldadum.plans.mining_queries import _PAIRS
from maldadum.plans.text_queries import PLAIN_RULES
from maldadum.session import spread
from maldadum.sources.tables import one_row_per_id, table


def _dataset(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "edit_tagger_v2_dataset")


def _memory(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases by hand, and two-word entries of the corpus found more than once."""
    rows = mining.entries(one_row_per_id(table(spark, folder, "corpus_records"), *mining.RECORD_COLUMNS))
    mined = rows.where(F.size(F.split("err", " ")) == 2).groupBy(F.col("err").alias("src"), F.col("cor").alias("dst")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return G.manual_phrases(rows).unionByName(mined.select("src", "dst", F.lit(0.98).alias("confidence")))


def candidate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs, phrases and tokens of every example that may be replaced, from left to right."""
    tokens = G.labelled_tokens(_dataset(spark, folder).withColumn("sentence", F.col("text")), "ex_no", "sentence")
    fixes = spark.createDataFrame(list(vocab.MANUAL_FIXES), "src STRING, dst STRING, confidence DOUBLE")
    found = G.groups(tokens, "sentence", fixes, _memory(spark, folder))
    return found.select(F.col("key").alias("ex_no"), "idx", "n_tokens", "kind", "st", "ed", "original", "replacement", "score")


def replace_windows(spark: SparkSession, folder: str) -> DataFrame:
    found = Wn.replace_windows(_dataset(spark, folder), "ex_no", "text")
    return found.select("ex_no", F.col("window.st").alias("st"), F.col("window.ed").alias("ed"), F.col("local.st").alias("local_st"), F.col("local.ed").alias("local_ed"), "window_text")


def mark_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that tell punctuation apart, by the kind of details."""
    rows = one_row_per_id(table(spark, folder, "corpus_records"), "errors").select(F.explode("errors").alias("e"))
    label = labels.entry_label_with_marks(F.col("e.err_text"), F.col("e.cor_text"), F.col("e.err_details"))
    return rows.select(label.alias("label"), F.coalesce("e.err_details.kind", F.lit("absent")).alias("kind")).groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


def plain_examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels.plain_examples(one_row_per_id(table(spark, folder, "corpus_records"), "id", "split", "error_type", "source", "err_sentence", "cor_sentence", "error_count", "errors"))
    return rows.select("id", "split", F.size("tokens").alias("n_tokens"), F.array_join("labels", " ").alias("labels"), "error_count", "located_error_count")


def light_profile(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents")).where("text is not null").select("doc_id", light.profile(F.col("text")).alias("profile"))


def light_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The graph's edges as candidates of their own sources, without analyses."""
    graph = table(spark, folder, "typed_confusion_graph").where("generatorScore is not null")
    found = graph.select(F.col("src").alias("key"), F.lit(0).alias("st"), F.length("src").alias("ed"), F.col("src").alias("original"), "replacement", "source", F.col("generatorScore").alias("generator"), F.col("contextHints.term").alias("hint_terms")).withColumn("said", F.col("key"))
    some = light.candidates(found.drop("said")).withColumn("said", F.col("key"))
    ranked = light.reranked(light.verified(some, "said"), "said", F.lit(False), F.lit(None).cast("double"))
    return ranked.select("key", "replacement", "source", "verify", "rerank", "final")


def one_edit_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = mining.word_pairs(mining.entries(one_row_per_id(table(spark, folder, "corpus_records"), *mining.RECORD_COLUMNS)))
    return light.one_edit(rows.select(F.col("err").alias("tok")), table(spark, folder, "typed_confusion_graph").select("src"))


def edit_previews(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with plain rules applied, and how many letters are marked."""
    t = F.col("err_sentence")
    rows = table(spark, folder, "corpus_records").where("err_sentence is not null").select("rec_no", light.preview(t, P.rule_edits(t, PLAIN_RULES)).alias("p"))
    return rows.select("rec_no", "p.text", F.size("p.markers").alias("n_markers"), F.aggregate("p.markers", F.lit(0), lambda a, m: a + m["ed"] - m["st"]).alias("marked"))


QUERIES = {f.__name__: f for f in (candidate_groups, replace_windows, mark_labels, plain_examples, light_profile, light_scores, one_edit_words, edit_previews)}

_R4 = "round(({0})::DECIMAL(18, 10), 4)::DOUBLE"
_FIXES = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in vocab.MANUAL_FIXES)
_PHRASES = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in vocab.MANUAL_PHRASES)
_RIEUL = "(unicode(right({0}, 1)) BETWEEN 44032 AND 55203 AND (unicode(right({0}, 1)) - 44032) % 28 = 8)"
_W, _F = "whole", "replace(fixed, ' ', '')"
_STRIP = "regexp_replace({0}, '[\\s\\p{{Z}}\\p{{P}}]', '', 'g')"
_NESTED, _COUNT, _CHARS = "err_sentence", "", ""
for _a, _b, _ in PLAIN_RULES:
    _NESTED = f"replace({_NESTED}, '{_a}', '{_b}')"
_times = [f"((length(err_sentence) - length(replace(err_sentence, '{a}', ''))) // {len(a)})" for a, _, _ in PLAIN_RULES]
_COUNT = " + ".join(_times)
_CHARS = " + ".join(f"{len(b)} * {t}" for (_, b, _), t in zip(PLAIN_RULES, _times))

SQL = {
    "candidate_groups": f"""WITH RECURSIVE {_PAIRS},
        mem AS (SELECT * FROM (VALUES {_PHRASES}) v(src, dst, sure) UNION ALL SELECT err, cor, 0.98::DOUBLE FROM entry WHERE len(string_split(err, ' ')) = 2 GROUP BY err, cor HAVING count(*) > 1),
        form AS (SELECT {duck.all_tokens("src")} AS f, dst, sure FROM mem WHERE src <> dst),
        t AS (SELECT ex_no, text, tokens AS ts, labels AS ls, token_offsets AS os, unnest(range(1, len(tokens) + 1)) AS i FROM edit_tagger_v2_dataset),
        pr AS (SELECT ex_no, i, os[i][1] AS st, os[i + 1][2] AS ed, text[os[i][1] + 1:os[i + 1][2]] AS original FROM t WHERE i < len(ts) AND ls[i] = 'KEEP' AND ls[i + 1] = 'KEEP'),
        pw AS (SELECT *, regexp_replace(original, '\\s+', '', 'g') AS whole FROM pr),
        px AS (SELECT * FROM pw WHERE length(whole) >= 2 AND length(regexp_replace(whole, '[^가-힣]', '', 'g')) >= 0.7 * length(whole)),
        pc AS (SELECT px.*, dst AS fixed, confidence AS g, true AS sure FROM px JOIN (VALUES {_FIXES}) v(src, dst, confidence) ON v.src = whole
            UNION ALL SELECT *, left(whole, length(whole) - 2) || '게요', 0.96::DOUBLE, false FROM px WHERE ends_with(whole, '께요') AND length(whole) > 2 AND (ends_with(whole, '을께요') OR {_RIEUL.format("left(whole, length(whole) - 2)")})
            UNION ALL SELECT *, left(whole, length(whole) - 1) || '게', 0.95::DOUBLE, false FROM px WHERE ends_with(whole, '께') AND length(whole) > 1 AND (ends_with(whole, '을께') OR {_RIEUL.format("left(whole, length(whole) - 1)")})
            UNION ALL SELECT *, '안 ' || whole[2:], 0.95::DOUBLE, true FROM px WHERE starts_with(whole, '않') AND length(whole) > 2 AND whole[2] IN ({", ".join(f"'{x}'" for x in ("하", "해", "되", "돼", "됐", "계"))})
            UNION ALL SELECT *, '안 ' || whole[2:], 0.96::DOUBLE, true FROM px WHERE starts_with(whole, '안됐') AND length(whole) > 2),
        pt AS (SELECT *, {duck.typo(_W, _F)} AS typo FROM pc WHERE fixed <> original),
        ps AS (SELECT *, {_R4.format("0.46::DOUBLE * g + 0.3::DOUBLE * typo + 0.086::DOUBLE")} AS score FROM pt WHERE typo >= CASE WHEN sure THEN 0.62 ELSE 0.72 END),
        pb AS (SELECT * FROM (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY ex_no, i ORDER BY score DESC, g DESC, typo DESC, fixed) = 1) WHERE score >= CASE WHEN sure THEN 0.72 ELSE 0.78 END),
        ru AS (SELECT ex_no, i, k, ts[i] AS head, os[i][1] AS st, os[i + k - 1][2] AS ed, text[os[i][1] + 1:os[i + k - 1][2]] AS original FROM t, (VALUES (2), (3)) v(k) WHERE i + k - 1 <= len(ts) AND len(list_filter(ls[i:i + k - 1], lambda l: l <> 'OPEN_REPLACE')) = 0),
        rs AS (SELECT ru.*, dst, sure, array_to_string({duck.all_tokens("original")}, ' ') AS said, array_to_string(f, ' ') AS form, array_to_string({duck.all_tokens("original")}, '') AS sb, array_to_string(f, '') AS fb FROM ru JOIN form ON f[1] = head AND len(f) = k),
        rt AS (SELECT *, CASE WHEN said = form THEN 1.0::DOUBLE ELSE {duck.typo("sb", "fb")} END AS typo FROM rs),
        rg AS (SELECT *, CASE WHEN said = form THEN sure ELSE greatest(0.72::DOUBLE, sure - 0.08::DOUBLE + (typo - 0.86::DOUBLE) * 0.4::DOUBLE) END AS g FROM rt WHERE said = form OR (typo >= 0.94 AND {duck.edits("sb", "fb")} <= 1 AND sure >= 0.98)),
        rb AS (SELECT *, {_R4.format("0.48::DOUBLE * g + 0.28::DOUBLE * typo + 0.086::DOUBLE")} AS score FROM rg),
        rc AS (SELECT * FROM rb WHERE score >= CASE WHEN said = form THEN 0.76 ELSE 0.86 END AND typo >= 0.97 QUALIFY row_number() OVER (PARTITION BY ex_no, i ORDER BY score DESC, k, g DESC, typo DESC, dst) = 1),
        pl AS (SELECT ex_no, i, 0 AS age, 'pair' AS kind, 2 AS n, st, ed, original, fixed AS replacement, score FROM pb UNION ALL SELECT ex_no, i, 1, 'phrase', k, st, ed, original, dst, score FROM rc
            UNION ALL SELECT ex_no, i, 2, 'token', 1, os[i][1], os[i][2], ts[i], NULL, NULL FROM t WHERE ls[i] = 'OPEN_REPLACE'),
        pp AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY ex_no, i ORDER BY age) = 1),
        nx AS (SELECT a.ex_no, a.i, min(b.i) AS following FROM pp a LEFT JOIN pp b ON b.ex_no = a.ex_no AND b.i >= a.i + a.n GROUP BY ALL),
        go AS (SELECT ex_no, min(i) AS i FROM pp GROUP BY ex_no UNION ALL SELECT nx.ex_no, nx.following FROM go JOIN nx ON nx.ex_no = go.ex_no AND nx.i = go.i WHERE nx.following IS NOT NULL)
        SELECT pp.ex_no, (pp.i - 1)::INT AS idx, n::INT AS n_tokens, kind, st, ed, original, replacement, score FROM go JOIN pp ON pp.ex_no = go.ex_no AND pp.i = go.i""",
    "replace_windows": """WITH t AS (SELECT ex_no, text, token_offsets AS os, len(labels) AS n, unnest(labels) AS l, generate_subscripts(labels, 1) - 1 AS i FROM edit_tagger_v2_dataset),
        o AS (SELECT *, i - row_number() OVER (PARTITION BY ex_no ORDER BY i) AS g FROM t WHERE l = 'OPEN_REPLACE'),
        k AS (SELECT *, (row_number() OVER (PARTITION BY ex_no, g ORDER BY i) - 1) // 3 AS piece FROM o),
        r AS (SELECT ex_no, any_value(text) AS text, any_value(os) AS os, any_value(n) AS n, min(i) AS f, max(i) AS e FROM k GROUP BY ex_no, g, piece),
        w AS (SELECT *, os[greatest(f - 3, 0) + 1][1] AS st, os[least(e + 3, n - 1) + 1][2] AS ed FROM r)
        SELECT ex_no, st, ed, os[f + 1][1] - st AS local_st, os[e + 1][2] - st AS local_ed, text[st + 1:ed] AS window_text FROM w""",
    "mark_labels": f"""WITH r AS ({duck.one_per_id("errors")}), x AS (SELECT unnest(errors) AS e FROM r),
        y AS (SELECT coalesce(e.err_text, '') AS a, coalesce(e.cor_text, '') AS b, e.err_details AS d FROM x)
        SELECT CASE WHEN coalesce(d.kind = 'tags' AND list_contains(d.tags, '띄어쓰기'), false) OR (a <> b AND replace(a, ' ', '') = replace(b, ' ', '')) OR coalesce(d.counts['spacing.insert'] > 0, false) OR coalesce(d.counts['spacing.delete'] > 0, false) OR coalesce(d.counts['spacing.replace'] > 0, false) THEN 'SPACE_FIX'
            WHEN coalesce(d.kind = 'tags' AND list_contains(d.tags, '문장부호'), false) OR (a <> b AND {_STRIP.format("a")} = {_STRIP.format("b")}) OR coalesce(d.counts['mark.insert'] > 0, false) OR coalesce(d.counts['mark.delete'] > 0, false) OR coalesce(d.counts['mark.replace'] > 0, false) THEN 'PUNCT_FIX'
            ELSE 'OPEN_REPLACE' END AS label, coalesce(d.kind, 'absent') AS kind, count(*) AS n FROM y GROUP BY ALL""",
    "light_profile": """WITH d AS (SELECT doc_id, text, length(text) AS len, greatest(length(text), 1) AS n FROM documents WHERE text IS NOT NULL),
        s AS (SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / n AS latin, length(regexp_replace(text, '[^0-9]', '', 'g')) / n AS digit, length(regexp_replace(text, '[^가-힣]', '', 'g')) / n AS hangul FROM d)
        SELECT doc_id, CASE WHEN latin > 0.3 OR digit > 0.25 THEN 'MIXED' WHEN regexp_matches(text, '[ㅋㅎㅠ]{2,}|[!?]{2,}|개좋|(^|[^A-Za-z0-9_])ㄹㅇ($|[^A-Za-z0-9_])') THEN 'CHAT' WHEN hangul < 0.35 THEN 'QUERY' WHEN NOT regexp_matches(text, '\\s') AND len > 12 THEN 'NOISY' ELSE 'NORMAL' END AS profile FROM s""",
    "light_scores": f"""WITH e AS (SELECT src, replacement, source, generatorScore AS g, list_transform(contextHints, lambda h: h.term) AS hints, {duck.edits("src", "replacement")} AS d FROM typed_confusion_graph WHERE generatorScore IS NOT NULL),
        n AS (SELECT * FROM e WHERE replacement <> '' AND replacement <> src AND d <= greatest(3, ceil(length(src) * 0.5)) QUALIFY row_number() OVER (PARTITION BY src, replacement ORDER BY g DESC, source) = 1),
        k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY src ORDER BY g DESC, replacement) <= 6),
        v AS (SELECT src, replacement, source, g, round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, 0.35::DOUBLE + g * 0.35::DOUBLE + CASE WHEN d <= 1 THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN d >= 4 THEN 0.25::DOUBLE ELSE 0 END
                + CASE WHEN len(list_filter(coalesce(hints, []), lambda h: h <> '' AND contains(src, h))) > 0 THEN 0.12::DOUBLE WHEN source = 'AUTO_FAMILY_SEED' THEN -0.08::DOUBLE ELSE 0 END - CASE WHEN source = 'GEN_BACKOFF' THEN 0.1::DOUBLE ELSE 0 END))::DECIMAL(18, 10), 6)::DOUBLE AS verify FROM k
            UNION ALL SELECT DISTINCT src, src, 'ORIGINAL', 0.2::DOUBLE, 0.25::DOUBLE FROM e),
        r AS (SELECT *, 0.28::DOUBLE + verify * 0.18::DOUBLE + CASE WHEN contains(replacement, '아기') AND contains(replacement, '낳') THEN 0.55::DOUBLE ELSE 0 END - CASE WHEN contains(replacement, '놓') THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN replacement = src THEN 0.08::DOUBLE ELSE 0 END AS s FROM v WHERE source = 'ORIGINAL' OR verify >= 0.36)
        SELECT src AS key, replacement, source, verify, round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, s))::DECIMAL(18, 10), 6)::DOUBLE AS rerank,
            round(least(0.99::DOUBLE, greatest(0.01::DOUBLE, s) + 0.12::DOUBLE * g + 0.12::DOUBLE * verify + 0.08::DOUBLE * 0.8::DOUBLE)::DECIMAL(18, 10), 6)::DOUBLE AS final FROM r""",
    "one_edit_words": f"""WITH {_PAIRS}, t AS (SELECT DISTINCT err AS tok FROM pair WHERE length(err) >= 2), w AS (SELECT DISTINCT src FROM typed_confusion_graph WHERE length(src) > 0)
        SELECT tok, src FROM t JOIN w ON tok <> src AND abs(length(tok) - length(src)) <= 1 WHERE {duck.edits("tok", "src")} <= 1""",
    "edit_previews": f"SELECT rec_no, {_NESTED} AS text, ({_COUNT})::INT AS n_markers, ({_CHARS})::INT AS marked FROM corpus_records WHERE err_sentence IS NOT NULL",
}
