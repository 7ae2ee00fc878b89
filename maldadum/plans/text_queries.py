"""Queries on texts, spans, edits, candidates, proposals and requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maldadum import vocab
from maldadum.functions import similarity as S, spans as P, text as T
from maldadum.operators import candidates as C, decode as D, mining
from maldadum.operators.rules import scan_rules
from maldadum.plans import duck
from maldadum.session import materialize, spread
from maldadum.sources.tables import one_row_per_id, table
from maldadum.streaming import requests as R

#: Literal rules that neither overlap nor make one another's texts.
PLAIN_RULES = [("몇일", "며칠", 0.99), ("금새", "금세", 0.99), ("어떻해", "어떡해", 0.99), ("역활", "역할", 0.99), ("희안하", "희한하", 0.99), ("설겆이", "설거지", 0.99)]
#: Rules that do overlap: the longer one wins at the same place.
OVERLAPPING_RULES = [*PLAIN_RULES, ("역활을", "역할을", 0.97), ("희안하게", "희한하게", 0.97), ("것같은", "것 같은", 0.95)]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def tokenize_offsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "corpus_records").select("rec_no", F.posexplode_outer(T.tokens(F.col("cor_sentence"))).alias("idx", "t")).where("t is not null")
    return rows.select("rec_no", "idx", "t.tok", "t.st", "t.ed")


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of texts of any length, counted per document."""
    return T.explode_tokens(_documents(spark, folder), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("ed").alias("last_end"), F.sum(F.col("ed") - F.col("st")).alias("chars"))


def phrase_forms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpus_records").where("err_sentence is not null").select("rec_no", T.phrase(F.col("err_sentence")).alias("form"), T.collapsed(F.col("err_sentence")).alias("collapsed"))


def context_words(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "corpus_records").select(F.explode(T.words(F.col("cor_sentence"))).alias("word"))
    return words.groupBy(T.strip_particle(F.col("word")).alias("term")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("n_forms"))


def clause_at_cursor(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).where("text is not null")
    start, clause = T.clause_at(F.col("text"), F.col("cursor_pos"))
    realtime = F.col("mode") == "realtime"
    return rows.select("doc_id", F.when(realtime, start).otherwise(0).alias("start"), F.when(realtime, clause).otherwise(F.col("text")).alias("clause"))


def text_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).where("text is not null")
    return rows.select("doc_id", T.profile(F.col("text")).alias("profile"), F.round(T.hangul_ratio(F.col("text")), 6).alias("hangul"))


def literal_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses and names with their places."""
    t = F.col("text")
    spans = F.concat(P.find_all(t, r"https?://[^\s]+", "URL"), P.find_literal(t, "안내문", "TERM"))
    return _documents(spark, folder).where("text is not null").select("doc_id", T.each(spans).alias("s")).where("s is not null").select("doc_id", "s.st", "s.ed", "s.kind", "s.text")


def protected_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", T.each(P.protected(F.col("text"))).alias("s")).where("s is not null").select("doc_id", "s.st", "s.ed", "s.kind", "s.text")


def masked_texts(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, folder).where("text is not null").select("doc_id", P.masked(t, P.find_all(t, r"https?://[^\s]+", "URL")).alias("masked"))


def apply_edits(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("err_sentence")
    rows = table(spark, folder, "corpus_records").where("err_sentence is not null").withColumn("edits", P.non_overlapping(P.rule_edits(t, PLAIN_RULES)))
    return rows.select("rec_no", F.size("edits").alias("n_edits"), P.applied(t, F.col("edits")).alias("edited"))


def rule_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits that survive protected spans and overlaps."""
    rows = _documents(spark, folder).where("text is not null").select("doc_id", "text", P.protected(F.col("text")).alias("spans"))
    return scan_rules(rows, "text", OVERLAPPING_RULES, "spans").select("doc_id", F.explode("edits").alias("e")).select("doc_id", "e.st", "e.ed", "e.src", "e.dst", "e.confidence")


def spacing_points(spark: SparkSession, folder: str) -> DataFrame:
    """Where blanks are missing in sentences that differ from the corrected ones in blanks only."""
    rows = table(spark, folder, "corpus_records").where(T.spacing_only(F.col("err_sentence"), F.col("cor_sentence")))
    return rows.select("rec_no", F.explode(P.insertion_points(F.col("err_sentence"), F.col("cor_sentence"))).alias("place"))


def pair_similarity(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("src"), F.col("replacement")
    p = S.shared_prefix(a, b)
    return table(spark, folder, "typed_confusion_graph").select(
        "edge_no", F.levenshtein(a, b).alias("edits"), p.alias("prefix"), S.shared_suffix(a, b, p).alias("suffix"), F.round(S.preserved(a, b), 6).alias("preserved"), S.typo_similarity(a, b).alias("typo"),
        F.coalesce(S.syllable_parts(F.substring(a, 1, 1))["initial"], F.lit(-1)).alias("initial"))


def change_hulls(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "edit_tagger_v2_dataset").where("variant = 'noisy' and corrected_text is not null")
    return rows.select("ex_no", S.change_hull("text", "corrected_text").alias("h")).select("ex_no", "h.*")


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "typed_confusion_graph")


def _error_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = one_row_per_id(table(spark, folder, "corpus_records"), *mining.RECORD_COLUMNS)
    return mining.word_pairs(mining.entries(rows)).select("record", F.col("err").alias("tok"), F.col("cor").alias("gold"), "channel", "cor_sentence")


def token_candidates(spark: SparkSession, folder: str) -> DataFrame:
    edges = _graph(spark, folder).groupBy("src", F.col("replacement").alias("dst")).agg(F.max("frequency").alias("frequency"))
    tokens = _error_tokens(spark, folder).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    return C.exact(tokens, edges).select("tok", "n", "dst", "frequency")


def phrase_matches(spark: SparkSession, folder: str) -> DataFrame:
    memory = spark.createDataFrame(list(vocab.MANUAL_PHRASES) + [("것같은", "것 같은", 0.95), ("한번쯤", "한 번쯤", 0.95), ("며칠 동안", "몇 날 동안", 0.5)], "src STRING, dst STRING, confidence DOUBLE")
    return C.phrases(spread(table(spark, folder, "corpus_records")).where("err_sentence is not null"), "rec_no", "err_sentence", memory)


def similar_words(spark: SparkSession, folder: str) -> DataFrame:
    return C.similar(_error_tokens(spark, folder), _graph(spark, folder))


def suffix_targets(spark: SparkSession, folder: str) -> DataFrame:
    graph = _graph(spark, folder).withColumns({"lemma": F.col("src"), "targetLemma": F.col("replacement")})
    rules = mining.suffix_rules(mining.lemma_edges(graph), limit=None)
    return C.by_suffix(graph.select(F.concat("replacement", F.lit("다")).alias("lemma"), T.coarse_pos(F.col("pos")).alias("pos")).distinct(), rules)


def hits_at_k(spark: SparkSession, folder: str) -> DataFrame:
    ranked = mining.confusion_edges(mining.word_pairs(mining.entries(one_row_per_id(table(spark, folder, "corpus_records").where("split = 'train'"), *mining.RECORD_COLUMNS))), 1)
    gold = mining.word_pairs(mining.entries(one_row_per_id(table(spark, folder, "corpus_records").where("split = 'validation'"), *mining.RECORD_COLUMNS)))
    return C.hits_at(ranked.select(F.col("err").alias("tok"), F.col("cor").alias("dst"), "rank"), gold.select(F.col("err").alias("tok"), F.col("cor").alias("dst")))


def channel_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Channel counts of all edges of a replacement, maps added key by key."""
    graph = _graph(spark, folder)
    counts = graph.select("replacement", F.explode("interfaceStats").alias("channel", "n")).groupBy("replacement", "channel").agg(F.sum("n").alias("n"))
    return counts.join(graph.groupBy("replacement").agg(F.sum("frequency").alias("frequency")), "replacement").select("replacement", "frequency", "channel", "n")


def joined_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring tokens that together are a known word."""
    pairs = C.next_pairs(table(spark, folder, "edit_tagger_v2_dataset"), "ex_no")
    words = _graph(spark, folder).select("replacement").distinct()
    return pairs.join(words, F.col("joined") == F.col("replacement")).select("ex_no", "idx", "joined")


def sentence_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Beam-decoded proposals from mined edges on noisy sentences."""
    edges = materialize(mining.confusion_edges(mining.word_pairs(mining.entries(one_row_per_id(table(spark, folder, "corpus_records"), *mining.RECORD_COLUMNS))), 2, 3), "edges")
    rows = T.explode_tokens(table(spark, folder, "edit_tagger_v2_dataset").where("variant = 'noisy'").withColumn("sentence", F.col("text")), "ex_no", "text", r"\S+", ("sentence",)).select("ex_no", F.col("sentence").alias("text"), F.struct("tok", "st", "ed").alias("t"))
    options = F.sort_array(F.collect_list(F.struct("rank", "cor", "score")))
    found = rows.join(edges, F.col("t.tok") == F.col("err")).groupBy("ex_no", "text", "t").agg(options.alias("o"))
    keep = F.array(F.struct(F.col("t.tok").alias("replacement"), F.lit(0.2).alias("score"), F.lit(False).alias("apply")))
    group = F.struct(F.col("t.st").alias("st"), F.col("t.ed").alias("ed"), F.col("t.tok").alias("original"), F.concat(F.transform("o", lambda x: F.struct(x["cor"].alias("replacement"), x["score"].alias("score"), F.lit(True).alias("apply"))), keep).alias("options"))
    return D.decode(found.groupBy("ex_no", "text").agg(F.array_sort(F.collect_list(group)).alias("groups")), "ex_no", "text", "groups")


def debounce_latest(spark: SparkSession, folder: str) -> DataFrame:
    return R.debounced(table(spark, folder, "events"), "user_id", "ts", "event_id").select("user_id", "n", "last")


def latest_request(spark: SparkSession, folder: str) -> DataFrame:
    return R.latest(_documents(spark, folder).where("writer_key is not null and received_at is not null"), "writer_key", "received_at", "doc_id")


def recent_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return R.newest(_documents(spark, folder).select("doc_id", "received_at", "source"), "received_at", "doc_id").select("doc_id", "source")


def profile_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector's nearest label prototype by cosine; a prototype is the mean vector of its label."""
    return C.nearest_prototypes(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")


QUERIES = {f.__name__: f for f in (
    tokenize_offsets, document_tokens, phrase_forms, context_words, clause_at_cursor, text_profile, literal_spans, protected_spans, masked_texts, apply_edits, rule_edits, spacing_points, pair_similarity, change_hulls,
    token_candidates, phrase_matches, similar_words, suffix_targets, hits_at_k, channel_mix, joined_neighbours, sentence_proposals, debounce_latest, latest_request, recent_sessions, profile_cosine)}

_PIECES = "regexp_extract_all({0}, '[" + duck.SPACE.replace("{", "{{").replace("}", "}}") + "]*(?:[가-힣A-Za-z0-9]+|[^" + duck.SPACE.replace("{", "{{").replace("}", "}}") + "])')"
_ENDS = "list_transform(p, lambda x, i: list_sum(list_transform(p[1:i::INT], lambda y: length(y))))"
_PARTICLES = " ".join(f"WHEN ends_with(w, '{p}') AND length(w) > {len(p) + 1} THEN left(w, length(w) - {len(p)})" for p in vocab.PARTICLES)
_NESTED = "err_sentence"
for _a, _b, _ in PLAIN_RULES:
    _NESTED = f"replace({_NESTED}, '{_a}', '{_b}')"
_COUNTS = " + ".join(f"(length(err_sentence) - length(replace(err_sentence, '{a}', ''))) // {len(a)}" for a, _, _ in PLAIN_RULES)
_PAIR = "entry AS (SELECT * FROM pair)"


from maldadum.plans.mining_queries import _PAIRS, _SUFFIXES  # noqa: E402

_FIRST = duck.one_per_id("error_type", "source", "interface", "keyboard", "cor_sentence", "errors")

SQL = {
    "tokenize_offsets": f"""WITH t AS (SELECT rec_no, {_PIECES.format("cor_sentence")} AS p FROM corpus_records WHERE cor_sentence IS NOT NULL),
        e AS (SELECT rec_no, unnest(p) AS piece, unnest({_ENDS})::INT AS ed, generate_subscripts(p, 1)::INT - 1 AS idx FROM t)
        SELECT rec_no, idx, regexp_replace(piece, '^[{duck.SPACE}]+', '') AS tok, (ed - length(regexp_replace(piece, '^[{duck.SPACE}]+', '')))::INT AS st, ed FROM e""",
    "document_tokens": f"""SELECT doc_id, len({duck.all_tokens("text")}) AS n_tokens, length(regexp_replace(text, '[\\s\\p{{Z}}]+$', ''))::INT AS last_end, length(regexp_replace(text, '[\\s\\p{{Z}}]', '', 'g'))::BIGINT AS chars FROM documents WHERE len({duck.all_tokens("text")}) > 0""",
    "suffix_targets": f"""WITH {_SUFFIXES}, l AS (SELECT DISTINCT replacement || '다' AS lemma, replacement AS stem, split_part(pos, '-', 1) AS pos FROM typed_confusion_graph)
        SELECT lemma, l.pos, source_suffix, target_suffix, left(stem, length(stem) - length(source_suffix)) || target_suffix || '다' AS target, score
        FROM l JOIN rule ON rule.pos = l.pos AND ends_with(stem, source_suffix) AND length(stem) > length(source_suffix)""",
    "hits_at_k": f"""WITH {_PAIRS.replace(_FIRST, _FIRST.replace("FROM corpus_records", "FROM corpus_records WHERE split IN ('train', 'validation')").replace("PARTITION BY id", "PARTITION BY split, id").replace("SELECT id,", "SELECT id, split,")).replace("SELECT id, error_type", "SELECT id, split, error_type")},
        f AS (SELECT err, cor, similarity, count(*) AS frequency FROM pair WHERE split = 'train' GROUP BY ALL),
        s AS (SELECT *, round(least(0.985::DOUBLE, 0.5::DOUBLE + ln(1 + frequency) / 12 + 0.28::DOUBLE * similarity), 4) AS score FROM f),
        k AS (SELECT err, cor, row_number() OVER (PARTITION BY err ORDER BY frequency DESC, score DESC, cor DESC) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY err ORDER BY frequency DESC, score DESC, cor DESC) <= 8),
        h AS (SELECT rank FROM pair LEFT JOIN k ON k.err = pair.err AND k.cor = pair.cor WHERE split = 'validation')
        SELECT count(*) AS n, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 3) AS hit_3, count(*) FILTER (rank <= 5) AS hit_5, round(coalesce(count(*) FILTER (rank <= 1) / nullif(count(*), 0), 0), 6) AS rate_1,
            round(coalesce(count(*) FILTER (rank <= 3) / nullif(count(*), 0), 0), 6) AS rate_3, round(coalesce(count(*) FILTER (rank <= 5) / nullif(count(*), 0), 0), 6) AS rate_5 FROM h""",
    "phrase_forms": f"SELECT rec_no, array_to_string({duck.all_tokens('err_sentence')}, ' ') AS form, trim(regexp_replace(err_sentence, '[\\t\\f\\v ]+', ' ', 'g')) AS collapsed FROM corpus_records WHERE err_sentence IS NOT NULL",
    "context_words": f"""WITH t AS (SELECT unnest({duck.words("cor_sentence")}) AS w FROM corpus_records)
        SELECT CASE WHEN NOT regexp_full_match(w, '[가-힣]+') THEN w {_PARTICLES} ELSE w END AS term, count(*) AS n, count(DISTINCT w) AS n_forms FROM t GROUP BY 1""",
    "clause_at_cursor": """WITH d AS (SELECT doc_id, text, mode, greatest(0, least(coalesce(cursor_pos, length(text)), length(text))) AS c FROM documents WHERE text IS NOT NULL),
        b AS (SELECT *, CASE WHEN regexp_matches(right(left(text, c), 1), '[\\n.?!,;]') THEN left(text, c - 1) ELSE left(text, c) END AS body FROM d),
        s AS (SELECT *, greatest(length(body) - length(regexp_extract(body, '[^\\n.?!,;]*$')), c - 128) AS st FROM b)
        SELECT doc_id, CASE WHEN mode = 'realtime' THEN st ELSE 0 END::INT AS start, CASE WHEN mode = 'realtime' THEN text[st + 1:c] ELSE text END AS clause FROM s""",
    "text_profile": """WITH d AS (SELECT doc_id, text, length(text) AS len, greatest(length(text), 1) AS n FROM documents WHERE text IS NOT NULL),
        s AS (SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / n AS latin, length(regexp_replace(text, '[^0-9]', '', 'g')) / n AS digit, length(regexp_replace(text, '[^가-힣]', '', 'g')) / n AS hangul FROM d)
        SELECT doc_id, CASE WHEN latin > 0.3 OR digit > 0.25 THEN 'MIXED' WHEN regexp_matches(text, '[ㅋㅎㅠ]{2,}|[!?]{2,}') THEN 'CHAT' WHEN hangul < 0.35 THEN 'QUERY' WHEN NOT contains(text, ' ') AND len > 12 THEN 'NOISY' ELSE 'NORMAL' END AS profile, round(hangul, 6) AS hangul FROM s""",
    "literal_spans": """WITH k AS (SELECT * FROM (VALUES ('URL', 'https?://[^\\s]+'), ('TERM', '안내문')) v(kind, pattern)),
        m AS (SELECT doc_id, kind, regexp_extract_all(text, pattern) AS h, string_split_regex(text, pattern) AS g FROM documents, k WHERE text IS NOT NULL),
        e AS (SELECT doc_id, kind, unnest(h) AS text, generate_subscripts(h, 1) AS i, h, g FROM m)
        SELECT doc_id, kind, text, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::INT AS st,
            (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))))::INT AS ed FROM e""",
    "masked_texts": """WITH m AS (SELECT doc_id, string_split_regex(text, 'https?://[^\\s]+') AS g FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, list_aggregate(list_transform(g, lambda x, i: CASE WHEN i = 1 THEN x ELSE '__URL_' || (i - 2) || '__' || x END), 'string_agg', '') AS masked FROM m""",
    "apply_edits": f"SELECT rec_no, ({_COUNTS})::INT AS n_edits, {_NESTED} AS edited FROM corpus_records WHERE err_sentence IS NOT NULL",
    "pair_similarity": f"""SELECT edge_no, {duck.edits("src", "replacement")}::INT AS edits, {duck.prefix("src", "replacement")}::INT AS prefix, {duck.suffix("src", "replacement")}::INT AS suffix, CASE WHEN src = replacement THEN 1.0 ELSE round({duck.preserved("src", "replacement")}, 6) END AS preserved,
        {duck.typo("src", "replacement")} AS typo, CASE WHEN unicode(src) BETWEEN 44032 AND 55203 THEN (unicode(src) - 44032) // 588 ELSE -1 END::INT AS initial FROM typed_confusion_graph""",
    "token_candidates": f"""WITH {_PAIRS}, t AS (SELECT err AS tok, count(*) AS n FROM pair GROUP BY ALL), g AS (SELECT src, replacement AS dst, max(frequency) AS frequency FROM typed_confusion_graph GROUP BY ALL)
        SELECT tok, n, dst, frequency FROM t JOIN g ON g.src = t.tok""",
    "phrase_matches": f"""WITH m AS (SELECT src, dst, confidence, {duck.all_tokens("src")} AS f FROM (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in [*vocab.MANUAL_PHRASES, ("것같은", "것 같은", 0.95), ("한번쯤", "한 번쯤", 0.95), ("며칠 동안", "몇 날 동안", 0.5)])}) v(src, dst, confidence)),
        t AS (SELECT rec_no, {duck.all_tokens("err_sentence")} AS ts FROM corpus_records WHERE err_sentence IS NOT NULL),
        p AS (SELECT rec_no, ts, unnest(ts) AS head, generate_subscripts(ts, 1) AS i FROM t)
        SELECT rec_no, (i - 1)::INT AS first, len(f)::INT AS n_tokens, src, dst, confidence FROM p JOIN m ON m.f[1] = p.head AND ts[i:i + len(f) - 1] = f
        QUALIFY row_number() OVER (PARTITION BY rec_no, i ORDER BY len(f) DESC, confidence DESC, dst) = 1""",
    "similar_words": f"""WITH {_PAIRS}, t AS (SELECT DISTINCT err AS tok FROM pair), w AS (SELECT DISTINCT src FROM typed_confusion_graph WHERE src <> ''),
        n AS (SELECT tok, src, {duck.edits("tok", "src")}::INT AS edits FROM t JOIN w ON left(tok, 1) = left(src, 1) AND abs(length(tok) - length(src)) <= 1 AND tok <> src),
        s AS (SELECT *, {duck.typo("tok", "src")} AS similarity FROM n WHERE edits <= 2)
        SELECT tok, src, edits, similarity, row_number() OVER (PARTITION BY tok ORDER BY similarity DESC, src)::INT AS rank FROM s WHERE similarity >= 0.74 QUALIFY row_number() OVER (PARTITION BY tok ORDER BY similarity DESC, src) <= 4""",
    "channel_mix": """WITH e AS (SELECT replacement, unnest(map_entries(interfaceStats)) AS m FROM typed_confusion_graph), f AS (SELECT replacement, sum(frequency)::BIGINT AS frequency FROM typed_confusion_graph GROUP BY ALL)
        SELECT e.replacement, frequency, m.key AS channel, sum(m.value)::BIGINT AS n FROM e JOIN f USING (replacement) GROUP BY ALL""",
    "joined_neighbours": """WITH t AS (SELECT ex_no, tokens, labels, unnest(range(1, len(tokens))) AS i FROM edit_tagger_v2_dataset), p AS (SELECT ex_no, (i - 1)::INT AS idx, tokens[i] || tokens[i + 1] AS joined FROM t WHERE labels[i] = 'KEEP' AND labels[i + 1] = 'KEEP')
        SELECT ex_no, idx, joined FROM p WHERE joined IN (SELECT replacement FROM typed_confusion_graph)""",
    "debounce_latest": """WITH g AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
        SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last FROM s GROUP BY user_id, burst""",
    "latest_request": "SELECT writer_key, received_at, doc_id FROM documents WHERE writer_key IS NOT NULL AND received_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY writer_key ORDER BY received_at DESC, doc_id DESC) = 1",
    "recent_sessions": "SELECT doc_id, source FROM documents ORDER BY received_at DESC NULLS LAST, doc_id DESC LIMIT 20",
    "profile_cosine": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT label, i, avg(v) AS v FROM e GROUP BY ALL),
        d AS (SELECT e.vec_id, p.label, sum(e.v * p.v) / (sqrt(sum(e.v * e.v)) * sqrt(sum(p.v * p.v))) AS c FROM e JOIN p USING (i) GROUP BY ALL)
        SELECT vec_id, label, round(c, 4) AS cosine FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC) = 1""",
}
