"""Queries on token-label examples and sentence pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maldadum.functions import text as T
from maldadum.operators import labels
from maldadum.plans import duck
from maldadum.session import spread
from maldadum.sources.tables import one_row_per_id, table

_RECORD = ("id", "split", "error_type", "source", "err_sentence", "cor_sentence", "error_count", "errors")


def _dataset(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "edit_tagger_v2_dataset")


def label_examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels.examples(spread(one_row_per_id(table(spark, folder, "corpus_records"), *_RECORD)))
    return rows.drop("token_offsets").withColumns({"tokens": F.array_join("tokens", " "), "labels": F.array_join("labels", " ")})


def clean_examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels.examples(spread(one_row_per_id(table(spark, folder, "corpus_records"), *_RECORD))).where("variant = 'clean'")
    return rows.select("id", "split", F.size("tokens").alias("n_tokens"), F.element_at("tokens", -1).alias("last_token"), F.element_at(F.element_at("token_offsets", -1), -1).alias("last_end"))


def entry_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = one_row_per_id(table(spark, folder, "corpus_records"), "errors").select(F.explode("errors").alias("e"))
    return rows.select(labels.entry_label(F.col("e.err_text"), F.col("e.cor_text"), F.col("e.err_details")).alias("label"), F.coalesce("e.err_details.kind", F.lit("absent")).alias("kind")).groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return labels.label_counts(_dataset(spark, folder))


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return labels.class_weights(_dataset(spark, folder))


def deduplicated_examples(spark: SparkSession, folder: str) -> DataFrame:
    return labels.deduplicated(_dataset(spark, folder), "ex_no").select("ex_no", "id", "variant")


def balanced_examples(spark: SparkSession, folder: str) -> DataFrame:
    return labels.balanced(_dataset(spark, folder), "ex_no", 0.5).select("ex_no", "split", "variant")


def tagger_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Of the plainest prediction: a token is wrong if the corrected text does not hold it."""
    rows = _dataset(spark, folder).where("corrected_text is not null").select("corrected_text", F.explode(F.arrays_zip("tokens", "labels")).alias("t"))
    found = F.contains(F.col("corrected_text"), F.col("t.tokens"))
    return labels.token_metrics(rows.select(F.col("t.labels").alias("gold"), F.when(found, "KEEP").otherwise("OPEN_REPLACE").alias("pred")))


def replace_runs(spark: SparkSession, folder: str) -> DataFrame:
    return labels.label_runs(_dataset(spark, folder), "ex_no")


def pair_clean(spark: SparkSession, folder: str) -> DataFrame:
    return labels.clean_pairs(table(spark, folder, "corpus_records").select("split", F.col("err_sentence").alias("original"), F.col("cor_sentence").alias("corrected")))


def exact_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dataset(spark, folder).where("corrected_text is not null")
    return rows.groupBy("split", "variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.trim("text") == F.trim("corrected_text")).cast("int")), 6).alias("exact"))


def type_shares(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    counts = one_row_per_id(table(spark, folder, "corpus_records"), "error_type").groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))  # a row per type


def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "corpus_records").select("split", "error_type", F.upper(F.trim("source")).alias("source"), "member_name", "error_count")
    rows.createOrReplaceTempView("_split_rows")
    return rows.sparkSession.sql("""
        SELECT split, error_type, source, count(*) AS n, count(DISTINCT member_name) AS n_members, sum(error_count) AS n_errors, grouping(error_type) AS all_types, grouping(source) AS all_sources
        FROM _split_rows GROUP BY GROUPING SETS ((split), (split, error_type), (split, source))""").withColumns({"all_types": F.col("all_types").cast("int"), "all_sources": F.col("all_sources").cast("int")})


def repeat_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "corpus_records").where("err_sentence is not null")
    return rows.select("rec_no", T.drop_repeats(F.col("err_sentence")).alias("cleaned"))


def word_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Words that differ place by place."""
    rows = _dataset(spark, folder).where("corrected_text is not null").select("ex_no", F.split("text", " ").alias("a"), F.split("corrected_text", " ").alias("b"))
    each = rows.select("ex_no", F.posexplode(F.slice(F.arrays_zip("a", "b"), F.lit(1), F.least(F.size("a"), F.size("b")))).alias("place", "w"))
    return each.where("w.a <> w.b").select("ex_no", "place", F.col("w.a").alias("original"), F.col("w.b").alias("corrected"))


QUERIES = {f.__name__: f for f in (label_examples, clean_examples, entry_labels, label_counts, class_weights, deduplicated_examples, balanced_examples, tagger_metrics, replace_runs, pair_clean, exact_match, type_shares, split_summary, repeat_cleanup, word_diff)}

_STRIP = "regexp_replace({0}, '[\\s\\p{{Z}}\\p{{P}}]', '', 'g')"
SQL = {
    "clean_examples": f"""WITH r AS ({duck.one_per_id("split", "cor_sentence")}), t AS (SELECT *, regexp_extract_all(cor_sentence, '[^{duck.SPACE}]+') AS ws FROM r WHERE cor_sentence IS NOT NULL)
        SELECT id || ':clean' AS id, split, len(ws)::INT AS n_tokens, ws[-1] AS last_token, length(regexp_replace(cor_sentence, '[{duck.SPACE}]+$', ''))::INT AS last_end FROM t WHERE len(ws) > 0""",
    "entry_labels": f"""WITH r AS ({duck.one_per_id("errors")}), x AS (SELECT unnest(errors) AS e FROM r),
        y AS (SELECT coalesce(e.err_text, '') AS a, coalesce(e.cor_text, '') AS b, e.err_details AS d FROM x)
        SELECT CASE WHEN coalesce(d.kind = 'tags' AND list_contains(d.tags, '띄어쓰기'), false) OR (a <> b AND replace(a, ' ', '') = replace(b, ' ', ''))
            OR coalesce(d.counts['spacing.insert'] > 0, false) OR coalesce(d.counts['spacing.delete'] > 0, false) OR coalesce(d.counts['spacing.replace'] > 0, false) THEN 'SPACE_FIX'
            WHEN a <> b AND {_STRIP.format("a")} = {_STRIP.format("b")} THEN 'KEEP' ELSE 'OPEN_REPLACE' END AS label, coalesce(d.kind, 'absent') AS kind, count(*) AS n FROM y GROUP BY ALL""",
    "label_counts": "SELECT split, variant, label, count(*) AS n FROM (SELECT split, variant, unnest(labels) AS label FROM edit_tagger_v2_dataset) GROUP BY ALL",
    "class_weights": """WITH c AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM edit_tagger_v2_dataset) GROUP BY ALL)
        SELECT label, n, round((1 / sqrt(1 + n)) / avg(1 / sqrt(1 + n)) OVER (), 6) AS weight FROM c""",
    "deduplicated_examples": "SELECT ex_no, id, variant FROM edit_tagger_v2_dataset QUALIFY row_number() OVER (PARTITION BY text, labels ORDER BY variant <> 'noisy', ex_no) = 1",
    "balanced_examples": """WITH n AS (SELECT split, floor(count(*) * 0.5) AS want FROM edit_tagger_v2_dataset WHERE variant = 'noisy' GROUP BY ALL),
        c AS (SELECT ex_no, split, variant, row_number() OVER (PARTITION BY split ORDER BY ex_no) AS k FROM edit_tagger_v2_dataset WHERE variant = 'clean')
        SELECT ex_no, split, variant FROM edit_tagger_v2_dataset WHERE variant = 'noisy' UNION ALL SELECT ex_no, c.split, variant FROM c JOIN n ON n.split = c.split WHERE k <= want""",
    "tagger_metrics": """WITH t AS (SELECT corrected_text, unnest(tokens) AS tok, unnest(labels) AS g FROM edit_tagger_v2_dataset WHERE corrected_text IS NOT NULL),
        p AS (SELECT g, CASE WHEN contains(corrected_text, tok) THEN 'KEEP' ELSE 'OPEN_REPLACE' END AS p FROM t),
        c AS (SELECT count(*) AS n, count(*) FILTER (g = p) AS r, count(*) FILTER (g <> 'KEEP' AND p <> 'KEEP') AS tp, count(*) FILTER (p <> 'KEEP') AS pp, count(*) FILTER (g <> 'KEEP') AS gp,
            count(*) FILTER (g = 'KEEP') AS keep, count(*) FILTER (g = 'KEEP' AND p <> 'KEEP') AS fp, count(*) FILTER (g = 'OPEN_REPLACE' AND p = g) AS otp, count(*) FILTER (p = 'OPEN_REPLACE') AS opp, count(*) FILTER (g = 'OPEN_REPLACE') AS ogp,
            count(*) FILTER (g = 'SPACE_FIX' AND p = g) AS stp, count(*) FILTER (p = 'SPACE_FIX') AS spp, count(*) FILTER (g = 'SPACE_FIX') AS sgp FROM p)
        SELECT n AS n_tokens, round(coalesce(r / nullif(n, 0), 0), 6) AS accuracy, round(coalesce(fp / nullif(keep, 0), 0), 6) AS keep_fpr,
            round(coalesce(tp / nullif(pp, 0), 0), 6) AS non_keep_precision, round(coalesce(tp / nullif(gp, 0), 0), 6) AS non_keep_recall, round(coalesce(2 * tp / nullif(pp + gp, 0), 0), 6) AS non_keep_f1,
            round(coalesce(otp / nullif(opp, 0), 0), 6) AS open_replace_precision, round(coalesce(otp / nullif(ogp, 0), 0), 6) AS open_replace_recall, round(coalesce(2 * otp / nullif(opp + ogp, 0), 0), 6) AS open_replace_f1,
            round(coalesce(stp / nullif(spp, 0), 0), 6) AS space_fix_precision, round(coalesce(stp / nullif(sgp, 0), 0), 6) AS space_fix_recall, round(coalesce(2 * stp / nullif(spp + sgp, 0), 0), 6) AS space_fix_f1 FROM c""",
    "replace_runs": """WITH t AS (SELECT ex_no, tokens, len(tokens) AS n, unnest(labels) AS l, generate_subscripts(labels, 1) - 1 AS i FROM edit_tagger_v2_dataset),
        o AS (SELECT *, i - row_number() OVER (PARTITION BY ex_no ORDER BY i) AS g FROM t WHERE l = 'OPEN_REPLACE'),
        k AS (SELECT *, (row_number() OVER (PARTITION BY ex_no, g ORDER BY i) - 1) // 3 AS piece FROM o),
        r AS (SELECT ex_no, any_value(tokens) AS tk, any_value(n) AS n, min(i) AS f, max(i) AS l FROM k GROUP BY ex_no, g, piece)
        SELECT ex_no, f::INT AS first, l::INT AS last, array_to_string(tk[f + 1:l + 1], ' ') AS tokens, array_to_string(tk[greatest(f - 3, 0) + 1:f], ' ') AS before, array_to_string(tk[l + 2:l + 4], ' ') AS after FROM r""",
    "pair_clean": """SELECT DISTINCT split, trim(err_sentence) AS original, trim(cor_sentence) AS corrected FROM corpus_records
        WHERE trim(err_sentence) <> trim(cor_sentence) AND length(trim(err_sentence)) BETWEEN 2 AND 200 AND length(trim(cor_sentence)) BETWEEN 2 AND 200""",
    "exact_match": "SELECT split, variant, count(*) AS n, round(avg((trim(text) = trim(corrected_text))::INT), 6) AS exact FROM edit_tagger_v2_dataset WHERE corrected_text IS NOT NULL GROUP BY ALL",
    "type_shares": f"WITH r AS ({duck.one_per_id('error_type')}), c AS (SELECT error_type, count(*) AS n FROM r GROUP BY ALL) SELECT error_type, n, round(100 * n / sum(n) OVER (), 2) AS percent FROM c",
    "split_summary": """SELECT split, error_type, upper(trim(source)) AS source, count(*) AS n, count(DISTINCT member_name) AS n_members, sum(error_count)::BIGINT AS n_errors, grouping(error_type)::INT AS all_types, grouping(upper(trim(source)))::INT AS all_sources
        FROM corpus_records GROUP BY GROUPING SETS ((split), (split, error_type), (split, upper(trim(source))))""",
    "repeat_cleanup": """WITH t AS (SELECT rec_no, string_split(trim(regexp_replace(regexp_replace(err_sentence, '[^가-힣ㄱ-ㅎㅏ-ㅣA-Za-z0-9\\s.,!?~''"()%:/-]', '', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM corpus_records WHERE err_sentence IS NOT NULL)
        SELECT rec_no, array_to_string(list_filter(w, lambda x, i: i = 1 OR x <> w[(i - 1)::INT]), ' ') AS cleaned FROM t""",
    "word_diff": """WITH t AS (SELECT ex_no, string_split(text, ' ') AS a, string_split(corrected_text, ' ') AS b FROM edit_tagger_v2_dataset WHERE corrected_text IS NOT NULL),
        z AS (SELECT ex_no, unnest(range(0, least(len(a), len(b))))::INT AS place, a, b FROM t)
        SELECT ex_no, place, a[place + 1] AS original, b[place + 1] AS corrected FROM z WHERE a[place + 1] <> b[place + 1]""",
}
