"""Queries p2, p5, p7, p8 and p9 over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maldadum.llm import cooccurrence, mixing, sampling, terms, tokens
from maldadum.session import materialize
from maldadum.sources.tables import one_row_per_id, table


def _categories(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(one_row_per_id(table(spark, folder, "corpus_records"), "error_type", "source"), "categories")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    report = sampling.quotas(_categories(spark, folder), table(spark, folder, "sample_targets"))
    return report.where("short").select("error_type", "source")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.quotas(_categories(spark, folder), table(spark, folder, "sample_targets"))


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    records = _categories(spark, folder)
    return sampling.sample(records, sampling.quotas(records, table(spark, folder, "sample_targets"))).select("rec_no", "error_type", "source")


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    return one_row_per_id(table(spark, folder, "corpus_records"), "cor_sentence")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "typed_confusion_graph").select(F.explode("contextHints.term").alias("item"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(_baskets(spark, folder), "cor_sentence", _items(spark, folder), min_together=5, min_lift=8)
    return pairs.select("term_a", "term_b")


def p5_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair found together at least five times, with its surprise under the fitted null."""
    return cooccurrence.surprise(_baskets(spark, folder), "cor_sentence", _items(spark, folder), min_together=5)


def _term_counts(spark: SparkSession, folder: str) -> DataFrame:
    records = materialize(one_row_per_id(table(spark, folder, "corpus_records"), "errors"), "term-records")
    counts = terms.term_counts(terms.occurrences(records, {"err_text": F.col("errors.err_text"), "cor_text": F.col("errors.cor_text")}))
    return terms.marked(counts, records.count())


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder).where("mark is not null").select("field", F.col("term").alias("term_value"), "mark")


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder).select("field", F.col("term").alias("term_value"), "occ", "rec", "mark")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    sized = materialize(mixing.sized_documents(table(spark, folder, "documents"), "doc_id"), "sized")
    report, _ = mixing.mix_plan(sized, table(spark, folder, "mix_targets"))
    return report.where("short").select("source")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    sized = materialize(mixing.sized_documents(table(spark, folder, "documents"), "doc_id"), "sized")
    return mixing.mix_plan(sized, table(spark, folder, "mix_targets"))[0]


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_sample, p5_found, p5_surprise, p7_found, p7_counts, p8_ids, p9_found, p9_report, p9_mixture)}

_ONE = "SELECT * FROM corpus_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY rec_no) = 1"
_TERMS = f"""
    r AS ({_ONE}),
    e AS (SELECT id, unnest(errors) AS x FROM r),
    t AS (SELECT id, 'err_text' AS field, x.err_text AS term_value FROM e UNION ALL SELECT id, 'cor_text', x.cor_text FROM e),
    c AS (SELECT field, term_value, count(*) AS occ, count(DISTINCT id) AS rec FROM t WHERE term_value <> '' GROUP BY ALL),
    m AS (SELECT *, CASE WHEN rec = 1 THEN 'rare' WHEN rec * 100 > 2 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)"""

SQL = {
    "p2_found": f"""
        WITH r AS ({_ONE}), n AS (SELECT count(*) // 5 AS size FROM r),
        c AS (SELECT error_type, lower(trim(source)) AS key, count(*) AS n FROM r GROUP BY ALL)
        SELECT t.error_type, t.source FROM n, sample_targets t LEFT JOIN c ON c.error_type = t.error_type AND c.key = lower(trim(t.source))
        WHERE coalesce(c.n, 0) < greatest(t.min_rows, -((-t.target_permille * size) // 1000))""",
    "p5_found": f"""
        WITH r AS ({_ONE}), i AS (SELECT DISTINCT h.term AS item FROM (SELECT unnest(contextHints) AS h FROM typed_confusion_graph)),
        w AS (SELECT DISTINCT id, unnest(regexp_extract_all(cor_sentence, '[가-힣A-Za-z0-9]+')) AS item FROM r),
        b AS (SELECT id, item FROM w WHERE item IN (SELECT item FROM i)),
        f AS (SELECT item, count(*) AS n FROM b GROUP BY item),
        p AS (SELECT x.item AS term_a, y.item AS term_b, count(*) AS c FROM b x JOIN b y ON x.id = y.id AND x.item < y.item GROUP BY ALL)
        SELECT term_a, term_b FROM p JOIN f fa ON fa.item = term_a JOIN f fb ON fb.item = term_b
        WHERE c >= 5 AND c * (SELECT count(*) FROM r) >= 8 * fa.n * fb.n""",
    "p7_found": f"WITH {_TERMS} SELECT field, term_value, mark FROM m WHERE mark IS NOT NULL",
    "p7_counts": f"WITH {_TERMS} SELECT field, term_value, occ, rec, mark FROM m",
}
