"""Queries p1 and p4 over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maldadum.operators import nested, skew
from maldadum.session import materialize
from maldadum.sources.tables import one_row_per_id, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    details = nested.vendor_details(table(spark, folder, "vendor_files"))
    return details.select("file_id", F.col("item_pos"), F.col("err_pos"), "leaf_kind", "leaf_key")


def p1_items(spark: SparkSession, folder: str) -> DataFrame:
    return nested.vendor_items(table(spark, folder, "vendor_files"))


def p1_errors(spark: SparkSession, folder: str) -> DataFrame:
    return nested.vendor_errors(table(spark, folder, "vendor_files"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of error texts with its counts and details."""
    records = one_row_per_id(table(spark, folder, "corpus_records"), "source", "errors")
    entries = materialize(skew.error_entries(records), "entries")  # read by three jobs
    return skew.pair_details(entries, table(spark, folder, "typed_confusion_graph"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of at least 1 percent of all entries."""
    pairs = p4_pairs(spark, folder)
    return pairs.where((F.col("err_text") != "") & (F.col("cor_text") != "") & (F.col("n_entries") * 100 >= F.col("n_total"))).select("err_text", "cor_text")


QUERIES = {"p1_found": p1_found, "p1_items": p1_items, "p1_errors": p1_errors, "p4_found": p4_found, "p4_pairs": p4_pairs}

_ENTRIES = """
    r AS (SELECT id, source, errors FROM corpus_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY rec_no) = 1),
    e AS (SELECT id, upper(trim(source)) AS source, x.err_text, x.cor_text, x.edit_distance, x.err_details.kind AS kind
          FROM (SELECT id, source, unnest(errors) AS x FROM r))"""

_VENDOR = """
    f AS (SELECT file_id, j FROM (SELECT file_id, CASE WHEN json_valid(ltrim(payload, chr(65279))) THEN ltrim(payload, chr(65279))::JSON END AS j FROM vendor_files) WHERE json_type(j) = 'OBJECT'),
    d AS (SELECT file_id, CASE json_type(j, '$.data') WHEN 'ARRAY' THEN json_extract(j, '$.data[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.data')] END AS items FROM f),
    i AS (SELECT file_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS item_pos FROM d),
    l AS (SELECT file_id, item_pos, CASE json_type(item, '$.annotation.errors') WHEN 'ARRAY' THEN json_extract(item, '$.annotation.errors[*]') WHEN 'OBJECT' THEN [json_extract(item, '$.annotation.errors')] END AS errs FROM i),
    e AS (SELECT file_id, item_pos, unnest(errs) AS err, generate_subscripts(errs, 1) - 1 AS err_pos FROM l)"""

SQL = {
    "p1_found": f"""
        WITH {_VENDOR},
        t AS (SELECT file_id, item_pos, err_pos, json_extract(err, '$.err_details') AS x, json_type(err, '$.err_details') AS k FROM e WHERE json_type(err) = 'OBJECT'),
        o AS (SELECT file_id, item_pos, err_pos, json_extract(x, '$.*') AS vs, json_keys(x) AS ks FROM t WHERE k = 'OBJECT'),
        p AS (SELECT file_id, item_pos, err_pos, unnest(ks) AS outer_key, unnest(vs) AS v FROM o),
        r AS (SELECT file_id, item_pos, err_pos, 'tags' AS leaf_kind, unnest(json_extract_string(x, '$[*]')) AS leaf_key FROM t WHERE k = 'ARRAY'
              UNION ALL SELECT file_id, item_pos, err_pos, 'counts', outer_key || '.' || unnest(json_keys(v)) FROM p WHERE json_type(v) = 'OBJECT'
              UNION ALL SELECT file_id, item_pos, err_pos, 'raw', x->>'$' FROM t WHERE k NOT IN ('ARRAY', 'OBJECT', 'NULL') AND x->>'$' <> '')
        SELECT file_id, item_pos::BIGINT AS item_pos, err_pos::BIGINT AS err_pos, leaf_kind, leaf_key FROM r
        UNION ALL SELECT file_id, item_pos, err_pos, 'none', '' FROM t WHERE (file_id, item_pos, err_pos) NOT IN (SELECT (file_id, item_pos, err_pos) FROM r)""",
    "p1_errors": f"""
        WITH {_VENDOR}
        SELECT file_id, item_pos::BIGINT AS item_pos, err_pos::BIGINT AS err_pos, err->>'$.err_idx' AS err_idx, err->>'$.err_location' AS err_location, err->>'$.err_text' AS err_text, err->>'$.cor_text' AS cor_text, err->>'$.edit_distance' AS edit_distance FROM e""",
    "p1_items": f"""
        WITH {_VENDOR}
        SELECT file_id, item_pos::BIGINT AS item_pos, {", ".join(f"item->>'$.metadata_info.{c}' AS {c}" for c in ("id", "source", "interface", "keyboard", "date", "gender", "age"))},
            {", ".join(f"item->>'$.annotation.{c}' AS {c}" for c in ("reg_date", "err_sentence", "cor_sentence", "err_sentence_spell", "cor_sentence_spell"))} FROM i""",
    "p4_found": f"""
        WITH {_ENTRIES}
        SELECT err_text, cor_text FROM e WHERE err_text <> '' AND cor_text <> ''
        GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM e)""",
    "p4_pairs": f"""
        WITH {_ENTRIES},
        g AS (SELECT src, replacement, count(*) AS n_edges, sum(frequency)::BIGINT AS edge_frequency FROM typed_confusion_graph GROUP BY ALL),
        p AS (SELECT err_text, cor_text, count(*) AS n_entries, count(DISTINCT id) AS n_records,
                count(*) FILTER (kind = 'tags') AS n_tags, count(*) FILTER (kind = 'counts') AS n_counts,
                count(*) FILTER (kind = 'raw') AS n_raw, sum(edit_distance)::BIGINT AS sum_distance,
                count(DISTINCT source) AS n_sources, (SELECT count(*) FROM e) AS n_total
              FROM e GROUP BY err_text, cor_text)
        SELECT p.*, coalesce(n_edges, 0) AS n_edges, edge_frequency
        FROM p LEFT JOIN g ON g.src = p.err_text AND g.replacement = p.cor_text""",
}
