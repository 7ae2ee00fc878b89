"""Rule tables of a corpus, built and written in one go."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from maldadum.operators import family, mining
from maldadum.session import materialize
from maldadum.sources import sinks
from maldadum.sources.tables import one_row_per_id

LABELS = ("KEEP", "SPACE_FIX", "OPEN_REPLACE")


def rule_tables(records: DataFrame, graph: DataFrame, min_count: int = 30) -> dict[str, DataFrame]:
    """Every table that corrections read, by name: fixes and phrases with those given by hand, edges of surfaces with their hints, edges of lemmas, seeds and ending rules.

    :param records: corpus records, rows repeated or not.
    :param graph: confusion edges with lemmas."""
    rows = materialize(mining.entries(one_row_per_id(records, *mining.RECORD_COLUMNS)), "entries")  # read by every table
    pairs = mining.word_pairs(rows)
    hints = mining.context_hints(pairs).groupBy("err", "cor").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "count"))).alias("h"))  # eight a pair
    edges = mining.confusion_edges(pairs).join(mining.counters(pairs), ["err", "cor"]).join(hints, ["err", "cor"], "left")
    mined = mining.surface_fixes(rows, min_count).select(F.col("err").alias("src"), F.col("cor").alias("dst"), "confidence")
    lemmas = mining.lemma_edges(graph)
    return {
        "surface_fixes": mining.merged_rules(mined, mining.manual_rules(rows)),
        "phrase_memory": mining.phrase_memory(mining.phrase_pairs(rows)),
        "confusion_edges": edges.withColumn("hints", F.transform("h", lambda x: F.struct(x["term"].alias("term"), x["count"].alias("count")))).drop("h"),
        "lemma_edges": mining.kept_lemma_edges(lemmas),
        "family_seeds": family.auto_seeds(graph),
        "suffix_rules": mining.suffix_rules(lemmas),
    }


def write_rules(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write the tables as assets, and the label numbers; how many rows each has."""
    counts = {name: sinks.write_asset(table, os.path.join(folder, f"{name}.json")) for name, table in tables.items()}
    sinks.write_label_ids(list(LABELS), os.path.join(folder, "labels.json"))
    return counts
