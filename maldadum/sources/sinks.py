"""Sinks: JSON lines, CSV, and small JSON assets."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Observation, functions as F

#: Rows of an asset, which is one file written by the driver.
ASSET_ROWS = 100_000


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write JSON lines (UTF-8, nulls kept) and return the number of rows, observed while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return int(seen.get["n"])


def write_csv(df: DataFrame, path: str, *by: str, mark: bool = False) -> None:
    """Write CSV with a header, in folders by the columns ``by``; quotes inside values are doubled.

    :param mark: begin every file with a byte-order mark, as spreadsheets want it (written into the first column's name)."""
    if mark:
        first = next(c for c in df.columns if c not in by)
        df = df.withColumnRenamed(first, "\ufeff" + first)
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_asset(df: DataFrame, path: str, **header: object) -> int:
    """Write a small table as one readable JSON file with ``header`` and ``items``; a table above ASSET_ROWS is refused."""
    rows = [r.asDict(recursive=True) for r in df.limit(ASSET_ROWS + 1).collect()]
    if len(rows) > ASSET_ROWS:
        raise ValueError(f"an asset holds at most {ASSET_ROWS} rows; write a table instead")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump({**header, "count": len(rows), "items": rows}, out, ensure_ascii=False, indent=2, default=str)
    return len(rows)


def write_label_ids(labels: list[str], path: str) -> None:
    """Label numbers in both directions."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump({"label2id": {x: i for i, x in enumerate(labels)}, "id2label": dict(enumerate(labels))}, out, ensure_ascii=False, indent=2)


def append_session(df: DataFrame, path: str) -> None:
    """Append session rows to a table that readers may list by newest first (``streaming.requests.newest``)."""
    df.write.mode("append").parquet(path)
