"""Sentence proposals: the best combinations of one option per span, by beam search inside each sentence.

A sentence's groups travel in one array on its row, so decoding needs no shuffle beyond the one that gathered them; a sentence has few spans.

Defined results: a sentence without groups proposes itself with score .99; null text counts as empty; groups that overlap a span already
decided are passed over; equal texts are proposed once with the best score; ties go to fewer edits, then to the smaller text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GROUPS = "array<struct<st:int,ed:int,original:string,options:array<struct<replacement:string,score:double,apply:boolean>>>>"
_PENALTY, _KEEP = 0.04, 0.2


def proposals(text: str, groups: list[dict], width: int = 8, top: int = 3) -> list[tuple[str, float, float, int]]:
    """(text, score, raw score, edits) of the best combinations."""
    if not groups:
        return [(text, 0.99, 0.99, 0)]
    beams: list[tuple[float, tuple[tuple[int, int, str, bool], ...]]] = [(0.0, ())]
    groups = sorted(groups, key=lambda g: (g["st"], g["ed"]))
    for g in groups:
        options = g["options"] or [{"replacement": g["original"], "score": _KEEP, "apply": False}]
        grown: dict[tuple, tuple[float, tuple]] = {}
        for raw, chosen in beams:
            if any(g["st"] < b and a < g["ed"] for a, b, _, _ in chosen):
                follow = [(raw, chosen)]
            else:
                edits = sum(c[3] for c in chosen)
                follow = [(round(raw + o["score"] - (_PENALTY if o["apply"] and edits else 0.0), 4), (*chosen, (g["st"], g["ed"], o["replacement"], bool(o["apply"])))) for o in options]
            for beam in follow:
                mark = tuple(sorted((c[0], c[2]) for c in beam[1]))
                if mark not in grown or beam[0] > grown[mark][0]:
                    grown[mark] = beam
        beams = sorted(grown.values(), key=lambda b: (-b[0], sum(c[3] for c in b[1]), b[1]))[:width]
    low, high = _KEEP * len(groups), 0.99 * len(groups)
    best: dict[str, tuple[str, float, float, int]] = {}
    for raw, chosen in beams:
        out, at = [], 0
        for a, b, replacement, apply in sorted(chosen):
            if apply:
                out += [text[at:a], replacement]
                at = b
        said = "".join(out) + text[at:]
        score = round(min(0.99, 0.15 + 0.84 * max(0.0, min(1.0, (raw - low) / (high - low)))), 4)
        if said not in best or raw > best[said][2]:
            best[said] = (said, score, raw, sum(c[3] for c in chosen))
    return sorted(best.values(), key=lambda p: (-p[2], p[3], p[0]))[:top]


def decode(df: DataFrame, key: str, text: str, groups: str, width: int = 8, top: int = 3) -> DataFrame:
    """``key``, ``rank``, ``proposal``, ``score``, ``raw_score``, ``n_edits`` of each row's best proposals; ``groups`` as ``GROUPS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i + 1, *p) for k, t, g in zip(*(c.to_pylist() for c in batch.columns)) for i, p in enumerate(proposals(t or "", g or [], width, top))]
            columns = list(zip(*rows)) or [()] * 6
            types = (batch.schema.types[0], pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "rank", "proposal", "score", "raw_score", "n_edits"])

    return df.select(F.col(key), F.col(text), F.col(groups).cast(GROUPS)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, rank INT, proposal STRING, score DOUBLE, raw_score DOUBLE, n_edits INT")


def merged_proposals(first: DataFrame, second: DataFrame, key: str, top: int = 3) -> DataFrame:
    """Proposals of two origins, one per text with the best raw score, the best ``top`` per row."""
    from pyspark.sql import Window as W

    both = first.unionByName(second).groupBy(key, "proposal").agg(F.max("raw_score").alias("raw_score"), F.max_by("score", "raw_score").alias("score"), F.min_by("n_edits", F.struct(-F.col("raw_score"), "n_edits")).alias("n_edits"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("raw_score"), "n_edits", "proposal"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top)
