"""Literal rewrite rules over texts, by one automaton for all rules.

An Aho-Corasick automaton finds all places of all rules in one pass over a text, however many rules there are. Of one rule's places those that
overlap its last one are passed over; places that touch a guarded span are left out; then edits are chosen greedily by (start, longest,
most confident), each beginning at or after the end of the last one.

Defined results: null and empty texts have no edits; rules with an empty text are refused; of rules with equal texts all replacements
compete; the rules, at most MAX_RULES, are held by the driver and every task."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_RULES = 1_000_000
EDITS = "array<struct<st:int,ed:int,src:string,dst:string,confidence:double>>"
EDITS_TYPE = pa.list_(pa.struct([("st", pa.int32()), ("ed", pa.int32()), ("src", pa.string()), ("dst", pa.string()), ("confidence", pa.float64())]))


def _automaton(rules: Sequence[tuple[str, str, float]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    targets: dict[str, list[tuple[str, float]]] = {}
    for src, dst, confidence in rules:
        targets.setdefault(src, []).append((dst, confidence))
    for src, to in targets.items():
        found.add_word(src, (src, to))
    if targets:
        found.make_automaton()
    return found if targets else None


def choose(text: str, automaton, guarded: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int, str, str, float]]:
    """The edits of one text; ``guarded`` are disjoint spans in order."""
    starts, ends = [g[0] for g in guarded], [g[1] for g in guarded]
    last: dict[str, int] = {}
    places = []
    for end, (src, to) in automaton.iter(text):
        st, ed = end + 1 - len(src), end + 1
        if st < last.get(src, 0):
            continue
        last[src] = ed
        at = bisect_right(ends, st)
        if at < len(starts) and starts[at] < ed:
            continue
        places += [(st, -ed, -confidence, dst, src) for dst, confidence in to]
    kept: list[tuple[int, int, str, str, float]] = []
    for st, back, less, dst, src in sorted(places):
        if not kept or st >= kept[-1][1]:
            kept.append((st, -back, src, dst, -less))
    return kept


def scan_rules(df: DataFrame, text: str, rules: Sequence[tuple[str, str, float]], guarded: str | None = None) -> DataFrame:
    """``df`` with ``edits``; ``guarded`` names a column of spans (``array<struct<st, ed, ...>>``)."""
    if len(rules) > MAX_RULES or any(not r[0] for r in rules):
        raise ValueError(f"at most {MAX_RULES} rules, none of them empty")
    columns = df.columns
    at, spans = columns.index(text), columns.index(guarded) if guarded else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            guards = batch.column(spans).to_pylist() if guarded else [None] * len(texts)
            edits = [choose(t, automaton, [(g["st"], g["ed"]) for g in s or ()]) if t and automaton else [] for t, s in zip(texts, guards)]
            shaped = [[dict(zip(("st", "ed", "src", "dst", "confidence"), e)) for e in row] for row in edits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shaped, EDITS_TYPE)], names=[*columns, "edits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, f"{schema}, edits {EDITS}")
