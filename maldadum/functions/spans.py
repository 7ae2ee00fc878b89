"""Spans in texts and edits on them, as folds over arrays in the JVM.

A span is ``struct<st, ed, ...>``, half-open, in code points. Empty or null texts have no spans."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from maldadum import vocab

_SPAN = "array<struct<st:int,ed:int,kind:string,text:string>>"
_EDIT = "array<struct<st:int,ed:int,src:string,dst:string,confidence:double>>"


def find_all(text: Column, pattern: str, kind: str, sign: str | None = None) -> Column:
    """All matches of a pattern from left to right, with offsets: what is between matches and the matches themselves add up to the text.

    :param sign: a string that every match holds; texts without it are passed over before any pattern is tried."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    placed = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),  # one gap more than hits
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda acc, z: F.when(z["hit"].isNull(), acc).otherwise(F.struct(
            (acc["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(z["gap"])).alias("st"), (acc["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("ed"), F.lit(kind).alias("kind"), z["hit"].alias("text")))).alias("out"))),
        lambda acc: acc["out"])
    some = F.contains(text, F.lit(sign)) if sign else text != ""
    return F.when(some, placed).otherwise(F.array().cast(_SPAN))


def find_literal(text: Column, literal: str, kind: str) -> Column:
    return find_all(text, r"\Q" + literal + r"\E" if "\\E" not in literal else re.escape(literal), kind, literal)


def merged(spans: Column, text: Column) -> Column:
    """Sorted by (start, end); overlapping spans become one of the first one's kind, touching ones stay apart."""
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(last(acc)["ed"], s["ed"])
        grown = F.struct(last(acc)["st"].alias("st"), end.alias("ed"), last(acc)["kind"].alias("kind"), F.substring(text, last(acc)["st"] + 1, end - last(acc)["st"]).alias("text"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["st"] >= last(acc)["ed"], F.concat(acc, F.array(s))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPAN), step)


def protected(text: Column) -> Column:
    """Spans that no edit may touch."""
    sign = {"URL": "http", "EMAIL": "@", "MENTION": "@", "PHONE": "-", "HASHTAG": "#"}
    scans = [find_all(text, pattern, kind, sign.get(kind)) for kind, pattern in vocab.PROTECTED_PATTERNS]
    scans += [find_literal(text, term, "ENTITY") for term in vocab.ENTITIES] + [find_literal(text, term, "USER_DICT") for term in vocab.USER_TERMS]
    return merged(F.concat(*scans), text)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``__KIND_i__``."""
    folded = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("cur"), F.lit("").alias("out"), F.lit(0).alias("i")),
        lambda acc, s: F.struct(s["ed"].alias("cur"), F.concat(acc["out"], F.substring(text, acc["cur"] + 1, s["st"] - acc["cur"]), F.lit("__"), s["kind"], F.lit("_"), acc["i"].cast("string"), F.lit("__")).alias("out"), (acc["i"] + 1).alias("i")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["cur"] + 1, F.length(text))))
    return F.when(text.isNotNull(), folded)


def overlaps_any(st: Column, ed: Column, spans: Column) -> Column:
    return F.exists(spans, lambda p: (st < p["ed"]) & (ed > p["st"]))


def rule_edits(text: Column, rules: list[tuple[str, str, float]], spans: Column | None = None) -> Column:
    """Edits of literal rules (from, to, confidence) wherever they occur, outside of ``spans``, one per (start, end, replacement)."""
    found = []
    for src, dst, confidence in rules:
        found.append(F.transform(find_literal(text, src, "RULE"), lambda s: F.struct(s["st"].alias("st"), s["ed"].alias("ed"), s["text"].alias("src"), F.lit(dst).alias("dst"), F.lit(confidence).alias("confidence"))))
    edits = F.array_distinct(F.concat(*found))
    return F.filter(edits, lambda e: ~overlaps_any(e["st"], e["ed"], spans)) if spans is not None else edits


def non_overlapping(edits: Column) -> Column:
    """Greedy choice by (start, longest, most confident): an edit is kept if it begins at or after the end of the last one kept."""
    ordered = F.transform(
        F.array_sort(F.transform(edits, lambda e: F.struct(e["st"].alias("st"), (-e["ed"]).alias("back"), (-e["confidence"]).alias("less"), e["dst"].alias("dst"), e["src"].alias("src")))),
        lambda e: F.struct(e["st"].alias("st"), (-e["back"]).alias("ed"), e["src"].alias("src"), e["dst"].alias("dst"), (-e["less"]).alias("confidence")))
    return F.aggregate(ordered, F.array().cast(_EDIT), lambda acc, e: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["ed"] <= e["st"]), F.concat(acc, F.array(e))).otherwise(acc))


def applied(text: Column, edits: Column) -> Column:
    """The text with sorted, disjoint edits spliced in."""
    folded = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("cur"), F.lit("").alias("out")),
        lambda acc, e: F.struct(e["ed"].alias("cur"), F.concat(acc["out"], F.substring(text, acc["cur"] + 1, e["st"] - acc["cur"]), e["dst"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["cur"] + 1, F.length(text))))
    return F.when(text.isNotNull(), folded)


def insertion_points(text: Column, spaced: Column) -> Column:
    """Places of ``text`` before which ``spaced`` has a blank that ``text`` has not, if they differ in blanks only; else no places."""
    state = "struct<i:int,out:array<int>>"
    walked = F.aggregate(
        F.split(spaced, ""),
        F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("out")).cast(state),
        lambda acc, ch: F.when(ch == F.substring(text, acc["i"] + 1, F.lit(1)), F.struct((acc["i"] + 1).alias("i"), acc["out"].alias("out")))
        .when(ch == " ", F.struct(acc["i"].alias("i"), F.concat(acc["out"], F.array(acc["i"])).alias("out")))
        .otherwise(F.struct((acc["i"] + F.when(F.substring(text, acc["i"] + 1, F.lit(1)) == " ", 2).otherwise(1)).cast("int").alias("i"), acc["out"].alias("out"))),
        lambda acc: acc["out"])
    return F.when(F.replace(text, F.lit(" ")) == F.replace(spaced, F.lit(" ")), walked).otherwise(F.array().cast("array<int>"))
