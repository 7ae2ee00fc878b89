"""Similarities of short strings as Column expressions; nulls give null."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from maldadum.functions.text import phrase, strip_noise


def _both(a: Column, b: Column, value: Column) -> Column:
    """``value`` where neither side is null; least and greatest pass over nulls."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def shared_prefix(a: Column, b: Column) -> Column:
    shorter = F.least(F.length(a), F.length(b))
    return F.size(F.filter(F.sequence(F.lit(0), shorter), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))) - 1


def shared_suffix(a: Column, b: Column, prefix: Column) -> Column:
    """Length of the common end that does not reach into the common prefix."""
    room = F.least(F.length(a), F.length(b)) - prefix
    end = lambda x, n: F.substring(x, F.length(x) - n + 1, n)
    return F.size(F.filter(F.sequence(F.lit(0), room), lambda n: end(a, n) == end(b, n))) - 1


def preserved(a: Column, b: Column) -> Column:
    """Share of the longer string that common prefix and suffix keep; 1 if equal, 0 if either is empty."""
    p = shared_prefix(a, b)
    kept = (p + shared_suffix(a, b, p)) / F.greatest(F.length(a), F.length(b))
    return _both(a, b, F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(kept))


def edit_share(a: Column, b: Column) -> Column:
    """1 less edits by the longer length, not below 0."""
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def surface_similarity(a: Column, b: Column) -> Column:
    """Kept ends and edits together, on strings without noise."""
    x, y = strip_noise(a), strip_noise(b)
    return _both(a, b, F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.round(0.55 * preserved(x, y) + 0.45 * edit_share(x, y), 4)))


def phrase_similarity(a: Column, b: Column) -> Column:
    x, y = F.replace(phrase(a), F.lit(" ")), F.replace(phrase(b), F.lit(" "))
    return _both(a, b, F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(F.round(edit_share(x, y), 4)))


def syllable_parts(ch: Column) -> Column:
    """``struct<initial, medial, final>`` of a Hangul syllable, else null."""
    code = F.ascii(ch) - 0xAC00
    parts = F.struct(F.floor(code / 588).cast("int").alias("initial"), F.floor(F.pmod(code, F.lit(588)) / 28).cast("int").alias("medial"), F.pmod(code, F.lit(28)).cast("int").alias("final"))
    return F.when((code >= 0) & (code < 11172), parts)


def char_similarity(a: Column, b: Column) -> Column:
    """1 if equal, else the share of equal letters of two syllables, 0 if either is no syllable."""
    x, y = F.ascii(a) - 0xAC00, F.ascii(b) - 0xAC00
    inside = (x >= 0) & (x < 11172) & (y >= 0) & (y < 11172)
    letters = lambda n: (F.floor(n / 588), F.floor(F.pmod(n, F.lit(588)) / 28), F.pmod(n, F.lit(28)))
    same = sum(((p == q).cast("int") for p, q in zip(letters(x), letters(y))), F.lit(0))
    return F.when(a == b, 1.0).when(inside, same / 3.0).otherwise(0.0)


def typo_similarity(a: Column, b: Column) -> Column:
    """.55 of the kept ends and .45 of the mean similarity of the characters between them, place by place."""
    p = shared_prefix(a, b)
    s = shared_suffix(a, b, p)
    wa, wb = F.length(a) - p - s, F.length(b) - p - s
    wide = F.greatest(wa, wb)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(wa, wb), F.lit(1))), F.lit(0.0), lambda acc, i: acc + char_similarity(F.substring(a, p + i, F.lit(1)), F.substring(b, p + i, F.lit(1))))
    core = F.when((wa < 1) | (wb < 1), 0.0).otherwise(total / wide)
    kept = (p + s) / F.greatest(F.length(a), F.length(b))
    return _both(a, b, F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.round(0.55 * kept + 0.45 * core, 4)))


@F.pandas_udf(T.DoubleType())
def matcher_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity, which no built-in expresses; null where either side is null."""
    known: dict[tuple[str, str], float] = {}
    for left, right in pairs:
        out = []
        for a, b in zip(left, right):
            if a is None or b is None:
                out.append(None)
                continue
            if (a, b) not in known:
                if len(known) > 100_000:
                    known.clear()
                known[a, b] = SequenceMatcher(None, a, b).ratio()
            out.append(known[a, b])
        yield pd.Series(out, dtype="float64")


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("st", "ed", "to_st", "to_ed")]))
def change_hull(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Hull of all differing blocks of two strings, on either side; -1 where nothing differs or a side is null."""
    out = []
    for a, b in zip(left, right):
        blocks = [] if a is None or b is None else [o for o in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
        out.append((min(o[1] for o in blocks), max(o[2] for o in blocks), min(o[3] for o in blocks), max(o[4] for o in blocks)) if blocks else (-1, -1, -1, -1))
    return pd.DataFrame(out, columns=["st", "ed", "to_st", "to_ed"])


def score_from_frequency(frequency: Column, similarity: Column) -> Column:
    return F.round(F.least(F.lit(0.985), 0.5 + F.log1p(frequency) / 12 + 0.28 * similarity), 4)


def fix_confidence(count: Column, similarity: Column) -> Column:
    return F.round(F.least(F.lit(0.995), 0.9 + F.least(F.lit(0.09), count / 2000) + F.greatest(F.lit(0.0), similarity - 0.8) * 0.2), 4)


def phrase_confidence(frequency: Column, similarity: Column) -> Column:
    return F.round(F.least(F.lit(0.995), 0.9 + 0.03 * F.least(frequency, F.lit(5)) + 0.05 * similarity), 4)


def rounded(x: Column, places: int = 4) -> Column:
    """Rounded half up, of what is left of a double after ten places, so that sums in another order give the same."""
    return F.round(F.round(x, 10), places)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def unit_score(x: Column) -> Column:
    """A score within [0, 1] as it is, any other through a flat sigmoid."""
    return F.when((x >= 0) & (x <= 1), x).otherwise(sigmoid(x / 4))


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
