"""Pieces of DuckDB SQL that say what the Column functions say."""

from __future__ import annotations

from maldadum import vocab


def one_per_id(*columns: str) -> str:
    return f"SELECT {', '.join(('id', *columns))} FROM corpus_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY rec_no) = 1"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[가-힣A-Za-z0-9]+')"


#: White space, inside a class.
SPACE = r"\s\x0B\x{85}\p{Z}"


def all_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[가-힣A-Za-z0-9]+|[^{SPACE}]')"


def strip_noise(x: str) -> str:
    return f"regexp_replace({x}, '^[^가-힣A-Za-z0-9]+|[^가-힣A-Za-z0-9]+$', '', 'g')"


def channel(p: str = "") -> str:
    return f"""CASE WHEN contains(coalesce({p}error_type, ''), '음성') OR starts_with(coalesce({p}source, ''), 'STT_ENGINE') OR contains(lower(coalesce({p}interface, '')), 'voice') THEN 'voice'
        WHEN coalesce({p}keyboard, '') <> '' AND lower({p}keyboard) <> 'none' THEN 'keyboard' ELSE 'generic' END"""


def edits(a: str, b: str) -> str:
    """Edit distance of characters: levenshtein counts bytes, so each distinct character is first written as one of its own."""

    def coded(x: str) -> str:
        return f"coalesce(list_aggregate(list_transform(string_split({x}, ''), lambda ch: chr((47 + strpos({a} || {b}, ch))::INT)), 'string_agg', ''), '')"

    return f"levenshtein({coded(a)}, {coded(b)})"


def prefix(a: str, b: str) -> str:
    return f"(len(list_filter(range(0, least(length({a}), length({b})) + 1), lambda i: left({a}, i::INT) = left({b}, i::INT))) - 1)"


def suffix(a: str, b: str) -> str:
    p = prefix(a, b)
    return f"(len(list_filter(range(0, least(length({a}), length({b})) - {p} + 1), lambda i: right({a}, i::INT) = right({b}, i::INT))) - 1)"


def preserved(a: str, b: str) -> str:
    return f"(({prefix(a, b)} + {suffix(a, b)}) / greatest(length({a}), length({b})))"


def strip_particle(x: str) -> str:
    bare = strip_noise(x)
    cases = " ".join(f"WHEN ends_with({bare}, '{p}') AND length({bare}) > {len(p) + 1} THEN left({bare}, length({bare}) - {len(p)})" for p in vocab.PARTICLES)
    return f"(CASE WHEN NOT regexp_full_match({bare}, '[가-힣]+') THEN {bare} {cases} ELSE {bare} END)"


def near_terms(toks: str, at: str, window: int = 3) -> str:
    """Context terms of the token at the 1-based place ``at`` of a list of tokens."""
    near = f"list_concat({toks}[greatest({at} - {window}, 1):{at} - 1], {toks}[{at} + 1:{at} + {window}])"
    return f"list_filter(list_transform({near}, lambda w: {strip_particle('w')}), lambda v: length(v) >= 2 AND length(regexp_replace(v, '[^가-힣]', '', 'g')) >= 0.5 * length(v))"


def hint_score(terms: str, hints: str) -> str:
    """Of a list of terms and a list of hints {term, count}: the first term that meets a hint counts equal hints, else those that one begins the other; later ones equal hints only."""
    total = lambda some: f"coalesce(list_sum(list_transform({some}, lambda g: g.count)), 0)"
    values = f"list_transform({terms}, lambda t: {{'e': {total(f'list_filter({hints}, lambda h: h.term = t)')}, 'p': {total(f'list_filter({hints}, lambda h: starts_with(t, h.term) OR starts_with(h.term, t))')}}})"
    met = "coalesce(list_position(list_transform(vs, lambda v: v.e > 0 OR v.p > 0), true), 0)"
    return f"""(SELECT coalesce(round(least(1.0::DOUBLE, (CASE WHEN j = 0 THEN 0 ELSE CASE WHEN vs[j].e > 0 THEN vs[j].e ELSE vs[j].p END + coalesce(list_sum(list_transform(vs[j + 1:], lambda v: v.e)), 0) END)::DOUBLE / greatest({total(hints)}, 1)), 4), 0.0::DOUBLE)
        FROM (SELECT vs, {met} AS j FROM (SELECT {values} AS vs)))"""


def typo(a: str, b: str) -> str:
    p, s = prefix(a, b), suffix(a, b)
    ch = lambda x: f"unicode({x}[({p} + i)::INT])"
    inside = " AND ".join(f"{ch(x)} BETWEEN 44032 AND 55203" for x in (a, b))
    part = lambda f: f"({f(ch(a))} = {f(ch(b))})::INT"
    letters = f"({part(lambda c: f'(({c} - 44032) // 588)')} + {part(lambda c: f'((({c} - 44032) % 588) // 28)')} + {part(lambda c: f'(({c} - 44032) % 28)')}) / 3.0::DOUBLE"
    wa, wb = f"(length({a}) - {p} - {s})", f"(length({b}) - {p} - {s})"
    total = f"list_sum(list_transform(range(1, least({wa}, {wb}) + 1), lambda i: CASE WHEN {a}[({p} + i)::INT] = {b}[({p} + i)::INT] THEN 1.0::DOUBLE WHEN {inside} THEN {letters} ELSE 0.0::DOUBLE END))"
    core = f"CASE WHEN least({wa}, {wb}) < 1 THEN 0.0::DOUBLE ELSE {total} / greatest({wa}, {wb}) END"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE round(0.55::DOUBLE * {preserved(a, b)} + 0.45::DOUBLE * {core}, 4) END"
