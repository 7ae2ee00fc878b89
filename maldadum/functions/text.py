"""Tokens with offsets, text clean-up and predicates, as Column expressions that stay in the JVM.

Offsets are half-open and count code points. Null texts give null; empty texts give empty arrays. Folds over arrays copy what they have
gathered so far, so they suit clauses and documents of some thousand tokens; :func:`explode_tokens` takes texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from maldadum import vocab

_TOKENS = "array<struct<tok:string,st:int,ed:int>>"
_NOISE, _HANGUL = regex.compile(r"^[^가-힣A-Za-z0-9]+|[^가-힣A-Za-z0-9]+$"), regex.compile("[가-힣]+")


def tokens(text: Column, pattern: str = vocab.TOKEN) -> Column:
    """``array<struct<tok, st, ed>>`` of tokens that only white space separates (``vocab.TOKEN`` or ``\\S+``)."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(rf"(?U)\s*(?:{pattern})"), F.lit(0)), lambda p: F.struct(F.length(p).alias("n"), F.regexp_replace(p, r"(?U)^\s+", "").alias("tok")))
    grown = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast(_TOKENS).alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(p["tok"].alias("tok"), (acc["at"] + p["n"] - F.length(p["tok"])).alias("st"), (acc["at"] + p["n"]).alias("ed")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.isNotNull(), grown)


def each(values: Column) -> Column:
    """The elements of an array made by a costly expression. A plain explode makes Spark infer a filter that evaluates the array again."""
    return F.explode_outer(values)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(vocab.WORD), F.lit(0))


def explode_tokens(df: DataFrame, key: str, text: str, pattern: str = vocab.TOKEN, keep: Sequence[str] = (), window: int = 0) -> DataFrame:
    """One row per token: ``key``, the columns ``keep``, ``idx``, ``tok``, ``st``, ``ed``; linear in the length of the text, whatever it is.

    :param window: with it also ``near``, the tokens up to so many places before and after."""
    carried = [key, *keep]
    own = [pa.field("idx", pa.int32()), pa.field("tok", pa.string()), pa.field("st", pa.int32()), pa.field("ed", pa.int32()), *([pa.field("near", pa.list_(pa.string()))] if window else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).finditer
        for batch in batches:
            rows: list[tuple] = []
            for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = [(m.group(), m.start(), m.end()) for m in find(t or "")]
                said = [f[0] for f in found] if window else []
                for i, f in enumerate(found):
                    rows.append((k, i, *f, said[max(0, i - window) : i] + said[i + 1 : i + 1 + window]) if window else (k, i, *f))
                    if len(rows) >= 50_000:
                        yield flush(rows, batch)
                        rows = []
            yield flush(rows, batch)

    def flush(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        at, *columns = list(zip(*rows)) or [()] * (1 + len(own))
        where = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*[batch.column(i).take(where) for i in range(len(carried))], *[pa.array(c, f.type) for c, f in zip(columns, own)]], names=[*carried, *[f.name for f in own]])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)
    return df.select(*[F.col(c) for c in carried], F.col(text).alias("_text")).mapInArrow(run, f"{schema}, idx INT, tok STRING, st INT, ed INT{', near ARRAY<STRING>' if window else ''}")


def phrase(text: Column) -> Column:
    """Tokens joined by one space."""
    return F.array_join(F.regexp_extract_all(text, F.lit(vocab.JVM_TOKEN), F.lit(0)), " ")


def collapsed(text: Column) -> Column:
    """Tabs and runs of blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\t\f\x0B ]+", " "))


def strip_noise(token: Column) -> Column:
    """Without what is neither Hangul, Latin letter nor digit at both ends."""
    return F.regexp_replace(token, r"^[^가-힣A-Za-z0-9]+|[^가-힣A-Za-z0-9]+$", "")


def strip_particle(token: Column, particles: Sequence[str] = vocab.PARTICLES) -> Column:
    """The token without noise and, if it is all Hangul, without the first particle of the list that leaves two letters."""
    bare = strip_noise(token)
    out = bare
    for p in reversed(particles):
        out = F.when(F.endswith(bare, F.lit(p)) & (F.length(bare) > len(p) + 1), F.substring(bare, F.lit(1), F.length(bare) - len(p))).otherwise(out)
    return F.when(bare.rlike("^[가-힣]+$"), out).otherwise(bare)


def hangul_ratio(text: Column) -> Column:
    """Share of Hangul syllables, 0 for the empty text."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[^가-힣]", "")), F.length(text)), F.lit(0.0))


def without_space_and_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\p{P}]", "")


def punctuation_only(a: Column, b: Column) -> Column:
    return (a != b) & (without_space_and_punctuation(a) == without_space_and_punctuation(b))


def spacing_only(a: Column, b: Column) -> Column:
    return (a != b) & (F.replace(a, F.lit(" ")) == F.replace(b, F.lit(" ")))


def has_control(text: Column) -> Column:
    return text.rlike(r"\p{C}")


def channel(error_type: Column, source: Column, interface: Column, keyboard: Column) -> Column:
    """How a text was put in: voice, keyboard or generic."""
    e, s, i, k = (F.coalesce(x, F.lit("")) for x in (error_type, source, interface, keyboard))
    return (
        F.when(F.contains(e, F.lit("음성")) | F.startswith(s, F.lit("STT_ENGINE")) | F.contains(F.lower(i), F.lit("voice")), "voice")
        .when((k != "") & (F.lower(k) != "none"), "keyboard")
        .otherwise("generic"))


def context_terms(sentence: Column, target: Column, window: int = 2) -> Column:
    """Terms within ``window`` words of the first place of ``target`` (an equal word, else one that holds it or is held by it): at least two
    letters long and with Hangul."""
    all_words, bare = words(sentence), strip_noise(target)
    exact = F.array_position(all_words, bare)
    held = F.array_position(F.transform(all_words, lambda w: F.contains(w, bare) | F.contains(bare, w)), F.lit(True))
    at = F.when(exact > 0, exact).otherwise(held).cast("int")
    near = F.filter(all_words, lambda w, i: (i + 1 >= at - window) & (i + 1 <= at + window) & (i + 1 != at) & (F.length(w) >= 2) & w.rlike("[가-힣]"))
    return F.when((at > 0) & (bare != ""), near).otherwise(F.array().cast("array<string>"))


def context_of(near: Column) -> Column:
    """Context terms of neighbouring tokens: without particles, at least two letters long and half Hangul."""
    return F.filter(F.transform(near, lambda w: strip_particle(w)), lambda w: (F.length(w) >= 2) & (hangul_ratio(w) >= 0.5))


def near_words(tokens: Column, window: int = 3) -> Column:
    """``array<struct<tok, terms>>``: each token of an array with the context terms within ``window`` tokens of it. Every token loses its particle once, however many
    it stands near; linear in the number of tokens."""
    bare = F.transform(tokens, lambda w: strip_particle(w))
    term = lambda w: F.when((F.length(w) >= 2) & (hangul_ratio(w) >= 0.5), w)
    # bound in a struct of its own, as an expression inside a lambda is evaluated for every element
    once = F.array(F.struct(tokens.alias("t"), F.transform(bare, term).alias("b")))

    def around(s: Column) -> Column:
        def one(tok: Column, i: Column) -> Column:
            first = F.greatest(i + 1 - window, F.lit(1))
            return F.struct(tok.alias("tok"), F.array_compact(F.concat(F.slice(s["b"], first, i + 1 - first), F.slice(s["b"], i + 2, F.lit(window)))).alias("terms"))

        return F.transform(s["t"], one)

    return F.when(tokens.isNotNull(), F.get(F.transform(once, around), F.lit(0)))


def _term(token: str) -> str:
    """The context term that a token makes, as :func:`context_of` has it, or ''."""
    bare = _NOISE.sub("", token)
    if _HANGUL.fullmatch(bare):
        bare = next((bare[: -len(p)] for p in vocab.PARTICLES if bare.endswith(p) and len(bare) > len(p) + 1), bare)
    return bare if len(bare) >= 2 and 2 * sum("가" <= c <= "힣" for c in bare) >= len(bare) else ""


def explode_near_words(df: DataFrame, text: str, window: int = 3) -> DataFrame:
    """One row per token: ``tok`` and ``terms``, those of :func:`near_words` joined by blanks. In Python, where a worker remembers the term of a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = regex.compile(vocab.TOKEN).findall, {}
        for batch in batches:
            toks: list[str] = []
            near: list[str] = []
            for t in batch.column(0).to_pylist():
                found = find(t or "")
                if len(known) > 1_000_000:
                    known.clear()
                for w in found:
                    if w not in known:
                        known[w] = _term(w)
                bare = [known[w] for w in found]
                toks += found
                near += [" ".join(filter(None, bare[max(0, i - window) : i] + bare[i + 1 : i + 1 + window])) for i in range(len(bare))]
                if len(toks) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(toks, pa.string()), pa.array(near, pa.string())], names=["tok", "terms"])
                    toks, near = [], []
            yield pa.RecordBatch.from_arrays([pa.array(toks, pa.string()), pa.array(near, pa.string())], names=["tok", "terms"])

    return df.select(text).mapInArrow(run, "tok STRING, terms STRING")


def span_terms(sentence: Column, target: Column, window: int = 3) -> Column:
    """Context terms as in :func:`near_words` around the first token of the sentence that equals ``target`` without noise; none without one."""
    toks = F.regexp_extract_all(sentence, F.lit(vocab.JVM_TOKEN), F.lit(0))
    at = F.array_position(toks, strip_noise(target)).cast("int")
    first = F.greatest(at - window, F.lit(1))
    near = F.concat(F.slice(toks, first, at - first), F.slice(toks, at + 1, F.lit(window)))
    return F.when(at > 0, context_of(near)).otherwise(F.array().cast("array<string>"))


def stem(lemma: Column) -> Column:
    """The lemma without a final 다."""
    return F.when(F.endswith(lemma, F.lit("다")), F.substring(lemma, F.lit(1), F.length(lemma) - 1)).otherwise(lemma)


def coarse_pos(tag: Column) -> Column:
    return F.substring_index(tag, "-", 1)


def clause_at(text: Column, cursor: Column, limit: int = 128) -> tuple[Column, Column]:
    """(start, clause): from the last clause end before the cursor up to the cursor, at most ``limit`` characters of it.

    A clause end right before the cursor closes the clause that is meant; a null cursor stands at the end."""
    at = F.greatest(F.lit(0), F.least(F.coalesce(cursor, F.length(text)), F.length(text)))
    before = F.substring(text, F.lit(1), at)
    body = F.when(F.substring(before, -1, 1).rlike(r"[\n.?!,;]"), F.substring(before, F.lit(1), F.length(before) - 1)).otherwise(before)
    tail = F.regexp_extract(body, r"[^\n.?!,;]*$", 0)
    start = F.greatest(F.length(body) - F.length(tail), at - limit)
    return start, F.substring(text, start + 1, at - start)


def profile(text: Column) -> Column:
    """MIXED (many Latin letters or digits), CHAT, QUERY (little Hangul), NOISY (long without a blank) or NORMAL, in this order."""
    share = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]", "")) / F.greatest(F.length(text), F.lit(1))
    return (F.when((share("A-Za-z") > 0.3) | (share("0-9") > 0.25), "MIXED").when(text.rlike("[ㅋㅎㅠ]{2,}|[!?]{2,}"), "CHAT").when(share("가-힣") < 0.35, "QUERY")
            .when(~F.contains(text, F.lit(" ")) & (F.length(text) > 12), "NOISY").otherwise("NORMAL"))


def drop_repeats(text: Column) -> Column:
    """Without consecutive repeats of a word and without characters outside the usual set."""
    parts = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^가-힣ㄱ-ㅎㅏ-ㅣA-Za-z0-9\s.,!?~'\"()%:/-]", ""), r"\s+", " ")), " ")
    return F.array_join(F.filter(parts, lambda w, i: (i == 0) | (w != F.get(parts, i - 1))), " ")
