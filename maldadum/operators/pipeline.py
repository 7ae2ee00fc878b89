"""Correction of request texts: clause, protected spans, profile, rules, phrases, spacing, tagging, candidates, decisions, proposals.

One row per request throughout. Rules and patterns are expressions on the row; dictionaries are joined on token keys, once per distinct token; the candidates of a
request come back to its row by one aggregation on the request key. Where a model would speak (spacing, morphology, language model
scores) its absence has a fixed meaning: no spacing edits, no lemma candidates, no score differences, and the heuristic tagger.

Defined results: a null or empty text gives itself, without spans, edits or proposals other than itself; unknown modes count as inspect; tokens of one character and
those less than half Hangul are kept, as the tagger keeps them (rules and phrases apply to them)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum import adapters, vocab
from maldadum.adapters import Model
from maldadum.functions import features as X, similarity as S, spans as P, text as T
from maldadum.operators import candidates as C, decode as D, ranking as R
from maldadum.operators.rules import EDITS, EDITS_TYPE, scan_rules
from maldadum.session import materialize


def clauses(requests: DataFrame, key: str, text: str, cursor: str, mode: str) -> DataFrame:
    """``key``, ``text``, ``start`` and ``clause``: the clause at the cursor in realtime mode, else the whole text."""
    start, clause = T.clause_at(F.col(text), F.col(cursor))
    real = F.coalesce(F.col(mode) == "realtime", F.lit(False))
    return requests.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), F.when(real, F.coalesce(start, F.lit(0))).otherwise(0).alias("start"), F.when(real, F.coalesce(clause, F.lit(""))).otherwise(F.coalesce(F.col(text), F.lit(""))).alias("clause"))


def phrase_edits(rows: DataFrame, key: str, text: str, guarded: str, memory: DataFrame) -> DataFrame:
    """``rows`` with ``phrase_edits``: the phrases of ``memory`` (``src``, ``dst``, ``confidence``) that stand in the text's tokens outside of ``guarded`` spans, the longest and most
    confident per place, then from left to right without overlap. A row meets the phrases that begin with one of its tokens, then compares them whole."""
    heads = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(vocab.JVM_TOKEN), F.lit(0)))).alias("head"))
    forms = C.with_head(memory.where("src <> dst"), "src", "head").select("head", T.phrase(F.col("src")).alias("form"), "dst", F.col("confidence").cast("double").alias("confidence"))
    met = heads.join(forms, "head").groupBy(key).agg(F.collect_set(F.struct("form", "dst", "confidence")).alias("_known"))
    whole = rows.join(met, key, "left")
    columns = whole.columns
    at, spans = columns.index(text), columns.index(guarded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(vocab.TOKEN).finditer
        for batch in batches:
            found = []
            for said, guard, known in zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist(), batch.column(len(columns) - 1).to_pylist()):
                row: list[dict] = []
                by_head: dict[str, list[tuple]] = {}
                for k in known or ():
                    parts = k["form"].split(" ")
                    by_head.setdefault(parts[0], []).append((-len(parts), -k["confidence"], k["dst"], parts))
                tokens = [(m.group(), m.start(), m.end()) for m in find(said)] if by_head else []
                for i, (head, st, _) in enumerate(tokens):
                    if row and st < row[-1]["ed"]:
                        continue
                    for back, less, dst, parts in sorted(by_head.get(head, ())):
                        place = tokens[i:i - back]
                        ed = place[-1][2]
                        if [t[0] for t in place] == parts and not any(st < g["ed"] and ed > g["st"] for g in guard or ()):
                            row.append({"st": st, "ed": ed, "src": said[st:ed], "dst": dst, "confidence": -less})
                            break
                found.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, EDITS_TYPE)], names=[*columns[:-1], "phrase_edits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[:-1])
    return whole.mapInArrow(run, f"{schema}, phrase_edits {EDITS}")


_LOCK = "array<struct<st:int,ed:int>>"


def precise_spans(edits: Column) -> Column:
    """Spans of edits of at least .96 whose texts have two letters or more: what follows leaves them alone."""
    long = lambda x: F.length(F.trim(x)) >= 2
    return F.transform(F.filter(edits, lambda e: (e["confidence"] >= 0.96) & long(e["src"]) & long(e["dst"])), lambda e: F.struct(e["st"].alias("st"), e["ed"].alias("ed")))


def spaced_edits(rows: DataFrame, text: str, spaced: str, guarded: str, preserved: str | None = None) -> DataFrame:
    """``rows`` with ``spacing_edits``: blanks that ``spaced`` has and the text has not, outside of guarded and inside of no preserved span; blanks are never taken away.

    NORMAL texts (``profile``) gain .03 of confidence; edits of .9 and more stay."""
    score = F.round(F.least(F.lit(0.99), 0.96 + F.when(F.col("profile") == "NORMAL", 0.03).otherwise(0.0)), 4)
    kind = "array<struct<st:int,ed:int,src:string,dst:string,confidence:double>>"
    free = lambda i: ~P.overlaps_any(F.greatest(i - 1, F.lit(0)), F.least(i + 1, F.length(text)), F.col(guarded))
    loose = lambda i: F.lit(True) if preserved is None else ~F.exists(preserved, lambda p: (p["st"] < i) & (i < p["ed"]))
    places = F.filter(P.insertion_points(F.col(text), F.col(spaced)), lambda i: free(i) & loose(i))
    return rows.withColumn("spacing_edits", F.coalesce(F.transform(places, lambda i: F.struct(i.alias("st"), i.alias("ed"), F.lit("").alias("src"), F.lit(" ").alias("dst"), score.alias("confidence"))), F.array()).cast(kind))


def token_candidates(tokens: DataFrame, edges: DataFrame, memory: DataFrame) -> DataFrame:
    """What each distinct token (``tok``) could become without its context: mined edges (:func:`candidates.added_edges`), single-token phrases of ``memory``, spelling patterns,
    stems often mistaken, and what words much like it become. Columns as :func:`candidates.prefilter` takes them, one row per replacement."""
    words = tokens.select("tok").where((F.length("tok") >= 2) & (T.hangul_ratio(F.col("tok")) >= 0.5)).distinct()
    strings, counts = F.array().cast("array<string>"), F.create_map().cast("map<string,bigint>")
    bare = {"kind": F.lit(None).cast("string"), "pos": F.lit(None).cast("string"), "family": strings, "slots": strings, "hints": F.array().cast(C._HINTS), "stats": counts}
    shaped = lambda df: df.select("tok", "dst", "source", F.col("generator").cast("double").alias("generator"), *[F.col(c) if c in df.columns else v.alias(c) for c, v in bare.items()])
    known = edges.unionByName(requests_constants(tokens).select("src", "dst", "source", "generator", *[v.alias(c) for c, v in bare.items()]))
    exact = C.exact(words, known)
    single = C.exact(words, memory.where(~F.contains("src", F.lit(" "))).select("src", "dst", F.lit("PHRASE_MEMORY").alias("source"), F.col("confidence").alias("generator")))
    pattern = words.where(F.col("tok").rlike("께$|께요$|^않|^안됐|^낫")).select("tok", T.each(F.concat(X.pattern_candidates(F.col("tok")), X.stem_candidates(F.col("tok")))).alias("p")).where("p is not null")
    pattern = pattern.select("tok", "p.dst", F.when(F.contains("p.dst", F.lit(" ")), "COMMON_PHRASE_PATTERN").when(F.startswith("tok", F.lit("낫")), "MORPH").otherwise("COMMON_SURFACE_PATTERN").alias("source"), F.col("p.score").alias("generator"))
    near = C.similar(words.where((F.length("tok") >= 2) & (T.hangul_ratio(F.col("tok")) >= 0.7)), known).select("tok", "src", "similarity")
    fallback = near.join(known, "src").where(F.col("dst") != F.col("tok")).withColumns({"source": F.lit("SURFACE_JAMO_FALLBACK"), "generator": S.rounded(F.least(F.lit(0.88), F.greatest(F.lit(0.58), 0.45 * F.col("generator") + 0.45 * F.col("similarity") + 0.08)))})
    every = shaped(exact).unionByName(shaped(single)).unionByName(shaped(pattern)).unionByName(shaped(fallback.withColumns({"family": strings, "slots": strings, "kind": bare["kind"], "pos": bare["pos"]})))
    return C.best_per_replacement(every.where(F.col("dst") != F.col("tok"))).withColumn("support", C.support(F.col("stats")))


def requests_constants(df: DataFrame) -> DataFrame:
    """Replacements given by hand as a table of ``df``'s session."""
    return df.sparkSession.createDataFrame(list(vocab.OPEN_REPLACEMENTS), "src STRING, dst STRING, source STRING, generator DOUBLE")


def correct(requests: DataFrame, edges: DataFrame, rules: list[tuple[str, str, float]] | None = None, key: str = "doc_id", text: str = "text", cursor: str = "cursor_pos", mode: str = "mode", phrases: DataFrame | None = None, spacing: Callable[[], Model] | None = None) -> DataFrame:
    """One row per request: ``key``, ``profile``, ``n_protected``, ``n_rule_edits``, ``n_phrase_edits``, ``n_spacing_edits``, ``final_text`` (rules, phrases and spacing applied), ``suggested_text`` (the best
    proposal), ``proposals``, counts of decisions and the ``decision`` over all of them.

    :param edges: replacements of tokens, as :func:`candidates.added_edges` gives them.
    :param phrases: mined phrases beside those given by hand: ``src``, ``dst``, ``confidence``.
    :param spacing: factory of a model that sets blanks (``adapters.spaced``)."""
    rules = rules if rules is not None else list(vocab.MANUAL_FIXES)
    c = F.col("clause")
    rows = clauses(requests, key, text, cursor, mode).withColumn("spans", P.protected(c)).withColumn("profile", T.profile(P.masked(c, F.col("spans"))))
    rows = scan_rules(rows, "clause", rules, "spans")
    memory = requests.sparkSession.createDataFrame(list(vocab.MANUAL_PHRASES), "src STRING, dst STRING, confidence DOUBLE")
    memory = memory if phrases is None else memory.unionByName(phrases.select("src", "dst", "confidence"))
    ruled = rows.withColumn("ruled", P.applied(c, F.col("edits"))).withColumn("unphrased", P.protected(F.col("ruled")))
    rows = phrase_edits(materialize(ruled, "ruled"), key, "ruled", "unphrased", memory.where(~F.contains("src", F.lit(" "))))
    rows = rows.withColumn("joined", P.applied(F.col("ruled"), F.col("phrase_edits"))).withColumnRenamed("phrase_edits", "first_phrases").drop("ruled", "unphrased").withColumn("unspaced", P.protected(F.col("joined")))
    if spacing is None:
        rows = rows.withColumn("spacing_edits", F.array().cast(EDITS))
    else:
        rows = spaced_edits(adapters.spaced(rows, "joined", "blanks", spacing), "joined", "blanks", "unspaced").drop("blanks")
    rows = rows.withColumn("set", P.applied(F.col("joined"), F.col("spacing_edits"))).drop("joined", "unspaced").withColumn("unnormal", P.protected(F.col("set")))
    rows = phrase_edits(materialize(rows, "spaced"), key, "set", "unnormal", memory)
    locked = F.concat(precise_spans(F.col("edits")), precise_spans(F.col("first_phrases")), precise_spans(F.col("phrase_edits")))
    rows = rows.withColumns({"fixed": P.applied(F.col("set"), F.col("phrase_edits")), "locked": locked.cast(_LOCK)}).drop("set", "unnormal").withColumn("guard", P.protected(F.col("fixed")))
    rows = rows.withColumn("compared", F.transform(X.comparison_spans(F.col("fixed")), lambda t: F.struct(t["st"].alias("st"), t["ed"].alias("ed"))))
    rows = materialize(rows, "clauses")  # read three times below
    group = [key, "st", "ed"]
    tokens = T.explode_tokens(rows, key, "fixed", keep=("guard", "locked", "compared", "profile"), window=3).where((F.length("tok") >= 2) & (T.hangul_ratio(F.col("tok")) >= 0.5))
    kinds = materialize(token_candidates(tokens, edges, memory), "kinds")
    met = tokens.join(kinds, "tok").where(~P.overlaps_any(F.col("st"), F.col("ed"), F.col("guard")) & ~P.overlaps_any(F.col("st"), F.col("ed"), F.col("compared")))
    met = met.withColumns({"channel": F.lit("generic"), "terms": T.context_of(F.col("near"))}).drop("near", "guard", "compared")
    scored = C.prefilter(C.enriched(met).drop("hints", "stats", "terms"), keys=group)
    # the heuristic tagger reopens a token whose best candidate is sure enough, unless what went before has settled its span
    best = F.max(F.when(F.col("rank") == 1, F.struct(F.col("score"), (F.col("source").isin("FAMILY_SEED", "FAMILY_SURFACE_EXAMPLE") & (F.col("context") >= 0.18)).alias("strong")))).over(W.partitionBy(*group))
    opened = scored.withColumn("_best", best).where((F.col("_best.score") >= 0.72) & (~P.overlaps_any(F.col("st"), F.col("ed"), F.col("locked")) | F.col("_best.strong"))).drop("_best", "locked")
    ranked = materialize(R.reranked(R.verified(R.family_prior(opened, group), group), group), "ranked")  # read twice
    keyed = [*group, "profile"]
    found = R.options(ranked, keyed, "tok", F.lit(False), F.col("profile") == "CHAT")
    original = F.max(F.when(F.col("decision") == "KEEP", F.col("replacement")))
    choice = F.struct("rank", "replacement", F.col("option").alias("score"), (F.col("decision") != "KEEP").alias("apply"))
    per_group = found.groupBy(*group).agg(original.alias("original"), F.array_sort(F.collect_list(F.when(F.col("decision") != "REJECT", choice))).alias("o"), F.collect_set(F.when(F.col("decision") != "KEEP", F.col("decision"))).alias("d"), F.count_if(F.col("decision") == "SUGGEST_ONLY").alias("suggested"), F.count_if(F.col("decision") == "REJECT").alias("rejected"))
    shaped = F.struct("st", "ed", "original", F.transform("o", lambda x: x.dropFields("rank")).alias("options"))
    gathered = per_group.groupBy(key).agg(F.array_sort(F.collect_list(shaped)).alias("groups"), F.sum("suggested").alias("n_suggested"), F.sum("rejected").alias("n_rejected"), F.array_distinct(F.flatten(F.collect_set("d"))).alias("decisions"))
    whole = rows.join(gathered, key, "left").withColumn("groups", F.coalesce("groups", F.array().cast(D.GROUPS)))
    decoded = D.decode(whole, key, "fixed", "groups").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "proposal", "score", "n_edits"))).alias("proposals"))
    out = whole.join(decoded, key, "left")
    splice = lambda part: F.concat(F.substring("text", F.lit(1), F.col("start")), part, F.substring(F.col("text"), F.col("start") + F.length("clause") + 1, F.length("text")))
    n = lambda *arrays: sum((F.size(a) for a in arrays[1:]), F.size(arrays[0]))
    return out.select(key, "profile", n("spans").alias("n_protected"), n("edits").alias("n_rule_edits"), n("first_phrases", "phrase_edits").alias("n_phrase_edits"), n("spacing_edits").alias("n_spacing_edits"),
                      splice(F.col("fixed")).alias("final_text"), splice(F.coalesce(F.get("proposals.proposal", F.lit(0)), F.col("fixed"))).alias("suggested_text"), F.coalesce("proposals", F.slice("proposals", 1, 0)).alias("proposals"),
                      F.coalesce("n_suggested", F.lit(0)).cast("bigint").alias("n_suggested"), F.coalesce("n_rejected", F.lit(0)).cast("bigint").alias("n_rejected"), R.overall(F.coalesce("decisions", F.array().cast("array<string>"))).alias("decision"))


def substring_cases(results: DataFrame) -> DataFrame:
    """Pass and fail counts of results (``said``, ``expected``, ``forbidden`` ARRAY<STRING>): all of expected in what was said, nothing of forbidden."""
    ok = F.contains("said", "expected") & ~F.coalesce(F.exists("forbidden", lambda x: F.contains(F.col("said"), x)), F.lit(False))
    return results.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("passed"))
