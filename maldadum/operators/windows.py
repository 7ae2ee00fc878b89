"""Windows around labelled runs, and proposals that a generator makes for them.

A window is a run of open replacements, at most three tokens, with three tokens of context. A generated window is put back into its sentence if it looks like text, keeps what is
protected, changes something at the run, and does not change too much.

Defined results: sentences without a run have no window; a generator that says nothing or the window itself proposes nothing; equal texts are proposed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum.functions import features as X, similarity as S, spans as P

_SPAN = "array<struct<st:int,ed:int>>"


def projected(spans: Column, start: Column, end: Column) -> Column:
    """Spans cut to a window and counted from its beginning."""
    inside = F.filter(spans, lambda s: (s["st"] < end) & (s["ed"] > start))
    return F.transform(inside, lambda s: F.struct((F.greatest(s["st"], start) - start).cast("int").alias("st"), (F.least(s["ed"], end) - start).cast("int").alias("ed"))).cast(_SPAN)


def touches(change: Column, span: Column, margin: int = 2) -> Column:
    """Whether a change (``st``, ``ed``) overlaps a span widened by ``margin``; an insertion must lie within or at its borders."""
    start, end = F.greatest(F.lit(0), span["st"] - margin), span["ed"] + margin
    return F.when(change["st"] == change["ed"], (start <= change["st"]) & (change["st"] <= end)).otherwise((change["st"] < end) & (change["ed"] > start))


def odd_characters(text: Column) -> Column:
    """Whether a text holds a character that no correction would bring in."""
    return text.rlike(r"[^가-힣A-Za-z0-9\s.,!?~:;'\"()\[\]{}<>/%+-]")


def texts_kept(original: Column, generated: Column, spans: Column) -> Column:
    """Whether the generated text still holds the text of every span of the original that is not blank."""
    said = lambda s: F.substring(original, s["st"] + 1, s["ed"] - s["st"])
    return F.coalesce(F.forall(spans, lambda s: (F.trim(said(s)) == "") | F.contains(generated, said(s))), F.lit(True))


def replace_windows(rows: DataFrame, key: str, text: str, context: int = 3, most: int = 3) -> DataFrame:
    """Windows of examples (``labels``, ``token_offsets``): ``key``, ``text``, ``window_no``, ``window`` and ``span`` (places in the text) and ``local`` (the span in the window), ``window_text``.

    Runs longer than ``most`` tokens are cut from their beginning. All inside the row's arrays."""
    n = F.size("labels")
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("labels"), i) == "OPEN_REPLACE")
    kind = "array<struct<first:int,last:int>>"
    last = lambda acc: F.element_at(acc, -1)
    runs = F.aggregate(at, F.array().cast(kind), lambda acc, i: F.when((F.size(acc) > 0) & (last(acc)["last"] == i - 1) & (i - last(acc)["first"] < most), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), i.alias("last"))))).otherwise(F.concat(acc, F.array(F.struct(i.alias("first"), i.alias("last"))))))
    each = rows.where(n > 0).select(key, F.col(text).alias("text"), "token_offsets", n.alias("_n"), F.posexplode(runs).alias("window_no", "r"))
    edge = lambda i, side: F.get(F.get("token_offsets", i), F.lit(side))
    first, end = F.greatest(F.col("r.first") - context, F.lit(0)), F.least(F.col("r.last") + context, F.col("_n") - 1)
    cut = each.select(key, "text", "window_no", F.struct(edge(first, 0).alias("st"), edge(end, 1).alias("ed")).alias("window"), F.struct(edge(F.col("r.first"), 0).alias("st"), edge(F.col("r.last"), 1).alias("ed")).alias("span"))
    local = F.struct((F.col("span.st") - F.col("window.st")).alias("st"), (F.col("span.ed") - F.col("window.st")).alias("ed"))
    return cut.withColumns({"local": local, "window_text": F.substring(F.col("text"), F.col("window.st") + 1, F.col("window.ed") - F.col("window.st"))})


def window_proposals(windows: DataFrame, key: str, generated: str, top: int = 3) -> DataFrame:
    """Whole-sentence proposals of generated windows (``array<struct<text, score>>`` per row of :func:`replace_windows`): ``key``, ``proposal``, ``score``, ``raw_score``, ``edit_ratio``,
    ``typo``, ``rank``; the best ``top`` per sentence. What is protected in the sentence stays."""
    each = windows.withColumn("guard", P.protected(F.col("text"))).select(key, "text", "window", "local", "window_text", "guard", F.explode(generated).alias("g")).withColumn("said", F.trim("g.text"))
    w = F.col("window_text")
    plausible = each.where((F.col("said") != "") & (F.col("said") != w) & ~odd_characters(F.col("said")) & texts_kept(w, F.col("said"), projected(F.col("guard"), F.col("window.st"), F.col("window.ed"))))
    changed = plausible.withColumn("change", S.change_hull("window_text", "said")).where((F.col("change.st") >= 0) & touches(F.col("change"), F.col("local")))
    whole = changed.withColumn("proposal", F.concat(F.substring("text", F.lit(1), F.col("window.st")), F.col("said"), F.substring(F.col("text"), F.col("window.ed") + 1, F.length("text"))))
    t, p = F.col("text"), F.col("proposal")
    kept = whole.where((p != t) & ~odd_characters(p) & texts_kept(t, p, F.col("guard"))).withColumns({"edit_ratio": X.edit_ratio(t, p), "typo": S.typo_similarity(t, p)}).where((F.col("edit_ratio") <= 0.35) & (F.col("typo") >= 0.55))
    raw = 0.32 + 0.36 * S.sigmoid(F.coalesce("g.score", F.lit(-1.5))) + 0.26 * F.col("typo") - 0.2 * F.col("edit_ratio")
    rated = kept.withColumns({"raw_score": S.rounded(raw), "score": S.rounded(F.least(F.lit(0.97), F.greatest(F.lit(0.2), raw)))})
    best = rated.groupBy(key, "proposal").agg(F.max(F.struct("raw_score", "score", "edit_ratio", "typo")).alias("b")).select(key, "proposal", "b.*")
    return best.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("raw_score"), F.desc("score"), "proposal"))).where(F.col("rank") <= top)
