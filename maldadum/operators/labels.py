"""Token-label examples from corpus records, and what is counted on them.

Spans of error texts are located one after the other: each search goes on where the last span ended, passes over places that are taken, wraps
around once, and falls back to the token that the entry names. That state runs along a record's entries, so a record is one row of an
Arrow function; everything else is expressions.

Defined results: a record without tokens gives no example, one whose labels are all KEEP no noisy one; null texts count as empty; entries
without index come last; of labels that meet on a token the one of higher rank stays, of equal ones the later."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maldadum import vocab
from maldadum.functions import text as T


def entry_label(err: Column, cor: Column, details: Column) -> Column:
    """SPACE_FIX, KEEP (only punctuation changed) or OPEN_REPLACE."""
    e, c = F.coalesce(err, F.lit("")), F.coalesce(cor, F.lit(""))
    tagged = F.coalesce((details["kind"] == "tags") & F.array_contains(details["tags"], "띄어쓰기"), F.lit(False))
    counted = [F.coalesce(F.try_element_at(details["counts"], F.lit(f"spacing.{k}")) > 0, F.lit(False)) for k in ("insert", "delete", "replace")]
    spacing = tagged | T.spacing_only(e, c) | counted[0] | counted[1] | counted[2]
    return F.when(spacing, "SPACE_FIX").when(T.punctuation_only(e, c), "KEEP").otherwise("OPEN_REPLACE")


def entry_label_with_marks(err: Column, cor: Column, details: Column) -> Column:
    """SPACE_FIX, PUNCT_FIX or OPEN_REPLACE: as :func:`entry_label`, but changes of punctuation have a label of their own."""
    e, c = F.coalesce(err, F.lit("")), F.coalesce(cor, F.lit(""))
    tagged = F.coalesce((details["kind"] == "tags") & F.array_contains(details["tags"], "문장부호"), F.lit(False))
    counted = [F.coalesce(F.try_element_at(details["counts"], F.lit(f"mark.{k}")) > 0, F.lit(False)) for k in ("insert", "delete", "replace")]
    marks = tagged | T.punctuation_only(e, c) | counted[0] | counted[1] | counted[2]
    return F.when(entry_label(err, cor, details) == "SPACE_FIX", "SPACE_FIX").when(marks, "PUNCT_FIX").otherwise("OPEN_REPLACE")


def _located(sentence: str, tokens: list[tuple[int, int]], entries: list[dict]) -> list[tuple[int, int, str]]:
    taken: list[tuple[int, int, str]] = []
    cursor = 0

    def free(lo: int, hi: int) -> bool:
        return all(hi <= a or b <= lo for a, b, _ in taken)

    def search(target: str, start: int) -> tuple[int, int] | None:
        at = sentence.find(target, start)
        while at >= 0 and not free(at, at + len(target)):
            at = sentence.find(target, at + 1)
        return (at, at + len(target)) if at >= 0 else None

    far = 10**9
    for e in sorted(entries, key=lambda e: (far if e["err_idx"] is None else e["err_idx"], far if e["err_location"] is None else e["err_location"])):
        text, place = e["err_text"] or "", e["err_location"]
        span = (search(text, cursor) or (search(text, 0) if cursor else None)) if text else None
        if span is None and place is not None and 0 <= place < len(tokens):
            last = min(len(tokens), place + max(1, len(text.split()))) - 1
            span = (tokens[place][0], tokens[last][1])
            span = span if free(*span) else None
        if span is not None:
            taken.append((*span, e["label"]))
            cursor = span[1]
    return taken


def labelled(df: DataFrame, sentence: str, entries: str, *keep: str) -> DataFrame:
    """The columns ``keep``, ``tokens``, ``labels``, ``token_offsets`` and ``located`` of each row; ``entries`` has ``err_idx``, ``err_location``, ``err_text``,
    ``label``. Rows stay where they are; nothing is joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(r"\S+").finditer
        rank = vocab.LABEL_PRIORITY
        types = (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.int32())
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                tokens = [(m.start(), m.end()) for m in find(text)]
                labels = ["KEEP"] * len(tokens)
                spans = _located(text, tokens, found or [])
                for lo, hi, label in spans:
                    if label != "KEEP":
                        for i, (a, b) in enumerate(tokens):
                            if a < hi and lo < b and rank[label] >= rank[labels[i]]:
                                labels[i] = label
                out.append(([text[a:b] for a, b in tokens], labels, [list(t) for t in tokens], len(spans)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *[pa.array(c, t) for c, t in zip(columns, types)]], names=[*keep, "tokens", "labels", "token_offsets", "located"])

    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep) + "tokens ARRAY<STRING>, labels ARRAY<STRING>, token_offsets ARRAY<ARRAY<INT>>, located INT"
    return df.select(F.col(sentence).alias("_sentence"), F.col(entries).alias("_entries"), *[F.col(k) for k in keep]).mapInArrow(run, schema)


def examples(records: DataFrame) -> DataFrame:
    """Noisy and clean examples of records (``id``, ``split``, ``error_type``, ``source``, sentences, ``error_count``, ``errors``)."""
    entries = F.transform(F.coalesce("errors", F.slice("errors", 1, 0)), lambda e: F.struct(e["err_idx"].alias("err_idx"), e["err_location"].alias("err_location"), e["err_text"].alias("err_text"), entry_label(e["err_text"], e["cor_text"], e["err_details"]).alias("label")))
    meta = ("id", "split", "error_type", "source", "err_sentence", "cor_sentence", "error_count")
    rows = records.select(*meta, entries.alias("entries"))
    noisy = labelled(rows, "err_sentence", "entries", *meta).where(F.exists("labels", lambda x: x != "KEEP")).select(
        F.concat("id", F.lit(":noisy")).alias("id"), F.col("id").alias("base_id"), F.lit("noisy").alias("variant"), "split", "error_type", "source",
        F.coalesce("err_sentence", F.lit("")).alias("text"), F.coalesce("cor_sentence", F.lit("")).alias("corrected_text"), "tokens", "labels", "token_offsets",
        F.coalesce("error_count", F.lit(0)).alias("error_count"), F.col("located").alias("located_error_count"))
    spans = T.tokens(F.col("cor_sentence"), r"\S+")
    clean = records.select(*meta).withColumn("t", spans).where(F.size("t") > 0).select(
        F.concat("id", F.lit(":clean")).alias("id"), F.col("id").alias("base_id"), F.lit("clean").alias("variant"), "split", F.lit("CLEAN_REFERENCE").alias("error_type"), "source",
        F.col("cor_sentence").alias("text"), F.col("cor_sentence").alias("corrected_text"), F.col("t.tok").alias("tokens"), F.transform("t", lambda x: F.lit("KEEP")).alias("labels"),
        F.transform("t", lambda x: F.array(x["st"], x["ed"])).alias("token_offsets"), F.lit(0).alias("error_count"), F.lit(0).alias("located_error_count"))
    return noisy.unionByName(clean)


def plain_examples(records: DataFrame) -> DataFrame:
    """One example per record with tokens, with labels for punctuation, whether or not anything is labelled: ``id``, ``split``, ``error_type``, ``source``, ``text``, ``corrected_text``, ``tokens``,
    ``labels``, ``token_offsets``, ``error_count`` (as given, else the number of entries), ``located_error_count``."""
    errors = F.coalesce("errors", F.slice("errors", 1, 0))
    entries = F.transform(errors, lambda e: F.struct(e["err_idx"].alias("err_idx"), e["err_location"].alias("err_location"), e["err_text"].alias("err_text"), entry_label_with_marks(e["err_text"], e["cor_text"], e["err_details"]).alias("label")))
    meta = ("id", "split", "error_type", "source", "err_sentence", "cor_sentence", "error_count", "n_entries")
    rows = records.select(*meta[:-1], F.coalesce(F.size("errors"), F.lit(0)).alias("n_entries"), entries.alias("entries"))
    return labelled(rows, "err_sentence", "entries", *meta).where(F.size("tokens") > 0).select(
        "id", "split", "error_type", "source", F.coalesce("err_sentence", F.lit("")).alias("text"), F.coalesce("cor_sentence", F.lit("")).alias("corrected_text"), "tokens", "labels", "token_offsets",
        F.coalesce("error_count", F.greatest("n_entries", F.lit(0))).alias("error_count"), F.col("located").alias("located_error_count"))


#: Label of pieces that no loss is taken of.
IGNORED = -100


def piece_labels(word_of_piece: Column, labels: Column, names: list[str]) -> Column:
    """A label number per sub-word piece: that of its word for a word's first piece, IGNORED for others and for pieces of no word.

    :param word_of_piece: ``array<int>``, the word each piece belongs to, null for special pieces.
    :param names: label names in the order of their numbers."""
    number = F.create_map(*[F.lit(x) for pair in ((n, i) for i, n in enumerate(names)) for x in pair])
    first = lambda w, i: (i == 0) | ~F.coalesce(F.get(word_of_piece, i - 1) == w, F.lit(False))
    return F.transform(word_of_piece, lambda w, i: F.when(w.isNotNull() & first(w, i), F.try_element_at(number, F.get(labels, w))).otherwise(IGNORED))


def deduplicated(rows: DataFrame, order: str) -> DataFrame:
    """One example per text and labels: a noisy one before a clean one, then the first by ``order``. The digest of the key is what is shuffled with the row."""
    best = W.partitionBy("text", "labels").orderBy((F.col("variant") != "noisy").cast("int"), order)
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


#: Ranges of the order in which clean rows are counted.
BINS = 65_536


def balanced(rows: DataFrame, order: str, ratio: float = 1.0) -> DataFrame:
    """All noisy rows, and per split the first clean ones by ``order`` up to ``ratio`` times as many; rows without ``order`` come last.

    The cut is found without one task seeing a split: counts per range of the order, BINS of them whatever the data, give the range in which it falls."""
    noisy = rows.where("variant = 'noisy'").groupBy("split").agg(F.floor(F.count(F.lit(1)) * ratio).cast("bigint").alias("want"))
    ends = rows.where("variant = 'clean'").agg(F.min(order), F.max(order)).first()
    low, width = ends[0] or 0, ((ends[1] or 0) - (ends[0] or 0)) // BINS + 1
    at = F.coalesce(F.expr(f"(`{order}` - {low}L) div {width}L"), F.lit(BINS + 1).cast("bigint"))
    clean = rows.where("variant = 'clean'").withColumn("_bin", at)
    bins = clean.groupBy("split", "_bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("split").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    starts = bins.withColumn("before", F.coalesce(before, F.lit(0))).join(noisy, "split").select("split", "_bin", (F.col("want") - F.col("before")).alias("room"))
    placed = clean.join(starts.where("room > 0"), ["split", "_bin"]).withColumn("_n", F.row_number().over(W.partitionBy("split", "_bin").orderBy(order)))
    return rows.where("variant = 'noisy'").unionByName(placed.where("_n <= room").drop("_bin", "_n", "room"))


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.select("split", "variant", F.explode("labels").alias("label")).groupBy("split", "variant", "label").agg(F.count(F.lit(1)).alias("n"))


def class_weights(rows: DataFrame) -> DataFrame:
    """(1 + count) ^ -1/2 per label, divided by the mean of all labels."""
    counts = rows.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    raw = 1 / F.sqrt(1 + F.col("n"))
    return counts.withColumn("weight", F.round(raw / F.avg(raw).over(W.partitionBy()), 6))  # a row per label


def token_metrics(pairs: DataFrame) -> DataFrame:
    """One row of token-level figures of (``gold``, ``pred``) rows; a share of nothing is 0."""
    g, p = F.col("gold"), F.col("pred")
    n = {"n": F.lit(True), "right": g == p, "tp": (g != "KEEP") & (p != "KEEP"), "pp": p != "KEEP", "gp": g != "KEEP", "keep": g == "KEEP", "fp": (g == "KEEP") & (p != "KEEP")}
    for label, short in (("OPEN_REPLACE", "or"), ("SPACE_FIX", "sf")):
        n |= {f"{short}_tp": (g == label) & (p == label), f"{short}_pp": p == label, f"{short}_gp": g == label}
    c = pairs.agg(*[F.count_if(v).alias(k) for k, v in n.items()])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    f1 = lambda a, b, d: F.coalesce(F.try_divide(2 * F.col(a), F.col(b) + F.col(d)), F.lit(0.0))
    figures = {"accuracy": share("right", "n"), "keep_fpr": share("fp", "keep")}
    for short, tp, pp, gp in (("non_keep", "tp", "pp", "gp"), ("open_replace", "or_tp", "or_pp", "or_gp"), ("space_fix", "sf_tp", "sf_pp", "sf_gp")):
        figures |= {f"{short}_precision": share(tp, pp), f"{short}_recall": share(tp, gp), f"{short}_f1": f1(tp, pp, gp)}
    return c.select(F.col("n").alias("n_tokens"), *[F.round(v, 6).alias(k) for k, v in figures.items()])


def label_runs(rows: DataFrame, key: str, label: str = "OPEN_REPLACE", most: int = 3, context: int = 3) -> DataFrame:
    """Maximal runs of ``label`` cut into pieces of at most ``most`` tokens: ``key``, ``first``, ``last`` (token indices), ``tokens``, ``before``, ``after``.

    Gaps and islands inside the row's arrays: no shuffle."""
    at = F.filter(F.sequence(F.lit(0), F.size("labels") - 1), lambda i: F.get(F.col("labels"), i) == label)
    start = "array<struct<first:int,last:int>>"
    runs = F.aggregate(at, F.array().cast(start), lambda acc, i: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] == i - 1) & (i - F.element_at(acc, -1)["first"] < most),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), i.alias("last"))))).otherwise(F.concat(acc, F.array(F.struct(i.alias("first"), i.alias("last"))))))
    each = rows.where(F.size("labels") > 0).select(key, "tokens", F.explode(runs).alias("r"))
    cut = lambda lo, hi: F.array_join(F.slice("tokens", F.greatest(lo, F.lit(0)) + 1, F.greatest(hi - F.greatest(lo, F.lit(0)), F.lit(0))), " ")
    first, last = F.col("r.first"), F.col("r.last")
    return each.select(key, first.alias("first"), last.alias("last"), cut(first, last + 1).alias("tokens"), cut(first - context, first).alias("before"), cut(last + 1, F.least(last + 1 + context, F.size("tokens"))).alias("after"))


def clean_pairs(pairs: DataFrame, least: int = 2, most: int = 200) -> DataFrame:
    """Distinct trimmed pairs of texts that differ and are within the length bounds; ``split``, ``original``, ``corrected``."""
    trimmed = pairs.select("split", F.trim("original").alias("original"), F.trim("corrected").alias("corrected"))
    fit = lambda c: F.length(c).between(least, most)
    return trimmed.where((F.col("original") != F.col("corrected")) & fit("original") & fit("corrected")).distinct()
