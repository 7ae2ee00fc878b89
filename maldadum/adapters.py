"""Where models plug in: spacing, morphology, embeddings, token labels, generation and small numeric models.

A model is a function from a list of distinct inputs to a list of outputs of the same length; it is loaded once per Python worker by a factory. Each
distinct text is computed once for the whole table and joined back, which stands for a memory of earlier calls. Without a model, and where one
fails on an input, the result is what degraded operation defines: the text itself for spacing, no analyses, -999 as sentence score,
null for embeddings, labels, proposals and numbers - and a null model score leaves the base score as it is (``functions.features.blended``)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Model = Callable[[Sequence[Any]], Sequence[Any]]
ANALYSES = "array<struct<score:double,morphs:array<struct<form:string,tag:string,lemma:string,st:int,ed:int>>>>"
#: Model files below this size are placeholders.
LEAST_BYTES = 1024
NO_SCORE = -999.0


def per_distinct(df: DataFrame, column: str, out: str, kind: str, factory: Callable[[], Model] | None, batch: int = 64) -> DataFrame:
    """``df`` with ``out`` of SQL type ``kind``: the model's output on each distinct value of ``column``; null without a model, for null values, and where the
    model raises on a batch and then on the value alone."""
    if factory is None:
        return df.withColumn(out, F.lit(None).cast(kind))
    arrow_kind = df.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        model = factory()
        for part in batches:
            values = part.column(0).to_pylist()
            said: list[Any] = []
            for lo in range(0, len(values), batch):
                some = values[lo : lo + batch]
                try:
                    said += list(model(some))
                except Exception:  # noqa: BLE001 - a model may raise anything; its absence has a defined meaning
                    for one in some:
                        try:
                            said += list(model([one]))
                        except Exception:  # noqa: BLE001
                            said.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, to_arrow_type(arrow_kind))], names=[column, out])

    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    key = df.schema[column].dataType.simpleString()
    return df.join(distinct.mapInArrow(run, f"`{column}` {key}, `{out}` {kind}"), column, "left")


def spaced(df: DataFrame, column: str, out: str = "spaced", factory: Callable[[], Model] | None = None) -> DataFrame:
    """The text with blanks set by a model; the text itself without one."""
    return per_distinct(df, column, out, "string", factory).withColumn(out, F.coalesce(out, column))


def analysed(df: DataFrame, column: str, out: str = "analyses", factory: Callable[[], Model] | None = None) -> DataFrame:
    """Analyses of the text, the best first; none without a model."""
    return per_distinct(df, column, out, ANALYSES, factory).withColumn(out, F.coalesce(out, F.array().cast(ANALYSES)))


def sentence_score(analyses: str) -> Column:
    return F.coalesce(F.get(F.col(f"{analyses}.score"), F.lit(0)), F.lit(NO_SCORE))


def predicates(analyses: str) -> Column:
    """``array<struct<rank, score, lemma, pos, slot>>``: of each analysis its first verb or adjective and the tags that follow it, one per (lemma, pos, slot)."""

    def state(a: Column, rank: Column) -> Column:
        at = F.array_position(F.transform(a["morphs"], lambda m: F.substring_index(m["tag"], "-", 1).isin("VV", "VA", "VX")), F.lit(True)).cast("int")
        head = F.get(a["morphs"], at - 1)
        slot = F.array_join(F.transform(F.slice(a["morphs"], at + 1, F.greatest(F.size(a["morphs"]) - at, F.lit(0))), lambda m: m["tag"]), "+")
        return F.when(at > 0, F.struct(rank.cast("int").alias("rank"), a["score"].alias("score"), head["lemma"].alias("lemma"), F.substring_index(head["tag"], "-", 1).alias("pos"), slot.alias("slot")))

    found = F.filter(F.transform(F.col(analyses), state), lambda s: s.isNotNull())
    same = lambda s, t: (s["lemma"] == t["lemma"]) & (s["pos"] == t["pos"]) & (s["slot"] == t["slot"])
    return F.filter(found, lambda s, i: ~F.exists(F.slice(found, F.lit(1), i), lambda t: same(s, t)))


def inflected(df: DataFrame, morphs: str, out: str = "surface", factory: Callable[[], Model] | None = None) -> DataFrame:
    """Morph sequences (``array<struct<form, tag>>``) put together as a word; null without a model."""
    return per_distinct(df, morphs, out, "string", factory)


def embedded(df: DataFrame, column: str, out: str = "embedding", factory: Callable[[], Model] | None = None) -> DataFrame:
    """Vectors of the text scaled to length 1; null without a model."""
    raw = per_distinct(df, column, out, "array<double>", factory)
    norm = F.sqrt(F.aggregate(out, F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn(out, F.transform(out, lambda x: F.try_divide(x, norm)))


def labelled(df: DataFrame, tokens: str, out: str = "predicted", factory: Callable[[], Model] | None = None) -> DataFrame:
    """``array<struct<label, confidence>>`` per token list; null without a model."""
    return per_distinct(df, tokens, out, "array<struct<label:string,confidence:double>>", factory)


def generated(df: DataFrame, column: str, out: str = "generated", factory: Callable[[], Model] | None = None) -> DataFrame:
    """``array<struct<text, score>>`` of whole-sentence proposals; null without a model."""
    return per_distinct(df, column, out, "array<struct<text:string,score:double>>", factory)


def onnx_numbers(path: str) -> Callable[[], Model] | None:
    """Factory of a small numeric model in a file: feature arrays to one number each. None if the file is missing or a placeholder."""
    if not os.path.exists(path) or os.path.getsize(path) < LEAST_BYTES:
        return None

    def load() -> Model:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name

        def run(rows: Sequence[Sequence[float]]) -> list[float]:
            got = np.asarray(session.run(None, {name: np.asarray(rows, np.float32)})[0], np.float64)
            return got.reshape(len(rows), -1).mean(axis=1).tolist()

        return run

    return load


def numbers(df: DataFrame, features: str, out: str = "model_score", factory: Callable[[], Model] | None = None) -> DataFrame:
    """A number per feature array; null without a model."""
    return per_distinct(df, features, out, "double", factory)
