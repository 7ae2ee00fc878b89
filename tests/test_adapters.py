"""Models plugged in, absent and failing."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from maldadum import adapters as A
from maldadum.functions import features as X

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module

def spacing():
    def model(texts):
        if any("!" in t for t in texts):
            raise ValueError("no")
        return [t.replace("할수", "할 수") for t in texts]

    return model


def morphs():
    return lambda texts: [[(-1.5, [("먹", "VV", "먹다", 0, 1), ("었", "EP", None, 1, 2), ("다", "EF", None, 2, 3)]), (-2.0, [("먹", "VV", "먹다", 0, 1), ("었", "EP", None, 1, 2), ("다", "EF", None, 2, 3)]), (-3.0, [("밥", "NNG", None, 0, 1)])] for _ in texts]


def test_spacing(spark):
    df = spark.createDataFrame([(1, "할수 있다"), (2, "할수 있다"), (3, "틀려!"), (4, None), (5, "")], "k INT, t STRING")
    assert {r.k: r.spaced for r in A.spaced(df, "t", factory=spacing).collect()} == {1: "할 수 있다", 2: "할 수 있다", 3: "틀려!", 4: None, 5: ""}
    assert {r.k: r.spaced for r in A.spaced(df, "t").collect()} == {1: "할수 있다", 2: "할수 있다", 3: "틀려!", 4: None, 5: ""}
    assert A.spaced(df.limit(0), "t", factory=spacing).count() == 0


def test_morphology(spark):
    df = spark.createDataFrame([("먹었다",)], "t STRING")
    row = A.analysed(df, "t", factory=morphs).select(A.predicates("analyses").alias("p"), A.sentence_score("analyses").alias("s")).first()
    assert [(x.rank, x.lemma, x.pos, x.slot) for x in row.p] == [(0, "먹다", "VV", "EP+EF")] and row.s == -1.5
    row = A.analysed(df, "t").select(A.predicates("analyses").alias("p"), A.sentence_score("analyses").alias("s")).first()
    assert row.p == [] and row.s == A.NO_SCORE


def test_vectors_and_numbers(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "t STRING, f ARRAY<DOUBLE>")
    assert A.embedded(df, "t", factory=lambda: lambda ts: [[3.0, 4.0] for _ in ts]).first().embedding == [0.6, 0.8]
    assert A.embedded(df, "t").first().embedding is None and A.labelled(df, "f").first().predicted is None and A.generated(df, "t").first().generated is None
    (tmp_path / "m.onnx").write_bytes(b"x")
    assert A.onnx_numbers(str(tmp_path / "m.onnx")) is None is A.onnx_numbers(str(tmp_path / "none.onnx"))
    scored = A.numbers(df, "f", factory=A.onnx_numbers(str(tmp_path / "m.onnx")))
    assert scored.select(X.blended(F.lit(0.7), F.col("model_score"), 0.4)).first()[0] == 0.7
    assert A.numbers(df, "f", factory=lambda: lambda rows: [sum(r) for r in rows]).first().model_score == 3.0
