"""The whole correction, and lemma families."""

from oracle import FOLDER
from pyspark.sql import functions as F

from maldadum.functions import features as X
from maldadum.operators import candidates as C, family, pipeline as L
from maldadum.plans import pipeline_queries as Q
from maldadum.sources.tables import table


GRAPH = "src STRING, dst STRING, source STRING, generatorScore DOUBLE, interfaceType STRING, pos STRING, lemma STRING, targetLemma STRING, suffixSlots ARRAY<STRING>, contextHints ARRAY<STRUCT<term: STRING, count: BIGINT>>, interfaceStats MAP<STRING, BIGINT>"


def edges_of(spark, *rows):
    """Edges (from, to, score, hints) seen often enough."""
    return C.added_edges(spark.createDataFrame([(a, b, "CONFUSION_SET", score, None, None, None, None, None, hints, {"generic": 20}) for a, b, score, hints in rows], GRAPH))


def test_correct(spark):
    rows = [
        (1, "가도되요? 오늘은 금새 왔어요", None, "inspect"), (2, "앞은 금새. 뒤는 금새 됬다", None, "realtime"), (3, None, None, None), (4, "", 3, "realtime"),
        (5, "https://되요.kr 을 봤다", None, "inspect"), (6, "낳다야 낫다야?", None, "inspect"), (7, "제가 할께요 AI를", None, "odd"), (1, "가도되요? 오늘은 금새 왔어요", None, "inspect"),
    ]
    requests = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, cursor_pos INT, mode STRING").withColumn("spans", F.lit("clash"))
    hints = [("왔어요", 3), ("뒤", 3)]
    edges = edges_of(spark, ("금새", "금세", 0.95, hints), ("금새", "금쇠", 0.6, None), ("AI를", "AL를", 0.99, None), ("낫다야", "낳다야", 0.9, None))
    got = {r.doc_id: r for r in L.correct(requests.dropDuplicates(["doc_id"]), edges).collect()}
    assert got[1].final_text == "가도돼요? 오늘은 금새 왔어요" and got[1].suggested_text == "가도돼요? 오늘은 금세 왔어요" and got[1].n_rule_edits == 1
    assert got[2].suggested_text == "앞은 금새. 뒤는 금세 됐다"
    assert got[3].suggested_text == "" == got[4].suggested_text and got[3].n_suggested == 0
    assert got[5].final_text == "https://되요.kr 을 봤다" and got[5].n_protected == 1
    assert got[6].suggested_text == "낳다야 낫다야?"
    assert got[7].suggested_text == "제가 할께요 AI를" and got[7].n_rejected == 0
    assert {r.decision for r in got.values()} == {"AUTO_APPLY", "SUGGEST_ONLY"} and got[1].n_suggested >= 1
    assert all(len(r.proposals) >= 1 for r in got.values())
    assert L.correct(requests.limit(0), edges).count() == 0


def test_substring_cases(spark):
    df = spark.createDataFrame([("아기를 낳았다", "낳았다", None), ("가나", "다", None), ("가나", "가", ["나"]), (None, "x", None)], "said STRING, expected STRING, forbidden ARRAY<STRING>")
    assert L.substring_cases(df).first()[:] == (4, 1)


def test_small_functions(spark):
    df = spark.createDataFrame([("할께요",), ("갈께",), ("먹께요",), ("않해요",), ("안됐다",), ("않",), ("RTX께",), ("부탁드려요",), ("",)], "t STRING")
    t = F.col("t")
    got = {r.t: ([tuple(x) for x in r.p], r.c) for r in df.select("t", X.pattern_candidates(t).alias("p"), X.is_compound(t).alias("c")).collect()}
    assert got["할께요"][0] == [("할게요", 0.96)] and got["갈께"][0] == [("갈게", 0.95)] and got["먹께요"][0] == [] and got["않해요"][0] == [("안 해요", 0.95)] and got["안됐다"][0] == [("안 됐다", 0.96)]
    assert got["부탁드려요"][1] and not got["않"][1]
    numbers = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],)], "x ARRAY<DOUBLE>")
    a, b = [r[0] for r in numbers.select(X.softmax_top(F.col("x"))).collect()]
    assert a.label == 1 and abs(a.confidence - 0.4683) < 1e-3 and b is None
    mixed = spark.createDataFrame([(0.5, None), (0.5, 1.0), (None, 1.0)], "b DOUBLE, m DOUBLE")
    assert [r[0] for r in mixed.select(X.blended(F.col("b"), F.col("m"), 0.4)).collect()][:2] == [0.5, 0.7]


def test_merged_edges(spark):
    schema = "src STRING, dst STRING, score DOUBLE, stats MAP<STRING, BIGINT>"
    a = spark.createDataFrame([("x", "y", 0.5, {"voice": 1}), ("x", "z", 0.9, None)], schema)
    b = spark.createDataFrame([("x", "y", 0.7, {"voice": 2, "generic": 1}), ("q", "r", None, {"voice": 5})], schema)
    got = {(r.src, r.dst): (r.score, r.stats, r.origin) for r in family.merged_edges(a, b).collect()}
    assert got == {("x", "y"): (0.7, {"voice": 3, "generic": 1}, "both"), ("x", "z"): (0.9, {}, "mined"), ("q", "r"): (None, {"voice": 5}, "given")}


def test_merged_edges_reads_every_edge(spark, tmp_path):
    graph = "edge_no BIGINT, src STRING, replacement STRING, generatorScore DOUBLE, interfaceStats MAP<STRING, BIGINT>"
    edges = [(i, f"가{i}", "나", 0.5, {"voice": 1}) for i in range(6)] + [(6, "가0", "나", 0.75, {"voice": 2, "generic": 4}), (8, "다", "라", 0.25, None)]
    spark.createDataFrame(edges, graph).write.parquet(str(tmp_path / "typed_confusion_graph.parquet"))
    records = table(spark, FOLDER, "corpus_records").limit(0)
    records.write.parquet(str(tmp_path / "corpus_records.parquet"))
    summed = {(r.src, r.dst): (r.score, r.stats) for r in family.summed_edges(table(spark, str(tmp_path), "typed_confusion_graph")).collect()}
    assert summed == {("가0", "나"): (0.75, {"voice": 3, "generic": 4}), **{(f"가{i}", "나"): (0.5, {"voice": 1}) for i in range(1, 6)}, ("다", "라"): (0.25, {})}
    merged = {r.src: (r.dst, r.origin, r.score, r.generic, r.keyboard, r.voice) for r in Q.merged_edges(spark, str(tmp_path)).collect()}
    assert merged == {"가0": ("나", "mined", 0.75, 4, 0, 3), **{f"가{i}": ("나", "mined", 0.5, 0, 0, 1) for i in range(1, 6)}, "다": ("라", "mined", 0.25, 0, 0, 0)}


def test_hint_scores_of_every_sentence(spark, tmp_path):
    hints = [("비", 2), ("해가", 3), ("해가", 1), (None, 1)]
    edges = [(1, "금세", hints), (2, "금세", [("바람이불어", 5)]), (3, "금세", None), (4, "없다", hints), (5, "왔다", [("금세", 1), ("", 1)])]
    spark.createDataFrame(edges, "edge_no BIGINT, replacement STRING, contextHints ARRAY<STRUCT<term: STRING, count: BIGINT>>").write.parquet(str(tmp_path / "typed_confusion_graph.parquet"))
    sentences = ["비가 금세 왔다", "해가 금세 비가", "금세 바람이", "아주 금세", "금세 왔다 금세", "비가 왔다", None, "비가 금세 왔다", ""]
    spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(sentences)], "rec_no BIGINT, id STRING, cor_sentence STRING").write.parquet(str(tmp_path / "corpus_records.parquet"))
    got = {(r.edge_no, r.score): r.n for r in Q.hint_scores(spark, str(tmp_path)).collect()}
    # edge 1: the hint 비 begins 비가 (2 of 6); 해가 is a hint (4 of 6), after which 비가 would have to be one too; four places meet none
    assert {k: n for k, n in got.items() if k[0] == 1} == {(1, round(2 / 6, 4)): 1, (1, round(4 / 6, 4)): 1, (1, 0.0): 4}
    assert sum(n for (e, _), n in got.items() if e == 3) == 6 and {s for (e, s) in got if e == 3} == {0.0} and not any(e == 4 for e, _ in got)


def test_correct_applies_phrases(spark):
    texts = ["정답을 맞췄다 그리고 시간을  맞혀서", "정답을 맞췄다니 안자 있었다", "온디바이스 정답 정답을 맞췄다", "", None, "가나 다라 마바"]
    requests = spark.createDataFrame([(i, t, None, "inspect") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, cursor_pos INT, mode STRING")
    edges = edges_of(spark)
    mined = spark.createDataFrame([("다라 마바", "다 라마바", 0.9), ("가나 다라", "가나다라", 0.8), ("온디바이스 정답", "x", 0.9)], "src STRING, dst STRING, confidence DOUBLE")
    got = {r.doc_id: (r.final_text, r.n_phrase_edits) for r in L.correct(requests, edges, phrases=mined).collect()}
    assert got == {0: ("정답을 맞혔다 그리고 시간을 맞춰서", 2), 1: ("정답을 맞췄다니 앉아 있었다", got[1][1]), 2: ("온디바이스 정답 정답을 맞혔다", 1), 3: ("", 0), 4: ("", 0), 5: ("가나다라 마바", 1)}
