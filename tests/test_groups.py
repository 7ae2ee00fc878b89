"""Groups of tokens, windows with generated proposals, candidates from analyses, labels, light variants."""

import re

import pytest
from pyspark.sql import functions as F

from maldadum import adapters
from maldadum.functions import text as T
from maldadum.operators import candidates as C, grouping as G, labels as L, light, mining, morphology as M, pipeline as P, windows as Wn
from maldadum.plans import assets
from maldadum.sources import readers
from maldadum.sources.tables import table
from oracle import FOLDER


def token_rows(spark, sentences):
    rows = []
    for key, (text, labels) in enumerate(sentences):
        for i, m in enumerate(re.finditer(r"\S+", text)):
            rows.append((key, text, i, m.group(), m.start(), m.end(), labels[i] if i < len(labels) else "KEEP", 0.9))
    return spark.createDataFrame(rows, "key INT, sentence STRING, idx INT, tok STRING, st INT, ed INT, label STRING, confidence DOUBLE")


def test_groups_consume_tokens(spark):
    o, k = "OPEN_REPLACE", "KEEP"
    tokens = token_rows(spark, [("할 께요 정말", [k, k, k]), ("정답을 맞췄다 그만", [o, o, o]), ("정답을 맞췄따 다", [o, o, k]), ("좋 겟다 한번", [k, k, o]), ("가나 다라", [o, k])])
    fixes = spark.createDataFrame([("좋겟다", "좋겠다", 0.99)], "src STRING, dst STRING, confidence DOUBLE")
    memory = spark.createDataFrame([("정답을 맞췄다", "정답을 맞혔다", 0.99)], "src STRING, dst STRING, confidence DOUBLE")
    got = sorted((r.key, r.idx, r.n_tokens, r.kind, r.replacement) for r in G.groups(tokens, "sentence", fixes, memory).collect())
    assert got == [(1, 0, 2, "phrase", "정답을 맞혔다"), (1, 2, 1, "token", None), (2, 0, 1, "token", None), (2, 1, 1, "token", None), (3, 0, 2, "pair", "좋겠다"), (3, 2, 1, "token", None), (4, 0, 1, "token", None)]  # 할 께요 is too little alike, 맞췄따 too little for a phrase one letter off
    pair = next(r for r in G.pairs(tokens, "sentence", fixes).collect() if r.key == 3)
    assert pair.original == "좋 겟다" and pair.confidence == round(0.9 * 0.78, 4) and pair.score == round(0.46 * 0.99 + 0.3 * 0.6667 + 0.086, 4)
    spans = {(r.key, r.st, r.ed) for r in G.phrase_targets(token_rows(spark, [("정답을 맞혔다 정말", []), ("맞혔다 정답을", [])]), memory).collect()}
    assert spans == {(0, 0, 7)}
    assert G.groups(tokens.limit(0), "sentence", fixes, memory).count() == 0


def test_routing_and_locks(spark):
    rows = [("PUNCT_FIX", "CONFUSION_SET", 0.6), ("PUNCT_FIX", "CONFUSION_SET", 0.5), ("JOSA_FIX", "MLM_TOPK", 0.9), ("EOMI_FIX", "MORPH", 0.55), ("SPACE_FIX", "MORPH", 0.9), ("OPEN_REPLACE", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "label STRING, source STRING, score DOUBLE")
    got = [tuple(r[0]) for r in df.select(G.routed(F.col("label"), F.col("source"), F.col("score"))).collect()]
    assert got == [("OPEN_REPLACE", "PROMOTE_TO_OPEN_REPLACE"), ("KEEP", "DEFER_TO_RULES"), ("JOSA_FIX", "PASS_TO_DOWNSTREAM"), ("OPEN_REPLACE", "PROMOTE_TO_OPEN_REPLACE"), ("KEEP", "DEFER_TO_SPACING"), ("OPEN_REPLACE", "PASS_TO_DOWNSTREAM"), ("KEEP", "PASS_TO_DOWNSTREAM")]
    spans = spark.createDataFrame([("OPEN_REPLACE", 0, 2, "DATA_CONFUSION", 0.9), ("OPEN_REPLACE", 0, 2, "FAMILY_SEED", 0.2), ("OPEN_REPLACE", 5, 7, None, None), ("SPACE_FIX", 0, 2, None, None)], "label STRING, st INT, ed INT, source STRING, context DOUBLE").withColumn("s", F.array(F.struct(F.lit(1).alias("st"), F.lit(5).alias("ed"))))
    assert [r[0] for r in spans.select(G.locked(F.col("label"), F.col("st"), F.col("ed"), F.col("s"), F.col("source"), F.col("context"))).collect()] == ["KEEP", "OPEN_REPLACE", "OPEN_REPLACE", "SPACE_FIX"]


def test_window_proposals(spark):
    text = "오늘은 RTX 4060 을 나았다 그리고 집에 아주 늦게 갔다"
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    labels = ["OPEN_REPLACE" if text[a:b] == "나았다" else "KEEP" for a, b in words]
    rows = spark.createDataFrame([(1, text, labels, [list(w) for w in words]), (2, "가나", ["KEEP"], [[0, 2]]), (3, "", [], [])], "id INT, text STRING, labels ARRAY<STRING>, token_offsets ARRAY<ARRAY<INT>>")
    windows = Wn.replace_windows(rows, "id", "text")
    w = windows.first()
    assert windows.count() == 1 and w.window_text == "RTX 4060 을 나았다 그리고 집에 아주" and w.window_text[w.local.st : w.local.ed] == "나았다"
    said = [("RTX 4060 을 낳았다 그리고 집에 아주", -0.2), ("RTX 을 낳았다 그리고 집에 아주", 0.0), (w.window_text, 0.0), ("RTX 4060 을 나았다 그리고 집에 매우", 0.0), ("RTX 4060 을 낳았다★ 그리고 집에 아주", 0.0), ("", 0.0), ("RTX 4060 을 낳았다 그리고 집에 아주", -0.9)]
    generated = windows.withColumn("g", F.lit(None).cast("array<struct<text:string,score:double>>")).drop("g").crossJoin(spark.createDataFrame([(said,)], "g ARRAY<STRUCT<text: STRING, score: DOUBLE>>"))
    got = Wn.window_proposals(generated, "id", "g").collect()
    assert [r.proposal for r in got] == [text.replace("나았다", "낳았다")] and got[0].rank == 1
    import math

    n = len(text)
    typo = 0.55 * (n - 1) / n + 0.45 * 2 / 3
    assert abs(got[0].raw_score - (0.32 + 0.36 / (1 + math.exp(0.2)) + 0.26 * typo - 0.2 / n)) < 2e-4


def test_spans_in_windows(spark):
    df = spark.createDataFrame([([(0, 3), (5, 9), (12, 14)],)], "s ARRAY<STRUCT<st: INT, ed: INT>>")
    assert [tuple(x) for x in df.select(Wn.projected(F.col("s"), F.lit(2), F.lit(7))).first()[0]] == [(0, 1), (3, 5)]
    changes = spark.createDataFrame([(3, 4), (0, 1), (1, 1), (0, 0), (8, 9), (10, 11)], "a INT, b INT")
    span = F.struct(F.lit(3).alias("st"), F.lit(6).alias("ed"))
    assert [r[0] for r in changes.select(Wn.touches(F.struct(F.col("a").alias("st"), F.col("b").alias("ed")), span)).collect()] == [True, False, True, False, False, False]


MORPHS = {
    "나았다": [(-3.0, [("낫", "VV-I", "낫다", 0, 1), ("았", "EP", "았", 1, 2), ("다", "EF", "다", 2, 3)]), (-4.0, [("나", "VV", "나다", 0, 1), ("았", "EP", "았", 1, 2), ("다", "EF", "다", 2, 3)]), (-5.0, [("낫", "VV-I", "낫다", 0, 1), ("았", "EP", "았", 1, 2), ("다", "EF", "다", 2, 3)])],
    "좋겟다": [(-2.0, [("좋", "VA", "좋다", 0, 1), ("겟", "EP", "겟", 1, 2), ("다", "EF", "다", 2, 3)])],
    "하늘": [(-1.0, [("하늘", "NNG", "하늘", 0, 2)])],
}


def analyser():
    """A model that travels to workers by value."""
    known = MORPHS

    def analyse(texts):
        return [[{"score": s, "morphs": [dict(zip(("form", "tag", "lemma", "st", "ed"), m)) for m in ms]} for s, ms in known[t]] for t in texts]

    return lambda: analyse


def joiner():
    return lambda: lambda sequences: ["".join(m["form"] for m in s) for s in sequences]


@pytest.fixture(scope="module")
def analysed(spark):
    tokens = spark.createDataFrame([(1, "나았다", 0, 3), (2, "좋겟다", 0, 3), (3, "하늘", 0, 2), (4, "모름", 0, 2)], "key INT, tok STRING, st INT, ed INT")
    return adapters.analysed(tokens, "tok", factory=analyser())


def test_states(analysed):
    got = sorted((r.key, r["rank"], r.lemma, r.pos, r.slot, r.irregular, r.stem) for r in M.states(analysed).collect())
    assert got == [(1, 0, "낫다", "VV", "EP+EF", None, "낫"), (1, 1, "나다", "VV", "EP+EF", None, "나"), (2, 0, "좋다", "VA", "EP+EF", None, "좋")]
    rows = {r.tok: r for r in analysed.select("tok", M.predicate_lemmas(F.col("analyses")).alias("l"), M.looks_like_predicate(F.col("analyses")).alias("p"), M.lemma_tag(F.col("analyses"), F.lit("낫다"), F.lit("VA-R")).alias("t"), M.mended(F.get("analyses.morphs", F.lit(0))).alias("m")).collect()}
    assert rows["나았다"].l == ["낫다", "나다"] and rows["나았다"].p and not rows["하늘"].p and rows["나았다"].t == "VV-I" and rows["좋겟다"].t == "VA"
    assert "".join(x.form for x in rows["좋겟다"].m.sequence) == "좋겠다" and rows["좋겟다"].m.score == 0.93 and rows["나았다"].m is None


def test_candidates_from_lemmas(spark, analysed):
    state = M.states(analysed)
    kinds = "src STRING, dst STRING, source STRING, generator DOUBLE, kind STRING, slots ARRAY<STRING>, hints ARRAY<STRUCT<term: STRING, count: BIGINT>>, stats MAP<STRING, BIGINT>"
    edges = spark.createDataFrame([("낫다", "낳다", "FAMILY_SEED", 0.9, None, ["EP"], [("아기", 3)], {"voice": 2}), ("낫다", "낳다", "LEMMA_CONFUSION", 0.8, "voice", ["EC"], [("아기", 1)], {"voice": 1}), ("나다", "하다", "FAMILY_SEED", 0.9, None, [], [], {}), ("좋다", "종다", "LEMMA_DATA_CONFUSION", 0.9, None, ["ETM"], [("x", 1)], {})], kinds)
    graph = M.lemma_graph(edges)
    g = {(r.src, r.dst): r for r in graph.collect()}
    assert ("나다", "하다") not in g and ("낫다", "놓다") in g and g["낳다", "낫다"].generator == 0.846 and g["낫다", "낳다"].hints == [("아기", 4)] and g["낫다", "낳다"].stats == {"voice": 3} and g["낫다", "낳다"].slots == ["EC", "EP"] and g["낫다", "낳다"].generator == 0.94
    met = M.confused(state, graph)
    assert {(r.key, r.target) for r in met.collect()} == {(1, "낳다"), (1, "놓다")}  # 종다 wants another slot
    got = {(r.key, r.dst): (r.source, r.family) for r in M.reinflected(met, joiner()).collect()}
    assert got == {(1, "낳았다"): ("CONFUSION_SET", ["낫다", "낳다"]), (1, "놓았다"): ("MORPH", ["낫다", "놓다"])}
    assert M.reinflected(met, None).count() == 0
    lexicon = spark.createDataFrame([("낮다", "VA"), ("낫다", "VV"), ("낳다", "VV"), ("조다", "VA")], "lemma STRING, pos STRING")
    rules = spark.createDataFrame([("ㅅ", "ㅎ", "VV", 0.7), ("낫", "낳", "VV", 0.7)], "source_suffix STRING, target_suffix STRING, pos STRING, score DOUBLE")
    assert M.by_endings(state, rules, lexicon).count() == 0  # a stem of one letter has no ending of its own
    long = state.withColumns({"stem": F.concat(F.lit("앞"), "stem"), "lemma": F.concat(F.lit("앞"), "lemma")})
    found = M.by_endings(long, rules, lexicon.withColumn("lemma", F.concat(F.lit("앞"), "lemma"))).collect()
    assert [(r.lemma, r.target, r.generator) for r in found] == [("앞낫다", "앞낳다", 0.7)]
    near = M.by_similar_stems(long.withColumn("stem", F.concat(F.lit("가나다라"), "stem")), spark.createDataFrame([("가나다라앞낳다", "VV"), ("가나다라앞낮다", "VA")], "lemma STRING, pos STRING")).collect()
    assert {(r.lemma, r.target) for r in near} == {("앞낫다", "가나다라앞낳다"), ("앞나다", "가나다라앞낳다")}
    examples = spark.createDataFrame([("낫다", "낳다", "나앗다", "낳았다", 3, 0.8), ("낫다", "낳다", "하늘로", "땅", 3, 0.8)], "lemma STRING, target STRING, `from` STRING, `to` STRING, count BIGINT, generator DOUBLE")
    assert {r.dst for r in M.by_examples(state, examples).collect()} == {"낳았다"}


def test_word_tokens(spark):
    rows = [(1, 0, 0, "아기", "NNG", 0, 2, "아기를 낳았다"), (1, 0, 0, "를", "JKO", 2, 3, "아기를 낳았다"), (1, 0, 1, "낳", "VV", 4, 5, "아기를 낳았다"), (1, 0, 1, "았", "EP", 5, 6, "아기를 낳았다"), (1, 0, 1, "다", "EF", 6, 7, "아기를 낳았다")]
    df = spark.createDataFrame(rows, "key INT, sent INT, word INT, form STRING, tag STRING, st INT, ed INT, said STRING")
    got = sorted((r.st, r.ed, r.tok, r.lemma_key, r.pos, r.slots) for r in M.word_tokens(df, "said").collect())
    assert got == [(0, 3, "아기를", None, None, []), (4, 7, "낳았다", "낳다", "VV", ["EP", "EF"])]


def test_labels_of_marks_and_pieces(spark):
    kind = "err STRING, cor STRING, d STRUCT<kind: STRING, tags: ARRAY<STRING>, counts: MAP<STRING, INT>, value: STRING>"
    rows = [("할수", "할 수", None), ("갔다", "갔다.", None), ("가", "나", ("tags", ["문장부호"], None, None)), ("가", "나", ("counts", None, {"mark.insert": 1}, None)), ("가", "나", ("counts", None, {"mark.insert": 0}, None)), (None, None, None)]
    assert [r[0] for r in spark.createDataFrame(rows, kind).select(L.entry_label_with_marks(F.col("err"), F.col("cor"), F.col("d"))).collect()] == ["SPACE_FIX", "PUNCT_FIX", "PUNCT_FIX", "PUNCT_FIX", "OPEN_REPLACE", "OPEN_REPLACE"]
    pieces = spark.createDataFrame([([None, 0, 0, 1, None], ["KEEP", "OPEN_REPLACE"]), ([], [])], "w ARRAY<INT>, l ARRAY<STRING>")
    assert [r[0] for r in pieces.select(L.piece_labels(F.col("w"), F.col("l"), ["KEEP", "SPACE_FIX", "OPEN_REPLACE"])).collect()] == [[-100, 0, -100, 2, -100], []]


def test_spacing_edits(spark):
    rows = spark.createDataFrame([("가나다라 마바", "가나 다라 마 바", "NORMAL", [(3, 4)], [(0, 4)]), ("가나", "가나", "CHAT", [], []), ("가 나", "가나", "NORMAL", [], []), ("가나다", "가 나다", "CHAT", [], [])], "t STRING, s STRING, profile STRING, g ARRAY<STRUCT<st: INT, ed: INT>>, p ARRAY<STRUCT<st: INT, ed: INT>>")
    got = [[(e.st, e.dst, e.confidence) for e in r.spacing_edits] for r in P.spaced_edits(rows, "t", "s", "g", "p").collect()]
    assert got == [[(6, " ", 0.99)], [], [], [(1, " ", 0.96)]]


def test_correct_with_a_spacing_model(spark):
    requests = spark.createDataFrame([(1, "교정이됀건가 봄", None, "inspect")], "doc_id BIGINT, text STRING, cursor_pos INT, mode STRING")
    from test_pipeline import edges_of

    row = P.correct(requests, edges_of(spark), spacing=lambda: lambda texts: [t.replace("이된", "이 된 ") for t in texts]).first()
    assert row.final_text == "교정이 된 건가 봄" and row.n_spacing_edits == 2 and row.n_rule_edits == 1


def test_light(spark):
    assert [r[0] for r in spark.createDataFrame([("아 ㄹㅇ 좋네",), ("정말 개좋다",), ("가나다라마바사아자차카타파\t하",), ("abc 가",)], "t STRING").select(light.profile(F.col("t"))).collect()] == ["CHAT", "CHAT", "NORMAL", "MIXED"]
    rows = spark.createDataFrame([(1, "너무좋은데산책가도할수있어요", "NOISY", [])], "id INT, t STRING, profile STRING, spans ARRAY<STRUCT<st: INT, ed: INT>>")
    got = {r.place: r.score for r in light.spacing_points(rows, "id", "t").collect()}
    text = "너무좋은데산책가도할수있어요"
    want = {}
    for i in range(1, len(text)):
        near = text[max(0, i - 4) : i + 4]
        score = 0.42 + sum(0.1 for h in light._HINTS if h[:2] in near or h[-2:] in near) + (0.15 if re.search("가도|는데|어요|했다|하면", near) else 0) + 0.03
        if round(score, 6) >= 0.8:
            want[i] = round(min(0.99, score), 4)
    assert got == want and got
    candidates = spark.createDataFrame([(1, 0, 3, "나았다", "낳았다", "FAMILY", 0.9), (1, 0, 3, "나았다", "낳았다", "GEN_BACKOFF", 0.5), (1, 0, 3, "나았다", "하늘만큼땅", "X", 0.9), (1, 0, 3, "나았다", "놓았다", "GEN_BACKOFF", 0.4)], "key INT, st INT, ed INT, original STRING, replacement STRING, source STRING, generator DOUBLE")
    some = light.candidates(candidates).withColumns({"said": F.lit("나았다 아기"), "family": F.when(F.col("source") == "FAMILY", "낳다"), "hint_terms": F.when(F.col("source") == "FAMILY", F.array(F.lit("아기")))})
    canonical = spark.createDataFrame([(1, 0, 3, "낫다", "VV", ["EP", "EF"])], "key INT, st INT, ed INT, lemma_key STRING, pos STRING, slots ARRAY<STRING>")
    ranked = light.reranked(light.verified(some, "said", canonical), "said", F.lit(False), F.lit(None).cast("double"))
    got = {r.replacement: (r.verify, r.final) for r in ranked.collect()}
    verify = 0.35 + 0.9 * 0.35 + 0.18 + 0.06 + 0.12
    assert set(got) == {"나았다", "낳았다", "놓았다"} and got["낳았다"][0] == round(min(0.99, verify), 6) and got["나았다"][0] == 0.25
    assert abs(got["낳았다"][1] - 0.99) < 1e-9 and abs(got["놓았다"][0] - (0.35 + 0.14 + 0.18 - 0.1)) < 1e-9
    assert [r.replacement for r in light.best_per_place(ranked).collect()] == ["낳았다"]
    edits = spark.createDataFrame([("가나다라", [(2, 3, "xyz", "REJECT"), (0, 1, "a", "AUTO_APPLY"), (0, 2, "b", "SUGGEST_ONLY")])], "t STRING, e ARRAY<STRUCT<st: INT, ed: INT, dst: STRING, decision: STRING>>")
    p = edits.select(light.preview(F.col("t"), F.col("e")).alias("p"), light.by_decision(F.col("e")).alias("d")).first()
    assert p.p.text == "a나xyz라" and [tuple(m) for m in p.p.markers] == [(0, 1), (2, 5)] and [len(x) for x in p.d] == [1, 1, 1]


def test_taggers(spark):
    guard = "guard ARRAY<STRUCT<st: INT, ed: INT>>"
    rows = [(1, 0, "나았다", 0, 3, [], "KEEP", 0.9, True), (1, 1, "나았다", 4, 7, [(0, 9)], "OPEN_REPLACE", 0.9, True), (1, 2, "A가", 8, 10, [], "OPEN_REPLACE", 0.9, True), (1, 3, "가", 11, 12, [], "OPEN_REPLACE", 0.9, True), (1, 4, "나았다", 13, 16, [], "SPACE_FIX", 0.7, True), (1, 5, "나았다", 17, 20, [], "KEEP", 0.9, False), (1, 6, "나았다고", 21, 25, [], "KEEP", 0.6, True)]
    tokens = spark.createDataFrame(rows, f"key INT, idx INT, tok STRING, st INT, ed INT, {guard}, predicted STRING, sure DOUBLE, confusable BOOLEAN")
    best = spark.createDataFrame([(1, i, "FAMILY_SEED", 0.75, 0.9, 0.0, ["낫다"], "VV") for i in (0, 1, 4, 5)] + [(1, 6, "DATA_CONFUSION", 0.9, 0.9, 0.17, [], "VV")], "key INT, idx INT, source STRING, score DOUBLE, norm DOUBLE, context DOUBLE, family ARRAY<STRING>, pos STRING")
    got = [(r.label, r.confidence) for r in G.tagged(tokens, best).orderBy("idx").collect()]
    assert got == [("OPEN_REPLACE", 0.9), ("KEEP", 1.0), ("KEEP", 0.99), ("KEEP", 0.98), ("SPACE_FIX", 0.7), ("KEEP", 0.9), ("KEEP", 0.6)]
    got = [(r.label, r.confidence) for r in G.heuristic(tokens, best).orderBy("idx").collect()]
    assert got == [("OPEN_REPLACE", 0.75), ("KEEP", 1.0), ("KEEP", 0.98), ("KEEP", 0.98), ("OPEN_REPLACE", 0.75), ("OPEN_REPLACE", 0.75), ("OPEN_REPLACE", 0.9)]
    words = spark.createDataFrame([("나았다", "낳았다"), ("나았다", "나았다"), ("나았다", "나 았다"), ("나았다", "[MASK]"), ("나았다", "좋겠다"), ("나았다고", "낳았다구"), ("나았다고요", "낳았다구요"), ("나았다", None)], "a STRING, b STRING")
    assert [r[0] for r in words.select(C.valid_surface(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False, False, True, False]


def test_kept_lemma_edges(spark):
    schema = "lemma STRING, target STRING, pos STRING, frequency BIGINT, similarity DOUBLE, slots ARRAY<STRING>, interface_stats MAP<STRING, BIGINT>"
    rows = [("가다", "나다", "VV", 9, 0.55, [], {"generic": 9}), ("가다", "다다", "VV", 9, 0.55, [], {"voice": 9}), ("가다", "라다", "VV", 4, 0.9, [], {"voice": 2, "keyboard": 2}), ("가다", "마다", "VV", 4, 0.9, [], {"voice": 1, "keyboard": 3}), ("가다", "바다", "VV", 1, 0.9, [], {}), ("가다", "사다", "VV", 2, 0.9, [], None)]
    assert [(r.target, r["rank"]) for r in mining.kept_lemma_edges(spark.createDataFrame(rows, schema)).orderBy("rank").collect()] == [("다다", 1), ("마다", 2), ("사다", 3)]


def test_rule_tables(spark, tmp_path):
    tables = assets.rule_tables(table(spark, FOLDER, "corpus_records"), table(spark, FOLDER, "typed_confusion_graph"), 3)
    counts = assets.write_rules(tables, str(tmp_path))
    assert counts["surface_fixes"] >= 25 and counts["confusion_edges"] > 0 and set(counts) == set(tables)
    assert readers.asset(spark, str(tmp_path / "surface_fixes.json"), "src STRING, dst STRING, confidence DOUBLE").count() == counts["surface_fixes"]


def test_requests(spark, tmp_path):
    bodies = ['{"text":"가나","mode":"inspect"}', '{"text":"가나","cursor":9}', '{"text":""}', "{", '{"cursor":1}', '{"text":"' + "가" * 5001 + '"}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id INT, value STRING")
    got = [(r.text, r.cursor_pos, r.mode, r.problem) for r in readers.requests(df).orderBy("id").collect()]
    assert got == [("가나", 2, "inspect", None), ("가나", 2, "realtime", None), ("", 0, "realtime", None), (None, None, "realtime", "no text"), (None, None, "realtime", "no text"), (None, None, "realtime", "more than 5000 characters")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(bodies), encoding="utf-8")
    query = readers.requests(spark.readStream.text(str(tmp_path / "in"))).writeStream.format("memory").queryName("asked").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("asked").where("problem is null").count() == 3


def test_context_terms(spark):
    df = spark.createDataFrame([("동생이 시장에서 사과를, 어제 샀다 그래 A",)], "t STRING")
    toks = F.regexp_extract_all("t", F.lit("[가-힣A-Za-z0-9]+|[^\\s]"), F.lit(0))
    near = {x.tok: x.terms for x in df.select(T.near_words(toks).alias("w")).first().w}
    assert near["사과를"] == ["동생", "시장", "어제", "샀다"] and near["A"] == ["어제", "샀다", "그래"]
    assert df.select(T.span_terms(F.col("t"), F.lit("사과를,"))).first()[0] == near["사과를"] and df.select(T.span_terms(F.col("t"), F.lit("없다"))).first()[0] == []
