"""Kinds of documents and their figures."""

import pytest
from hypothesis import given, settings, strategies as st

from maldadum.llm import quality as Q

PROSE = "어제 시장에서 동생이 사과를 샀어요. 그리고 집에 와서 모두 나눠 먹었습니다."
CASES = [
    (PROSE, None), (PROSE.replace(".", ""), None), ("\n".join(f"{i}. {PROSE}" for i in range(4)), None), ("\n".join(f"> {PROSE}" for _ in range(2)), None),
    (PROSE * 3 + "\nhttps://a.invalid/1", None), (PROSE * 4 + "\n- 사과\n- 배\n- 감", None), (PROSE * 4 + "\n이름 | 수량\n사과 | 3\n배 | 4", None), ("ㅋㅋㅋ 오늘 뭐해? 나는 집에 있어 ㅠㅠ", None),
    ("살 것:\n- 사과\n- 배 2개\n- 감\n- 주문하기", "list"), ("사과\n배\n신청서 2장\n구매하기\n둥근 거울", "list"), ("1) 사과\n2) 배와 감\n3) 조사하기", "list"), ("사과, 배, 감 2개, 귤, 주문하기, 둥근 거울", "list"), ("[x] 이불\n[ ] 거울\n[ ] 자전거 3대", "list"),
    ("준비물, 시험지, 감자 3통, 편지, 우편함, 까만 북, 도화지, 주문하기", "list"), ("!?#%&*() - = + ~~ !!", "junk"), ("비가 온다.\n물론 나는 간다.\n그래도 봄이다.\n이미 늦었다.", None),
    ("품목,수량,장소\n사과,3,시장\n배,4,창고", "table"), ("품목\t수량\n사과\t3\n배\t4\n감\t5", "table"), ("| 품목 | 수량 |\n|---|---|\n| 사과 | 3 |\n| 배 | 4 |", "table"), ("품목   수량   장소\n사과   3   시장\n   4   창고", "table"),
    ("된장 " * 40, "junk"), ("~~~~~ ===== %%%%% @@@@@", "junk"), ("6YrtpoTdEKGzWibGKuvAi8FgAobdPFEKIBZSL0kN\nc/WGg5GXe/KPisIUzJHANJo6Yakvlw", "junk"), ("ㅍㅇㄴㅁㄹ ㅈㄷㄱㅁㅇㅌㅈ ㅇㅈㄷ ㅂㅍㅈ", "junk"),
    ("http://a.invalid/1\nhttp://b.invalid/2", "junk"), ('<td class="c1">이전\n<li class="c2">&nbsp;\n<div class="c3">', "junk"), ("킾슂 뵲쫹픺칽 뻾곾캵흻튱뾔 뎬큋졎", "junk"), ("가위 안내문".encode().decode("latin-1"), "junk"),
]


@pytest.mark.parametrize(("text", "kind"), CASES)
def test_kinds(text, kind):
    assert Q.statistics(text)["doc_kind"] == kind


def test_figures():
    s = Q.statistics("가나 다라.\n가나 다라.\n\n마바")
    assert (s["n_words"], s["n_lines"]) == (5, 3)
    assert s["mean_word_length"] == 12 / 5 and s["symbol_ratio"] == 2 / 12 and s["punctuated_lines"] == 2 / 3
    assert s["duplicate_lines"] == pytest.approx(1 / 3) and s["duplicate_paragraphs"] == 0 and s["dominant_ngram"] == 10 / 12


def brute_cover(words):
    best = 0
    for n in (1, 2, 3, 4):
        for gram in {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}:
            at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) == gram]
            if len(at) > 1:
                best = max(best, sum(len(words[k]) for k in {j for i in at for j in range(i, i + n)}))
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["가", "나나", "다다다", "abcd"]), min_size=1, max_size=25))
def test_dominant_ngram_covers_each_character_once(words):
    solid = sum(map(len, words))
    assert Q._dominant(words, solid) == pytest.approx(brute_cover(words) / solid)


def test_a_word_said_many_times_is_no_junk():
    text = PROSE + " 정말" * 9 + " " + PROSE.replace("어제", "그제") + " 그런데 내일은 비가 온다고 하니까 우산을 챙겨야 합니다."
    assert Q.statistics(text)["dominant_ngram"] < 0.5 and Q.statistics(text)["doc_kind"] is None


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, PROSE), (4, PROSE), (None, "사과\n배\n감\n귤"), (5, "말 " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 AS n_words", "'x' AS doc_kind")
    got = Q.document_statistics(df, "doc_id", "text").collect()
    assert len(got) == 7 and sorted(str(r.doc_kind) for r in got) == ["None"] * 5 + ["junk", "list"]
    assert all(r.n_words == 0 and r.mean_word_length is None for r in got if r.doc_id in (1, 2, 3))
    assert Q.document_statistics(df.limit(0), "doc_id", "text").count() == 0
