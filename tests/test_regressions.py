"""Whole corrections by rules, phrases and heuristics alone: cases with the text expected, and which of them need a model."""

import pytest

from maldadum.operators import pipeline as L
from maldadum.plans.ranking_queries import graph_edges
from oracle import FOLDER

# Text, expected part, column, parts that must not occur.
CASES = [
    ("아기를 나았다", "낳았다", "suggested_text", []),
    ("아기를 나을 수 있을까?", "낳을 수", "suggested_text", []),
    ("감기 낳앗으면 좋겟다", "나았으면", "suggested_text", []),
    ("선생님이 답을 가르켰다", "가르쳤다", "suggested_text", []),
    ("지금 v2인가? 교정이됀건가? 이 문장을 테스트해바", "교정이 된 건가? 이 문장을 테스트해 봐", "suggested_text", []),
    ("내일 회의 내용을 다시한번 확인하자", "다시 한 번", "suggested_text", []),
    ("학교를 갔다", "학교를 갔다", "final_text", []),
    ("문제가 다르다", "문제가 다르다", "final_text", []),
    ("시간을 맞혀서 오세요", "시간을 맞춰서 오세요", "suggested_text", ["보세요"]),
    ("이 약을 먹으면 병이 금방 낮는다", "이 약을 먹으면 병이 금방 낫는다", "suggested_text", ["막으면"]),
    ("병원을 갔다 오는 길이다", "병원을 갔다 오는 길이다", "suggested_text", ["오늘 길이다", "보는 길이다"]),
    ("회의 시간에 마춰서 자료를 보내주세요", "맞춰서", "suggested_text", ["마 춰서"]),
    ("문제를 마추고 집에 갔다", "맞히고", "suggested_text", ["마 주고", "마 추고"]),
    ("정답을 맞췄다", "정답을 맞혔다", "suggested_text", []),
    ("정답을 맞추었다", "정답을 맞혔다", "suggested_text", []),
    ("동생이 아파서 약을 먹고 많이 낮아졌다", "나아졌다", "suggested_text", []),
    ("기온이 빨리 나아졌으면 좋겠다", "나아졌으면", "suggested_text", ["낳아졌으면", "나가졌으면", "나어졌으면"]),
    ("기온이 많이 낮아졌다", "기온이 많이 낮아졌다", "final_text", ["나아졌다"]),
    ("시간을 맞혀서 와라", "시간을 맞춰서 와라", "suggested_text", ["보세요"]),
    ("시간을 맞춰서 와라", "시간을 맞춰서 와라", "suggested_text", ["맞혀서"]),
    ("왠지 오늘은 기분이 좋다", "왠지 오늘은 기분이 좋다", "final_text", ["웬지"]),
    ("정답을 맞혔다", "정답을 맞혔다", "suggested_text", ["맞췄다", "맞추었다"]),
    ("웬일로 이렇게 일찍 왔어", "웬일로 이렇게 일찍 왔어", "final_text", []),
    ("짐을 바닦에 내려놨다", "짐을 바닥에 내려 놨다", "suggested_text", []),
    ("어제 본 사람이 오늘도 같은 자리에 안자 있었다", "앉아 있었다", "suggested_text", []),
    ("아기를 나을 수 있을까? 낳다야 낫다야?", "아기를 낳을 수 있을까? 낳다야 낫다야?", "suggested_text", ["낳다이", "낫다냐"]),
]
#: Cases that need morphology, a tagger or a spacing model.
NEED_MODELS = {0, 1, 2, 3, 4, 5, 23, 25}


@pytest.fixture(scope="module")
def answers(spark):
    requests = spark.createDataFrame([(i, c[0], None, "inspect") for i, c in enumerate(CASES)], "doc_id BIGINT, text STRING, cursor_pos INT, mode STRING")
    return {r.doc_id: r for r in L.correct(requests, graph_edges(spark, FOLDER)).collect()}


def passed(answers, i):
    _, expected, column, forbidden = CASES[i]
    said = answers[i][column]
    return expected in said and not any(f in said for f in forbidden)


@pytest.mark.parametrize("i", [i for i in range(len(CASES)) if i not in NEED_MODELS])
def test_case(answers, i):
    assert passed(answers, i), answers[i]


def test_count(answers):
    n = sum(passed(answers, i) for i in range(len(CASES)))
    print(f"{n} of {len(CASES)} regression cases pass without models")
    assert n >= len(CASES) - len(NEED_MODELS)
