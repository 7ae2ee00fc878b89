"""Consistent forms: what is a case and what is not."""

import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from maldadum.llm import confusables as C


def nfd(text):
    return unicodedata.normalize("NFD", text)


CASES = [
    (nfd("café"), unicodedata.normalize("NFC", "café")), (nfd("봄에"), "봄에"), ("각", "각"), ("ᄏᄏ", "ㅋㅋ"), ("ﾾﾾ", "ㅎㅎ"), ("１２", "12"), ("Ｗｉ－Ｆｉ", "Wi-Fi"),
    ("a b", "a b"), ("a　b", "a b"), ("a b c", "a b c"), ("소­독", "소독"), ("﻿안", "안"), ("᠎한", "한"), ("가‍나", "가나"), ("가️", "가"), ("ㅤ", ""),
    ("Ηοmе", "Home"), ("ЅΝЅ를", "SNS를"), ("ОТΤ", "OTT"), ("ΡС를", "PC를"), ("сafé", "café"), ("Züriсh", "Zürich"), ("сор", "cop"),
]
MIXED = [
    ("Москвa", "Москва"), ("привеt", "привет"), ("кoт", "кот"), ("кafe", "kafe"), ("Ζαgreb", "Zagreb"), ("λόγoς", "λόγος"), ("раураl", "paypal"), ("αx", "ax"), ("Аррlе", "Apple"),
    ("\U0001d407\U0001d41e\U0001d425\U0001d425\U0001d428", "Hello"), ("ⲟpen", "open"), ("ꓮpple", "Apple"), ("ɑpple", "apple"), ("ＡΒС", "ABC"),
]
KEPT = ["", "ㅋㅋㅋ ㅠㅠ", "① ㎏ ½ … 大 ℃ ㎡", "\U0001f468‍\U0001f469‍\U0001f467", "☀️", "1️⃣", "\U0001f1f0\U0001f1f7", "\U0001f469\U0001f3fd‍\U0001f4bb", "naïve Zürich Señor", "мир язык привет", "λόγος", "日本語 かな", "안녕\t\r\n", "“말” ‘말’ – — ·", "™ © ®", "ﬁ"]


@pytest.fixture(scope="module")
def public(spark):
    return C.Spelling(C.public_twins(spark))


@pytest.mark.parametrize(("text", "form"), CASES + MIXED[:6] + [(t, t) for t in (unicodedata.normalize("NFC", k) for k in KEPT)])
def test_forms_of_fixed_values(text, form):
    assert C.normalize(text) == form


@pytest.mark.parametrize(("text", "form"), CASES + MIXED + [(t, t) for t in (unicodedata.normalize("NFC", k) for k in [*KEPT, "Δt πr λx μm", "ısı", "ʃɑ", "ספר", "рыба"])])
def test_forms(public, text, form):
    assert public.normalize(text) == form
    assert public.normalize(form) == form


def test_script_sets(public):
    assert public.resolved("о") >= {"Latin", "Cyrillic", "Greek"} and public.resolved("п") == {"Cyrillic"} and public.resolved("к") == {"Cyrillic"}
    assert "Latin" in public.resolved("к", roughly=True) and C.scripts("한") == {"other"}
    assert len(public.twins) > 150 and len(public.twins) < 2000


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=12) | st.text("가나abctrАВСаосптκπερ각́​ Ａ ", max_size=12))
def test_normalizing_again_changes_nothing(public, text):
    for spelling in (C.FIXED, public):
        once = spelling.normalize(text)
        assert spelling.normalize(once) == once


def test_frame(spark):
    rows = [(1, "가​", None, [("a b",), (None,), ("",)]), (2, None, "", None), (3, "보통 글", "보통 글", []), (1, "가​", None, [("a b",)]), (None, "x" * 200_000 + "１", None, None)]
    df = spark.createDataFrame(rows, "rec_no BIGINT, err_sentence STRING, cor_sentence STRING, errors ARRAY<STRUCT<err_text: STRING>>").selectExpr("*", "'x' AS value", "1 AS field")
    got = [tuple(r) for r in C.stand_ins(C.record_values(df), "value", "rec_no", "field", "err_pos").collect()]
    assert sorted(got, key=str) == sorted([(1, "err_sentence", -1), (1, "err_text", 0), (1, "err_sentence", -1), (1, "err_text", 0), (None, "err_sentence", -1)], key=str)
    assert C.stand_ins(C.record_values(df.limit(0)), "value", "rec_no").count() == 0


def test_jvm_side_passes_over_no_case(spark):
    texts = [t for t, _ in CASES]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert df.where(C.suspicious(df.t)).count() == len(texts)
