"""Trie encoding against the public library and round trips."""

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from maldadum.llm import tokens as K

PATH = f"{K.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


SAMPLES = ["", " ", "\n\n  \t", "안녕하세요 세상", "The quick brown fox's tail", "ㅋㅋㅋㅋ ㅠㅠ", "👩‍💻 café é", "a" * 5000, "<|endoftext|>", "x\x1cy z　w", "1234567 89.5", "힣" * 300]


def test_samples(reference):
    assert K.encode_batch([*SAMPLES, None], PATH).to_pylist() == [reference.encode_ordinary(t) for t in SAMPLES] + [[]]
    assert K.count_batch([*SAMPLES, None], PATH).tolist() == [len(reference.encode_ordinary(t)) for t in SAMPLES] + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40) | st.text("abcdeghinorst '가나다에서 \n0129!?", max_size=60))
def test_any_text(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))} if not hasattr(test_any_text, "enc") else None
    if ranks:
        test_any_text.enc = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = K.encode_batch([text], PATH).to_pylist()[0]
    assert ids == test_any_text.enc.encode_ordinary(text)
    assert test_any_text.enc.decode(ids) == text


def test_memory_is_refilled_when_full(reference, monkeypatch):
    monkeypatch.setattr(K, "CACHE_WORDS", 50)
    random.seed(1)
    texts = [" ".join("".join(random.choices("가나다라마바사", k=3)) for _ in range(40)) for _ in range(30)]
    for t in texts:
        assert K.encode_batch([t], PATH).to_pylist()[0] == reference.encode_ordinary(t)
    assert K.encode_batch(texts, PATH).to_pylist() == [reference.encode_ordinary(t) for t in texts]


def test_frame(spark, reference):
    rows = [(1, "가 나", 5), (1, "가 나", 5), (2, None, None), (None, "", 7), (3, "말 " * 20000, 1)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids INT")
    got = K.encode(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == sorted((r[0] or 0, len(reference.encode_ordinary(r[1] or ""))) for r in rows)
    assert K.encode(df.limit(0), "doc_id", "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert K.token_counts(df, "text", "doc_id", "ids").count() == 5
