"""Mixtures: permutations, packing, caps and reports."""

from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from maldadum.llm import mixing as X, tokens as K


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**62))
def test_permutation(size, key):
    there = X.permute(np.arange(size), size, key)
    assert sorted(there.tolist()) == list(range(size)) and X.permute(there, size, key, back=True).tolist() == list(range(size))


def tables(spark):
    docs = [(i, ("가나다 라마 " * (1 + i % 7)).strip() if i % 11 else None, ("big", " BIG", "small", "tiny ", None, "other")[i % 6]) for i in range(600)]
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 1), ("absent", 0.0, 2), ("gone", 0.1, 0)]
    return spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING"), spark.createDataFrame(targets, "source STRING, target_share DOUBLE, max_repeats INT"), docs


def test_mixture(spark):
    docs, targets, raw = tables(spark)
    mix, report = X.mixture(docs, targets, shards=3, block=16)
    rep = {r.source: r for r in report.collect()}
    path = f"{K.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    sizes = dict(zip([d[0] for d in raw], K.count_batch([d[1] for d in raw], path).tolist()))
    of = lambda name: sum(sizes[d[0]] for d in raw if (d[2] or "").strip().lower() == name)
    total = of("big") + of("small") + of("tiny")
    for name, share, repeats in (("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 1), ("absent", 0.0, 2), ("gone", 0.1, 0)):
        assert rep[name].n_tokens == of(name) and rep[name].short == (of(name) * repeats < share * total)
    rows = mix.collect()
    turns = {}
    for r in rows:
        turns.setdefault((r.source, r.block), set()).add((r.slot, r.turn))
    for (source, _), used in turns.items():
        assert len(used) <= rep[source].max_repeats and all(t < rep[source].max_repeats for _, t in used)
    assert Counter(s for s, _, _ in {(r.source, r.slot, r.block) for r in rows}) == {k: v.slots_granted for k, v in rep.items() if v.slots_granted}
    # a slot's tokens are those of its parts, and the report counts tokens
    ids = {d[0]: x for d, x in zip(raw, K.encode_batch([d[1] for d in raw], path).to_pylist())}
    assert all(r.ids == [t for p in r.parts for t in ids[p.key][p.token_from : p.token_to]] and 0 < len(r.ids) <= 16 for r in rows)
    granted = Counter()
    for r in rows:
        granted[r.source] += len(r.ids)
    assert {k: v.tokens_granted for k, v in rep.items() if v.tokens_granted} == dict(granted)
    assert all(abs(v.actual_share - granted[k] / sum(granted.values())) < 1e-12 for k, v in rep.items())
    assert all(len(r.ids) == 16 for r in rows if r.block < rep[r.source].n_blocks - 1)


def test_small_and_doubly_listed(spark):
    """Less than a block gives one block; a source listed twice counts once in the total; equal keys are documents of their own."""
    docs = spark.createDataFrame([(1, "가나다", "a"), (1, "가나다 라", "A ")], "doc_id BIGINT, text STRING, source STRING")
    targets = spark.createDataFrame([("a", 0.5, 1), ("A", 0.5, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    mix, report = X.mixture(docs, targets, shards=2)
    n = int(sum(K.count_batch(["가나다", "가나다 라"], f"{K.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")))
    assert all(r.n_tokens == n and not r.short for r in report.collect())
    assert [len(r.ids) for r in mix.collect()] == [n]


def test_packing_is_whole(spark, monkeypatch):
    """Every token of every listed document once, and blocks without gaps, however places are joined."""
    docs, targets, _ = tables(spark)
    want = {r.doc_id: r.n_tokens for r in X.sized_documents(docs, "doc_id").where("source in ('big', 'small', 'tiny') and n_tokens > 0").collect()}
    for limit in (X.BROADCAST_PLACES, 0):
        monkeypatch.setattr(X, "BROADCAST_PLACES", limit)
        parts = X.packed(X.encoded_documents(docs.repartition(3), "doc_id", targets), 16).collect()
        got, room = Counter(), {}
        for r in parts:
            got[r.key] += r.token_to - r.token_from
            room.setdefault((r.source, r.block), []).append((r["at"], r["at"] + r.token_to - r.token_from))
        assert dict(got) == want
        for spans in room.values():
            assert sorted(spans)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:])) and sorted(spans)[-1][1] <= 16


def test_nothing(spark):
    docs, targets, _ = tables(spark)
    mix, report = X.mixture(docs.limit(0), targets, shards=2)
    assert mix.count() == 0 and report.where("short").count() == 0 and report.count() == 5
    mix, report = X.mixture(docs, targets.limit(0), shards=2)
    assert mix.count() == 0 and report.count() == 0
