"""Examples, candidates, proposals and requests."""

import itertools
import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maldadum import vocab
from maldadum.functions import text as T
from maldadum.operators import candidates as C, decode as D, labels as L
from maldadum.sources import readers
from maldadum.streaming import requests as R

DETAILS = readers.DETAILS


def records(spark, rows):
    return spark.createDataFrame(rows, f"rec_no BIGINT, id STRING, split STRING, error_type STRING, source STRING, err_sentence STRING, cor_sentence STRING, error_count INT, errors {readers.ERRORS}")


def entry(idx, place, err, cor, details=None):
    return (idx, place, err, cor, 1, details)


def test_examples(spark):
    rows = [
        (1, "a", "train", "t", "s", "몇일 전에 할수 있다", "며칠 전에 할 수 있다", 2, [entry(1, 2, "할수", "할 수"), entry(0, 0, "몇일", "며칠")]),
        (2, "b", "train", "t", "s", "가 가 가", "가 나 다", 2, [entry(None, None, "가", "나"), entry(0, 0, "가", "다", ("tags", ["띄어쓰기"], None, None))]),
        (3, "c", "train", "t", None, "끝.", "끝", 1, [entry(0, 0, "끝.", "끝")]),
        (4, "d", "train", "t", "s", None, None, None, None),
        (5, "e", "train", "t", "s", "없는 말", "없는 말", 1, [entry(0, 1, "다른", "말"), entry(1, 9, "또", "x"), entry(2, None, None, None)]),
    ]
    got = {r.id: r for r in L.examples(records(spark, rows)).collect()}
    assert got["a:noisy"].labels == ["OPEN_REPLACE", "KEEP", "SPACE_FIX", "KEEP"] and got["a:noisy"].token_offsets == [[0, 2], [3, 5], [6, 8], [9, 11]]
    assert got["b:noisy"].labels == ["SPACE_FIX", "OPEN_REPLACE", "KEEP"] and got["b:noisy"].located_error_count == 2
    assert "c:noisy" not in got and got["c:clean"].labels == ["KEEP"] and "d:clean" not in got
    assert got["e:noisy"].labels == ["KEEP", "OPEN_REPLACE"]
    assert L.examples(records(spark, [])).count() == 0


def test_dedupe_and_balance(spark):
    rows = [(i, ("noisy", "clean")[i % 3 > 0], "train" if i < 70 else "validation", f"t{i % 20}", ["KEEP"]) for i in range(100)]
    df = spark.createDataFrame(rows, "ex_no BIGINT, variant STRING, split STRING, text STRING, labels ARRAY<STRING>")
    assert L.deduplicated(df, "ex_no").count() == 20
    out = L.balanced(df, "ex_no", 0.5).collect()
    for split in ("train", "validation"):
        noisy, clean = ([r.ex_no for r in out if r.split == split and r.variant == v] for v in ("noisy", "clean"))
        assert len(clean) == len(noisy) // 2 and clean and sorted(clean) == [r[0] for r in rows if r[1] == "clean" and r[2] == split][: len(clean)]


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "gold STRING, pred STRING")
    assert L.token_metrics(empty).first()[:] == (0, *[0.0] * 11)


def test_similar_equals_all_pairs(spark):
    random.seed(6)
    words = sorted({"".join(random.choices("가각나낳다", k=random.randint(1, 5))) for _ in range(60)})
    toks, known = spark.createDataFrame([(w,) for w in words[::2]] + [(None,), ("",)], "tok STRING"), spark.createDataFrame([(w,) for w in words] + [(None,)], "src STRING")
    got = {(r.tok, r.src) for r in C.similar(toks, known, 0.5, 2, 1000).collect()}
    from test_functions import typo

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    want = {(a, b) for a in words[::2] for b in words if a != b and a[0] == b[0] and abs(len(a) - len(b)) <= 1 and edits(a, b) <= 2 and round(typo(a, b), 4) >= 0.5}
    assert got == want


def test_similar_meets_on_equal_parts(spark):
    """With the bounds in use words meet on parts that no replaced letter touches, and no pair is lost."""
    from test_functions import typo

    random.seed(8)
    base = ["".join(random.choices("가각나낳다라마바", k=random.choice([2, 4, 5, 6, 8, 11, 12, 14, 20, 30, 31, 32]))) for _ in range(70)]
    words = set(base)
    for w in base:
        for _ in range(4):
            v = list(w)
            for _ in range(random.randint(1, 2)):
                v[random.randrange(1, len(v))] = random.choice("가각간갈나난낫낳")
            words.add("".join(v))
        words |= {w + "가", w[:-1]}
    words = sorted(w for w in words if w)
    toks, known = spark.createDataFrame([(w,) for w in words[::2]], "tok STRING"), spark.createDataFrame([(w,) for w in words], "src STRING")
    got = {(r.tok, r.src) for r in C.similar(toks, known, limit=10_000).collect()}
    edits = spark.createDataFrame([(a, b) for a in words[::2] for b in words if a != b and a[0] == b[0] and abs(len(a) - len(b)) <= 1], "a STRING, b STRING").where(F.levenshtein("a", "b") <= 2).collect()
    want = {(r.a, r.b) for r in edits if round(typo(r.a, r.b), 4) >= 0.74}
    assert got == want and len(want) > 100


def plain_hint_score(terms, hints):
    matched = 0
    for term in terms:
        matched += sum(n for h, n in hints if h == term)
        if not matched:
            matched += sum(n for h, n in hints if term.startswith(h) or h.startswith(term))
    return round(min(1.0, matched / (sum(n for _, n in hints) or 1)), 4)


def test_scores(spark):
    hint = "array<struct<term:string,count:bigint>>"
    given = [(["책상", "공부"], [("책상을", 3), ("의자", 1)]), (["책", "책상"], [("책상", 3), ("의자", 1)]), (["책상", "책"], [("책상", 3), ("책가방", 1)]), ([], [("책상", 1)]), (["가나"], [("", 2), (None, 1)]), (["가나"], None)]
    bare = lambda hints: [(t.removesuffix("을"), n) for t, n in hints or [] if t]
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(given)], f"i INT, terms ARRAY<STRING>, hints {hint}")
    got = {r.i: r.s for r in df.select("i", C.hint_score(F.col("terms"), C.plain_hints(F.col("hints"))).alias("s")).collect()}
    assert got == {i: plain_hint_score(t, bare(h)) for i, (t, h) in enumerate(given)} and got[1] == 1.0 and got[2] == 0.75
    rows = [({"voice": 3, "generic": 1}, "voice", "voice"), ({}, "generic", None), (None, "keyboard", "keyboard"), (None, "voice", "keyboard"), (None, "generic", "voice"), (None, "keyboard", "voice"), ({"other": 4, "voice": 1}, "voice", None)]
    kinds = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, stats MAP<STRING, BIGINT>, channel STRING, kind STRING")
    got = [r.s for r in kinds.select("i", C.interface_score(F.col("stats"), F.col("channel"), F.col("kind")).alias("s")).orderBy("i").collect()]
    assert got == [0.8275, 0.86, 0.94, 0.72, 0.32, 0.9, 0.2]


_EDGE = "edge_no BIGINT, replacement STRING, contextHints ARRAY<STRUCT<term: STRING, count: BIGINT>>"


def test_hint_scores_in_shards(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_PLACES", 50)
    monkeypatch.setattr(C, "SHARD_PLACES", 40)
    rng = random.Random(5)
    words = ["책상", "책상다리", "책", "의자", "의자를", "금세", "금세라도", "공부방", "비가", "ab책", "12", ",", "😀"]
    sentences = [*{" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(150)}, "", None]
    edges = [(i, rng.choice(words + [None]), None if i % 9 == 0 else [(rng.choice(words + ["", None]), rng.choice((None, 0, 1, 2, 5))) for _ in range(rng.randint(0, 6))]) for i in range(40)]
    given = spark.createDataFrame(edges, _EDGE)
    rows = spark.createDataFrame([(s,) for s in sentences], "s STRING")
    places = [(w.tok, w.terms) for (ws,) in rows.select(T.near_words(F.regexp_extract_all("s", F.lit(vocab.JVM_TOKEN), F.lit(0)))).collect() for w in ws or []]
    bare = {r.edge_no: [(h.term, h["count"]) for h in r.h] for r in given.select("edge_no", C.plain_hints(F.col("contextHints")).alias("h")).collect()}
    want = Counter((i, plain_hint_score(terms, bare[i])) for i, word, _ in edges for tok, terms in places if tok == word)
    got = {(r.edge_no, r.score): r.n for r in C.hint_scores(given, rows, "s").collect()}
    assert got == want and len(want) > 60 and max(Counter(t for t, _ in places).values()) > C.SHARD_PLACES
    terms = pa.chunked_array([[" ".join(t) for _, t in places]])
    hints = pa.chunked_array([[[{"term": t, "count": n} for t, n in bare[i]] for i, *_ in edges]])
    whole, parts = Counter(), Counter()
    for sums, most in ((whole, C._MEETINGS), (parts, 7)):
        monkeypatch.setattr(C, "_MEETINGS", most)
        for e, matched, total, n in C._met(hints, terms):
            for k in zip(e.tolist(), matched.tolist(), total.tolist(), n.tolist()):
                sums[k[:3]] += k[3]
    assert whole == parts and sum(whole.values()) == len(edges) * len(places)


def test_hint_scores_of_a_word_of_many_places_and_edges(spark):
    rng = random.Random(6)
    words = [a + b + c for a in "가나다라마바사아" for b in "고노도로모보소오" for c in "구누두루무부수우"]
    edges = [(i, "금세", [(w, 1) for w in rng.sample(words, 4)]) for i in range(3_000)]
    sentences = [(" ".join((*rng.sample(words, 3), "금세", *rng.sample(words, 3))),) for _ in range(20_000)]
    began = time.monotonic()
    got = C.hint_scores(spark.createDataFrame(edges, _EDGE), spark.createDataFrame(sentences, "s STRING"), "s").groupBy("edge_no").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("s")).collect()
    assert time.monotonic() - began < 45  # when each place was scored with each edge, 60,000,000 times, it took minutes
    near = Counter(w for (s,) in sentences for w in s.split())
    assert {r.edge_no: (r.n, round(4 * r.s)) for r in got} == {i: (20_000, sum(near[w] for w, _ in hints)) for i, _, hints in edges}


def test_prefilter_bounds_and_gates(spark):
    schema = "tok STRING, dst STRING, source STRING, generator DOUBLE, context DOUBLE, interface DOUBLE, support BIGINT, family ARRAY<STRING>"
    low, mid, yes, no = ("가나바사", "가나다러"), ("금새", "금세"), ["금세다"], []
    rows = [
        (*mid, "DATA_CONFUSION", 0.9, 0.0, 0.9, 7, no), (*mid, "DATA_CONFUSION", 0.9, 0.0, 0.9, 8, no), (*mid, "DATA_CONFUSION", 0.9, 0.08, 0.9, 0, no), (*mid, "CONFUSION_SET", 0.9, 0.0, 0.9, 0, no),
        (*mid, "FAMILY_SEED", 0.9, 0.0, 0.9, 13, yes), (*mid, "FAMILY_SEED", 0.9, 0.0, 0.9, 14, yes), (*mid, "AUTO_FAMILY_SEED", 0.9, 0.08, 0.9, 0, yes), (*mid, "MLM_TOPK", 0.1, 0.0, 0.9, 0, no),
        (*low, "CONFUSION_SET", 0.5, 0.0, 0.9, 0, no), (*low, "CONFUSION_SET", 0.72, 0.0, 0.9, 0, no), (*low, "CONFUSION_SET", 0.5, 0.1, 0.9, 0, no), (*low, "INFLECTION_RULE", 0.5, 0.0, 0.9, 0, yes), (*low, "MLM_TOPK", 0.9, 0.9, 0.9, 99, yes),
    ]
    plain = lambda r: (*r[:7], tuple(r[7]))
    kept = C.prefilter(spark.createDataFrame(rows, schema), 99).collect()
    typos = {r.tok: r.typo for r in kept}
    assert 0.48 <= typos["가나바사"] < 0.55 <= typos["금새"] < 0.62
    assert {plain(r[:8]) for r in kept} == {plain(rows[i]) for i in (1, 2, 3, 5, 6, 7, 9, 10, 11)}
    seed = next(r for r in kept if r.source == "FAMILY_SEED")
    assert seed.score == round(0.4 * seed.typo + 0.22 * 0.9 + 0.12 * 0.97 + 0.1 * 0.9, 4)


def test_every_occurrence_is_scored(spark):
    schema = "src STRING, dst STRING, source STRING, generatorScore DOUBLE, interfaceType STRING, pos STRING, lemma STRING, targetLemma STRING, suffixSlots ARRAY<STRING>, contextHints ARRAY<STRUCT<term: STRING, count: BIGINT>>, interfaceStats MAP<STRING, BIGINT>"
    edges = [("금새", "금세", "DATA_CONFUSION", 0.8, "voice", "VV", None, None, ["EF"], [("비가", 1)], {"voice": 1}), ("금새", "금세", "DATA_CONFUSION", 0.9, "generic", None, "나다", "가다", ["EF", "EC"], [("비가", 2), ("해가", 3)], {"voice": 1, "generic": 8}), ("금새", "금세", "DATA_CONFUSION", 0.7, None, None, None, "가다", None, None, None)]
    added = C.added_edges(spark.createDataFrame(edges, schema))
    row = added.select("generator", "kind", "pos", "family", "slots", "hints", "stats").first()
    assert tuple(row) == (0.9, "generic", "VV", ["가다", "나다"], ["EC", "EF"], [("비가", 3), ("해가", 3)], {"voice": 2, "generic": 8})
    places = [("금새", "generic", "1", ["비가", "금세"]), ("금새", "voice", "2", ["금세"]), ("금새", "generic", "2", ["금세"]), ("금새", None, "3", ["해가", "비가"])]
    got = {(r.channel, r.place): (r.context, r.rank) for r in C.scored(spark.createDataFrame(places, "tok STRING, channel STRING, place STRING, terms ARRAY<STRING>"), added, ["tok", "channel", "place"]).collect()}
    assert got == {("generic", "1"): (0.5, 1), ("voice", "2"): (0.0, 1), ("generic", "2"): (0.0, 1), (None, "3"): (1.0, 1)}


def test_beam_is_exhaustive_where_it_can_be():
    random.seed(8)
    for _ in range(60):
        text = "가나다라마바사"
        groups = [{"st": s, "ed": s + 1, "original": text[s], "options": [{"replacement": r, "score": round(random.random(), 3), "apply": True} for r in random.sample("xyz", random.randint(1, 2))] + [{"replacement": text[s], "score": 0.2, "apply": False}]} for s in sorted(random.sample(range(7), 2))]
        best = max(round(sum(o["score"] for o in combo) - 0.04 * max(0, sum(o["apply"] for o in combo) - 1), 4) for combo in itertools.product(*[g["options"] for g in groups]))
        got = D.proposals(text, groups, width=9)
        assert got[0][2] == pytest.approx(best, abs=1e-3) and got == sorted(got, key=lambda p: (-p[2], p[3], p[0]))


def test_decode_edge_cases(spark):
    df = spark.createDataFrame([(1, "가", []), (2, None, None), (3, "가나", [(0, 2, "가나", [("다", 0.9, True)]), (1, 2, "나", [("라", 0.9, True)])])], f"k INT, t STRING, g {D.GROUPS}")
    got = {(r.k, r.rank): (r.proposal, r.n_edits) for r in D.decode(df, "k", "t", "g").collect()}
    assert got == {(1, 1): ("가", 0), (2, 1): ("", 0), (3, 1): ("다", 1)}
    both = D.merged_proposals(D.decode(df, "k", "t", "g"), D.decode(df.where("k = 3"), "k", "t", "g"), "k")
    assert both.count() == 3


def test_requests_batch_and_stream_agree(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(f"u{i % 3}", start + dt.timedelta(minutes=7 * i + (60 if i > 20 else 0)), i) for i in range(40)] + [(None, start, 99), ("u0", None, 98)]
    df = spark.createDataFrame(rows, "writer STRING, ts TIMESTAMP, id BIGINT")
    batch = sorted((str(r.writer), r.n, r["last"]) for r in R.debounced(df, "writer", "ts", "id", "25 minutes").collect())
    assert sum(b[1] for b in batch) == 41 and R.latest(df.where("ts is not null"), "writer", "ts", "id").count() == 4
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = R.debounced(stream, "writer", "ts", "id", "25 minutes").writeStream.outputMode("complete").format("memory").queryName("bursts").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((str(r.writer), r.n, r["last"]) for r in spark.table("bursts").collect()) == batch
    assert R.newest(df, "ts", "id", 3).count() == 3 and R.newest_per_key(df, "writer", "ts", "id", 1).count() == 4


def test_phrases_never_broadcast_the_texts(spark, tmp_path, monkeypatch):
    """Small files hold many tokens: the driver gets the phrases or, where those are large, nothing."""
    texts = ["며칠 동안 것같은 일", "한번쯤 것같은, 며칠 동안 며칠", "며칠", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "rec_no BIGINT, t STRING").write.parquet(str(tmp_path / "rows.parquet"))
    memory = spark.createDataFrame([("것같은", "것 같은", 0.95), ("것같은", "것 같던", 0.9), ("며칠 동안", "몇 날 동안", 0.5), ("며칠", "몇 일", 0.9), (None, "x", 0.9)], "src STRING, dst STRING, confidence DOUBLE")
    expected = [(0, 0, 2, "몇 날 동안"), (0, 2, 1, "것 같은"), (1, 1, 1, "것 같은"), (1, 3, 2, "몇 날 동안"), (1, 5, 1, "몇 일"), (2, 0, 1, "몇 일")]
    for small in (True, False):
        if not small:
            monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
        got = C.phrases(spark.read.parquet(str(tmp_path / "rows.parquet")), "rec_no", "t", memory)
        assert sorted((r.rec_no, r.first, r.n_tokens, r.dst) for r in got.select("rec_no", "first", "n_tokens", "dst").collect()) == expected
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("BuildRight" in plan) == small and ("SortMergeJoin" in plan) != small
    assert C.phrases(spark.read.parquet(str(tmp_path / "rows.parquet")), "rec_no", "t", memory.where("false")).count() == 0
