"""Text, similarity and span functions against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from maldadum import vocab
from maldadum.functions import similarity as S, spans as P, text as T

TEXTS = ["아기를 나았다. RTX 4060  사면됨?", "가도되요? a@b.co 010-1234-5678 #태그 https://x.y/z 2를 3.5", "", " ", "AirPods Pro 2를 삿어요 12,5", "\n줄\t바꿈 ㅋㅋ!!", "맞춤법 교정기 맞춤법", "@이름.a https://a b", "되요되요 잇어요", "x" * 300]


def strings(n=150):
    random.seed(2)
    return [("".join(random.choices("가각간나낳낫a1 ", k=random.randint(0, 7))), "".join(random.choices("가각간나낳낫a1 ", k=random.randint(0, 7)))) for _ in range(n)] + [("되요", "돼요"), ("낳", "나"), ("같다", "같다")]


def prefix_suffix(a, b):
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p, s


def char_sim(a, b):
    if a == b:
        return 1.0
    x, y = ord(a) - 0xAC00, ord(b) - 0xAC00
    if not (0 <= x < 11172 and 0 <= y < 11172):
        return 0.0
    return sum(p == q for p, q in zip((x // 588, x % 588 // 28, x % 28), (y // 588, y % 588 // 28, y % 28))) / 3


def typo(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    p, s = prefix_suffix(a, b)
    x, y = a[p : len(a) - s], b[p : len(b) - s]
    core = sum(char_sim(c, d) for c, d in zip(x, y)) / max(len(x), len(y)) if x and y else 0.0
    return 0.55 * (p + s) / max(len(a), len(b)) + 0.45 * core


def test_similarities(spark):
    pairs = strings()
    df = spark.createDataFrame(pairs, "a STRING, b STRING")
    a, b = F.col("a"), F.col("b")
    p = S.shared_prefix(a, b)
    for r in df.select("a", "b", p.alias("p"), S.shared_suffix(a, b, p).alias("s"), S.typo_similarity(a, b).alias("typo"), S.surface_similarity(a, b).alias("surface"), S.phrase_similarity(a, b).alias("phrase"), S.matcher_ratio(a, b).alias("ratio")).collect():
        assert (r.p, r.s) == prefix_suffix(r.a, r.b)
        assert r.typo == pytest.approx(typo(r.a, r.b), abs=6e-5)
        assert 0 <= r.surface <= 1 and (r.surface == 1) == (re.sub("^[^가-힣A-Za-z0-9]+|[^가-힣A-Za-z0-9]+$", "", r.a) == re.sub("^[^가-힣A-Za-z0-9]+|[^가-힣A-Za-z0-9]+$", "", r.b) != "")
        from difflib import SequenceMatcher

        assert r.ratio == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio())
    nulls = spark.createDataFrame([(None, "a"), ("a", None)], "a STRING, b STRING")
    assert all(v is None for row in nulls.select(S.typo_similarity(a, b), S.matcher_ratio(a, b), F.levenshtein(a, b)).collect() for v in row)


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "k INT, t STRING")
    for pattern in (vocab.TOKEN, r"\S+"):
        folded = {r.k: r.o for r in df.select("k", T.tokens(F.col("t"), pattern).alias("o")).collect()}
        rows = {}
        for r in T.explode_tokens(df, "k", "t", pattern).collect():
            rows.setdefault(r.k, []).append((r.tok, r.st, r.ed))
        for i, t in enumerate(TEXTS):
            want = [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, t)]
            assert [tuple(x) for x in folded[i]] == want and rows.get(i, []) == want
        assert folded[len(TEXTS)] is None


def spans_by_re(text):
    patterns = [("URL", r"https?://[^\s]+"), ("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"), ("PHONE", r"\b\d{2,4}-\d{3,4}-\d{4}\b"), ("HASHTAG", r"#[\w가-힣]+"), ("MENTION", r"@[\w가-힣._-]+"), ("NUMBER", r"\b\d+(?:[.,]\d+)?\b")]
    patterns += [("ENTITY", re.escape(x)) for x in vocab.ENTITIES] + [("USER_DICT", re.escape(x)) for x in vocab.USER_TERMS]
    found = sorted((m.start(), m.end(), kind) for kind, p in patterns for m in re.finditer(p, text))
    out = []
    for a, b, kind in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, kind))
    return out


def test_protected_and_masked(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    t = F.col("t")
    for r in df.select("t", P.protected(t).alias("s"), P.masked(t, P.protected(t)).alias("m")).collect():
        want = spans_by_re(r.t)
        assert [(x.st, x.ed, x.kind) for x in r.s] == want and all(x.text == r.t[x.st : x.ed] for x in r.s)
        out, at = "", 0
        for i, (a, b, kind) in enumerate(want):
            out, at = out + r.t[at:a] + f"__{kind}_{i}__", b
        assert r.m == out + r.t[at:]


def test_edits(spark):
    rules = [("되요", "돼요", 0.99), ("되요되", "X", 0.5), ("잇어요", "있어요", 0.96), ("2", "two", 0.9)]
    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    t = F.col("t")
    chosen = P.non_overlapping(P.rule_edits(t, rules, P.protected(t)))
    for r in df.select("t", chosen.alias("e"), P.applied(t, chosen).alias("out")).collect():
        guard = spans_by_re(r.t)
        all_edits = [(m.start(), -m.end(), -c, d, s) for s, d, c in rules for m in re.finditer(re.escape(s), r.t) if not any(m.start() < b and a < m.end() for a, b, _ in guard)]
        kept, last = [], 0
        for st, back, _, dst, _ in sorted(all_edits):
            if st >= last or not kept:
                kept.append((st, -back, dst))
                last = -back
        assert [(x.st, x.ed, x.dst) for x in r.e] == kept
        out, at = "", 0
        for a, b, d in kept:
            out, at = out + r.t[at:a] + d, b
        assert r.out == out + r.t[at:]
    from maldadum.operators.rules import scan_rules

    one_pass = scan_rules(df.withColumn("spans", P.protected(t)), "t", rules, "spans")
    expressions = {r.t: r.e for r in df.select("t", chosen.alias("e")).collect()}
    assert {r.t: [tuple(e) for e in r.edits] for r in one_pass.collect()} == {k: [tuple(e) for e in v] for k, v in expressions.items()}
    nothing = spark.createDataFrame([(None,), ("",)], "t STRING")
    assert [r.edits for r in scan_rules(nothing, "t", rules).collect()] == [[], []] and scan_rules(df, "t", []).where("size(edits) > 0").count() == 0


def test_insertion_points(spark):
    cases = [("할수있다", "할 수 있다", [1, 2]), ("같다", "같다", []), ("어 부가", "어부가", []), ("가나 다", "가 나다", [1]), ("가", "나", []), ("", "", [])]
    df = spark.createDataFrame([c[:2] for c in cases], "a STRING, b STRING")
    assert [r[0] for r in df.select(P.insertion_points(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_predicates(spark):
    pairs = [("할수", "할 수"), ("가.", "가"), ("가", "가"), ("가 .", "가!"), ("가", "나"), ("", " ")]
    df = spark.createDataFrame(pairs, "a STRING, b STRING")
    bare = lambda x: "".join(c for c in x if not c.isspace() and not unicodedata.category(c).startswith("P"))
    for r in df.select("a", "b", T.punctuation_only(F.col("a"), F.col("b")).alias("p"), T.spacing_only(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.p == (r.a != r.b and bare(r.a) == bare(r.b)) and r.s == (r.a != r.b and r.a.replace(" ", "") == r.b.replace(" ", ""))


def test_clauses(spark):
    cases = [("앞. 뒤를 친다", None, 2, " 뒤를 친다"), ("앞. 끝.", None, 2, " 끝."), ("가나다", 2, 0, "가나"), ("", None, 0, ""), ("가" * 200, None, 72, "가" * 128), ("가,나", 99, 2, "나"), ("가", -5, 0, "")]
    df = spark.createDataFrame([c[:2] for c in cases], "t STRING, c INT")
    start, clause = T.clause_at(F.col("t"), F.col("c"))
    assert [tuple(r) for r in df.select(start, clause).collect()] == [c[2:] for c in cases]


def test_particles(spark):
    df = spark.createDataFrame([("동생이",), ("학교에서",), ("나는",), ("RTX는",), ("(책을)",), ("",)], "t STRING")
    assert [r[0] for r in df.select(T.strip_particle(F.col("t"))).collect()] == ["동생", "학교", "나는", "RTX는", "책을", ""]
