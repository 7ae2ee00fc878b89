"""Family prior, verifier, reranker, options and policy against plain Python."""

import math
import random

from pyspark.sql import functions as F

from maldadum import vocab
from maldadum.operators import ranking as R

ROW = "g INT, tok STRING, dst STRING, source STRING, generator DOUBLE, norm DOUBLE, score DOUBLE, typo DOUBLE, context DOUBLE, interface DOUBLE, family ARRAY<STRING>, pos STRING, slots ARRAY<STRING>, pos_hints ARRAY<STRING>, slot_hints ARRAY<STRING>, mlm DOUBLE, electra DOUBLE, morph DOUBLE"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def groups(seed, n=120):
    rng = random.Random(seed)
    x = lambda lo=0.0, hi=1.0: round(rng.uniform(lo, hi), 2)
    rows = []
    for g in range(n):
        pos_hints, slot_hints = rng.choice([[], ["VV"], ["VV", "VA"]]), rng.choice([[], ["EC"], ["EF+X"]])
        for i in range(rng.randint(1, 4)):
            norm = x(0.3)
            rows.append((g, "가나다", f"가{chr(0xB098 + 28 * i)}다", rng.choice(["CONFUSION_SET", "MLM_TOPK", "DATA_CONFUSION", "JAMO_FALLBACK"]), norm, norm, x(0.4), x(0.5), rng.choice([0.0, 0.05, 0.1, 0.15, 0.3]), x(0.2),
                         rng.choice([[], ["가다"], ["나다"], ["가다", "나다"]]), rng.choice([None, "VV", "VA-I", "NNG"]), rng.choice([[], ["EC+EF"], ["EF"]]), pos_hints, slot_hints, rng.choice([None, x(-2, 2)]), rng.choice([0.0, x(-0.1, 0.1)]), rng.choice([0.0, x(-3, 3)])))
    return rows


def cents(v):
    return round(v * 10000)


def prior(rows):
    rows = sorted(rows, key=lambda r: (-r["score"], -r["context"], -r["typo"], -r["norm"], r["dst"]))
    best = rows[0]
    for r in rows:
        r["family_match"] = bool(set(r["family"]) & set(best["family"])) or r["dst"] == best["dst"]
    hits = [r for r in rows if r["family_match"]]
    others = sorted((r for r in rows if not r["family_match"]), key=lambda r: (-r["score"], -r["typo"], -r["norm"], r["dst"]))
    return hits + [r for r in others[:1] if cents(r["score"]) >= cents(max(h["score"] for h in hits)) + 800]


def fits(slots, hints):
    return not slots or not hints or any(a == b or a.startswith(b + "+") or b.startswith(a + "+") for a in slots for b in hints)


def verify(rows):
    cur = lambda r: r["source"] in vocab.CURATED_SOURCES
    best = max([r["score"] for r in rows if cur(r)], default=0.0)
    some, out = any(map(cur, rows)), []
    for r in rows:
        pos = not r["pos_hints"] or not r["pos"] or r["pos"].split("-")[0] in r["pos_hints"]
        slot = fits(r["slots"], r["slot_hints"])
        if not pos or not slot and not cur(r):
            continue
        if not r["family_match"] and not cur(r) and r["context"] < 0.18 and cents(r["score"]) < cents(best) + 400:
            continue
        if some and not cur(r) and r["context"] < 0.12 and cents(r["score"]) < cents(best) + 500:
            continue
        if r["typo"] < 0.56 and not r["family_match"] and r["context"] < 0.2:
            continue
        v = 0.42 * r["typo"] + 0.24 * r["norm"] + 0.2 * r["score"] + 0.06 * r["context"] + 0.04 * r["interface"] + 0.08 * r["family_match"] + 0.05 * cur(r) + 0.03 * slot
        out.append({**r, "verifier": round(round(v, 10) + 1e-12, 4)})
    out.sort(key=lambda r: (-r["verifier"], -r["score"], -r["typo"], r["dst"]))
    mine, rest = [r for r in out if cur(r)][:2], [r for r in out if not cur(r)]
    kept = mine + [r for r in rest[:1] if not mine or cents(r["verifier"]) >= cents(mine[0]["verifier"]) + 800] if some else out[:3]
    kept.sort(key=lambda r: (-r["verifier"], -r["context"], -r["score"], -r["typo"], r["dst"]))
    fast = False
    if kept:
        lead, second = kept[0], kept[1]["verifier"] if len(kept) > 1 else 0.0
        gap = cents(lead["verifier"]) - cents(second)
        fast = cur(lead) and (len(kept) == 1 and lead["verifier"] >= 0.72 or lead["verifier"] >= 0.82 and gap >= 1400 and (lead["context"] >= 0.08 or lead["score"] >= 0.9) or lead["verifier"] >= 0.76 and gap >= 800 and (lead["context"] >= 0.05 or lead["score"] >= 0.78))
    for i, r in enumerate(kept):
        r["place"], r["fast"] = i + 1, fast
    return kept


def rank(rows):
    s = lambda x: 1 / (1 + math.exp(-x))
    for r in rows:
        m, e, k = r["mlm"] or 0.0, r["electra"] or 0.0, r["morph"] or 0.0
        verdict = s(10 * e + k / 2.8 + 1.4 * (r["typo"] - 0.55) + 1.1 * r["context"] + 0.55 * (r["interface"] - 0.5))
        edits = sum(a != b for a, b in zip(r["tok"], r["dst"]))
        final = 0.24 * s(m) + 0.28 * s(8 * e) + 0.12 * s(k / 3) + 0.22 * verdict + 0.1 * s(r["generator"]) + 0.08 * r["typo"] + 0.04 * vocab.SOURCE_PRIOR.get(r["source"], 0.25) + 0.04 * r["context"] + 0.02 * r["interface"] + 0.04 * r["family_match"] - min(0.18, 0.06 * edits) - (0.16 if r["typo"] < 0.6 else 0.0)
        r["verdict"], r["final"] = round(verdict, 4), r["verifier"] if r["fast"] else round(max(0.01, min(0.99, final)), 4)
        r["m"], r["e"], r["k"] = m, e, k
    mine = [r for r in rows if r["source"] in vocab.CURATED_SOURCES and not r["fast"]]
    if len(mine) >= 2:
        a = max(mine, key=lambda r: (r["verdict"], r["k"], r["e"], r["final"], -r["place"]))
        b = max(mine, key=lambda r: (r["typo"], r["score"], r["norm"], r["final"], -r["place"]))
        if a is not b and a["verdict"] - b["verdict"] >= 0.015 and (a["k"] - b["k"] >= 1.5 or a["e"] - b["e"] >= 0.01):
            a["final"], b["final"] = round(min(0.99, a["final"] + 0.14), 4), round(max(0.01, b["final"] - 0.12), 4)
    return rows


def test_stages(spark):
    rows = groups(3)
    df = spark.createDataFrame(rows, ROW)
    got = R.reranked(R.verified(R.family_prior(df, ["g"]), ["g"], "pos_hints", "slot_hints"), ["g"], "tok", "mlm", "electra", "morph").collect()
    want, swapped = {}, 0
    for g in range(120):
        mine = [dict(zip(NAMES, r)) for r in rows if r[0] == g]
        for r in rank(verify(prior(mine))):
            want[g, r["dst"]] = (r["verifier"], r["place"], r["fast"], r["final"])
    assert {(r.g, r.dst) for r in got} == set(want) and len({r.fast for r in got}) == 2
    for r in got:
        v, place, fast, final = want[r.g, r.dst]
        assert (r.place, r.fast) == (place, fast) and abs(r.verifier - v) < 2e-4 and abs(r.final - final) < 2e-4


def test_leaders_are_swapped(spark):
    base = dict(g=1, tok="가나다", source="CONFUSION_SET", generator=0.8, norm=0.8, score=0.6, context=0.0, interface=0.86, family=[], pos=None, slots=[], pos_hints=[], slot_hints=[], mlm=None)
    rows = [{**base, "dst": "가너다", "typo": 0.8, "electra": 0.0, "morph": 0.0}, {**base, "dst": "가니다", "typo": 0.7, "electra": 0.1, "morph": 2.0}]
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], ROW).withColumns({"family_match": F.lit(False), "verifier": F.col("typo"), "place": F.when(F.col("typo") == 0.8, 1).otherwise(2), "fast": F.lit(False)})
    plain = {r.dst: r.final for r in R.reranked(df.withColumn("source", F.lit("MLM_TOPK")), ["g"], "tok", "mlm", "electra", "morph").collect()}
    got = {r.dst: r.final for r in R.reranked(df, ["g"], "tok", "mlm", "electra", "morph").collect()}
    prior = 0.04 * (1.0 - 0.35)
    assert abs(got["가니다"] - plain["가니다"] - prior - 0.14) < 2e-4 and abs(got["가너다"] - plain["가너다"] - prior + 0.12) < 2e-4


def test_options_and_policy(spark):
    df = spark.createDataFrame([(1, "가나", d, s, f, p, fam) for d, s, f, p, fam in [("가너", "CONFUSION_SET", 0.9, 1, True), ("가니", "MLM_TOPK", 0.8, 2, False), ("가2", "CONFUSION_SET", 0.7, 3, False), ("가누", "CONFUSION_SET", 0.6, 4, False)]], "g INT, tok STRING, dst STRING, source STRING, final DOUBLE, place INT, family_match BOOLEAN")
    got = [(r.replacement, r.decision, r.option) for r in R.options(df, ["g"], "tok", F.lit(False), F.lit(True)).orderBy("rank").collect()]
    assert got == [("가너", "SUGGEST_ONLY", 0.82), ("가니", "SUGGEST_ONLY", 0.67), ("가2", "REJECT", 0.62), ("가나", "KEEP", 0.2)]
    guarded = R.options(df, ["g"], "tok", F.lit(True), F.lit(False)).collect()
    assert {r.decision for r in guarded} == {"REJECT", "KEEP"} and all("PROTECTED_SPAN" in r.reasons for r in guarded if r.decision == "REJECT")
    kinds = spark.createDataFrame([("SPELL", "SUGGEST_ONLY", 0.95), ("SPELL", "SUGGEST_ONLY", 0.94), ("OPEN_REPLACE", "PASS", 0.99), ("SPACE_INSERT", "REJECT", 0.99), ("SPACE_DELETE", "PASS", 0.97)], "k STRING, d STRING, c DOUBLE")
    assert [r[0] for r in kinds.select(R.policy(F.col("k"), F.col("d"), F.col("c"))).collect()] == ["AUTO_APPLY", "SUGGEST_ONLY", "SUGGEST_ONLY", "REJECT", "AUTO_APPLY"]
    some = spark.createDataFrame([(["AUTO_APPLY", "REJECT"],), (["AUTO_APPLY", "SUGGEST_ONLY"],), (["AUTO_APPLY"],), ([],)], "d ARRAY<STRING>")
    assert [r[0] for r in some.select(R.overall(F.col("d"))).collect()] == ["REJECT", "SUGGEST_ONLY", "AUTO_APPLY", "AUTO_APPLY"]


def test_nothing(spark):
    df = spark.createDataFrame([], ROW)
    ranked = R.reranked(R.verified(R.family_prior(df, ["g"]), ["g"]), ["g"])
    assert ranked.count() == 0 and R.options(ranked, ["g"], "tok", F.lit(False), F.lit(False)).count() == 0
