"""Every query of the subpackage over whole small tables: against its SQL, or against plain Python and the public tokenizer."""

import base64
import itertools
import math
import os
import re
import sys
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle import FOLDER, connection, same  # noqa: E402
from test_overlap import distance, plain  # noqa: E402

from maldadum.llm import confusables, quality, registry, tokens  # noqa: E402

Q = registry.queries()


def rows_of(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.fixture(scope="module")
def records():
    first = {}
    for r in sorted(rows_of("corpus_records"), key=lambda r: r["rec_no"]):
        first.setdefault(r["id"], r)
    return list(first.values())


@pytest.fixture(scope="module")
def ids():
    """The documents' ids by the public library."""
    with open(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    public = tiktoken.Encoding("public", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {d["doc_id"]: public.encode_ordinary(d["text"] or "") for d in rows_of("documents")}


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_same_rows_as_sql(spark, con, name):
    assert same(spark, con, Q[name], registry.sql()[name]) == ({}, {})


def test_p2_report_and_sample(spark, records):
    report = {(r.error_type, r.source): r for r in Q["p2_report"](spark, FOLDER).collect()}
    have = Counter((r["error_type"], (r["source"] or "").strip().lower()) for r in records if r["source"] is not None)
    size = len(records) // 5
    for t in rows_of("sample_targets"):
        r = report[t["error_type"], t["source"]]
        want = max(t["min_rows"], -(-t["target_permille"] * size // 1000))
        assert (r.n_records, r.wanted, r.short) == (have[t["error_type"], t["source"].strip().lower()], want, r.n_records < want)
        assert min(t["min_rows"], r.n_records) <= r.quota <= r.n_records
    lows = sum(min(t["min_rows"], report[t["error_type"], t["source"]].n_records) for t in rows_of("sample_targets"))
    assert sum(r.quota for r in report.values()) == max(lows, min(size, sum(r.n_records for (e, s), r in report.items())))
    taken = Counter((r.error_type, (r.source or "").strip().lower()) for r in Q["p2_sample"](spark, FOLDER).collect())
    assert taken == Counter({(e, s.strip().lower()): r.quota for (e, s), r in report.items() if r.quota})


def test_p3(spark):
    spelling = confusables.Spelling(confusables.public_twins(spark))
    values = Counter()
    for r in rows_of("corpus_records"):
        values[r["rec_no"], "err_sentence", -1, r["err_sentence"]] += 1
        values[r["rec_no"], "cor_sentence", -1, r["cor_sentence"]] += 1
        for i, e in enumerate(r["errors"] or []):
            values[r["rec_no"], "err_text", i, e["err_text"]] += 1
    form = lambda v: v if v is None else spelling.normalize(v)
    assert Counter(tuple(r) for r in Q["p3_forms"](spark, FOLDER).collect()) == Counter({(a, b, c, form(v)): n for (a, b, c, v), n in values.items()})
    found = Counter((r.rec_no, r.field, r.err_pos) for r in Q["p3_found"](spark, FOLDER).collect())
    assert found == Counter({(a, b, c): n for (a, b, c, v), n in values.items() if form(v) != v}) and sum(found.values()) > 20


def test_p5_surprise(spark, records):
    items = {h["term"] for e in rows_of("typed_confusion_graph") for h in e["contextHints"] or [] if h["term"] is not None}
    sets = [set(re.findall("[가-힣A-Za-z0-9]+", r["cor_sentence"] or "")) & items for r in records]
    one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    got = Q["p5_surprise"](spark, FOLDER).collect()
    assert {(r.term_a, r.term_b): (r.n_a, r.n_b, r.n_both, r.n_total) for r in got} == {(a, b): (one[a], one[b], c, len(records)) for (a, b), c in two.items() if c >= 5}
    for r in got:  # the null keeps what items and baskets have: no pair is expected more often than its items stand
        assert 0 < r.expected <= min(r.n_a, r.n_b) and abs(r.lift - r.n_both / r.expected) < 1e-9 and r.log10_p <= 0 and r.log10_q >= r.log10_p - 1e-9


def test_p6(spark):
    rows = rows_of("edit_tagger_v2_dataset")
    forms = {(r["ex_no"], f): plain(r[f]) for r in rows for f in ("text", "corrected_text") if r[f] and r[f].strip()}
    by_split = defaultdict(list)
    for r in rows:
        by_split[r["split"]].append(r["ex_no"])
    near, cover = set(), {}
    assert set(by_split) == {"train", "validation"}
    known: dict = {}
    for a, b in itertools.product(by_split["train"], by_split["validation"]):
        for f in ("text", "corrected_text"):
            x, y = forms.get((a, f)), forms.get((b, f))
            if x is None or y is None:
                continue
            longer = max(len(x), len(y))
            if abs(len(x) - len(y)) * 100 > 15 * longer or sum(((Counter(x) - Counter(y)) + (Counter(y) - Counter(x))).values()) * 100 > 2 * 15 * longer:
                continue
            if (x, y) not in known:
                known[x, y] = distance(x, y)
            if known[x, y] * 100 <= 15 * longer:
                near.add((min(a, b), max(a, b)))
                for k in (a, b):
                    cover[k] = max(cover.get(k, 0), 1 - known[x, y] / longer)
    assert {tuple(r) for r in Q["p6_found"](spark, FOLDER).collect()} == near and near
    want = defaultdict(list)
    for r in rows:
        want[r["split"], r["source"]].append(cover.get(r["ex_no"]))
    got = {(r.split, r.source): (r.n_rows, r.n_overlapping, r.n_exact, r.mean_coverage) for r in Q["p6_report"](spark, FOLDER).collect()}
    assert set(got) == set(want)
    for k, c in want.items():
        some = [x for x in c if x is not None]
        assert got[k][:3] == (len(c), len(some), sum(x == 1 for x in some)) and (not some or abs(got[k][3] - sum(some) / len(some)) < 1e-9)


def test_p8(spark, ids):
    assert {r.doc_id: r.ids for r in Q["p8_ids"](spark, FOLDER).collect()} == ids


def test_p9(spark, ids):
    source = {d["doc_id"]: (d["source"] or "").strip().lower() for d in rows_of("documents")}
    size = Counter()
    for k, x in ids.items():
        size[source[k]] += len(x)
    targets = {t["source"]: t for t in rows_of("mix_targets")}
    total = sum(size[s.strip().lower()] for s in targets)
    short = {s for s, t in targets.items() if size[s.strip().lower()] * t["max_repeats"] < t["target_share"] * total}
    assert {r.source for r in Q["p9_found"](spark, FOLDER).collect()} == short
    report = {r.source: r for r in Q["p9_report"](spark, FOLDER).collect()}
    assert {s: (r.n_tokens, r.short) for s, r in report.items()} == {s: (size[s.strip().lower()], s in short) for s in targets}
    mix = Q["p9_mixture"](spark, FOLDER).collect()
    granted = Counter()
    for r in mix:
        assert r.ids == [x for p in r.parts for x in ids[p.key][p.token_from : p.token_to]] and all(source[p.key] == r.source for p in r.parts) and r.turn < targets[r.source]["max_repeats"]
        granted[r.source] += len(r.ids)
    assert {s: r.tokens_granted for s, r in report.items() if r.tokens_granted} == dict(granted)
    assert all(math.isclose(r.actual_share, granted[s] / sum(granted.values())) for s, r in report.items())
    assert len(mix) <= -(-total // 2048) and len({(r.source, r.slot) for r in mix}) == len(mix)


def test_p10(spark):
    docs = rows_of("documents")
    want = {d["doc_id"]: quality.statistics(d["text"]) for d in docs if d["text"] and not d["text"].isspace()}
    got = {r.doc_id: r for r in Q["p10_statistics"](spark, FOLDER).collect()}
    assert set(got) == {d["doc_id"] for d in docs}
    for k, r in got.items():
        text = next(d["text"] for d in docs if d["doc_id"] == k) or ""
        assert r.n_words == len(text.split())
        if k in want:
            assert r.mean_word_length == pytest.approx(sum(map(len, text.split())) / len(text.split())) and 0 <= r.dominant_ngram <= 1
            assert r.prose_share + r.list_share + r.table_share + r.junk_share <= 1 + 1e-9
    assert {(r.doc_id, r.doc_kind) for r in Q["p10_found"](spark, FOLDER).collect()} == {(k, s["doc_kind"]) for k, s in want.items() if s["doc_kind"]}


def test_every_query_is_compared():
    here = set(globals())
    assert all(n in registry.sql() or f"test_{n.split('_')[0]}" in here or f"test_{n}" in here or n.startswith("p2_") for n in Q)
