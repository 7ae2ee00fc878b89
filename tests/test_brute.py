"""Core queries that SQL cannot say, against plain Python over whole small tables."""

from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pyarrow.parquet as pq
import pytest
import regex
from oracle import FOLDER
from test_functions import typo

from maldadum import vocab
from maldadum.plans import registry
from maldadum.plans.text_queries import OVERLAPPING_RULES

Q = registry.queries()


def rows_of(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def records():
    first = {}
    for r in sorted(rows_of("corpus_records"), key=lambda r: r["rec_no"]):
        first.setdefault(r["id"], r)
    return list(first.values())


def collected(spark, name):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in Q[name](spark, FOLDER).collect())


def protected(text):
    patterns = [(k, regex.compile(p.replace("(?U)", ""))) for k, p in vocab.PROTECTED_PATTERNS] + [("ENTITY", regex.compile(regex.escape(x))) for x in vocab.ENTITIES] + [("USER_DICT", regex.compile(regex.escape(x))) for x in vocab.USER_TERMS]
    found = sorted((m.start(), m.end(), kind, m.group()) for kind, p in patterns for m in p.finditer(text))
    out = []
    for st, ed, kind, said in found:
        if out and st < out[-1][1]:
            st0, ed0, kind0, _ = out[-1]
            ed0 = max(ed0, ed)
            out[-1] = (st0, ed0, kind0, text[st0:ed0])
        else:
            out.append((st, ed, kind, said))
    return out


def chosen(text, rules, spans):
    places = set()
    for src, dst, confidence in rules:
        at = text.find(src)
        while at >= 0:
            if not any(at < b and at + len(src) > a for a, b, *_ in spans):
                places.add((at, -(at + len(src)), -confidence, dst, src))
            at = text.find(src, at + len(src))
    kept = []
    for st, back, less, dst, src in sorted(places):
        if not kept or st >= kept[-1][1]:
            kept.append((st, -back, src, dst, -less))
    return kept


def test_protected_spans(spark):
    want = Counter((d["doc_id"], *s) for d in rows_of("documents") for s in protected(d["text"] or ""))
    assert collected(spark, "protected_spans") == want and len(want) > 100


def test_rule_edits(spark):
    want = Counter((d["doc_id"], *e) for d in rows_of("documents") if d["text"] for e in chosen(d["text"], OVERLAPPING_RULES, protected(d["text"])))
    assert collected(spark, "rule_edits") == want and len(want) > 10


def test_spacing_points(spark):
    want = Counter()
    for r in rows_of("corpus_records"):
        a, b = r["err_sentence"], r["cor_sentence"]
        if a is not None and b is not None and a != b and a.replace(" ", "") == b.replace(" ", ""):
            i = j = 0
            while i < len(a) and j < len(b):
                if a[i] == b[j]:
                    i, j = i + 1, j + 1
                elif b[j] == " ":
                    want[r["rec_no"], i] += 1
                    j += 1
                elif a[i] == " ":
                    i += 1
                else:
                    i, j = i + 1, j + 1
    assert collected(spark, "spacing_points") == want and want


def test_change_hulls(spark):
    want = Counter()
    for e in rows_of("edit_tagger_v2_dataset"):
        if e["variant"] == "noisy" and e["corrected_text"] is not None:
            ops = [o for o in SequenceMatcher(None, e["text"], e["corrected_text"], autojunk=False).get_opcodes() if o[0] != "equal"]
            want[(e["ex_no"], *((min(o[1] for o in ops), max(o[2] for o in ops), min(o[3] for o in ops), max(o[4] for o in ops)) if ops else (-1,) * 4))] += 1
    assert collected(spark, "change_hulls") == want


def entries(records):
    for r in records:
        for e in r["errors"] or []:
            err, cor = (e["err_text"] or "").strip(" "), (e["cor_text"] or "").strip(" ")
            if err and cor and err != cor:
                yield r, err, cor


def bare(text):
    return regex.sub(r"[\s\p{P}]", "", text)


def test_surface_fixes(spark, records):
    counts = defaultdict(Counter)
    for _, err, cor in entries(records):
        both = err + cor
        if " " not in both and len(err) <= 12 and len(cor) <= 12 and len(regex.findall("[가-힣]", both)) >= 0.7 * len(both) and bare(err) != bare(cor) and not regex.search(r"\p{C}|[\"'“”‘’`]", both):
            counts[err][cor] += 1
    want = {}
    for err, targets in counts.items():
        cor, n = min(targets.items(), key=lambda x: (-x[1], x[0]))
        similarity = round(SequenceMatcher(None, err, cor).ratio(), 4)
        if n >= 3 and n >= 0.95 * sum(targets.values()) and similarity >= 0.74:
            want[err, cor] = (n, similarity, round(min(0.995, 0.9 + min(0.09, n / 2000) + max(0.0, similarity - 0.8) * 0.2), 4))
    got = {(r.err, r.cor): (r["count"], r.similarity, r.confidence) for r in Q["surface_fixes"](spark, FOLDER).collect()}
    assert set(got) == set(want) and all(abs(x - y) < 2e-4 for k in got for x, y in zip(got[k], want[k]))


def label(e, marks):
    a, b, d = e["err_text"] or "", e["cor_text"] or "", e["err_details"] or {}
    tags, counts = (d.get("tags") or []) if d.get("kind") == "tags" else [], dict(d.get("counts") or [])
    if "띄어쓰기" in tags or a != b and a.replace(" ", "") == b.replace(" ", "") or any((counts.get(f"spacing.{k}") or 0) > 0 for k in ("insert", "delete", "replace")):
        return "SPACE_FIX"
    same = a != b and bare(a) == bare(b)
    if marks:
        return "PUNCT_FIX" if "문장부호" in tags or same or any((counts.get(f"mark.{k}") or 0) > 0 for k in ("insert", "delete", "replace")) else "OPEN_REPLACE"
    return "KEEP" if same else "OPEN_REPLACE"


def located(text, errors, marks):
    """Labels per white-space token and how many errors were found in the text, one after the other."""
    tokens = [(m.start(), m.end()) for m in regex.finditer(r"\S+", text)]
    big, taken, cursor = 10**9, [], 0
    for e in sorted(errors, key=lambda e: (big if e["err_idx"] is None else e["err_idx"], big if e["err_location"] is None else e["err_location"])):
        said, span = e["err_text"] or "", None
        starts = [m.start() for m in regex.finditer(regex.escape(said), text, overlapped=True)] if said else []
        clear = [s for s in starts if all(s + len(said) <= a or b <= s for a, b, _ in taken)]
        ahead = [s for s in clear if s >= cursor] or clear
        if ahead:
            span = (ahead[0], ahead[0] + len(said))
        elif e["err_location"] is not None and 0 <= e["err_location"] < len(tokens):
            last = min(len(tokens), e["err_location"] + max(1, len(said.split()))) - 1
            span = (tokens[e["err_location"]][0], tokens[last][1])
            span = span if all(span[1] <= a or b <= span[0] for a, b, _ in taken) else None
        if span:
            taken.append((*span, label(e, marks)))
            cursor = span[1]
    labels = ["KEEP"] * len(tokens)
    for lo, hi, name in taken:
        for i, (a, b) in enumerate(tokens):
            if name != "KEEP" and a < hi and lo < b and vocab.LABEL_PRIORITY[name] >= vocab.LABEL_PRIORITY[labels[i]]:
                labels[i] = name
    return [text[a:b] for a, b in tokens], labels, len(taken)


def test_label_examples(spark, records):
    want = Counter()
    for r in records:
        tokens, labels, n = located(r["err_sentence"] or "", r["errors"] or [], False)
        if any(x != "KEEP" for x in labels):
            want[f"{r['id']}:noisy", "noisy", " ".join(tokens), " ".join(labels), n] += 1
        clean = (r["cor_sentence"] or "").split()
        if clean:
            want[f"{r['id']}:clean", "clean", " ".join(regex.findall(r"\S+", r["cor_sentence"])), " ".join(["KEEP"] * len(regex.findall(r"\S+", r["cor_sentence"]))), 0] += 1
    got = Counter((r.id, r.variant, r.tokens, r.labels, r.located_error_count) for r in Q["label_examples"](spark, FOLDER).collect())
    assert got == want


def test_plain_examples(spark, records):
    want = Counter()
    for r in records:
        tokens, labels, n = located(r["err_sentence"] or "", r["errors"] or [], True)
        if tokens:
            want[r["id"], r["split"], len(tokens), " ".join(labels), r["error_count"] if r["error_count"] is not None else len(r["errors"] or []), n] += 1
    assert collected(spark, "plain_examples") == want


def test_sentence_proposals(spark, records):
    """Every proposal applies edges to its sentence, the best one the sum of the best options."""
    texts = {e["ex_no"]: e["text"] for e in rows_of("edit_tagger_v2_dataset") if e["variant"] == "noisy"}
    edges = defaultdict(list)
    for r in Q["confusion_edges"](spark, FOLDER).collect():
        if r["rank"] <= 3:
            edges[r.err].append((r.cor, r.score))
    got = defaultdict(list)
    for r in Q["sentence_proposals"](spark, FOLDER).collect():
        got[r.ex_no].append(r)
    assert set(got) == {k for k, t in texts.items() if any(w in edges for w in regex.findall(r"\S+", t))}
    for key, found in got.items():
        groups = [edges[w] for w in regex.findall(r"\S+", texts[key]) if w in edges]
        best, edits = 0.0, 0
        for options in groups:  # .2 to keep a token, .04 less for each edit after the first
            take = max(s for _, s in options) - (0.04 if edits else 0.0)
            best, edits = (best + take, edits + 1) if take > 0.2 else (best + 0.2, edits)
        top = min(found, key=lambda r: r["rank"])
        assert len(found) <= 3 and abs(top.raw_score - best) < 1e-3
        apart = regex.split(r"(\S+)", texts[key])
        for r in found:
            said = regex.split(r"(\S+)", r.proposal)
            assert all(x == y or y in {c for c, _ in edges.get(x, [])} for x, y in zip(apart, said, strict=True))


def test_spelling_patterns(spark, tmp_path):
    texts = ["제가 할께요 그리고 갈께 먹께요", "않해요 않가요 안됐다 안됐", "을께 RTX께 않", None, "할께요"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.tok, r.dst, r.score) for r in Q["spelling_patterns"](spark, str(tmp_path)).collect()}
    assert got == {("할께요", "할게요", 0.96), ("갈께", "갈게", 0.95), ("않해요", "안 해요", 0.95), ("안됐다", "안 됐다", 0.96), ("을께", "을게", 0.95)}


def test_seeded_subset(spark):
    a, b = (Q["seeded_subset"](spark, FOLDER).collect() for _ in range(2))
    rows = {e["ex_no"]: e["split"] for e in rows_of("edit_tagger_v2_dataset")}
    assert a == b and len(a) == min(500, len(rows)) == len({r.ex_no for r in a}) and all(rows[r.ex_no] == r.split for r in a)


def test_corrected_documents(spark):
    """Without phrases in a text the final text is that of the rules; suggestions change whole tokens to what the graph or a pattern says."""
    docs = {d["doc_id"]: d for d in rows_of("documents")}
    got = Q["corrected_documents"](spark, FOLDER).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(docs))
    checked = 0
    for r in got:
        d = docs[r.doc_id]
        text = d["text"] or ""
        if d["mode"] != "realtime" and r.n_phrase_edits == 0:
            out, at = [], 0
            edits = chosen(text, vocab.MANUAL_FIXES, protected(text))
            for st, ed, _, dst, _ in edits:
                out += [text[at:st], dst]
                at = ed
            assert r.final_text == "".join(out) + text[at:] and r.n_rule_edits == len(edits)
            checked += 1
        assert r.n_suggested > 0 or r.suggested_text == r.final_text
        assert (r.decision == "REJECT") == (r.n_rejected > 0)
    assert checked > 20 and typo("가", "가") == 1.0
