"""Structural indexing against a parser, and its defined results."""

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from maldadum.operators import nested as N

BAD = ['{"data":[1,]}', '{"data":[1 2]}', '{"data"}', '{"a":1}x', '{"data":[tru]}', '{"a":"\\x"}', '{"a":[1}]', "{,}", '{"a":1,}', "", '{"a":"b\nc"}', "[}", '{"a":{}{}}', '{"a"::1}', "{1:2}", '{"a":1}{"b":2}', '{"a":"x"y}', '{"a":"\\u12"}', "{'a':1}", '{"a":01}', '{"a":"b', '{"a":[']
GOOD = ["[1]", "{}", '"x"', "12", '{"d\\u0061ta":[null]}', "[[[]]]", '﻿{}', '{"a":"\\\\"}', '{"a":"\\\\\\""}', ' {"a" : [ 1 , {"b":null} ] } ', '{"a":{"b":{"c":{"d":[[],[[]]]}}}}']


@pytest.mark.parametrize(("text", "readable"), [(t, False) for t in BAD] + [(t, True) for t in GOOD])
def test_readable_as_the_parser_says(text, readable):
    try:
        json.loads(text.removeprefix("﻿"))
        assert readable
    except ValueError:
        assert not readable
    for around in (['{"ok":1}', text, '{"ok":[2]}'], [text], [text, text]):
        chunk, starts, ends, _ = next(N._chunks(pa.array(around)))
        index = N.StructuralIndex(chunk, starts, ends)
        assert index.readable.tolist() == [readable if t == text else True for t in around]


TEXTS = st.text(st.characters(codec="utf-8"), max_size=6)
LEAF = st.none() | st.booleans() | st.integers(-5, 500) | TEXTS
DETAILS = st.none() | st.just("") | TEXTS | st.integers(0, 99) | st.lists(TEXTS, max_size=3) | st.dictionaries(TEXTS, st.dictionaries(TEXTS, st.integers(0, 3), max_size=3), max_size=3)
ERROR = st.fixed_dictionaries({}, optional={"err_text": TEXTS, "err_details": DETAILS, "more": LEAF})
ITEM = st.none() | st.fixed_dictionaries({}, optional={"annotation": st.none() | st.fixed_dictionaries({}, optional={"errors": st.none() | ERROR | st.lists(ERROR, max_size=3)}), "metadata_info": st.none() | st.fixed_dictionaries({"id": TEXTS})})
PAYLOAD = st.fixed_dictionaries({}, optional={"data": st.none() | st.lists(ITEM, max_size=4), "info": st.dictionaries(TEXTS, LEAF, max_size=2)})


def details_by_parser(payload):
    try:
        doc = json.loads((payload or "").removeprefix("﻿"))
    except ValueError:
        return
    for i, item in enumerate((doc.get("data") or []) if isinstance(doc, dict) else []):
        errors = ((item or {}).get("annotation") or {}).get("errors")
        for j, e in enumerate([errors] if isinstance(errors, dict) else errors or []):
            d = e.get("err_details")
            rows = [("tags", t) for t in d] if isinstance(d, list) else [("counts", f"{a}.{b}") for a, v in d.items() for b in v] if isinstance(d, dict) else [("raw", str(d))] if d not in (None, "") else []
            for row in rows or [("none", "")]:
                yield (i, j, *row)


def details_by_index(payloads):
    rows = []
    for chunk, starts, ends, first in N._chunks(pa.array(payloads, pa.string())):
        index = N.StructuralIndex(chunk, starts, ends)
        docs, boxes, places = np.arange(len(starts)), index.root, []
        for level in N.VENDOR_LEVELS:
            source, place, values = index.elements(N._descend(index, boxes, level.path)) if len(index.is_object) else (docs[:0],) * 3
            docs, places, boxes = docs[source], [p[source] for p in places] + [place], index.box(values)
        real = np.flatnonzero(boxes >= 0)
        element, *columns = N._union_rows(index, N._descend(index, boxes[real], ("err_details",))) if len(real) else ([],)
        for at, kind, key, _ in zip(element, *[c.to_pylist() for c in columns]) if len(real) else ():
            rows.append((first + int(docs[real[at]]), int(places[0][real[at]]), int(places[1][real[at]]), kind, key))
    return rows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(PAYLOAD, st.booleans(), st.sampled_from([None, 1]), st.integers(0, 400)), min_size=1, max_size=5))
def test_details_as_the_parser_says(cases):
    payloads = [("﻿" if i % 2 else "") + json.dumps(p, ensure_ascii=a, indent=n) for i, (p, a, n, _) in enumerate(cases)]
    payloads += [p[: cut] for p, (*_, cut) in zip(payloads, cases)] + [None, ""]
    want = [(k, *row) for k, p in enumerate(payloads) for row in details_by_parser(p)]
    assert sorted(details_by_index(payloads)) == sorted(want)


def test_tables_keep_links_and_edge_cases(spark):
    files = [
        (1, '{"data":[null,{"metadata_info":{"id":"a","source":null},"annotation":{"err_sentence":"가","errors":{"err_idx":0,"err_text":"x\\n","err_details":["t","t"]}}},{"annotation":null}]}'),
        (2, None), (3, ""), (4, '{"data":'), (5, '{"data":[]}'), (None, '{"data":[{"annotation":{"errors":[{"err_details":{"o":{"i":1},"m":{}}},{"err_details":{"m":{}}}]}}]}'),
        (1, '{"data":[{"metadata_info":{"id":"b"}}]}'),
    ]
    df = spark.createDataFrame([(k, p, "clash") for k, p in files], "file_id BIGINT, payload STRING, item_pos STRING")
    items = [tuple(r)[:3] for r in N.vendor_items(df).collect()]
    assert sorted(items, key=str) == sorted([(1, 0, None), (1, 1, "a"), (1, 2, None), (None, 0, None), (1, 0, "b")], key=str)
    errors = [tuple(r)[:6] for r in N.vendor_errors(df).collect()]
    assert sorted(errors, key=str) == sorted([(1, 1, 0, "0", None, "x\n"), (None, 0, 0, None, None, None), (None, 0, 1, None, None, None)], key=str)
    details = [tuple(r) for r in N.vendor_details(df).collect()]
    assert sorted(details, key=str) == sorted([(1, 1, 0, "tags", "t", None), (1, 1, 0, "tags", "t", None), (None, 0, 0, "counts", "o.i", "1"), (None, 0, 1, "none", "", None)], key=str)
    assert N.vendor_details(df.limit(0)).count() == 0


def test_a_very_long_document(spark):
    payload = json.dumps({"data": [{"annotation": {"errors": [{"err_details": ["t"]}]}} for _ in range(150_000)]})
    assert len(payload) > N.CHUNK_BYTES
    df = spark.createDataFrame([(1, payload)], "file_id BIGINT, payload STRING")
    assert N.vendor_details(df).selectExpr("count(*)", "max(item_pos)").first()[:] == (150_000, 149_999)
