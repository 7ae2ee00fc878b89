"""Readers and sinks: round trips and defined results."""

import json
import zipfile

from maldadum.operators import nested
from maldadum.sources import readers, sinks


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("train", "가", 1), (None, None, 2)], "split STRING, id STRING, error_count INT")
    assert sinks.write_jsonl(rows, str(tmp_path / "a")) == 2
    back = readers.jsonl(spark, [str(tmp_path / "a"), str(tmp_path / "missing")])
    assert sorted((r.error_count, r.id) for r in back.collect()) == [(1, "가"), (2, None)]
    (tmp_path / "b.jsonl").write_text('\n{"id":"x"}\n{broken\n  \n', encoding="utf-8")
    assert [r.id for r in readers.jsonl(spark, str(tmp_path / "b.jsonl")).collect()] == ["x"]
    assert readers.jsonl(spark, str(tmp_path / "missing")).count() == 0


def test_zip_members(spark, tmp_path):
    folder = tmp_path / "Validation"
    folder.mkdir()
    with zipfile.ZipFile(folder / "VL_맞춤법.zip", "w") as z:
        z.writestr("b.json", "﻿{}".encode())
        z.writestr("a.json", b"\xff\xfe")
        z.writestr("c.txt", b"")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    got = sorted((r.zip_stem, r.split, r.member_name, r.payload) for r in readers.zip_members(spark, str(tmp_path)).collect() if r.member_name) + [(r.zip_stem, bool(r.problem)) for r in readers.zip_members(spark, str(tmp_path)).collect() if not r.member_name]
    assert got == [("VL_맞춤법", "validation", "a.json", None), ("VL_맞춤법", "validation", "b.json", "{}"), ("bad", True)]
    df = spark.createDataFrame([("VL_맞춤법",), ("x",), ("a_b_c",)], "stem STRING")
    assert [r[0] for r in df.select(readers.error_type("stem")).collect()] == ["맞춤법", "", "b_c"]


def test_csv_encodings_and_named_pairs(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("original,corrected\n되요,돼요\n같다,같다\n".encode("utf-8-sig"))
    (tmp_path / "k.csv").write_bytes("err_sentence,cor_sentence\n 안되 ,안 돼\n,x\n".encode("cp949"))
    (tmp_path / "z.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    rows = readers.csv_files(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in rows.where("problem is not null").collect()] == ["z.csv"]
    got = readers.named_pairs(rows, "row").collect()
    assert sorted((r.original, r.corrected) for r in got) == [("되요", "돼요"), ("안되", "안 돼")]


def test_assets(spark, tmp_path):
    rows = spark.createDataFrame([("되요", "돼요", 0.99)], "src STRING, dst STRING, confidence DOUBLE")
    assert sinks.write_asset(rows, str(tmp_path / "x" / "fixes.json"), version=1) == 1
    assert json.loads((tmp_path / "x" / "fixes.json").read_text(encoding="utf-8"))["version"] == 1
    loaded, missing = readers.assets(spark, {"a": (str(tmp_path / "x" / "fixes.json"), "src STRING, dst STRING"), "b": (str(tmp_path / "none.json"), "src STRING")})
    assert [tuple(r) for r in loaded["a"].collect()] == [("되요", "돼요")] and missing == ["b"] and loaded["b"].columns == ["src"]
    sinks.write_label_ids(["KEEP", "SPACE_FIX"], str(tmp_path / "labels.json"))
    assert json.loads((tmp_path / "labels.json").read_text())["label2id"] == {"KEEP": 0, "SPACE_FIX": 1}


def test_csv_sink_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("train", 'a "b", c'), ("validation", "d")], "split STRING, original STRING")
    sinks.write_csv(rows, str(tmp_path / "c"), "split")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted((r.split, r.original) for r in back.collect()) == [("train", 'a "b", c'), ("validation", "d")]
    for _ in range(2):
        sinks.append_session(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_records_from_vendor_tables(spark):
    payload = json.dumps({"data": [{"metadata_info": {"id": "a", "source": "S"}, "annotation": {"err_sentence": "x", "errors": [{"err_idx": 1, "err_text": "e", "err_details": {"spell": {"swap": 2}}}, {"err_details": ["t"]}, {"err_details": None}]}}, None]})
    files = spark.createDataFrame([(7, payload)], "file_id BIGINT, payload STRING")
    rows = readers.normalized_records(nested.vendor_items(files), nested.vendor_errors(files), nested.vendor_details(files)).orderBy("item_pos").collect()
    assert rows[0].error_count == 3 and rows[0].errors[0].err_details.counts == {"spell.swap": 2} and rows[0].errors[1].err_details.tags == ["t"] and rows[0].errors[2].err_details is None
    assert rows[1].error_count == 0 and rows[1].id is None
