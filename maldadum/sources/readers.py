"""Sources of corpora and rule tables.

Texts are read with explicit schemas. Defined results: missing files give empty tables of the same schema; lines or members that cannot be
read are left out of the records and kept as problems, where a reader says so; encodings are tried in order."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DETAILS = "STRUCT<kind: STRING, tags: ARRAY<STRING>, counts: MAP<STRING, INT>, value: STRING>"
ERRORS = f"ARRAY<STRUCT<err_idx: INT, err_location: INT, err_text: STRING, cor_text: STRING, edit_distance: INT, err_details: {DETAILS}>>"
RECORD = ("split STRING, error_type STRING, member_name STRING, id STRING, source STRING, interface STRING, keyboard STRING, date STRING, gender STRING, age STRING, reg_date STRING, "
          f"err_sentence STRING, cor_sentence STRING, err_sentence_spell STRING, cor_sentence_spell STRING, error_count INT, errors {ERRORS}")
#: Longest text of a request.
REQUEST_CHARACTERS = 5_000


def requests(lines: DataFrame, body: str = "value") -> DataFrame:
    """Correction requests from JSON bodies, of a batch or a stream: ``text``, ``cursor_pos`` (the text's end if absent), ``mode`` ('realtime' unless 'inspect' is asked for) and ``problem`` of bodies that are no
    request: unreadable, without a text, or with one of more than REQUEST_CHARACTERS. Other columns stay."""
    r = F.from_json(body, "text STRING, cursor INT, mode STRING")
    rows = lines.withColumn("_r", r).withColumn("text", F.col("_r.text"))
    long = F.length("text") > REQUEST_CHARACTERS
    problem = F.when(F.col("text").isNull(), "no text").when(long, f"more than {REQUEST_CHARACTERS} characters")
    cursor = F.greatest(F.lit(0), F.least(F.coalesce("_r.cursor", F.length("text")), F.length("text")))
    return rows.select(*[c for c in lines.columns if c not in (body, "text")], F.when(~long, F.col("text")).alias("text"), F.when(problem.isNull(), cursor).alias("cursor_pos"), F.when(F.col("_r.mode") == "inspect", "inspect").otherwise("realtime").alias("mode"), problem.alias("problem"))


#: Names under which pair files call the erroneous and the corrected text, in the order of preference (fixed values).
PAIR_NAMES = (
    ("original", "corrected"), ("source_sentence", "target_sentence"), ("input", "output"), ("text", "correction"), ("원문", "정답"), ("source", "target"),
    ("error_sentence", "correct_sentence"), ("문장", "정답문장"), ("오류문장", "교정문장"), ("before", "after"), ("err_sentence", "cor_sentence"),
)
ENCODINGS = ("utf-8-sig", "cp949", "euc-kr")


def jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str = RECORD) -> DataFrame:
    """Records of JSON lines files; files that are not there are left out, blank lines skipped, broken lines give no record."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            found.append(spark.read.text(path))
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
    if not found:
        return spark.createDataFrame([], schema)
    lines = found[0]
    for more in found[1:]:
        lines = lines.unionByName(more)
    parsed = lines.where("trim(value) <> ''").select(F.from_json("value", f"{schema}, _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    return parsed.where("_broken is null").drop("_broken")


def zip_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """Members of zip files: ``zip_stem``, ``split`` (train or validation, from the folder), ``member_name``, ``payload`` and ``problem``.

    Archives are distributed as whole files and unpacked member by member; an unreadable archive or member gives one row with ``problem``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                stem = where.rsplit("/", 1)[-1].removesuffix(".zip")
                split = "validation" if "validation" in where.lower() else "train"
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                    names = sorted(n for n in archive.namelist() if n.endswith(suffix))
                except zipfile.BadZipFile as problem:
                    yield row(stem, split, None, None, str(problem))
                    continue
                for name in names:
                    try:
                        yield row(stem, split, name, archive.read(name).decode("utf-8-sig"), None)
                    except (UnicodeDecodeError, zipfile.BadZipFile, OSError) as problem:
                        yield row(stem, split, name, None, str(problem))

    def row(*values: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in values], names=["zip_stem", "split", "member_name", "payload", "problem"])

    return files.mapInArrow(run, "zip_stem STRING, split STRING, member_name STRING, payload STRING, problem STRING")


def error_type(stem: str) -> Column:
    """The part of a file stem after its first underscore."""
    return F.regexp_extract(F.col(stem), r"^[^_]*_(.*)$", 1)


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents of a folder and below, each with ``path``."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).withColumn("path", F.input_file_name())


def csv_files(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """Rows of CSV files of unknown encoding: ``path``, ``row`` MAP<STRING, STRING> and ``problem``; the first encoding that decodes a whole file counts, and a
    file that none decodes gives one row with ``problem`` and no map."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for encoding in encodings:
                    try:
                        text = content.decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([None], kind), pa.array([f"none of {', '.join(encodings)} decodes it"])], names=["path", "row", "problem"])
                    continue
                rows = [[(k, v) for k, v in r.items() if k is not None and v is not None] for r in csv.DictReader(io.StringIO(text))]
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(part)), pa.array(part, kind), pa.nulls(len(part), pa.string())], names=["path", "row", "problem"])

    return files.mapInArrow(run, "path STRING, row MAP<STRING, STRING>, problem STRING")


def named_pairs(rows: DataFrame, fields: str, names: Sequence[tuple[str, str]] = PAIR_NAMES) -> DataFrame:
    """``original`` and ``corrected`` of the first pair of names whose texts a row's map has, not empty and not equal; rows without one are left out."""
    of = lambda name: F.trim(F.try_element_at(fields, F.lit(name)))
    pair = F.coalesce(*[F.when((of(a) != "") & (of(b) != "") & (of(a) != of(b)), F.struct(of(a).alias("original"), of(b).alias("corrected"))) for a, b in names])
    return rows.withColumn("_p", pair).where("_p is not null").select(*[c for c in rows.columns if c != fields], "_p.original", "_p.corrected")


def asset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON table (an object's ``items`` or a list); missing or unreadable files give no rows of the schema."""
    try:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
        data = json.loads(text)
    except (AnalysisException, ValueError):
        data = []
    items = data.get("items", []) if isinstance(data, dict) else data
    line = spark.createDataFrame([(json.dumps(x, ensure_ascii=False),) for x in items] if isinstance(items, list) else [], "value STRING")
    return line.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def assets(spark: SparkSession, tables: dict[str, tuple[str, str]]) -> tuple[dict[str, DataFrame], list[str]]:
    """Several assets by name (path, schema), and the names of those that gave no rows."""
    loaded = {name: asset(spark, path, schema) for name, (path, schema) in tables.items()}
    return loaded, [name for name, df in loaded.items() if df.isEmpty()]


def normalized_records(items: DataFrame, errors: DataFrame, details: DataFrame) -> DataFrame:
    """Corpus records put together again from the linked tables of a vendor file (``operators.nested``): one row per item with its errors in order."""
    one = details.groupBy("file_id", "item_pos", "err_pos").agg(
        F.first("leaf_kind").alias("kind"),
        F.array_sort(F.collect_list(F.when(F.col("leaf_kind") == "tags", F.col("leaf_key")))).alias("tags"),
        F.map_from_entries(F.collect_list(F.when(F.col("leaf_kind") == "counts", F.struct("leaf_key", F.expr("try_cast(leaf_value as int)"))))).alias("counts"),
        F.max(F.when(F.col("leaf_kind") == "raw", F.col("leaf_key"))).alias("value"))
    shaped = F.when(F.col("kind") == "none", None).otherwise(F.struct("kind", F.when(F.col("kind") == "tags", F.col("tags")).alias("tags"), F.when(F.col("kind") == "counts", F.col("counts")).alias("counts"), "value"))
    whole = errors.join(one, ["file_id", "item_pos", "err_pos"], "left")
    number = lambda c: F.expr(f"try_cast({c} as int)").alias(c)
    lists = whole.groupBy("file_id", "item_pos").agg(F.array_sort(F.collect_list(F.struct("err_pos", number("err_idx"), number("err_location"), "err_text", "cor_text", number("edit_distance"), shaped.alias("err_details"))), lambda a, b: (a["err_pos"] - b["err_pos"]).cast("int")).alias("e"))
    joined = items.join(lists, ["file_id", "item_pos"], "left")
    errs = F.transform(F.coalesce("e", F.slice("e", 1, 0)), lambda x: x.dropFields("err_pos"))
    return joined.withColumn("errors", errs).withColumn("error_count", F.coalesce(F.size("errors"), F.lit(0))).drop("e")
