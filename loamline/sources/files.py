"""Readers of the file shapes that training data comes in."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLET = ("condition", "instruction", "response")
#: Columns under which a prompt or an answer may stand, in order.
PROMPTS = ("instruction", "prompt", "question", "input", "query", "source", "problem", "text")
ANSWERS = ("response", "completion", "answer", "output", "target", "targets", "solution", "summary")


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with the columns its schema calls for: a triplet, messages (and tools), or the known prompt and answer names."""
    df = spark.read.parquet(path)
    if set(TRIPLET) <= set(df.columns):
        return df.select(*TRIPLET)
    if "messages" in df.columns:
        return df.select("messages", *([c for c in ("tools",) if c in df.columns]))
    return df.select(*[c for c in df.columns if c in (*PROMPTS, *ANSWERS, "condition", "task")])


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object on a line, plain or gzipped; a bad line is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse as objects, control characters allowed, and how many lines did not."""
    fields = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowUnquotedControlChars": "true"}).alias("r"))
    good = parsed.filter("r is not null and r._bad is null").select("r.*").drop("_bad")
    return good, parsed.agg(F.count_if(F.expr("r is null or r._bad is not null")).alias("bad_lines"))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects that follow each other over any number of lines: ``path, idx, json``; what never closes is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder(strict=False)
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, i = 0, 0
                while m := re.compile(r"[^\s\0,]").search(text, at):
                    try:
                        value, at = decoder.raw_decode(text, m.start())
                    except ValueError:
                        at = text.find("\n", m.start()) + 1 or len(text)
                        continue
                    if isinstance(value, dict):
                        rows.append((name, i, json.dumps(value, sort_keys=True)))
                        i += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "idx", "json"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), "value")
    return files.mapInArrow(run, "path string, idx long, json string")


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated with a header; all text, blanks null."""
    reader = spark.read.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("quote", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def numpy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``.npy`` vectors of whole numbers: ``path, values``; one row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = [(p, np.load(io.BytesIO(c), allow_pickle=False).astype(np.int64).ravel()) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["path", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, values array<long>")


def zipped_samples(spark: SparkSession, path: str, folder: str = "samples/") -> DataFrame:
    """JSON members of zip files in the order of their names: ``archive, member, json``; files that are no zip are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(name, m, z.read(m).decode("utf-8", "replace")) for m in sorted(z.namelist()) if m.startswith(folder) and m.endswith(".json")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["archive", "member", "json"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, json string")


def summary_metrics(logs: DataFrame, text: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """``--- name ---`` sections of ``key....: value`` lines: ``section, key, value`` of finite numbers, beside the columns to ``keep``."""
    parts = F.expr(f"filter(split({text}, '(?m)^--- '), x -> x rlike '^[^\\\\n]+ ---')")
    sections = logs.select(*keep, F.explode(parts).alias("part")).select(*keep, F.regexp_extract("part", r"^(.*?) ---", 1).alias("section"), F.explode(F.split("part", "\n")).alias("line"))
    found = sections.select(*keep, "section", F.regexp_extract("line", r"^([A-Za-z][^:]*?)\.*:\s*(\S+)\s*$", 1).alias("key"), F.regexp_extract("line", r":\s*(\S+)\s*$", 1).try_cast("double").alias("value"))
    return found.filter("key <> '' and value is not null and not isnan(value) and abs(value) < double('infinity')")


def event_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """``time \\t message`` lines: ``ts, action, job, gpus, batch, attempt``; other lines are left out."""
    # fixed format: START kind name ... gpu_0,1 attempt_1_of_2 batch_8
    message = F.regexp_extract(text, r"^[^\t]*\t\s*(.*)$", 1)
    action = F.regexp_extract(message, r"^(START|END|FAILED|STOPPED)\b", 1)
    get = lambda p: F.regexp_extract(message, p, 1)
    rows = lines.select(F.regexp_extract(text, r"^([^\t]*)\t", 1).try_cast("timestamp").alias("ts"), action.alias("action"), get(r"^\S+\s+(\S+)").alias("job"), get(r"\bgpu_([0-9,]+)").alias("g"), get(r"\bbatch_(\S+)").alias("batch"), get(r"\battempt_(\d+_of_\d+)").alias("attempt"))
    return rows.filter("ts is not null and action <> ''").withColumn("gpus", F.transform(F.filter(F.split("g", ","), lambda x: x != ""), lambda x: x.cast("int"))).drop("g")


def progress(lines: DataFrame, text: str = "value") -> DataFrame:
    """The last ``done/total [elapsed<left, rate]`` of each text: ``done, total, per_second``."""
    hits = F.regexp_extract_all(F.col(text), F.lit(r"(\d+/\d+ \[[^\]]*?[\d.]+(?:it/s|s/it)\])"), 1)
    last = F.try_element_at(hits, F.lit(-1))
    rate = F.regexp_extract(last, r"([\d.]+)(?:it/s|s/it)\]", 1).try_cast("double")
    per_second = F.when(F.contains(last, F.lit("it/s")), rate).otherwise(F.try_divide(F.lit(1.0), rate))
    return lines.select(text, F.regexp_extract(last, r"^(\d+)/", 1).try_cast("long").alias("done"), F.regexp_extract(last, r"/(\d+) ", 1).try_cast("long").alias("total"), per_second.alias("per_second"))


def long_history(rows: DataFrame, run: str, step: str, values: str) -> DataFrame:
    """Rows with a map of metric values as ``run, step, metric, value``."""
    return rows.select(run, step, F.explode(values).alias("metric", "value")).filter("value is not null")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files: ``path, meta`` (front matter as a map) and ``body``."""
    from loamline.operators.sequential import front_matter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [front_matter(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(m.items()) for m, _ in split], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in split])], ["path", "meta", "body"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(run, "path string, meta map<string,string>, body string")


def chosen(catalog: DataFrame, groups: list[str], only: list[str] = (), skip: list[str] = ()) -> DataFrame:
    """Catalog rows (``name, groups, gated``) in a wanted group, listed if there is a list, not skipped and not gated."""
    out = catalog.filter(F.arrays_overlap("groups", F.array(*[F.lit(g) for g in groups])) & ~F.coalesce("gated", F.lit(False)))
    out = out.filter(F.col("name").isin(*only)) if only else out
    return out.filter(~F.col("name").isin(*skip)) if skip else out


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files whose size or time isn't what the manifest (``path, length, modificationTime``) has."""
    now = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return now.join(manifest, ["path", "length", "modificationTime"], "left_anti")


def remaining(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests whose id isn't in the output yet."""
    return requests.join(done.select(key), key, "left_anti")


def nested(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Values at JSON paths of a text column, null where there is none; lists are joined by commas."""
    v = F.try_parse_json(F.col(column))
    one = lambda p: F.coalesce(F.array_join(F.try_variant_get(v, p, "array<string>"), ", "), F.try_variant_get(v, p, "string"))
    return df.select("*", *[one(p).alias(n) for n, p in paths.items()])
