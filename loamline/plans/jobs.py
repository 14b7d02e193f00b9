"""Job tables: dependencies, readiness, progress; and registries of converters, benchmarks and generators."""

from __future__ import annotations

import abc
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.shared import cut

TERMINAL = ("DONE", "FAILED", "SKIPPED")


def dependencies(jobs: DataFrame) -> DataFrame:
    """``job_id, dep, dep_status`` for every dependency; the status of a missing job is null."""
    deps = jobs.select("job_id", F.explode("deps").alias("dep"))
    return deps.join(jobs.select(F.col("job_id").alias("dep"), F.col("status").alias("dep_status")), "dep", "left")


def hopeless(jobs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Jobs that can't succeed: failed or skipped ones, and waiting ones (success mode) with a dependency that can't."""
    edges = jobs.filter(~F.col("status").isin("DONE", "RUNNING") & (F.col("deps_mode") != "terminal")).select("job_id", F.explode("deps").alias("dep"))
    found = jobs.filter(F.col("status").isin("FAILED", "SKIPPED")).select("job_id")
    for _ in range(most_rounds):
        more = edges.join(found.select(F.col("job_id").alias("dep")), "dep", "left_semi").select("job_id").distinct().join(found, "job_id", "left_anti")
        if more.isEmpty():
            return found
        found = cut(found.unionByName(more))
    raise RuntimeError("the dependency chain is longer than the rounds allowed")


def ready(jobs: DataFrame) -> DataFrame:
    """``job_id, satisfied``: all dependencies done, or in terminal mode ended or beyond hope; a missing one is never satisfied."""
    lost = hopeless(jobs).select(F.col("job_id").alias("dep"), F.lit(True).alias("lost"))
    d = dependencies(jobs).join(lost, "dep", "left").join(jobs.select("job_id", "deps_mode"), "job_id")
    ended = F.col("dep_status").isNotNull() & (F.col("dep_status").isin(*TERMINAL) | F.coalesce("lost", F.lit(False)))
    ok = F.when(F.col("deps_mode") == "terminal", ended).otherwise(F.coalesce(F.col("dep_status") == "DONE", F.lit(False)))
    told = d.groupBy("job_id").agg(F.bool_and(ok).alias("ok"))
    return jobs.select("job_id").join(told, "job_id", "left").select("job_id", F.coalesce("ok", F.lit(True)).alias("satisfied"))


def row_to_job(rows: DataFrame) -> DataFrame:
    """Text columns of a plan as a job: blanks are null, lists and maps parsed."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.withColumn("deps", F.coalesce(F.split(blank(F.col("deps")), ","), F.array().cast("array<string>"))).withColumn("metadata", F.from_json(blank(F.col("metadata")), "map<string,string>"))


def job_to_row(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("deps", F.array_join("deps", ",")).withColumn("metadata", F.coalesce(F.to_json("metadata"), F.lit("")))


def shard_total(total, index, shards):
    """Rows of one of several shards dealt in turn."""
    return F.floor((total + shards - 1 - index) / shards).cast("long")


def eta(done, seconds, left):
    """Seconds left at the rate so far, null before anything is done."""
    return F.try_divide(left * seconds, done)


def enough_memory(gpus: DataFrame, least_free: int) -> DataFrame:
    """The device with most free memory that has enough: ``gpu``, or no row."""
    return gpus.filter(F.col("free") >= least_free).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("free"), "gpu"))).filter("_k = 1").select("gpu")


class Registry:
    """Callables by name; a prefix names a family."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable] = {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def keep(f: Callable) -> Callable:
            if name in self._by_name:
                raise KeyError(f"{name} is registered already")
            self._by_name[name] = f
            return f

        return keep

    def __getitem__(self, name: str) -> Callable:
        if name in self._by_name:
            return self._by_name[name]
        family = [n for n in self._by_name if n.endswith("*") and name.startswith(n[:-1])]
        if not family:
            raise KeyError(f"{name} is none of {', '.join(sorted(self._by_name))}")
        return self._by_name[max(family, key=len)]


class Benchmark(abc.ABC):
    """Prompts with truths as a DataFrame (``idx, prompt, truth``), and metrics of generations joined to them."""

    settings: dict[str, object] = {}

    @abc.abstractmethod
    def prompts(self) -> DataFrame: ...

    @abc.abstractmethod
    def metrics(self, answered: DataFrame) -> DataFrame: ...

    def options(self, **given: object) -> dict[str, object]:
        """Settings, the most specific first: given ones, the class's, its parents'."""
        out: dict[str, object] = {}
        for c in reversed(type(self).__mro__):
            out |= getattr(c, "settings", {})
        return out | given


def generate(prompts: DataFrame, client: Callable[[list[str]], list[str]], *, prompt: str = "prompt", batch: int = 64) -> DataFrame:
    """``generation`` beside each prompt, from a client that takes and returns lists of texts."""
    names = prompts.columns
    at = names.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            got = [g for i in range(0, len(texts), batch) for g in client(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*names, "generation"])

    return prompts.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", generation string")


@functools.lru_cache(4)
def tokenizer(path: str):
    """The tokenizer that a file describes, once for each worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text without special tokens; the file must be there on executors."""
    return lambda text: tokenizer(path).encode(text, add_special_tokens=False).ids


def tokenised(rows: DataFrame, encode: Callable[[str], list[int]], render: Callable[[str, str], tuple[str, str]], least: int = 2) -> DataFrame:
    """Prompt and answer ids where the ids of the prompt begin those of the whole and ``least`` ids of an answer are left: ``inst_tokens, resp_tokens``."""
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, i, r in zip(*(c.to_pylist() for c in b.columns)):
                prompt, whole = (encode(t) for t in render(i, r))
                if whole[: len(prompt)] == prompt and len(whole) - len(prompt) >= least:
                    out.append((k, prompt, whole[len(prompt) :]))
            if out:
                ks, ins, rs = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ks, b.column(0).type), pa.array(ins, pa.list_(pa.int64())), pa.array(rs, pa.list_(pa.int64()))], [key, "inst_tokens", "resp_tokens"])

    return rows.select(key, "instruction", "response").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, inst_tokens array<long>, resp_tokens array<long>")
