"""Metric histories in long form (``step, key, value`` and whatever names a run): cleaning, splicing, replacing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import text as X
from loamline.operators import measure as M


def finite_rows(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is a finite number, as a double."""
    return rows.withColumn(value, X.finite(F.col(value))).filter(F.col(value).isNotNull())


def any_prefix(key: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [key.startswith(p) for p in prefixes], F.lit(False))


def renamed(rows: DataFrame, names: list[tuple[str, str]], key: str = "key", strict: bool = False) -> DataFrame:
    """Leading namespaces replaced, the first that fits; with ``strict`` a key that none fits is an error."""
    out = F.raise_error(F.concat(F.lit("no namespace for "), F.col(key))).cast("string") if strict else F.col(key)
    for old, new in reversed(names):
        out = F.when(F.col(key).startswith(old), X.rewrite_prefix(F.col(key), old, new)).otherwise(out)
    return rows.withColumn(key, out)


def with_replacement(history: DataFrame, fresh: DataFrame, *, step: int, epoch: float, prefixes: list[str], tolerance: float = 1e-12) -> DataFrame:
    """The evaluation keys at a step, or at any step of the same epoch, replaced by fresh rows at that step (history has ``epoch``)."""
    hit = ((F.col("step") == step) | (F.abs(F.col("epoch") - epoch) <= tolerance)) & any_prefix(F.col("key"), prefixes)
    kept = history.filter(~F.coalesce(hit, F.lit(False)))
    put = fresh.select(F.lit(step).cast(history.schema["step"].dataType).alias("step"), F.lit(float(epoch)).alias("epoch"), "key", "value")
    return kept.select("step", "epoch", "key", "value").unionByName(put)


def spliced(training: DataFrame, evaluation: DataFrame, *, evals: list[str], drop: list[str] = ()) -> DataFrame:
    """Training keys of one history and evaluation keys of another, without convenience keys; evaluation overwrites by step and key."""
    own = lambda df, want: df.filter((any_prefix(F.col("key"), evals) == want) & ~any_prefix(F.col("key"), list(drop))).select("step", "key", "value", F.lit(int(want)).alias("_of"))
    return M.coalesce_rows(own(training, False).unionByName(own(evaluation, True)), ["step", "key"], "value", ["_of"])


def steps_of(rows: DataFrame, axes: list[str]) -> DataFrame:
    """``step`` from the first of several axis columns that has a value."""
    return rows.withColumn("step", F.coalesce(*[F.col(a).cast("long") for a in axes]))


def appended(first: DataFrame, second: DataFrame, drop: str) -> DataFrame:
    """One history after the other, without keys that hold a marker; equal rows once."""
    return first.unionByName(second).filter(~F.contains(F.col("key"), F.lit(drop))).dropDuplicates()


def newly_complete(states: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """Files that are complete and have no marker yet, in the order of their names."""
    return states.filter("complete").join(marked.select(key), key, "left_anti").orderBy(key)


def renamed_field(df: DataFrame, column: str, old: str, new: str, constants: dict[str, Column]) -> DataFrame:
    """A struct column with a field renamed and others set."""
    out = F.col(column).withField(new, F.col(f"{column}.{old}")).dropFields(old)
    for name, value in constants.items():
        out = out.withField(name, value)
    return df.withColumn(column, out)


def within(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the ranges that hold them (start inclusive), by an equi-join on blocks of ``width``."""
    block = lambda c: F.floor(F.col(c) / width)
    spread = ranges.withColumn("_b", F.explode(F.sequence(block(start), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_b", block(at)).join(spread, "_b").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def as_of(points: DataFrame, states: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """For each point the last state of its key at or before it, by one union and window."""
    from pyspark.sql import Window

    a = points.select(*points.columns, F.lit(None).cast(states.schema[value].dataType).alias(value), F.lit(1).alias("_p"))
    rest = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (by, at)]
    b = states.select(by, at, *rest, value, F.lit(0).alias("_p")).select(*a.columns)
    w = Window.partitionBy(by).orderBy(at, "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_p = 1").drop("_p")


def blocks(requests: DataFrame, like: list[str], order: str, size: int) -> DataFrame:
    """Requests that go together (equal in ``like``) in blocks of ``size``."""
    from pyspark.sql import Window

    return requests.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*like).orderBy(order)) - 1) / size).cast("long"))
