"""Event streams: windows, late data, last states, deduplication, resumable output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from loamline.operators.curate import last_wins
from loamline.shared import cut, fresh_path


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 1000) -> DataFrame:
    """Parquet files of events (a file, a folder or a pattern) as a stream, with ``ts`` as a timestamp with zone."""
    schema = spark.read.parquet(path).schema
    path = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"  # a pattern may also name a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window (tumbling, or sliding by ``slide``) and type; later events than the watermark are left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a user: no pause of ``gap`` or longer."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def last_states(events: DataFrame, opening: tuple[str, ...], closing: tuple[str, ...]) -> DataFrame:
    """For each user the event type that holds now: the last of the opening and closing ones (a state for each user)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for b in batches:
            b = b[b.event_type.isin([*opening, *closing])]
            if len(b):
                top = b.sort_values(["ts", "event_id"]).iloc[-1]
                now = (str(top.event_type), int(top.ts.value), int(top.event_id))
                best = now if best is None or now[1:] > tuple(best)[1:] else best
        if best is not None:
            state.update(tuple(best))
            yield pd.DataFrame({"user_id": [key[0]], "event_type": [best[0]], "open": [best[0] in opening]})

    return events.select("user_id", "event_type", "ts", "event_id").groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_type string, open boolean", "event_type string, ts long, event_id long", "update", GroupStateTimeout.NoTimeout)


def _written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What lies under a path of ours; no rows before anything was written."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_to(stream: DataFrame, path: str, progress: str) -> DataFrame:
    """Process what is there since the last run with this ``progress``, and append it to ``path``."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process what is there, through Parquet in the shared folder.  ``complete`` gives the last result, ``update`` the last row of each of ``keys``."""
    spark, out, progress = stream.sparkSession, fresh_path(stream.sparkSession, "stream"), fresh_path(stream.sparkSession, "progress")
    if mode == "append":
        return run_to(stream, out, progress)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    found = _written(spark, out, StructType([*stream.schema, StructField("batch", LongType())]))
    if mode == "update":
        return last_wins(found, keys, "batch").drop("batch")
    return found.filter(F.col("batch") == found.agg(F.max("batch")).first()[0]).drop("batch")


def append_new(stream: DataFrame, key: str, path: str, progress: str) -> None:
    """Append rows whose key the output doesn't have yet; what is written again after a restart isn't doubled."""

    def write(batch: DataFrame, _: int) -> None:
        old = _written(batch.sparkSession, path, batch.schema)
        batch.dropDuplicates([key]).join(old.select(key), key, "left_anti").write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def watch(status: DataFrame, done: Callable[[DataFrame], DataFrame], act: Callable[[DataFrame], None], progress: str, key: str, acted: str) -> None:
    """In each batch, act on the rows of keys that have newly become complete; the folder ``acted`` keeps those keys over restarts.

    A batch that failed between the action and the note of its keys is acted on again.
    """

    def step(batch: DataFrame, _: int) -> None:
        complete = done(batch).select(key).distinct()
        now = cut(complete.join(_written(batch.sparkSession, acted, complete.schema), key, "left_anti"))
        if not now.isEmpty():
            act(batch.join(now, key, "left_semi"))
            now.write.mode("append").parquet(acted)

    status.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
