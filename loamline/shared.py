"""The folder that the driver and all executors share, and cutting lineage into it.

The cluster names the folder in ``spark.checkpoint.dir``.  Where that is unset, a
folder is made only for a local master, as in tests; on a cluster it is an error,
for a folder of one machine is not seen by the others.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: Bytes of a batch on its way to a Python worker and the setting for them; a session that sets it keeps its own.
BATCH_BYTES, _BATCH = 3_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session, as a URI."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if named := spark.conf.get("spark.checkpoint.dir", None):
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from the copy in the shared folder.

    The copy survives lost executors.  Spark removes it when nothing refers to it any more, if the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; otherwise it stays until the folder is emptied.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of ``BATCH_BYTES``: rows are whole texts of any length, and a batch is held in several forms at once."""
    conf = df.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, str(BATCH_BYTES))
    if any(set(".`") & set(c) for c in df.columns):  # names that mapInArrow can't resolve
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return df.mapInArrow(run, schema)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Computed once and, if it has ``most`` rows at most, marked for broadcast; a larger table is left to an ordinary join."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def packed(df: DataFrame, **more) -> DataFrame:
    """All columns as the struct ``row`` beside columns of our own, so that no name of theirs can clash with ours."""
    return df.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], *more) -> DataFrame:
    """The columns of ``row`` under their own names, and ``more``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns], *more)


def named(column: str):
    """The column of that very name, dots included."""
    return F.col(f"`{column.replace('`', '``')}`")
