"""Writers of training data, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions import hashing as H
from loamline.functions import text as X
from loamline.operators import expand, curate


def triplets(df: DataFrame, *, both_sides: bool = False) -> DataFrame:
    """Stripped triplets with a default condition; rows without a response go, and with ``both_sides`` those without an instruction."""
    side = lambda c: X.strip(F.coalesce(F.col(c), F.lit("")))
    cond = side("condition") if "condition" in df.columns else F.lit("")
    out = df.select(F.coalesce(F.nullif(cond, F.lit("")), F.lit("direct")).alias("condition"), side("instruction").alias("instruction"), side("response").alias("response"))
    return out.filter("response <> ''" + (" and instruction <> ''" if both_sides else ""))


def write_triplets(df: DataFrame, path: str, *, both_sides: bool = False) -> None:
    triplets(df, both_sides=both_sides).write.option("compression", "zstd").parquet(path)


def write_categories(df: DataFrame, path: str, *, file: str, order: str, most: int) -> None:
    """A folder for each category, with at most ``most`` rows of each file, first come."""
    curate.cap(df, [file, "category"], [F.col(order)], most).write.option("compression", "zstd").partitionBy("category").parquet(path)


def chat_lines(df: DataFrame) -> DataFrame:
    """``{"messages": [user, assistant]}`` of rows with text on both sides, a line each."""
    t = df.select(X.clean_line(F.col("instruction")).alias("i"), X.clean_line(F.col("response")).alias("r")).filter("i <> '' and r <> ''")
    return t.select(F.to_json(F.struct(expand.to_messages(F.lit("direct"), F.col("i"), F.col("r")).alias("messages"))).alias("value"))


def write_chat(df: DataFrame, path: str) -> None:
    chat_lines(df).write.option("compression", "gzip").text(path)


def write_by_rows(df: DataFrame, path: str, rows: int) -> None:
    """Files of ``rows`` rows at most."""
    df.write.option("maxRecordsPerFile", rows).parquet(path)


def checksums(spark, path: str) -> DataFrame:
    """SHA-256, size and rows (lines that aren't blank) of text files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != "")).alias("rows"))


def report(df: DataFrame, title: str, missing: str = "—", most: int = 1000) -> str:
    """A Markdown table of a small result; one of more than ``most`` rows is an error."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report holds {most} rows at most, and {title!r} has more")
    rows = [[missing if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in found]
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return f"## {title}\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in lines) + "\n"


def sampled_dataset(df: DataFrame, *, epochs: int, seed: int, key: str = "row", context: int | None = None) -> DataFrame:
    """Every row once for each epoch, in a seeded order: ``epoch, order_key``, lengths, and offsets of its tokens."""
    rows = df.select(key, F.size("inst_tokens").cast("long").alias("inst_len"), F.size("resp_tokens").cast("long").alias("resp_len"))
    if context is not None:
        rows = expand_fit(rows, context)
    rows = expand.offsets(rows.withColumn("_all", F.lit(0)).withColumn("_len", F.col("inst_len") + F.col("resp_len")), ["_all"], [key], "_len").drop("_all", "_len")
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn("order_key", H.digest(seed, F.col("epoch"), F.col(key)))


def expand_fit(rows: DataFrame, context: int) -> DataFrame:
    room = F.lit(context) - F.least(F.col("inst_len"), F.lit(context))
    return rows.filter(room >= 1).withColumn("resp_len", F.least(F.col("resp_len"), room))
