"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import ann, hosts, langid, mixing, outliers, packing, quality, records, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document, and whether it lies within its language's and source's robust scatter."""
    return outliers.judge(_table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned out of the held-out fold."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a mixture with flattened source weights takes, in which pass and block."""
    return mixing.mix(_table(spark, sf_dir, "documents"), columns=["doc_id", "source"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned out of the held-out fold."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents by fingerprints that differ in two bits or fewer."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url; thin pages are the bad outcomes."""
    return hosts.judge(_table(spark, sf_dir, "pages"), hosts.thin_page(F.col("html")))


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as binary records of token ids, and what the files hold when read back."""
    return records.records_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned out of the held-out fold."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    return ann.search(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_outliers, op2_langid, op3_mixing, op4_quality, op5_simhash, op6_hosts, op7_records, op8_packing, op9_toxicity, op10_ann)}
SQL: dict[str, str] = {"op3_mixing": mixing.SQL, "op6_hosts": hosts.SQL}
