"""Words of many texts at once, as arrays; and bounded labelled samples for classifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.shared import cut, map_batches

#: Longer texts are worked on in parts, so that memory doesn't grow with the length of a text.
LONG = 4_000_000
_CUT = re.compile(rb"(?<=[^ \t\n\x0b\f\r])[ \t\n\x0b\f\r]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts one after another (null: empty), and where each begins (one more than there are texts)."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[edge[0] : edge[-1]]
    return raw, edge - edge[0]


def words_of(raw: np.ndarray, edge: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (cut at ASCII white space), which of them each word is, the words before each text, and the byte where each word begins."""
    if not len(raw):
        return [], np.zeros(0, np.int32), np.zeros(len(edge), np.int64), np.zeros(0, np.int64)
    dark = ~_SPACE[raw]
    first = np.zeros(len(raw), bool)
    first[edge[:-1][edge[:-1] < len(raw)]] = True
    at = np.flatnonzero(dark & (first | np.concatenate([[True], ~dark[:-1]])))
    moved = np.concatenate([[0], np.cumsum(dark)])
    offsets = np.concatenate([moved[at], moved[-1:]]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[dark]))]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.searchsorted(at, edge), at


def parts_of(text: bytes, size: int = LONG) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut in front of runs of white space; a run without white space stays whole."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, fold: F.Column, bound: int, *, good: str = "min", seed: int = 7) -> DataFrame:
    """``doc_id, label, text`` of ``bound`` labelled documents at most for which ``fold`` (of ``doc_id``) holds; texts are whole, null ones empty.

    Taken by a seeded hash of the id, among ids that ``docs`` has; every row of an id taken is there (see ``one_of_each``).
    Repeated labels of a document count as their least (``good="min"``) or greatest.
    Only the ids and labels taken are broadcast, ``bound`` rows at most.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & fold)
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(getattr(F, good)(column).cast("int").alias("label"))
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    taken = one.join(here, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(taken), "doc_id").select("doc_id", "label", "text")


def one_of_each(encoded: DataFrame, column: str, size: F.Column, most: int, seed: int = 7) -> DataFrame:
    """Of rows ``doc_id, label`` and an encoded text, the least encoded text of each id: whole documents until ``most`` units of ``size`` are reached.

    ``encoded`` has rows of a bounded number of ids, whose sizes meet in one window.
    """
    rows = cut(encoded.groupBy("doc_id", "label").agg(F.min(column).alias(column)))
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select("doc_id", size.alias("size")).select("doc_id", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before.filter(F.col("before") < most).select("doc_id")), "doc_id")


def fold_of(column: str, parts: int) -> F.Column:
    """``crc32(id as text) mod parts``."""
    return F.crc32(F.col(column).cast("string")) % parts


def keep_where(docs: DataFrame, decide: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, for whose texts ``decide`` holds."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(decide(batch.column(at).cast(pa.string())), pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns], names)

    return map_batches(docs, run, docs.schema)
