"""Connected components of a link table, by alternating large-star and small-star steps.

Each step takes the least neighbour of every node by an aggregation (combined before
the shuffle) and joins it back to the links, so a hub with very many links
is a skewed join side that can be split, never a group held by one task.
Nothing is collected; each round is cut into the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.shared import cut, map_batches

#: Links that are reduced to a forest at once.
_AT_ONCE = 1_000_000


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least that it reaches, itself left out."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def links() -> pa.RecordBatch:
        a, b = _roots(*np.concatenate(held, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        n += len(batch)
        if n >= _AT_ONCE:
            yield links()
            held, n = [], 0
    if n:
        yield links()


def forest(links: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect what ``links`` do, in number under the nodes for each ``_AT_ONCE`` of them; ``links`` is a table at hand (``cut``)."""
    tasks = -(-links.count() // _AT_ONCE)
    return map_batches(links.select("a", "b").coalesce(max(1, tasks)), _forest, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node with a link (columns ``a, b``, long): the least node that it reaches."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    for _ in range(most_rounds):
        e = cut(_small_star(_large_star(e).distinct()).distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
