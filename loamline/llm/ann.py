"""Approximate nearest neighbours by balanced posting lists (op 10).

Fit: a bounded sample of distinct vectors (``sample``, and 64 MB; up to that the number of lists grows with the table) is halved again and again, each time into two equal parts along a
two-means split, until a part has ``list_sample`` vectors; their means are the centroids, so lists are about equally long.
A graph of each centroid's nearest neighbours is kept in memory, and every search for centroids walks it best-first.

Index: all vectors, by one pass.  A vector goes to its nearest centroid, and near a boundary to further
ones too: those within ``1 + spread`` times the least distance, ``most_copies`` at most.

Search: a query reads the lists whose centroid is within ``1 + ratio`` times a reference distance, ``most_lists`` at most.  The reference is the mean distance of
its second to ninth nearest centroid, for the nearest alone says little: a vector of the sample has drawn its own centroid near.  Lists and queries meet by list; a long list is dealt into parts, and so are many queries of a list.  Distances are
exact, in double precision on the vectors as given.

Exact copies are one vector with its ``k + 1`` smallest ids (no more can be among anyone's k nearest), and queries with the same vector are
searched once, so that a vector standing for a third of the table is one row on either side.

Rules: vectors that are null, empty, zero, or hold null or non-finite components, null ids, and vectors of another length than most (the
longer of equally frequent ones) take no part; rows repeating an id and vector count once; of several vectors with one id, all are
candidates and each finds its own neighbours, ranked together; with fewer than k candidates all are returned; ties go to the smaller
id; of components beyond 1e150 the search is coarse, their distances are right; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.shared import cut, map_batches

_SAMPLE_BYTES = 64_000_000


@dataclasses.dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid, nearest first
    entries: np.ndarray

    def nearest(self, x: np.ndarray, n: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``n`` nearest centroids of each row that a best-first walk over the graph finds, and their distances (inf: none)."""
        b, c = len(x), len(self.centroids)
        n, beam = min(n, c), min(max(beam, n), c)
        square = (self.centroids**2).sum(1)
        own = (x**2).sum(1)[:, None]
        seen = np.zeros((b, c + 1), bool)
        row = np.arange(b)[:, None]
        ids = np.tile(self.entries, (b, 1))
        found, done = np.zeros((b, 0), np.int64), np.zeros((b, 0), bool)
        dist = np.zeros((b, 0))
        while True:
            first = np.sort(ids, axis=1)
            first[:, 1:][first[:, 1:] == first[:, :-1]] = c
            first[seen[row, first]] = c
            first = np.sort(first, axis=1)
            first = first[:, : max(1, int((first < c).sum(1).max()))]
            seen[row, first] = True
            at = np.minimum(first, c - 1)
            d = own + square[at] - 2 * np.einsum("bd,bkd->bk", x, self.centroids[at])
            d[first == c] = np.inf
            found, dist, done = np.concatenate([found, first], 1), np.concatenate([dist, d], 1), np.concatenate([done, first == c], 1)
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            found, dist, done = found[row, order], dist[row, order], done[row, order]
            if done.all():
                break
            step = np.argsort(done, axis=1, kind="stable")[:, :4]  # the nearest not yet expanded
            open_ = ~done[row, step]
            ids = np.where(open_[:, :, None], self.graph[np.minimum(found[row, step], c - 1)], c).reshape(b, -1)
            done[row, step] = True
        return found[:, :n], np.sqrt(np.maximum(dist[:, :n], 0))


def build(sample: np.ndarray, list_sample: int, neighbours: int = 24) -> Index:
    """Centroids by balanced halving, and their graph."""
    parts, leaves = [np.arange(len(sample))], []
    while parts:
        part = parts.pop()
        if len(part) <= list_sample:
            leaves.append(part)
            continue
        x = sample[part]
        a = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
        b = x[np.argmax(((x - a) ** 2).sum(1))]
        for _ in range(8):
            side = x @ (b - a)
            order = np.argsort(side, kind="stable")
            half = len(part) // 2
            a, b = x[order[:half]].mean(0), x[order[half:]].mean(0)
        parts += [part[order[:half]], part[order[half:]]]
    centroids = np.stack([sample[p].mean(0) for p in leaves])
    c = len(centroids)
    square = (centroids**2).sum(1)
    near = np.concatenate([np.argsort(square[None] - 2 * centroids[i : i + 256] @ centroids.T, axis=1, kind="stable")[:, : neighbours + 1] for i in range(0, c, 256)])
    graph = np.stack([np.concatenate([r[r != i], [i]])[: max(1, min(neighbours, c - 1))] for i, r in enumerate(near)])
    back = np.random.default_rng(1).integers(0, c, (c, 2))  # long links keep the graph in one piece
    entries = np.unique(np.linspace(0, c - 1, min(c, 24)).astype(np.int64))
    return Index(centroids, np.concatenate([graph, back], axis=1), entries)


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).astype(np.float64)


def _squarable(x: np.ndarray) -> np.ndarray:
    """Components beyond 1e150 are cut to it where lists and candidates are chosen, so that squares stay finite; reported distances don't use this."""
    return np.clip(x, -1e150, 1e150)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, also where squares would overflow."""
    with np.errstate(over="ignore"):
        out = np.sqrt(((x - y) ** 2).sum(1))
    if (far := ~np.isfinite(out)).any():
        half = x[far] / 2 - y[far] / 2
        most = np.abs(half).max(1)
        out[far] = np.minimum(2 * (most * np.sqrt(((half / most[:, None]) ** 2).sum(1))), np.finfo(float).max)
    return out


def _reference(d: np.ndarray) -> np.ndarray:
    """The distance that others are held against: the mean of the second to ninth nearest centroid, or of as many as there are."""
    some = np.where(np.isfinite(d[:, 1:9]), d[:, 1:9], np.nan)
    n = np.isfinite(some).sum(1)
    return np.where(n > 0, np.nansum(some, axis=1) / np.maximum(n, 1), d[:, 0])[:, None]


def search(vectors: DataFrame, *, k: int = 10, every: int = 100, sample: int = 65_536, list_sample: int = 32, spread: float = 0.25, most_copies: int = 6, ratio: float = 0.08, most_lists: int = 256, list_rows: int = 4_000, query_rows: int = 4_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of the rows whose id is divisible by ``every``: ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    item = vectors.schema[vector_col].dataType.elementType
    dtype, number = ("<f4", "float") if isinstance(item, T.FloatType) else ("<f8", "double")
    v = F.col(vector_col).cast(f"array<{number}>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & fine)
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width, total = widths[0]
    sample = min(sample, max(1024, _SAMPLE_BYTES // (8 * width)))
    rows = rows.filter(F.size("v") == width)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a batch, the k + 1 smallest ids of each vector, and the smallest that is a query."""
        for batch in batches:
            if not len(batch):
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)
            ids = batch.column(0).to_numpy()
            inverse = pa.array([r.tobytes() for r in flat], pa.binary()).dictionary_encode().indices.to_numpy()
            order = np.lexsort((ids, inverse))
            start = np.flatnonzero(np.concatenate([[True], inverse[order][1:] != inverse[order][:-1]]))
            groups = np.split(ids[order], start[1:])
            yield pa.RecordBatch.from_arrays([pa.array([flat[i].tobytes() for i in order[start]], pa.binary()), pa.array([np.unique(g)[: k + 1].tolist() for g in groups], pa.list_(pa.int64()))], ["vec", "ids"])

    least = lambda ids: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))), 1, k + 1)
    partial = map_batches(rows, combine, "vec binary, ids array<long>").groupBy("vec", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(least("ids").alias("ids"))
    distinct = cut(partial.groupBy("vec").agg(least("ids").alias("ids")).select("vec", "ids", F.col("ids")[0].alias("rep")))
    n = distinct.count()
    taken = distinct.select("vec", F.xxhash64("vec").alias("h")).filter(F.pmod(F.col("h"), F.lit(1 << 20)) < min(1 << 20, 2 + (2 * sample << 20) // n)).orderBy("h", "vec").limit(sample).select("vec").toArrow()
    x = _matrix(taken.column("vec").combine_chunks(), dtype).reshape(-1, width)
    index = spark.sparkContext.broadcast(build(_squarable(x), list_sample))  # under sample / list_sample * 2 centroids

    def dealt(columns: list[str], probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    part = batch.slice(at, 1024)
                    q = _squarable(_matrix(part.column(0), dtype).reshape(-1, width))
                    near, d = ix.nearest(q, most_lists if probe else most_copies, most_lists + 64 if probe else 32)
                    if probe:
                        take = d <= (1 + ratio) * _reference(d) + 1e-12
                    else:
                        take = d <= (1 + spread) * d[:, :1] + 1e-12
                    take &= np.isfinite(d)
                    r, c = np.nonzero(take)
                    yield pa.RecordBatch.from_arrays([pa.array(near[r, c]), *(col.take(pa.array(r)) for col in part.columns)], ["list", *columns])

        return run

    posted = map_batches(distinct.select("vec", "ids", "rep"), dealt(["vec", "ids", "rep"], False), "list long, vec binary, ids array<long>, rep long")
    asking = rows.filter(F.col("id") % every == 0).select("id", F.col("v"))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "vec"])

    asking = cut(map_batches(asking, bytes_of, "id long, vec binary"))
    queries = asking.groupBy("vec").agg(F.min("id").alias("q"))
    probes = cut(map_batches(queries.select("vec", "q"), dealt(["vec", "q"], True), "list long, vec binary, q long"))
    posted = cut(posted)
    sizes = posted.groupBy("list").agg(F.count("*").alias("n")).join(probes.groupBy("list").agg(F.count("*").alias("m")), "list")
    sizes = F.broadcast(sizes.selectExpr("list", f"cast(ceil(n / {list_rows}) as int) as vs", f"cast(ceil(m / {query_rows}) as int) as qs"))  # a row for each centroid
    left = posted.join(sizes, "list").select("list", F.pmod(F.xxhash64("rep"), "vs").cast("int").alias("vpart"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qpart"), "vec", "ids")
    right = probes.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vpart"), F.pmod(F.xxhash64("q"), "qs").cast("int").alias("qpart"), "vec", "q")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(a) and len(b):
            y, x = _matrix(a.column("vec").combine_chunks(), dtype).reshape(-1, width), _matrix(b.column("vec").combine_chunks(), dtype).reshape(-1, width)
            ids, who = a.column("ids").to_pylist(), b.column("q").to_pylist()
            near = _squarable(y)
            square = (near**2).sum(1)
            for at in range(0, len(x), 256):
                some = _squarable(x[at : at + 256])
                rough = square[None] + (some**2).sum(1)[:, None] - 2 * some @ near.T
                kth = np.partition(rough, min(k, rough.shape[1] - 1), axis=1)[:, min(k, rough.shape[1] - 1)]
                r, c = np.nonzero(rough <= (kth + 1e-9 * (1 + square.max()))[:, None])
                exact = distances(x[at + r], y[c])
                order = np.lexsort((exact, r))
                edge = np.searchsorted(r[order], np.arange(min(256, len(x) - at) + 1))
                for i in range(len(edge) - 1):
                    best = sorted((d, j) for p in order[edge[i] : edge[i + 1]].tolist() for d, j in ((exact[p], j) for j in ids[c[p]]))
                    out += [(who[at + i], j, float(d)) for d, j in best[: k + 1]]
        q, j, d = zip(*out) if out else ((), (), ())
        return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(j, pa.int64()), "d": pa.array(d, pa.float64())})

    by = ["list", "vpart", "qpart"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "q long, id long, d double")
    # of each query the best k + 1 in each partition first, then of all: no group holds more
    once = met.groupBy("q", "id").agg(F.min("d").alias("d")).selectExpr("*", "row_number() over (partition by q order by d, id) as place").filter(F.col("place") <= k + 1)
    best = once.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("best"))
    answers = asking.distinct().join(queries, "vec").join(best, "q").select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda c: c["id"] != F.col("id")), 1, k).alias("best"))
    return answers.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.d").alias("score"))

