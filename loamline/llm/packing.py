"""Bounded-space online best-fit packing of token sequences (op 8).

Every task keeps a fixed number of open bins.  They are keyed by their free
space in a bitset, one bit for each possible amount, so that the tightest bin
that still takes a piece is the lowest set bit from the piece's length on, and
the fullest bin is the lowest set bit of all.  A piece that fits nowhere opens a
bin; with all bins open the fullest closes first.  Within one Arrow batch the
longest pieces are placed first.

Bins left open when a task ends are packed once more, each as one item, with
those of neighbouring tasks (``tasks_a_group`` of them, so that what meets in a
task is bounded by ``tasks_a_group * open_bins`` bins).  No text is shuffled, and
only the pieces of open bins are.

Rules: a null text is empty and has the end id alone; a document of more than
``capacity`` ids is cut into full pieces and a rest, a shorter one never; repeated
rows are packed each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.encoding import encoder, slices
from loamline.shared import cut, map_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, bin long, offset long, open boolean"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


class OpenBins:
    """At most ``limit`` open bins of ``capacity``; ``put`` gives bin and offset, and says which bin it closed."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.next = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return found

    def put(self, size: int) -> tuple[int, int, list[int]]:
        """Place an item: its bin, its offset there, and the bins that are closed now."""
        closed = []
        if fits := self.bits >> size:
            free = size + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.count == self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
                self.count -= 1
            at, free = self.next, self.capacity
            self.next += 1
            self.count += 1
        if free == size:
            closed.append(at)
            self.count -= 1
        else:
            self.by_free.setdefault(free - size, []).append(at)
            self.bits |= 1 << free - size
        return at, self.capacity - free, closed


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """Piece number, start and length of a sequence of ``n`` ids."""
    return ((i, start, min(capacity, n - start)) for i, start in enumerate(range(0, n, capacity)))


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = 4096, open_bins: int = 512, tasks_a_group: int = 16, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: where its ids lie in which sequence (with ``with_ids``, the ids too, as little-endian u32)."""
    schema, types = PIECES + ", ids binary" * with_ids, _TYPES + [pa.binary()] * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bins, waiting, tail = TaskContext.get().partitionId(), OpenBins(capacity, open_bins), {}, np.array([end_id], "<u4")

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        for batch in batches:
            doc_ids, texts, todo, done = batch.column(0).to_pylist(), batch.column(1), [], []
            for lo, hi in slices(texts):
                ids, edge = encoder(tokenizer).encode(texts[lo:hi])
                for k in range(lo, hi):
                    own = np.concatenate([ids[edge[k - lo] : edge[k - lo + 1]], tail])
                    for piece, start, n in pieces_of(len(own), capacity):
                        part = own[start : start + n]
                        todo.append((n, k, piece, start, zlib.crc32(part), *([part.tobytes()] if with_ids else [])))
            todo.sort(key=lambda x: (-x[0], x[1], x[2]))
            for n, k, piece, start, crc, *ids_too in todo:
                at, offset, closed = bins.put(n)
                waiting.setdefault(at, []).append((doc_ids[k], piece, start, n, crc, task, at, offset, False, *ids_too))
                for b in closed:
                    done += waiting.pop(b)
            if done:
                yield table(done)
        if waiting:
            yield table([(*r[:8], True, *r[9:]) for rows in waiting.values() for r in rows])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = cut(map_batches(rows, place, schema))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    own = F.shiftleft("task", 32) + F.col("bin")
    closed = placed.filter("not open").select(*kept, own.alias("sequence_id"), "offset")
    left = placed.filter("open").withColumn("_own", own)
    moves = regroup(left.groupBy("task", "_own").agg(F.sum("length").alias("used")), capacity, open_bins, tasks_a_group)
    moved = left.join(moves, "_own").select(*kept, "sequence_id", (F.col("offset") + F.col("shift")).alias("offset"))
    return closed.unionByName(moved)


def regroup(bins: DataFrame, capacity: int, open_bins: int, tasks_a_group: int) -> DataFrame:
    """Pack open bins (``task, _own, used``) as items: the sequence that each joins and how far its pieces move in it."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], -r[2], r[1]))
        out, group, packed, names = [], None, None, {}
        for g, own, used in rows:
            if g != group:
                group, packed, names = g, OpenBins(capacity, open_bins), {}
            at, offset, _ = packed.put(used)
            out.append((own, names.setdefault(at, own), offset))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["_own", "sequence_id", "shift"])

    grouped = bins.select(F.expr(f"task div {tasks_a_group}").alias("g"), "_own", "used").repartition("g")
    return map_batches(grouped, again, "_own long, sequence_id long, shift long")
