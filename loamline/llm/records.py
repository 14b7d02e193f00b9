"""Length-delimited binary records of token ids, with an offset index (op 7).

A file holds frames one after another:

    u64 length | u32 masked CRC of these 8 bytes | payload | u32 masked CRC of the payload

all little-endian.  A mask is ``rotate right by 15, then add 0xA282EAD8`` (mod
2^32), so that a CRC stored inside checksummed data does no harm; the CRC is
CRC-32 as in zlib.  A payload is ``i64 document id | u8 flags | ids``: flag 1 marks
a null document id, flag 2 ids of 4 bytes instead of 2.

Beside each file of records lies its index, a file of its own (``.idx``): an entry of ``i64 document id | u8 flags | u64 offset | u32 size | u64 ids |
u64 ids of the file before`` for each frame, and a masked CRC behind each block of ``BLOCK`` entries.  Readers need nothing but the
folder's two kinds of files: they take offsets from the index and fetch frames in any order without scanning.

Writing: texts are encoded where they are read, and ids (two bytes each as a rule) are shuffled into ranges of ascending document ids, as many as there are input
partitions.  The ranges' bounds are approximate quantiles of the ids; an id so frequent that it spans several ranges is parted by a hash of the text.
A task writes a range into two files of its own name (range and attempt), and the row that comes back names
them.  A task that is run again writes other files and the rows of one
attempt only are kept, so a lost executor leaves unnamed files and nothing else.

Reading shuffled: blocks of ``run_length`` neighbouring frames are dealt out by a seeded hash, so that a permutation of the corpus costs a read for each
block; within a block frames come in the order of another hash.

Rules: a null text has the end id alone; rows with the same id each get a frame,
ordered by a hash of the text; null ids come first; a very long text is encoded in parts; an empty table gives an empty index and no files;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.encoding import encoder, slices
from loamline.shared import cut, fresh_path, map_batches, named

FILES = "path string, first long, frames long, tokens long"
INDEX = "path string, doc_id long, offset long, size long, n_tokens long, start long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_LENGTH, _CRC, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB")
_NULL_ID, _WIDE = 1, 2
BLOCK = 4096
_ENTRY = np.dtype([("doc_id", "<i8"), ("flags", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u8"), ("before", "<u8")])
_AROUND = _LENGTH.size + 2 * _CRC.size


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """The frame of one sequence of ids."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    payload = _HEAD.pack(doc_id or 0, _NULL_ID * (doc_id is None) + _WIDE * wide) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = _LENGTH.pack(len(payload))
    return b"".join([length, _CRC.pack(masked_crc(length)), payload, _CRC.pack(masked_crc(payload))])


def parse(data, where: str = "") -> tuple[int | None, np.ndarray]:
    """Document id and ids (u4) of the frame that ``data`` is; a damaged frame is an error."""
    if len(data) < _AROUND:
        raise ValueError(f"truncated record {where}")
    (n,), (crc,) = _LENGTH.unpack_from(data), _CRC.unpack_from(data, _LENGTH.size)
    if crc != masked_crc(data[: _LENGTH.size]) or n != len(data) - _AROUND:
        raise ValueError(f"damaged record length {where}")
    payload = data[_LENGTH.size + _CRC.size : -_CRC.size]
    if _CRC.unpack_from(data, len(data) - _CRC.size)[0] != masked_crc(payload):
        raise ValueError(f"damaged record {where}")
    doc_id, flags = _HEAD.unpack_from(payload)
    return None if flags & _NULL_ID else doc_id, np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=_HEAD.size).astype("<u4", copy=False)


def _open(uri: str):
    """The file system of a URI (local, HDFS or object store) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def index_bytes(entries: np.ndarray) -> bytes:
    """The index file of ``entries``: blocks of them, each with its masked CRC."""
    blocks = [entries[i : i + BLOCK].tobytes() for i in range(0, len(entries), BLOCK)]
    return b"".join(x for b in blocks for x in (b, _CRC.pack(masked_crc(b))))


def parse_index(data, where: str = "") -> np.ndarray:
    """The entries of an index file; a damaged one is an error."""
    out, at, whole = [], 0, BLOCK * _ENTRY.itemsize + _CRC.size
    while at < len(data):
        block = memoryview(data)[at : at + whole]
        entries, crc = block[: -_CRC.size], block[-_CRC.size :]
        if len(block) <= _CRC.size or len(entries) % _ENTRY.itemsize or _CRC.unpack(crc)[0] != masked_crc(entries):
            raise ValueError(f"damaged index {where}")
        out.append(np.frombuffer(entries, _ENTRY))
        at += whole
    return np.concatenate(out) if out else np.zeros(0, _ENTRY)


def _ranged(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``range, doc_id, h, ids`` of every text, dealt into ranges and ordered within them."""
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    n = max(1, rows.rdd.getNumPartitions())
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    edges = np.array(bounds or [], np.int64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, h, texts = batch.column(0), batch.column(1), batch.column(2)
            at, share = own.fill_null(np.iinfo(np.int64).min).to_numpy(), h.to_numpy() / 2.0**63
            low, high = np.searchsorted(edges, at, "left"), np.searchsorted(edges, at, "right")
            dealt = low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)
            for lo, hi in slices(texts):
                ids, edge = encoder(tokenizer).encode(texts[lo:hi])
                ids = np.insert(ids, edge[1:], end_id)
                ends = edge + np.arange(len(edge))
                wide = np.maximum.reduceat(ids, ends[:-1]) > 0xFFFF
                raw, short = ids.astype("<u4"), ids.astype("<u2").tobytes()
                told = [raw[a:b].tobytes() if w else short[2 * a : 2 * b] for a, b, w in zip(ends.tolist(), ends[1:].tolist(), wide.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(dealt[lo:hi]), own[lo:hi], h[lo:hi], pa.array(np.diff(ends)), pa.array(told, pa.binary())], ["range", "doc_id", "h", "n", "ids"])

    keyed = rows.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"), "text")
    return map_batches(keyed, encoded, "range long, doc_id long, h long, n long, ids binary").repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", "doc_id", "h", "ids")


def write_records(docs: DataFrame, directory: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write records and their index below ``directory``, in ascending order of ids.

    A row for each file of records comes back: its ``path`` (the index is beside it), the ids of all ``first`` before it, its ``frames`` and ``tokens``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _open(directory)
        attempt, out, now, entries, offset, before = TaskContext.get().taskAttemptId(), None, None, [], 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            name = f"part-{now:06d}-{attempt}"
            with files.open_output_stream(f"{folder}/{name}.idx") as f:
                f.write(index_bytes(np.concatenate(entries)))
            return pa.RecordBatch.from_arrays([pa.array([f"{directory}/{name}.rec"]), *(pa.array([x], pa.int64()) for x in (now, sum(map(len, entries)), before))], ["path", "range", "frames", "tokens"])

        try:
            for batch in batches:
                some = np.zeros(len(batch), _ENTRY)
                done = 0
                for k, (dealt, doc_id, _, n, ids) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                    if dealt != now:
                        if out is not None:
                            entries.append(some[done:k])
                            yield close()
                        files.create_dir(folder, recursive=True)
                        now, entries, offset, before, done = dealt, [], 0, 0, k
                        out = files.open_output_stream(f"{folder}/part-{now:06d}-{attempt}.rec", buffer_size=1 << 20)
                    data = frame(doc_id, np.frombuffer(ids, "<u4" if len(ids) == 4 * n else "<u2"))
                    out.write(data)
                    some[k] = (doc_id or 0, _NULL_ID * (doc_id is None), offset, len(data), n, before)
                    offset, before = offset + len(data), before + n
                entries.append(some[done:])
            if out is not None:
                yield close()
        finally:
            if out is not None:
                out.close()

    written = cut(map_batches(_ranged(docs, tokenizer, end_id, id_col, text_col), write, "path string, range long, frames long, tokens long"))
    # a row for each file, of which there are as many as input partitions
    return written.selectExpr("path", "sum(tokens) over (order by range, path rows between unbounded preceding and current row) - tokens as first", "frames", "tokens")


def read_index(files: DataFrame) -> DataFrame:
    """The entries of all index files, with each frame's ``start``: the ids of all frames before it, over all files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, frames in zip(*(c.to_pylist() for c in batch.columns)):
                source, name = _open(path)
                with source.open_input_file(name.removesuffix(".rec") + ".idx") as f:
                    entries = parse_index(f.read(), path)
                if len(entries) != frames:
                    raise ValueError(f"the index of {path} has {len(entries)} entries, not {frames}")
                for at in range(0, len(entries), 10_000):
                    e = entries[at : at + 10_000]
                    number = lambda x: pa.array(x.astype(np.int64))
                    ids = pa.array(e["doc_id"].astype(np.int64), mask=(e["flags"] & _NULL_ID) > 0)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(e)), ids, number(e["offset"]), number(e["size"]), number(e["n_tokens"]), number(e["before"] + np.uint64(first))], [c.split()[0] for c in INDEX.split(", ")])

    return map_batches(files.select("path", "first", "frames").repartition("path"), read, INDEX)


def shuffled(index: DataFrame, *, seed: int = 1, run_length: int = 256) -> DataFrame:
    """The index in a seeded order for reading: runs of about ``run_length`` neighbouring frames of a file, permuted."""
    run = F.xxhash64("path", F.expr(f"offset div {run_length * 2048}"), F.lit(seed))  # neighbours by offset, at two kilobytes a frame
    return index.withColumn("run", run).repartition("run").sortWithinPartitions("run", "offset").drop("run")


def read_records(index: DataFrame, *, seed: int = 1) -> DataFrame:
    """Fetch the frames that rows of an index name, check them, and return ids as a digest.

    Any subset of the rows in any order will do; frames that lie one behind another are read at once and given out in the order of a seeded hash.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            rows, got, at = list(zip(*(c.to_pylist() for c in batch.columns))), [], 0
            while at < len(rows):
                path, begin, end = rows[at][0], rows[at][1], rows[at][1] + rows[at][2]
                stop = at + 1
                while stop < len(rows) and rows[stop][0] == path and rows[stop][1] == end and end - begin < 1 << 22:
                    end, stop = end + rows[stop][2], stop + 1
                if path != opened:
                    files, name = _open(path)
                    opened, source = path, files.open_input_file(name)
                data = memoryview(source.read_at(end - begin, begin))
                for _, offset, size, n, start in sorted(rows[at:stop], key=lambda r: zlib.crc32(b"%d|%d" % (seed, r[1]))):
                    doc_id, ids = parse(data[offset - begin : offset - begin + size], f"{path} at {offset}")
                    if len(ids) != n:
                        raise ValueError(f"the index has another length than {path} at {offset}")
                    got.append((doc_id, start, len(ids), zlib.crc32(ids)))
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)] or [pa.array([], pa.int64())] * 4, READ.replace(" long", "").split(", "))

    return map_batches(index.select("path", "offset", "size", "n_tokens", "start"), read, READ)


def records_round_trip(docs: DataFrame, tokenizer: str, end_id: int, directory: str | None = None) -> DataFrame:
    """Write all documents and their index, read the index and then the records in a shuffled order, and return what they hold (``doc_id, start, n_tokens, ids_crc32``)."""
    directory = directory or fresh_path(docs.sparkSession, "records")
    return read_records(shuffled(read_index(write_records(docs, directory, tokenizer, end_id))))
