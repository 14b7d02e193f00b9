"""Binary records: an exact round trip, damage is found, frames can be read in any order."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamline.llm import records

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(docs):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        out.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


def check(docs):
    got = sorted(records.records_round_trip(docs, PATH, 2).collect(), key=lambda r: r.start)
    want, total = plain(docs)
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    return got


def test_documents(documents):
    assert len(check(documents)) == documents.count()


def test_odd(odd):
    assert len(check(odd)) == odd.count()


def test_none(none):
    assert records.records_round_trip(none, PATH, 2).collect() == []


def test_any_order(documents, tmp_path):
    files = records.write_records(documents, f"file://{tmp_path}/r", PATH, 2)
    index = records.read_index(files)
    names = sorted(p.name for p in (tmp_path / "r").iterdir())
    assert names == sorted(n for r in files.collect() for n in (r.path.split("/")[-1], r.path.split("/")[-1].replace(".rec", ".idx")))
    order = [r.offset for r in records.shuffled(index, run_length=4).collect()]
    assert sorted(order) == sorted(r.offset for r in index.collect()) and order != sorted(order)
    some = index.filter("doc_id % 7 = 3").orderBy(F.xxhash64("doc_id"))
    want = {r.doc_id: r.ids_crc32 for r in records.read_records(index).collect()}
    assert {r.doc_id: r.ids_crc32 for r in records.read_records(some).collect()} == {k: v for k, v in want.items() if k % 7 == 3}


def test_damage():
    data = bytearray(records.frame(5, np.array([1, 2, 70_000], "<u4")))
    assert records.parse(bytes(data))[0] == 5 and records.parse(bytes(data))[1].tolist() == [1, 2, 70_000]
    assert records.parse(records.frame(None, np.array([9], "<u4")))[0] is None
    for at in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.parse(bytes(bad))
    with pytest.raises(ValueError):
        records.parse(bytes(data[:-1]))


def test_damaged_index():
    entries = np.zeros(records.BLOCK + 3, records._ENTRY)
    entries["offset"] = np.arange(len(entries)) * 7
    data = bytearray(records.index_bytes(entries))
    assert (records.parse_index(bytes(data)) == entries).all() and len(records.parse_index(b"")) == 0
    for at in (0, records.BLOCK * records._ENTRY.itemsize + 1, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.parse_index(bytes(bad))
    with pytest.raises(ValueError):
        records.parse_index(bytes(data[:-1]))


def test_one_id_in_most_rows(spark):
    """An id of half the rows spans several ranges, which stay in order."""
    docs = spark.createDataFrame([(5, f"text {i}") for i in range(600)] + [(i, f"other {i}") for i in range(300)] + [(None, "no id")] * 3, "doc_id long, text string").repartition(8)
    assert len(check(docs)) == 903
    parts = {r.range: r["count"] for r in records._ranged(docs, PATH, 2, "doc_id", "text").groupBy("range").count().collect()}
    assert len(parts) > 5 and max(parts.values()) < 300
