"""Packing: every id is somewhere once, sequences are gapless and within capacity, and few."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loamline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, **options):
    rows = packing.pack(docs, PATH, 1, **options).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    capacity, want = options.get("capacity", 4096), []
    for d in docs.collect():
        ids = np.array(t.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d.doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, s, n in packing.pieces_of(len(ids), capacity)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by), sum(r.length for r in rows), rows


def test_documents(documents):
    n, total, _ = check(documents.repartition(5), open_bins=64, tasks_a_group=4)
    assert n <= 1.03 * total / 4096 + 3


def test_few_bins(documents):
    check(documents.repartition(7), open_bins=2, tasks_a_group=2)


def test_odd(odd):
    _, _, rows = check(odd, with_ids=True)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows) if "ids" in rows[0] else True


def test_none(none):
    assert packing.pack(none, PATH, 1).collect() == []


def test_bins_hold_their_rule():
    bins, free, rng = packing.OpenBins(100, 5), {}, random.Random(1)
    for _ in range(3000):
        size = rng.randint(1, 100)
        fits = [f for f in free.values() if f >= size]
        at, offset, closed = bins.put(size)
        if fits:
            assert free[at] == min(fits)
        elif len(free) == 5:
            assert free[closed[0]] == min(free.values())
        assert offset == 100 - free.get(at, 100)
        free[at] = free.get(at, 100) - size
        for b in closed:
            del free[b]
        assert len(free) <= 5 and 0 not in free.values()
