"""SimHash: fingerprints bit by bit, links and components against all pairs."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loamline.llm import components, simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    label = dict(zip(ids, ids))
    moved = True
    while moved:
        moved = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def test_against_all_pairs(documents):
    rows = simhash.near_duplicates(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    want = slow_components(ids, fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", want[i]) for i, f in zip(ids, fps)}


def test_crowded_links(spark):
    """Many fingerprints close to few centres, with groups split again as hot ones are."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    while len(fps) < 500:
        f = int(rng.choice(centres))
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    want = slow_components(list(range(len(fps))), fps)
    for large in (4096, 3):
        found = {r.node: r.component for r in components.components(simhash.links(nodes, large)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_trie_pairs():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 14, 3000, dtype=np.uint64))
    cut = len(fps) // 3
    starts, ends = np.array([0, cut]), np.array([cut, len(fps)])
    got = {(int(x), int(y)) if x < y else (int(y), int(x)) for a, b in simhash.trie_pairs(fps, starts, ends, 2) for x, y in zip(a, b)}
    want = {(i, j) for s, e in zip(starts, ends) for i in range(s, e) for j in range(i + 1, e) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want


def test_trie_visits(monkeypatch):
    """Far fewer node pairs than pairs of fingerprints are visited; in parts it is the same."""
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, fps[::40] ^ np.uint64(1 << 40) ^ np.uint64(8)]))
    run = lambda v: sorted(tuple(sorted(p)) for a, b in simhash.trie_pairs(fps, [0], [len(fps)], 2, v) for p in zip(a.tolist(), b.tolist()))
    visits = []
    got = run(visits)
    assert len(got) == 100 and 64 > len(visits) and len(fps) < sum(visits) < len(fps) ** 2 / 20
    monkeypatch.setattr(simhash, "_AT_ONCE", 1000)
    assert run(None) == got


def test_documents_enter_the_trie(spark):
    """Every group of two fingerprints or more on the given documents is joined by way of its trie."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = np.unique(np.array([r.fp for r in simhash.fingerprints(docs).collect()], np.int64).view(np.uint64))
    visits, links, groups = [], set(), 0
    for i in range(4):
        for j in range(i):
            key = ((fps >> np.uint64(16 * i)) & np.uint64(0xFFFF)) << np.uint64(16) | ((fps >> np.uint64(16 * j)) & np.uint64(0xFFFF))
            order = np.lexsort((fps, key))
            edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
            shared = np.diff(edge) > 1
            groups += shared.sum()
            own = fps[order]
            for a, b in simhash.trie_pairs(own, edge[:-1][shared], edge[1:][shared], 2, visits):
                links |= {tuple(sorted(p)) for p in zip(own[a].tolist(), own[b].tolist())}
    at = {f: i for i, f in enumerate(fps.tolist())}
    want = set()
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2):
            want.add((int(fps[i]), int(fps[i + 1 + j])))
    assert links == want and links and visits[0] >= 1 and sum(visits) > 2 * groups and len(at) == len(fps)


def test_odd(odd):
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    zero = "0" * 16
    assert {(2, zero, 2), (3, zero, 2), (4, zero, 2)} <= rows
    same = f"{slow_fingerprint('one two three four five'):016x}"
    assert {(1, same, 1), (7, same, 1), (8, same, 1)} <= rows
    assert sum(r[0] is None for r in rows) == 1


def test_none(none):
    assert simhash.near_duplicates(none).collect() == []


def test_keep_one(odd, documents):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 6, 9]
    found = simhash.near_duplicates(documents).select(F.col("component_id").alias("doc_id")).distinct()
    assert sorted(r.doc_id for r in simhash.keep_one(documents).collect()) == sorted(r.doc_id for r in found.collect())
    assert sorted(r.doc_id for r in simhash.keep_one(documents, most_broadcast=0).collect()) == sorted(r.doc_id for r in found.collect())


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1000, 1002)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_forest(spark, monkeypatch):
    """Fewer links connect the same, also where they come in parts."""
    rng = np.random.default_rng(12)
    pairs = np.concatenate([rng.integers(0, 400, (500, 2)) * 3, rng.integers(5000, 5040, (3000, 2))])
    links = spark.createDataFrame(pairs.tolist(), "a long, b long").repartition(7)
    want = {(r.node, r.component) for r in components.components(links).collect()}
    fewer = components.forest(links.checkpoint()).collect()
    assert len(fewer) == len({n for n, _ in want}) - len({c for _, c in want})
    assert {(r.node, r.component) for r in components.components(spark.createDataFrame(fewer)).collect()} == want
    monkeypatch.setattr(components, "_AT_ONCE", 300)
    parts = list(components._forest(iter(spark.createDataFrame(pairs.tolist(), "a long, b long").toArrow().to_batches(100))))
    assert len(parts) > 5
    assert {(r.node, r.component) for r in components.components(spark.createDataFrame([r for p in parts for r in zip(*p.to_pydict().values())], "a long, b long")).collect()} == want
