"""Near copies: components against exact similarities of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from loamline.llm import near_copies, simhash


def slow_components(texts):
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label, moved = {i: i for i in sets}, True
    near = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0)]
    while moved:
        moved = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                moved = True
    return label


@pytest.fixture(scope="module")
def changed():
    """Texts of 300 words, each with copies in which up to 10 words are others; long unlike texts too."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = []
    for _ in range(12):
        first = rng.choice(words, 300)
        for n in (0, 0, 1, 2, 4, 6, 7, 8, 10):
            copy = first.copy()
            copy[rng.choice(300, n, replace=False)] = "other"
            texts.append(" ".join(copy).upper() if n == 1 else "  ".join(copy))
    return dict(enumerate([*texts, None, "", " \n", "two words", "Two words", "one"]))


def found(df, **more):
    return {r.doc_id: r.component_id for r in near_copies.near_copies(df, **more).collect()}


def test_against_all_pairs(spark, changed):
    df = spark.createDataFrame(list(changed.items()), "doc_id long, text string").repartition(3)
    want = slow_components(changed)
    assert 12 < len(set(want.values())) < len(want) - 60
    for large in (512, 3):
        assert found(df, large=large) == want


def test_large_group_with_others(spark):
    """Many near copies of one text, of which some are just beyond 0.8 of all but each other; chunks of seven texts."""
    rng = np.random.default_rng(8)
    first = rng.choice(np.array([f"w{i}" for i in range(5000)]), 200)
    texts = []
    for i in range(60):
        copy = first.copy()
        copy[rng.choice(200, int(rng.integers(0, 9)), replace=False)] = f"x{i}"
        texts.append(" ".join(copy))
    texts = dict(enumerate(texts))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = slow_components(texts)
    assert 1 < len(set(want.values())) < 40
    for large in (512, 7, 2):
        assert found(df, large=large) == want


def test_given_documents(documents):
    assert found(documents) == slow_components({r.doc_id: r.text for r in documents.collect()})


def test_stage(spark, changed):
    """No two texts at 0.8 or more are left."""
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in changed.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_components(changed).values()))


def test_odd(odd, none):
    rows = near_copies.near_copies(odd).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (7, 1), (8, 1), (2, 2), (3, 2), (4, 2), (6, 6), (9, 9)} and len(rows) == 9
    assert near_copies.near_copies(none).collect() == []


def test_parts(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000)).encode()
    want = near_copies.shingles(text)
    monkeypatch.setattr(near_copies, "LONG", 50)
    monkeypatch.setattr(near_copies, "parts_of", lambda t, _: __import__("loamline.llm.words", fromlist=["x"]).parts_of(t, 50))
    assert len(want) == 700 and (near_copies.shingles(text) == want).all()


def test_candidates_are_of_simhash_tries(spark, changed):
    """Sets of candidates are just what the bits connect: equal block and size part, budget kept, fingerprint by fingerprint."""
    sets = {i: near_copies.shingles((t or "").encode()) for i, t in changed.items()}
    fps = {i: near_copies.fingerprints(s) for i, s in sets.items()}
    rows = [(i, near_copies.parts(len(sets[i])), f.view(np.int64).tolist()) for i, f in fps.items()]
    found = {}
    for r in simhash.close_sets(spark.createDataFrame(rows, "node long, parts array<int>, fps array<long>"), near_copies.BUDGET).collect():
        found.setdefault((r.table, r.key), set()).add(r.node)
    want = []
    for table in range(4 * near_copies.COUNT):
        n, block = divmod(table, 4)
        groups = {}
        for i, f in fps.items():
            for part in near_copies.parts(len(sets[i])):
                if len(f):
                    groups.setdefault((part, int(f[n]) >> 16 * block & 0xFFFF), []).append(i)
        for group in groups.values():
            while group:
                reached, todo = set(), [group[0]]
                while todo:
                    at = todo.pop()
                    reached.add(at)
                    todo += [i for i in group if i not in reached and i not in todo and int(fps[i][n] ^ fps[at][n]).bit_count() <= near_copies.BUDGET]
                group = [i for i in group if i not in reached]
                want += [(table, tuple(sorted(reached)))] if len(reached) > 1 else []
    assert sorted((t, tuple(sorted(m))) for (t, _), m in found.items()) == sorted(want) and len(want) > 500


@pytest.mark.parametrize("first, second, both", [(4, 5, 4), (6, 7, 6), (90, 90, 80), (80, 100, 80)])
def test_fingerprints_meet(first, second, both):
    """Pairs at the least similarities share a block within the budget, and a size part."""
    rng, missed = np.random.default_rng(first), 0
    assert set(near_copies.parts(first)) & set(near_copies.parts(second))
    for _ in range(1000):
        hashes = rng.integers(0, 1 << 64, first + second - both, dtype=np.uint64)
        differ = near_copies.fingerprints(hashes[:first]) ^ near_copies.fingerprints(hashes[first - both :])
        blocks = differ.view(np.uint16).reshape(-1, 4) == 0
        missed += not (blocks.any(1) & (np.bitwise_count(differ) <= near_copies.BUDGET)).any()
    assert missed <= 2


def test_crowd_costs_less_than_its_pairs():
    """A crowd of close fingerprints is connected without visiting all its pairs."""
    rng = np.random.default_rng(4)
    fps = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 64, (6000, 3), dtype=np.uint64)).sum(1, dtype=np.uint64))
    visits = []
    label = np.arange(len(fps))
    for a, b in simhash.trie_pairs(fps, [0], [len(fps)], 10, visits, label):
        for x, y in zip(label[a].tolist(), label[b].tolist()):
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            label[max(x, y)] = min(x, y)
        while (label[label] != label).any():
            label[:] = label[label]
    assert (label == 0).all() and sum(visits) < len(fps) ** 2 / 4


def test_crowd_is_searched_once(spark, monkeypatch):
    """Near texts that meet in many tables, linked or not, are brought to the search once each, and not again for each table."""
    rng, brought, count = np.random.default_rng(9), [], 60
    first = rng.choice(np.array([f"w{i}" for i in range(5000)]), 100)
    texts = {}
    for i in range(count):
        copy = first.copy()
        copy[rng.choice(100, 1 + i % 3, replace=False)] = f"x{i}"
        texts[i] = " ".join(copy)
    search = near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda rows, *more: brought.append(rows.count()) or search(rows, *more))
    want = slow_components(texts)
    assert found(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == want and 1 < len(set(want.values())) < count
    assert sum(brought) <= count


def test_wide_crowd_of_narrow_groups_keeps_them(spark):
    """A chain of 200 nodes in pairs would cost more as one group; 30 nodes in three groups of 20 cost less; 600 in four of 450 are marked as large."""
    groups = [[i, i + 1] for i in range(199)] + [list(range(1000, 1030))[k : k + 20] for k in (0, 5, 10)] + [list(range(2000, 2600))[k : k + 450] for k in (0, 50, 100, 150)]
    close = spark.createDataFrame([(40, key, min(g), i) for key, g in enumerate(groups) for i in g], "table int, key long, first long, node long").repartition(5)
    nodes = close.select("node", (close.node + 7).alias("doc_id")).distinct()
    rows = near_copies._grouped(close.checkpoint(), nodes, 512).collect()
    assert sorted((r.key, r.table, r.n, r.node) for r in rows if r.table == 40) == [(key, 40, 2, i) for key in range(199) for i in (key, key + 1)]
    assert sorted((r.key, r.n, r.node) for r in rows if r.table == -1) == [(1000, 1, i) for i in range(1000, 1030)] + [(2000, 600, i) for i in range(2000, 2600)]
    assert all(r.doc_id == r.node + 7 for r in rows)
