"""SimHash near-duplicates by a binary trie self-join (op 5).

Fingerprints: 64 bits; words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased,
3-word shingles with repeats, XXH64 (seed 42) of each; a bit is one if it is set in over half of the hashes.

Links: fingerprints that differ in ``budget`` bits or fewer.  Only distinct fingerprints take part.
The 64 bits are cut into four blocks of 16; with two differing bits at most, two of the blocks are
equal, so each fingerprint goes to six groups, one for each pair of blocks; this deals out the work.  Every link comes from the trie: in
each group, of two fingerprints on, these form a binary trie which is joined with itself.  Pairs of nodes go down together, level by level, as arrays of
ranges; differing branches add up, and a pair beyond the budget is pruned.  Groups of one are
dropped before (a semi-join by count), and a group of more than ``large`` goes to six
smaller ones by its other 32 bits, after which 2^16 fingerprints is the most that a group can hold.  A group hands on a
star for each of its connected sets, not its pairs.

Components are found over the whole link table (``components.py``).

Wider budgets (``close_sets``, for ``near_copies.py``): many fingerprints of one set of hashes, each dealt to a group for every block of 16 bits; the
same trie joins the groups.

Rules: a null text is one without words; texts without words have fingerprint zero and link like any other;
texts of one or two words are one shingle; repeated rows share their fingerprint; rows with a null id are
in the component of their fingerprint (null if no id is there); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.components import components
from loamline.llm.encoding import slices
from loamline.llm.words import LONG, parts_of
from loamline.shared import cut, map_batches, named, packed, unpacked

#: Pairs of trie nodes that are worked on at once, and where connected ones are left out.
_AT_ONCE, _AT_ONCE_JOINED = 500_000, 50_000
#: Bytes of a text worked on at once.
_PART = LONG
#: For each further fingerprint, what is mixed into a hash.
_MIX = np.random.default_rng(11).integers(0, 1 << 63, (2, 96), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    import xxhash

    digest, ones, n, carried = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, []

    def count(shingles: Iterator[bytes]) -> int:
        bits = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
        np.add(ones, np.unpackbits(bits, axis=1).sum(0, dtype=np.int64), out=ones)
        return len(bits)

    for part in parts_of(text or b"", _PART):
        words = carried + part.lower().split()
        for at in range(0, len(words) - 2, 1 << 16):
            some = words[at : at + (1 << 16) + 2]
            n += count(map(b" ".join, zip(some, some[1:], some[2:])))
        carried = words[-2:]
    if not n and carried:
        n = count(iter([b" ".join(carried)]))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def set_fingerprints(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` unsigned fingerprints of a set of 64-bit hashes: a bit of each is one if it is set in over half of the hashes as mixed for it."""
    ones = np.zeros(64 * count, np.int64)
    for at in range(0, len(hashes), 240):  # sums fit a byte
        mixed = (hashes[at : at + 240, None] ^ _MIX[0, :count]) * _MIX[1, :count]
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as the long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t) for lo, hi in slices(texts) for t in texts[lo:hi].to_pylist()), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, fp long")


def trie_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, visits: list[int] | None = None, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs within ``budget`` bits in each range of ``fps`` (unsigned, ascending in each range, distinct).

    A node is a range of ``fps`` with equal upper bits.  Each range's root is paired with itself; a pair of nodes goes down to the pairs of their children,
    a bit that differs is counted, and a pair beyond the budget is pruned.  A node with one leaf is that leaf, so a pair of such is settled
    by its remaining bits.  ``visits`` gets the number of node pairs of each step.  If what is yielded is joined in ``label`` (in place, equal for what
    is connected), pairs of nodes that are connected throughout are left out, so a crowd of close fingerprints costs far less than its pairs.
    """
    lo, hi, yielded = np.asarray(starts, np.int64), np.asarray(ends, np.int64), False
    at_once = _AT_ONCE if label is None else min(_AT_ONCE, _AT_ONCE_JOINED)
    stack = [(63, np.stack([lo, hi, lo, hi, np.zeros(len(lo), np.int64)]))]
    while stack:
        level, pairs = stack.pop()
        if pairs.shape[1] > at_once:  # in parts, so that memory doesn't grow with the pairs of a level
            stack += [(level, part) for part in np.array_split(pairs, -(-pairs.shape[1] // at_once), axis=1)]
            continue
        if yielded and label is not None:
            run = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            lo1, hi1, lo2, hi2, _ = pairs
            pairs = pairs[:, (run[lo1] != run[hi1 - 1]) | (run[lo2] != run[hi2 - 1]) | (label[lo1] != label[lo2])]
            if not pairs.shape[1]:
                continue
        if visits is not None:
            visits.append(pairs.shape[1])
        lo1, hi1, lo2, hi2, differ = pairs
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        a, b = lo1[leaf], lo2[leaf]
        below = np.uint64((1 << (level + 1)) - 1)
        near = (a != b) & (differ[leaf] + np.bitwise_count((fps[a] ^ fps[b]) & below) <= budget)
        if near.any():
            yielded = True
            yield a[near], b[near]
        if leaf.all():
            continue
        lo1, hi1, lo2, hi2, differ = pairs[:, ~leaf]
        mid1, mid2 = _middle(fps, lo1, hi1, level), _middle(fps, lo2, hi2, level)
        other = lo1 != lo2  # of a node paired with itself the two crossed pairs are one
        children = [(lo1, mid1, lo2, mid2, differ), (mid1, hi1, mid2, hi2, differ), (lo1, mid1, mid2, hi2, differ + 1), tuple(x[other] for x in (mid1, hi1, lo2, mid2, differ + 1))]
        pairs = np.concatenate([np.stack(c) for c in children], axis=1)
        alone = (pairs[0] == pairs[2]) & (pairs[1] - pairs[0] <= 1)  # a leaf paired with itself
        pairs = pairs[:, (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= budget) & ~alone]
        if pairs.shape[1]:
            stack.append((level - 1, pairs))


def _middle(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where the children of nodes part: the first position whose bit ``level`` is one, by bisection of all nodes at once."""
    bit = np.uint64(1 << level)
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = np.zeros(len(lo), bool)
        one[open_] = (fps[mid[open_]] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _connected(group: np.ndarray, fps: np.ndarray, budget: int) -> np.ndarray:
    """The position of the first of its connected set for each fingerprint of whole groups (ascending by group and fingerprint, distinct)."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    label = np.arange(len(fps))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for a, b in trie_pairs(fps, starts, np.concatenate([starts[1:], [len(fps)]]), budget, label=label):
        while True:
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            for x, y in zip(a[:4096].tolist(), b[:4096].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    label[max(x, y)] = min(x, y)
            while (label[label] != label).any():
                label[:] = label[label]
    return label


def _stars(group: np.ndarray, fps: np.ndarray, nodes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each linked node to the first of its connected set, over whole groups."""
    order = np.lexsort((fps, group))
    group, fps, nodes = group[order], fps[order], nodes[order]
    label = _connected(group, fps, budget)
    linked = label != np.arange(len(fps))
    return nodes[linked], nodes[label[linked]]


def _join_groups(batches: Iterator[pa.RecordBatch], budget: int, at_once: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows ``key, sub, fp, node`` ordered by key and sub; links ``a, b`` come out."""
    held = np.zeros((0, 4), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        group = np.concatenate([[0], np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(1))])
        a, b = _stars(group, np.ascontiguousarray(rows[:, 2]).view(np.uint64), rows[:, 3], budget)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        if len(held) >= at_once:
            last = int(np.flatnonzero((held[:, :2] == held[-1, :2]).all(1))[0])
            if last:
                yield links(held[:last])
                held = held[last:]
    if len(held):
        yield links(held)


def _blocks(bits: int, size: int, column: str) -> F.Column:
    """The six pairs of four blocks of a column's low ``bits`` bits, as longs that also hold which pair it is."""
    part = lambda i: F.shiftrightunsigned(column, i * size).bitwiseAND((1 << size) - 1)
    pairs = itertools.combinations(range(bits // size), 2)
    return F.array(*[F.lit(p << 2 * size).bitwiseOR(F.shiftleft(part(i), size)).bitwiseOR(part(j)) for p, (i, j) in enumerate(pairs)])


def _other_bits(key: str, fp: str) -> F.Column:
    """The 32 bits of ``fp`` that are not in the pair of 16-bit blocks that ``key`` names."""
    part = lambda i: F.shiftrightunsigned(fp, i * 16).bitwiseAND(0xFFFF)
    out = None
    for p, pair in enumerate(itertools.combinations(range(4), 2)):
        i, j = sorted(set(range(4)) - set(pair))
        rest = F.shiftleft(part(i), 16).bitwiseOR(part(j))
        out = F.when(F.shiftright(key, 32) == p, rest) if out is None else out.when(F.shiftright(key, 32) == p, rest)
    return out


def links(nodes: DataFrame, large: int = 4096) -> DataFrame:
    """Links ``a, b`` (ids in ``node``) that connect what two differing bits connect; ``nodes`` has distinct ``fp``."""
    budget = 2  # the blocks above are laid out for it
    keyed = nodes.select(F.explode(_blocks(64, 16, "fp")).alias("key"), "fp", "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = cut(keyed.join(shared, "key"))
    few = grouped.filter(f"n <= {large}").select("key", F.lit(0).cast("long").alias("sub"), "fp", "node")
    many = grouped.filter(f"n > {large}").withColumn("rest", _other_bits("key", "fp"))
    many = many.select("key", F.explode(_blocks(32, 8, "rest")).alias("sub"), "fp", "node").withColumn("sub", F.col("sub") + 1)
    rows = few.unionByName(many).repartition("key", "sub").sortWithinPartitions("key", "sub")
    return map_batches(rows, lambda b: _join_groups(b, budget), "a long, b long")


def _join_keys(batches: Iterator[pa.RecordBatch], budget: int, at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows ``key, fp, node`` ordered by key; ``key, first, node`` come out for every member of a connected set of two or more, ``first`` naming the set."""
    held, n = [], 0

    def sets(rows: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0], [True]]))
        rows = rows[np.repeat(np.diff(edge) > 1, np.diff(edge))]
        key, fps, node = rows[:, 0], np.ascontiguousarray(rows[:, 1]).view(np.uint64), rows[:, 2]
        order = np.lexsort((node, fps, key))
        key, fps, node = key[order], fps[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (fps[1:] != fps[:-1])
        label = _connected(key[new], fps[new], budget)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
        several = np.bincount(label)[label] > 1
        return pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (key, node[new][label], node)], ["key", "first", "node"])

    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
        n += len(held[-1])
        if n >= at_once and held[-1][-1, 0] != held[0][0, 0]:
            rows = np.concatenate(held)
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield sets(rows[:last])
            held, n = [rows[last:]], len(rows) - last
    if n:
        yield sets(np.concatenate(held))


def close_sets(nodes: DataFrame, budget: int) -> DataFrame:
    """``table, key, first, node``: the members of each set (``key``; ``first`` is one of them) that links within ``budget`` bits connect in a group.

    ``nodes`` has ``node`` (long, distinct), ``fps`` (array of longs) and ``parts`` (array of ints under 64).  A group is one part, one fingerprint of the array and one
    block of 16 of its bits (the two are the ``table``), with equal bits in the block; each group's trie is joined with itself.
    """
    rotated = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseOR(F.shiftleft("fp", 64 - 16 * i)) if i else F.col("fp")
    key = lambda i: F.shiftleft((F.col("n") * 4 + i).cast("long") * 64 + F.col("part"), 16).bitwiseOR(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF))
    rows = nodes.select("node", F.explode("parts").alias("part"), "fps").select("node", "part", F.posexplode("fps").alias("n", "fp"))
    rows = rows.select("node", F.explode(F.array(*[F.struct(key(i).alias("key"), rotated(i).alias("fp")) for i in range(4)])).alias("r"))
    rows = rows.select("r.key", "r.fp", "node").repartition("key").sortWithinPartitions("key")
    found = map_batches(rows, lambda b: _join_keys(b, budget), "key long, first long, node long")
    return found.select(F.shiftright("key", 22).cast("int").alias("table"), F.xxhash64("key", "first").alias("key"), "first", "node")


def near_duplicates(docs: DataFrame, *, large: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row."""
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    linked = components(links(nodes.filter("node is not null"), large))
    labels = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, large: int = 4096, most_broadcast: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """One document of each component, that with the least id; all columns as they are, whatever their names.

    Components are those of ``near_duplicates``, or of ``found`` (``doc_id, component_id``).
    Documents without an id stay.  Rows with the same id are one document, of which the row with the least text stays.
    The ids to drop are broadcast if there are ``most_broadcast`` at most, else joined.
    """
    found = near_duplicates(docs, large=large, id_col=id_col, text_col=text_col) if found is None else found
    found = cut(found.filter("doc_id is not null"))
    drop = found.filter("doc_id <> component_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    n_drop, n_again = drop.count(), again.count()
    bounded = lambda ids, n: F.broadcast(ids) if n <= most_broadcast else ids
    rows = packed(docs, doc_id=named(id_col).cast("long"))
    kept = rows.join(bounded(drop, n_drop), "doc_id", "left_anti") if n_drop else rows
    if n_again:
        once = kept.join(bounded(again, n_again), "doc_id", "left_anti")
        more = kept.join(bounded(again, n_again), "doc_id", "left_semi")
        least = more.groupBy("doc_id").agg(F.min_by("row", F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))).alias("row"))
        kept = once.select("row").unionByName(least.select("row"))
    return unpacked(kept, docs.columns)
