"""Near copies by SimHash fingerprints of five-word shingles, each link checked by its exact Jaccard similarity.

Two texts are linked if the sets of their shingles (XXH64 of ``WIDTH`` words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shorter
text is one shingle) have a Jaccard similarity of ``LEAST`` or more.  The 64 bits of such texts' fingerprints differ in 10 on average and up to 19 or more,
for which no block keys of one fingerprint are selective.  So a set has ``COUNT`` fingerprints (sets of seven at most ``COUNT_SHORT``), each dealt to four
groups by its blocks of 16 bits (and by size: sets within 5 : 4 meet), whose tries are joined with themselves at a budget of ``BUDGET`` bits (``simhash.close_sets``).
A pair at similarity 0.8 differs in 0.152 of the bits (4 shingles of 5: 0.188, 5 of 6: 0.156) and is met in one group at least with probability 0.9999; closer ones more surely.

What a trie connects is a group of candidates.  Groups with the same members are one group, and texts with equal sets are one node before all that.
The groups of near texts overlap in most of the tables, so what all groups together connect (a crowd) is one group in place of those in it, each text once, wherever
comparing all of it costs no more than comparing the groups (``_cost``); a wide crowd of narrow groups, as a long chain is, keeps its groups.
Hash sets are shuffled in two passes:

1. The crowds, and the groups of the first ``FIRST`` tables (a fingerprint's block each).  A group of more than ``large`` texts is dealt to chunks by hash, each with the group's
   least text; within a chunk a search goes from each text over those not yet reached, so what is linked is not compared again.
2. Of the other groups, and the large ones of the first pass, those that the components of the first pass have not joined yet.
   Chunks hold texts of one component, or several small components; pairs of chunks are searched, but for those of a
   single component.  So a group of very many copies with few others costs copies times others, not its square.

Only stars come out of a search.  Components are found over the links of both passes.

Rules: rows with a null id take no part; texts without words (null too) are copies of each other;
rows with the same id each link it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.components import components, forest
from loamline.llm.encoding import slices
from loamline.llm.simhash import close_sets, set_fingerprints
from loamline.llm.words import LONG, parts_of
from loamline.shared import cut, map_batches, small

WIDTH = 5
#: Fingerprints of a set, of one with seven shingles at most, and the bits that may differ in one; the tables (four a fingerprint) of the first pass.
COUNT, COUNT_SHORT, BUDGET, FIRST = 40, 96, 10, 32
#: What bringing a text to a group costs, in comparisons of two texts.
ROW = 64
#: Ids of candidates that are broadcast at most; with more, documents are shuffled to them.
MOST_IDS = 2_000_000
#: Least similarity of a link, as a ratio of whole numbers.
LEAST = (4, 5)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles, ascending."""
    import xxhash

    digest, found, carried = xxhash.xxh64_digest, [np.zeros(0, np.uint64)], []
    for part in parts_of(text or b"", LONG):
        words = carried + part.lower().split()
        for at in range(0, len(words) - width + 1, 1 << 16):
            some = words[at : at + (1 << 16) + width - 1]
            rows = b"".join([digest(b" ".join(s), 42) for s in zip(*(some[i:] for i in range(width)))])
            found.append(np.unique(np.frombuffer(rows, ">u8").astype(np.uint64)))
        carried = words[-(width - 1) :]
    if len(found) == 1 and carried:
        return np.frombuffer(digest(b" ".join(carried), 42), ">u8").astype(np.uint64)
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints of a set; none if it is too small for another set to be at ``LEAST`` (all under the least share but equal ones)."""
    n = len(hashes)
    return set_fingerprints(hashes, COUNT_SHORT if n <= 7 else COUNT) if n * (LEAST[1] - LEAST[0]) >= LEAST[0] else np.zeros(0, np.uint64)


def parts(size: int) -> list[int]:
    """Bit lengths of a set's size and of the greatest that it may be linked to: of two linked sets the lesser has the greater's."""
    return sorted({size.bit_length(), (size * LEAST[1] // LEAST[0]).bit_length()})


def _sets(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """``doc_id, node`` of each row with an id, ``node`` a hash of its set; and its ``parts`` and ``fps`` or, if ``whole``, its ``hashes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for lo, hi in slices(texts):
                sets = [shingles(t) for t in texts[lo:hi].to_pylist()]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                if whole:
                    told = {"hashes": pa.array([s.tobytes() for s in sets], pa.binary())}
                else:
                    told = {"parts": pa.array([parts(len(s)) for s in sets], pa.list_(pa.int32())), "fps": pa.array([fingerprints(s).view(np.int64) for s in sets], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(nodes), *told.values()], ["doc_id", "node", *told])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    return map_batches(rows, run, f"doc_id long, node long, {'hashes binary' if whole else 'parts array<int>, fps array<long>'}")


def linked(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (a text first reached, another) that connect what pairs of ``LEAST`` or more connect, by search over texts not yet reached."""
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(size)])
    own = [flat[edge[i] : edge[i + 1]] for i in range(len(sets))]
    apart, here = np.arange(len(sets)), np.zeros(len(names), bool)
    while len(apart) > 1:
        first, apart = apart[0], apart[1:]
        queue = [first]
        while queue and len(apart):
            at = queue.pop()
            here[own[at]] = True
            both = np.add.reduceat(here[np.concatenate([own[i] for i in apart])], np.concatenate([[0], np.cumsum(size[apart])[:-1]]), dtype=np.int64)
            here[own[at]] = False
            near = LEAST[1] * both >= LEAST[0] * (size[at] + size[apart] - both)
            found = apart[near].tolist()
            yield from ((int(first), i) for i in found)
            queue += found
            apart = apart[~near]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, sub, doc_id, hashes`` ordered by key and sub; links ``a, b`` come out."""
    key, nodes, sets = None, [], []

    def links() -> pa.RecordBatch:
        pairs = np.array(list(linked(sets)), np.int64).reshape(-1, 2)
        own = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[pairs[:, 0]]), pa.array(own[pairs[:, 1]])], ["a", "b"])

    for batch in batches:
        for k, sub, node, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, sub) != key:
                if len(nodes) > 1:
                    yield links()
                key, nodes, sets = (k, sub), [], []
            nodes.append(node)
            sets.append(np.frombuffer(hashes, np.uint64))
    if len(nodes) > 1:
        yield links()


def _groups(keyed: DataFrame) -> DataFrame:
    """``key, n, node`` (the least) of the groups of ``key, node`` with two members or more; of groups with the same members, that of the first table (by two 64-bit sums of hashes)."""
    of = F.xxhash64("node")
    whole = keyed.groupBy("key").agg(F.min("table").alias("table"), F.count("*").alias("n"), F.min("node").alias("node"), F.bit_xor(of).alias("x"), F.bit_xor(F.xxhash64(of, F.lit(1))).alias("y")).filter("n > 1")
    return whole.groupBy("n", "x", "y").agg(F.min(F.struct("table", "key", "node")).alias("least")).select("least.key", "n", "least.node")


def _cost(n: str) -> F.Column:
    """Of a search over ``n`` texts, in comparisons."""
    return F.col(n).cast("double") * (F.col(n) + ROW)


def _grouped(close: DataFrame, nodes: DataFrame, large: int) -> DataFrame:
    """``key, table, n, node, doc_id``: the groups to search; a crowd that is one group has table -1, and an ``n`` of 1 if it has ``large`` texts at most."""
    crowds = cut(components(forest(close.select(F.col("first").alias("a"), F.col("node").alias("b")))).withColumnRenamed("component", "crowd"))
    groups = cut(_groups(close).join(crowds, "node").select("key", "n", "crowd"))
    of_crowd = crowds.groupBy("crowd").agg(F.count("*").alias("m"))
    costs = of_crowd.join(groups.groupBy("crowd").agg(F.sum(_cost("n")).alias("cost")), "crowd").select("crowd", "m", (_cost("m") <= F.col("cost")).alias("one"))
    odd = small(costs.filter((F.col("m") > large) | ~F.col("one")))
    members = cut(crowds.join(odd, "crowd", "left").join(nodes.select("node", "doc_id"), "node").withColumn("one", F.coalesce("one", F.lit(True))))
    ones = members.filter("one").select(F.col("crowd").alias("key"), F.lit(-1).alias("table"), F.coalesce("m", F.lit(1).cast("long")).alias("n"), "node", "doc_id")
    kept = groups.join(odd.filter(~F.col("one")).select("crowd"), "crowd", "left_semi").select("key", "n")
    others = close.join(members.filter(~F.col("one")).select("node", "doc_id"), "node").join(kept, "key").select("key", "table", "n", "node", "doc_id")
    return cut(ones.unionByName(others))


def _links(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links ``a, b`` found among the rows ``key, sub, node, doc_id`` of each key and sub; hash sets are made anew from the texts that take part."""
    rows = cut(rows)
    # of a candidate's rows those with another set go by the join with its node
    texts = docs.join(small(rows.select(F.col("doc_id").alias("__id")).distinct(), MOST_IDS), F.col(id_col).cast("long") == F.col("__id"), "left_semi")
    sets = _sets(texts, id_col, text_col, True).groupBy("node").agg(F.first("hashes").alias("hashes"))
    met = rows.join(sets, "node").select("key", "sub", "doc_id", "hashes").repartition("key", "sub").sortWithinPartitions("key", "sub", "doc_id")
    return cut(map_batches(met, _search, "a long, b long"))


def _first_pass(grouped: DataFrame, large: int) -> DataFrame:
    chunks = F.ceil(F.col("n") / large).cast("long")
    least = grouped.filter(F.col("n") > large).groupBy("key", "n").agg(F.min(F.struct("doc_id", "node")).alias("m"))
    least = least.select("key", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("sub"), "m.node", "m.doc_id")
    dealt = grouped.select("key", F.pmod(F.xxhash64("node"), chunks).alias("sub"), "node", "doc_id")
    return dealt.unionByName(least).distinct()


def _second_pass(grouped: DataFrame, large: int) -> DataFrame:
    """Rows ``key, sub, node, doc_id`` that bring texts of different components (``component``) together."""
    sizes = grouped.groupBy("key", "component").agg(F.count("*").alias("m"))
    of_key = sizes.groupBy("key").agg(F.count("*").alias("components"), F.sum(F.when(F.col("m") < large, F.col("m")).otherwise(0)).alias("rest")).filter("components > 1")
    sized = grouped.join(sizes.join(of_key, "key"), ["key", "component"])
    own = F.col("m") >= large  # a component with chunks of its own; the others are dealt by component
    name = F.when(own, F.col("component")).otherwise(-1)
    n = F.ceil(F.when(own, F.col("m")).otherwise(F.col("rest")) / large).cast("long")
    chunk = F.pmod(F.xxhash64(F.when(own, F.col("node")).otherwise(F.col("component"))), n)
    dealt = cut(sized.select("key", "node", "doc_id", name.alias("name"), chunk.alias("chunk")))
    chunks = dealt.select("key", "name", "chunk").distinct()
    other = chunks.select("key", F.col("name").alias("name2"), F.col("chunk").alias("chunk2"))
    several = chunks.groupBy("key").agg(F.count("*").alias("chunks"))
    # pairs of a key's chunks, of which there is one for each ``large`` texts; a chunk that is alone is its own partner
    here, there = (F.struct(F.col(a).alias("name"), F.col(b).alias("chunk")) for a, b in (("name", "chunk"), ("name2", "chunk2")))
    pairs = chunks.join(several, "key").join(other, "key").filter(((F.col("name") != F.col("name2")) | (F.col("name") == -1)) & ((here != there) | (F.col("chunks") == 1)))
    pairs = pairs.select("key", "name", "chunk", F.xxhash64(F.least(here, there), F.greatest(here, there)).alias("sub"))
    return dealt.join(pairs, ["key", "name", "chunk"]).select("key", "sub", "node", "doc_id")


def near_copies(docs: DataFrame, *, large: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for every row with an id: the least id of its component."""
    known = cut(_sets(docs, id_col, text_col, False))
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("parts").alias("parts"), F.first("fps").alias("fps"))
    close = cut(close_sets(nodes.select("node", "parts", "fps"), BUDGET))
    grouped = _grouped(close, nodes, large)
    first = _links(_first_pass(grouped.filter(F.col("table") < FIRST), large), docs, id_col, text_col)
    joined = cut(components(first))
    left = grouped.filter((F.col("table") >= FIRST) | (F.col("n") > large)).join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    left = cut(left.withColumn("component", F.coalesce("component", "doc_id")))
    second = _links(_second_pass(left, large), docs, id_col, text_col)
    found = components(first.unionByName(second))
    labels = nodes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component_id"))
    return known.join(labels, "node").select("doc_id", "component_id")
