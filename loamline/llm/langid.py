"""Language identification by nearest centroids of TF-IDF n-gram vectors (op 2).

Text is lower-cased and each run of other than letters becomes one gap; runs of one, two and three
characters (gaps included) are hashed into ``DIM`` counters.  A vector is ``log(1 + count) * idf``, scaled to length one;
idf counts over all learning documents.  Each language has several centroids: spherical k-means over a bounded sample of
its documents (``per_language``, by a seeded hash of the id).  A text gets the language of the centroid of
greatest cosine.  Seeds are taken from the nine tenths of a sample that are nearest to its mean, lest outliers take clusters.
``rejected`` marks texts farther from their centroid than learning documents of that language and length are: cosine under
``slack`` times the lowest percentile.  Short texts have lower cosines, so the percentile is taken of beginnings of
``CUTS`` characters, by their n-grams, and read between these; learning texts that are five deviations (of the
median) under their language's median are left out of it.

Rules: null texts and texts without letters are ``und``, score 0, rejected; a very long text is counted whole, in parts; rows with a null language, id or text aren't learned
from; without any learning rows all texts are ``und``; ties go to the first language by name; repeated rows are
predicted alike, and one of them at most is in the sample; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.encoding import slices
from loamline.llm.words import fold_of, keep_where
from loamline.shared import cut, map_batches

DIM = 4096
#: Texts and bytes of text that are worked on at once; longer texts are counted in parts of so many characters.
_ROWS, _BYTES = 64, 128_000
PART_CHARS = 128_000
#: Characters of the beginnings that floors are learned from, besides whole texts.
CUTS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or 0 for other than letters."""
    if not _tables:
        chars = map(chr, range(0x110000))
        lower = np.fromiter((ord(c.lower()[0]) if c.isalpha() else 0 for c in chars), np.uint32, 0x110000)
        _tables.append(lower)
    return _tables[0]


def _grams(strings: list[str]) -> np.ndarray:
    """n-gram counts of strings that are worked on at once, a row of ``DIM`` for each."""
    codes = [np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32) for s in strings]
    gap = np.zeros(1, np.uint32)
    flat = _letters()[np.concatenate([x for c in codes for x in (gap, c)] + [gap])]
    text = np.repeat(np.arange(len(codes) + 1), [len(c) + 1 for c in codes] + [1])
    keep = np.concatenate([[True], (flat[1:] != 0) | (flat[:-1] != 0) | (text[1:] != text[:-1])])
    c, text = flat[keep].astype(np.uint64), text[keep]
    a, b = c * np.uint64(0x9E3779B1), c * np.uint64(0x85EBCA77)
    one = c[c != 0] * np.uint64(0xC2B2AE3D)
    two = a[:-1] ^ (b[1:] + np.uint64(1))
    three = (a[:-2] ^ (b[1:-1] * np.uint64(31))) + c[2:] * np.uint64(0x27D4EB2F) + np.uint64(2)
    same2 = (text[:-1] == text[1:]) | (c[1:] == 0)  # the gap in front of the next text also ends this one
    same3 = (text[:-2] == text[1:-1]) & ((text[2:] == text[:-2]) | (c[2:] == 0)) & (c[1:-1] != 0)
    same2 &= (c[:-1] != 0) | (c[1:] != 0)
    grams = np.concatenate([one, two[same2], three[same3]])
    rows = np.concatenate([text[c != 0], text[:-1][same2], text[:-2][same3]])
    slot = (((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(DIM)).astype(np.int64)
    return np.bincount(rows * DIM + slot, minlength=(len(codes) + 1) * DIM)[: len(codes) * DIM].reshape(-1, DIM)


def counts(texts: pa.Array) -> np.ndarray:
    """n-gram counts, a row of ``DIM`` for each text; all zero without letters.

    A text of over ``PART_CHARS`` characters is counted in parts.  No n-gram is longer than three, so what a seam changes is what it changes
    between the two characters on either side: their counts together, less those of either side alone, are added.
    """
    strings = ["" if t is None else t for t in texts.to_pylist()]
    if max(map(len, strings), default=0) <= PART_CHARS:
        return _grams(strings)
    out = np.zeros((len(strings), DIM), np.int64)
    for row, s in zip(out, strings):
        for at in range(0, len(s) or 1, PART_CHARS):
            row += _grams([s[at : at + PART_CHARS]])[0]
            if at:
                both, left, right = _grams([s[at - 2 : at + 2], s[at - 2 : at], s[at : at + 2]])
                row += both - left - right
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n == 0, 1, n)).astype(np.float32)


def vectors(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors, and how many n-grams each text has (none without letters)."""
    n = counts(texts)
    return _unit(np.log1p(n) * idf), n.sum(1)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for lo, hi in slices(texts, _BYTES):
        yield from ((i, min(i + _ROWS, hi)) for i in range(lo, hi, _ROWS))


@dataclasses.dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    grams: np.ndarray  # of each centroid, ascending
    floors: np.ndarray  # of each centroid, at these numbers of n-grams

    def floor(self, best: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The least cosine of texts with so many n-grams to be in the language of their best centroid."""
        out = np.zeros(len(best))
        for i in np.unique(best[best >= 0]):
            out[best == i] = np.interp(np.log1p(grams[best == i]), np.log1p(self.grams[i]), self.floors[i])
        return out

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best centroid of each text (-1: none), its cosine, and whether the text is rejected."""
        best, cosine, floor = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
        for lo, hi in _parts(texts) if self.languages else ():
            x, n = vectors(texts[lo:hi], self.idf)
            near = x @ self.centroids.T
            best[lo:hi] = np.where(n > 0, near.argmax(1), -1)
            cosine[lo:hi] = np.where(n > 0, near.max(1), 0)
            floor[lo:hi] = self.floor(best[lo:hi], n)
        return best, np.clip(cosine, 0, 1), (best < 0) | (cosine < floor)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-point seeds, the tenth farthest from the mean left out; centroids and each member's own."""
    central = x @ _unit(x.mean(0, keepdims=True))[0]
    inner = x[central >= np.quantile(central, 0.1)]
    seeds = [int(np.argmax(central[central >= np.quantile(central, 0.1)]))]
    near = inner @ inner[seeds[0]]
    while len(seeds) < min(k, len(inner)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, inner @ inner[seeds[-1]])
    c = inner[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = _unit(np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c, np.argmax(x @ c.T, axis=1)


def _floors(x: np.ndarray, n: np.ndarray, begins: pa.Array, idf: np.ndarray, c: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of texts' beginnings (medians, ascending), and ``slack`` times the lowest percentile of their greatest cosines to ``c``."""
    import pyarrow.compute as pc

    near = (x @ c.T).max(1)
    middle = np.median(near)
    typical = near >= middle - 5 * max(1.4826 * np.median(np.abs(near - middle)), 0.02)
    told = [(np.median(n[typical]), np.quantile(near[typical], 0.01))]
    for size in CUTS:
        cut = pc.utf8_slice_codeunits(begins.filter(pa.array(typical)), 0, size)
        found = [((v @ c.T).max(1), m) for v, m in (vectors(cut[lo:hi], idf) for lo, hi in _parts(cut))]
        near, m = (np.concatenate(f) for f in zip(*found))
        if m.any():
            told.append((np.median(m[m > 0]), np.quantile(near[m > 0], 0.01)))
    grams, floors = np.array(sorted(told)).T
    short = len(CUTS) + 1 - len(grams)
    return np.pad(grams, (short, 0), "edge"), slack * np.pad(floors, (short, 0), "edge")


def sampled(rows: DataFrame, per_language: int, most_languages: int, seed: int) -> DataFrame:
    """``doc_id, lang, text`` of ``per_language`` ids of each language at most, by a seeded hash of the id; of rows with the same id and language, one."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)).alias("u")
    sizes = cut(rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")))
    if (n := sizes.count()) > most_languages:
        raise ValueError(f"{n} languages to learn, more than most_languages={most_languages}")
    likely = rows.select("doc_id", "lang", u).join(F.broadcast(sizes), "lang").filter(F.col("u") * F.col("n") < 2 * per_language).distinct()
    ids = likely.selectExpr("doc_id", "lang", "row_number() over (partition by lang order by u, doc_id) as k").filter(f"k <= {per_language}").select("doc_id", "lang")
    # per_language * most_languages ids at most
    return rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fit(docs: DataFrame, *, per_language: int = 400, clusters: int = 4, slack: float = 0.85, seed: int = 5, most_languages: int = 1000) -> Model:
    """Learn from ``doc_id, text, lang`` rows: idf from all of them, centroids from ``per_language`` of each language.

    What meets in a task are vectors and beginnings of the documents sampled of one language (about 20 kB each), never whole texts.
    What comes to the driver: ``DIM`` counts, and ``clusters`` vectors of ``DIM`` floats for each of ``most_languages`` at most; more are an error.
    """
    import pyarrow.compute as pc

    rows = docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for lo, hi in _parts(batch.column(0)):
                total += (counts(batch.column(0)[lo:hi]) > 0).sum(0)
                n += hi - lo
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], total]))], ["slot", "n"])

    seen = dict(map(tuple, map_batches(rows.select("text"), frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect()))
    idf = np.log((1 + seen.get(-1, 0)) / (1 + np.array([seen.get(i, 0) for i in range(DIM)]))) + 1

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in _parts(texts):
                x, n = vectors(texts[lo:hi], idf)
                some = np.flatnonzero(n)
                part = texts[lo:hi].take(pa.array(some))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].take(pa.array(some)), pa.array([x[i].astype("<f4").tobytes() for i in some], pa.binary()), pa.array(n[some]), pc.utf8_slice_codeunits(part, 0, CUTS[-1])], ["lang", "x", "n", "begin"])

    def centroids(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("x", "ascending"), ("begin", "ascending")]).combine_chunks()
        x, n = np.frombuffer(b"".join(table.column("x").to_pylist()), "<f4").reshape(-1, DIM), table.column("n").to_numpy()
        c, own = _cluster(x, clusters)
        c = c[[i for i in range(len(c)) if (own == i).any()]]
        grams, floors = _floors(x, n, table.column("begin").combine_chunks(), idf, c, slack)
        found = [(v.astype("<f4").tobytes(), grams.tolist(), floors.tolist()) for v in c]
        types = {"centroid": pa.binary(), "grams": pa.list_(pa.float64()), "floors": pa.list_(pa.float64())}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(found), pa.string())} | {k: pa.array([f[i] for f in found], t) for i, (k, t) in enumerate(types.items())})

    sample = map_batches(sampled(rows, per_language, most_languages, seed).select("lang", "text"), encoded, "lang string, x binary, n long, begin string")
    learned = sample.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary, grams array<double>, floors array<double>").collect()
    learned = sorted(learned, key=lambda r: (r[0], bytes(r[1])))
    tables = [np.array([r[i] for r in learned], float).reshape(-1, len(CUTS) + 1) for i in (2, 3)]
    return Model(idf, [r[0] for r in learned], np.array([np.frombuffer(r[1], "<f4") for r in learned]).reshape(-1, DIM), *tables)


def predict(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``columns`` of each row with ``lang_pred, score, rejected``."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(model)  # some vectors for each language
    keep = docs.select(*columns, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, cosine, rejected = told.value.judge(batch.column(batch.num_columns - 1))
            languages = [told.value.languages[i] if i >= 0 else "und" for i in best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(languages, pa.string()), pa.array(cosine), pa.array(rejected)], [*columns, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return map_batches(keep, run, f"{fields}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that aren't rejected, all columns as they are."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    return keep_where(docs, lambda texts: ~told.value.judge(texts)[2], text_col)


def identify(docs: DataFrame, *, parts: int = 4, held: int = 2) -> DataFrame:
    """Learn from the documents out of the held-out fold and predict all: ``doc_id, held_out, lang_pred, score, rejected``."""
    model = fit(docs.filter(fold_of("doc_id", parts) != held))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold_of("doc_id", parts) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
