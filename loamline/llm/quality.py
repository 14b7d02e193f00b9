"""Document quality by attention-based multiple-instance learning (op 4).

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded: proportions of kinds of characters and of
word lengths, repetition within the passage, its place in the whole, and its wording (``features``: shares of ``_WORDING`` hashed word classes, a
word's class by its lower-cased letters), through a learned layer
``h = tanh(W x + b)``.  Gated attention, learned from document labels alone, weighs the passages,
``a ~ exp(w (tanh(V h) * sigmoid(U h)))``, and the weighted sum of the ``h`` is scored by a logistic unit.

Learning takes at most ``bound`` labelled documents (by a seeded hash of the id), each with every passage, until there are
``most_passages``; scoring takes every passage of every text.

Rules: null and empty texts are one empty passage and get a score; a very long text is encoded in parts of whole passages; repeated rows score alike, and
one row of an id at most is learned from; with labels of one kind only the
score is the smoothed share of that kind; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.encoding import slices
from loamline.llm.words import _SPACE, LONG, fold_of, keep_where, labelled_sample, one_of_each, parts_of, raw_bytes, words_of
from loamline.shared import map_batches

PASSAGE = 64
#: Kinds of bytes: lower, upper, digit, space, line end, stop or comma, ! or ?, bar, other symbols, brackets and quotes, other, beyond ASCII.
_KINDS = 12
_KIND = np.full(256, 10, np.uint8)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A] = 0, 1, 2
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _KIND[0x0A] = 3, 4
_KIND[list(b".,;:")], _KIND[list(b"!?")], _KIND[ord("|")], _KIND[list(b"#*$%&<>=_~^\\/@+")], _KIND[list(b"()[]{}\"'`-")] = 5, 6, 7, 8, 9
_KIND[0x80:] = 11
_LENGTHS = 9
_WORDING = 64
_PLACE = _KINDS + _LENGTHS + 4
FEATURES = _PLACE + 1 + _WORDING
#: Bytes of texts, and of a single text, that are worked on at once.
_BYTES, _PART = 500_000, LONG


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and the passages before each text (one more than there are texts)."""
    raw, edge = raw_bytes(texts)
    if len(edge) > 1 and np.diff(edge).max() > _PART:
        rows = [_long_features(raw[a:b].tobytes()) for a, b in zip(edge, edge[1:])]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return _features(raw, edge)


def _long_features(text: bytes) -> np.ndarray:
    """The passages of one text, from parts of whole passages."""
    rows, held = [], b""
    for part in parts_of(text, _PART // 4):
        held += part
        at = np.frombuffer(held, np.uint8)
        dark = ~_SPACE[at]
        words = np.flatnonzero(dark & np.concatenate([[True], ~dark[:-1]]))
        if n := max(0, len(words) - 1) // PASSAGE * PASSAGE:
            end = int(words[n])
            rows.append(_features(at[:end], np.array([0, end]))[0])
            held = held[end:]
    if held or not rows:
        rows.append(_features(np.frombuffer(held, np.uint8), np.array([0, len(held)]))[0])
    out = np.concatenate(rows)
    out[:, _PLACE] = np.float32(min(len(out), 32) / 32)
    return out


def _features(raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, word, before, at = words_of(raw, edge)
    n_words = np.diff(before)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(first[-1])
    own_text = np.repeat(np.arange(len(n_words)), n_words)
    passage = first[own_text] + (np.arange(len(word)) - before[own_text]) // PASSAGE
    # a byte belongs to the passage of the word before it, or else of the first word
    byte_text = np.repeat(np.arange(len(n_words)), np.diff(edge))
    starts = np.zeros(len(raw), np.int64)
    starts[at] = 1
    last = np.cumsum(starts) - 1
    byte_passage = np.where(last >= before[byte_text], passage[np.maximum(last, 0)] if len(passage) else 0, first[byte_text])
    kinds = np.bincount(byte_passage * _KINDS + _KIND[raw], minlength=total * _KINDS).reshape(total, _KINDS)
    size = np.fromiter(map(len, uniq), np.int64, len(uniq))[word] if len(word) else np.zeros(0, np.int64)
    bins = np.minimum(size - 1, 15) * (_LENGTHS - 1) // 15
    lengths = np.bincount(passage * _LENGTHS + bins, minlength=total * _LENGTHS).reshape(total, _LENGTHS)
    coded = np.fromiter((zlib.crc32(w.lower()) % _WORDING for w in uniq), np.int64, len(uniq))[word] if len(word) else word
    wording = np.bincount(passage * _WORDING + coded, minlength=total * _WORDING).reshape(total, _WORDING)
    n = np.bincount(passage, minlength=total)
    pair = np.unique(passage * (len(uniq) + 1) + word) // (len(uniq) + 1)
    distinct = np.bincount(pair, minlength=total)
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])]) if len(word) else np.zeros(0, bool)
    repeats = np.bincount(passage[again], minlength=total)
    some, many = np.maximum(n, 1)[:, None], np.maximum(kinds.sum(1), 1)[:, None]
    where = np.repeat(np.minimum(n_passages, 32) / 32, n_passages)
    rest = np.stack([distinct / some[:, 0], repeats / some[:, 0], np.bincount(passage, size, total) / some[:, 0] / 10, n / PASSAGE, where], axis=1)
    return np.concatenate([kinds / many, lengths / some, rest, np.sqrt(wording / some)], axis=1).astype(np.float32), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclasses.dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float  # given where there was nothing to tell apart

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(first) - 1, self.prior)
        return _forward(self.weights, (x - self.mean) / self.scale, first)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    start, n = first[:-1], np.diff(first)
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, start), n))
    a /= np.repeat(np.add.reduceat(a, start), n)
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    f = _forward(w, x, first)
    n = np.diff(first)
    dz_out = (f["p"] - y) * weight / weight.sum()
    dz = np.repeat(dz_out[:, None] * w["c"], n, axis=0)
    da = (dz * f["h"]).sum(1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), n))
    gate = de[:, None] * w["w"]
    dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    grads = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dz_out, "d": dz_out.sum(keepdims=True)}
    return {k: v + decay * w[k] * (k not in "bd") for k, v in grads.items()}


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, *, hidden: int = 24, gate: int = 12, epochs: int = 60, least_steps: int = 1200, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Model:
    """Adam over shuffled batches of bags, for so many epochs and steps at least."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(np.unique(y)) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, prior)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = ((x - mean) / scale).astype(np.float32)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    w = {"W": draw(FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(1, np.float32)}
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    epochs = max(epochs, -(-least_steps * batch // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            n = np.diff(first)[take]
            rows = np.repeat(first[take] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            grads = _gradients(w, x[rows], np.concatenate([[0], np.cumsum(n)]), y[take], np.ones(len(take)), decay)
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (0.5 ** (3 * epoch / epochs)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, prior)


def fit(docs: DataFrame, labels: DataFrame, fold: F.Column, *, bound: int = 3000, most_passages: int = 200_000) -> Model:
    """Learn from labelled documents for which ``fold`` (of ``doc_id``) holds; their passage features come to the driver.

    Documents are taken whole: ``bound`` at most, and no further one once there are ``most_passages``.
    """
    sample = labelled_sample(docs, labels, "quality", fold, bound)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2), _BYTES):
                x, first = features(batch.column(2)[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], ["doc_id", "label", "x"])

    encoded = map_batches(sample, bags, "doc_id long, label int, x binary")
    table = one_of_each(encoded, "x", F.length("x") / (4 * FEATURES), most_passages).select("x", "label").toArrow()
    found = sorted(zip(table.column("x").to_pylist(), table.column("label").to_pylist()))  # in one order, however the rows were dealt
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b, _ in found]
    first = np.concatenate([[0], np.cumsum([len(b) for b in x])]).astype(np.int64)
    return train(np.concatenate(x) if x else np.zeros((0, FEATURES), np.float32), first, np.array([y for _, y in found], float))


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``columns`` of each row with ``score``."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            parts = [told.value.score(*features(texts[lo:hi])) for lo, hi in slices(texts, _BYTES)]
            got = np.concatenate(parts).astype(float) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], [*columns, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return map_batches(docs.select(*columns, F.col(text_col).cast("string").alias("__text")), run, f"{fields}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score ``threshold`` or more, all columns as they are."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    return keep_where(docs, lambda texts: np.concatenate([np.zeros(0, bool), *(told.value.score(*features(texts[lo:hi])) >= threshold for lo, hi in slices(texts, _BYTES))]), text_col)


def classify(docs: DataFrame, labels: DataFrame, *, parts: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Learn out of the held-out fold and score all: ``doc_id, held_out, score, predicted``."""
    model = fit(docs, labels, fold_of("doc_id", parts) != held)
    return score(docs, model).select("doc_id", F.coalesce(fold_of("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
