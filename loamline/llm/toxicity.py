"""Counterfactual-regularised toxicity classifier (op 9).

A text is the set of its words, lower-cased and stripped of surrounding punctuation, and of their first four and five
characters (which generalises over endings); a feature met twice or more is a second feature.  A logistic model scores the set.

Learning takes at most ``bound`` labelled texts (by a seeded hash of the id), whole ones, until their words have ``most_bytes``.  Every one that names an identity group
(``IDENTITY_TERMS``) is paired with counterfactuals in which every form of the terms (with punctuation, or met again) is swapped for others of
their list, and the squared change of the score is penalised (``pair_weight``), so that a mere mention moves no score.
An L1 penalty picks few features (proximal gradient), then the kept ones are fitted again under a light L2.

Rules: null texts, texts without words and texts with no learned feature get the base score; however long a text is
and however often a feature stands there, it counts once, or as met again; repeated rows score alike; with labels of one kind
only the score is their smoothed share; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.encoding import slices
from loamline.llm.words import LONG, fold_of, labelled_sample, one_of_each, parts_of, raw_bytes, words_of
from loamline.shared import map_batches

#: Neutral names of groups, a list for each kind; a term is swapped within its list.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "locals", "foreigners"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)
#: Bytes of a text worked on at once.
_PART = LONG
#: Marks the feature that another was met again.
AGAIN = "+"


def features_of(word: bytes) -> list[str]:
    """The features of one word: itself and its beginnings."""
    w = word.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}<>|*#$%&…«»„“”-_")
    return [w, *(f"{w[:k]}*" for k in (4, 5) if len(w) > k)] if w else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclasses.dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if not hasattr(self, "_slot"):
            names = sorted({f.removesuffix(AGAIN) for f in self.weights})
            self._slot = {f: i for i, f in enumerate(names)}
            self._once = np.array([self.weights.get(f, 0.0) for f in names])
            self._twice = np.array([self.weights.get(f + AGAIN, 0.0) for f in names])
        sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        if len(sizes) and sizes.max() > _PART:  # long texts in parts
            met = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i, t in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                for part in parts_of(t or b"", _PART):
                    pair, times = self._met(pa.array([part], pa.large_binary()).cast(pa.large_string()))
                    met.append((i * len(self._slot) + pair, times))
            pair, which = np.unique(np.concatenate([m[0] for m in met]), return_inverse=True)
            times = np.bincount(which, np.concatenate([m[1] for m in met]), minlength=len(pair))
        else:
            pair, times = self._met(texts)
        total = np.full(len(texts), self.bias)
        if len(pair):
            at, slot = pair // len(self._slot), pair % len(self._slot)
            total += np.bincount(at, self._once[slot] + self._twice[slot] * (times > 1), minlength=len(total))
        return _sigmoid(total)

    def _met(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The learned features that each text has, as text times features plus feature, and how often."""
        uniq, word, before, _ = words_of(*raw_bytes(texts))
        found = [[self._slot[f] for f in features_of(w) if f in self._slot] for w in uniq]
        n = np.fromiter(map(len, found), np.int64, len(found))
        if not n.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, start = np.array([s for f in found for s in f], np.int64), np.cumsum(n) - n
        hit = np.flatnonzero(n[word])
        text = np.searchsorted(before, hit, side="right") - 1
        each = n[word[hit]]
        slot = flat[np.repeat(start[word[hit]] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        return np.unique(np.repeat(text, each) * len(self._slot) + slot, return_counts=True)


class _Sparse:
    """Rows of distinct columns with value one."""

    def __init__(self, rows: Sequence[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], minlength=self.width)


def train(bags: Sequence[Sequence[str]], y: np.ndarray, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, *, least: int = 6, l1: float = 1e-3, l2: float = 1e-5, pair_weight: float = 5.0, rounds: int = 150, swaps: int = 2, seed: int = 11) -> Model:
    """Learn from lists of words (``bags``, a word twice if met again) and labels; features in under ``least`` texts are left out."""
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return Model({}, float(np.log(prior / (1 - prior))))
    rng, list_of = np.random.default_rng(seed), {t: g for g in groups for t in g}
    known: dict[str, list[str]] = {}
    index: dict[str, int] = {}  # of each feature

    def expand(words: Iterable[str]) -> np.ndarray:
        times = Counter(f for w in words for f in (known[w] if w in known else known.setdefault(w, features_of(w.encode()))))
        names = sorted({*times, *(f + AGAIN for f, n in times.items() if n > 1)})
        return np.fromiter((index.setdefault(f, len(index)) for f in names), np.int32, len(names))

    sets, pairs = [expand(b) for b in bags], []
    for i, bag in enumerate(bags):
        forms = {w: f[0] for w in bag if (f := known[w]) and f[0] in list_of}  # "women" and "women," are one term
        for _ in range(swaps if forms else 0):
            other_term = {t: str(rng.choice([o for o in list_of[t] if o != t])) for t in sorted(set(forms.values()))}
            pairs.append((i, expand(w.lower().replace(forms[w], other_term[forms[w]]) if w in forms else w for w in bag)))
    seen = np.bincount(np.concatenate([*sets, np.zeros(0, np.int32)]), minlength=len(index))
    named = {f for t in list_of for f in features_of(t.encode())}
    column = {f: i for i, f in enumerate(sorted(f for f, k in index.items() if seen[k] >= least or (f in named and seen[k])))}
    place = np.full(len(index), -1)
    place[[index[f] for f in column]] = np.arange(len(column))
    rows = lambda sets: _Sparse([np.sort(c[c >= 0]) for c in (place[s] for s in sets)], len(column))
    x, other, of = rows(sets), rows([s for _, s in pairs]), np.array([i for i, _ in pairs], np.int64)
    known.clear()
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = _sigmoid(x.dot(w) + b)
        r = weight * (p - y)
        out, up = x.back(r), r.sum()
        if len(of):
            q, s = p[of], _sigmoid(other.dot(w) + b)
            d = 2 * pair_weight * (q - s) / len(of)
            mine, theirs = np.bincount(of, d * q * (1 - q), minlength=x.n), -d * s * (1 - s)
            out, up = out + x.back(mine) + other.back(theirs), up + mine.sum() + theirs.sum()
        return out, up

    def descend(live: np.ndarray, l1: float, l2: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        """Accelerated proximal gradient with a step for each feature by how often it occurs."""
        often = x.back(weight) * 0.25 + l2 + 1e-6
        step = 1 / (often * np.sqrt(np.maximum(1.0, len(x.col) / max(1, x.n)) / 4))
        at, at_b, t = w, b, 1.0
        for _ in range(rounds):
            g, gb = gradient(at, at_b)
            moved = (at - step * (g + l2 * at)) * live
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            new_b = at_b - gb
            if ((at - new) * (new - w)).sum() > 0:
                t = 1.0
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            at, at_b = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
            w, b, t = new, new_b, nt
        return w, b

    w, b = descend(np.ones(len(column)), l1, 0.0, np.zeros(len(column)), 0.0)
    w, b = descend((w != 0).astype(float), 0.0, l2, w, b)
    return Model({f: float(w[i]) for f, i in column.items() if w[i]}, float(b))


def fit(docs: DataFrame, labels: DataFrame, fold: F.Column, *, bound: int = 6000, most_bytes: int = 48_000_000) -> Model:
    """Learn from labelled documents for which ``fold`` (of ``doc_id``) holds; their words come to the driver, each twice at most.

    Documents are taken whole: ``bound`` at most, and no further one once their words have ``most_bytes``.
    """
    sample = labelled_sample(docs, labels, "toxic", fold, bound, good="max")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                times = (Counter(t.lower().encode().split()) for t in batch.column(2)[lo:hi].to_pylist())
                got = [b" ".join(w for w in sorted(c) for _ in range(min(2, c[w]))) for c in times]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(got, pa.binary())], ["doc_id", "label", "words"])

    encoded = map_batches(sample, bags, "doc_id long, label int, words binary")
    table = one_of_each(encoded, "words", F.length("words"), most_bytes).select("words", "label").toArrow().sort_by([("words", "ascending"), ("label", "ascending")])
    return train([b.decode("utf-8", "replace").split(" ") for b in table.column("words").to_pylist()], np.array(table.column("label").to_pylist(), float))


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``columns`` of each row with ``score``."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # the kept features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            parts = [told.value.score(texts[lo:hi]) for lo, hi in slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*columns, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return map_batches(docs.select(*columns, F.col(text_col).cast("string").alias("__text")), run, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, *, parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Learn out of the held-out fold and score all: ``doc_id, held_out, score, predicted``."""
    model = fit(docs, labels, fold_of("doc_id", parts) != held)
    return score(docs, model).select("doc_id", F.coalesce(fold_of("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
