"""Scores of generated texts against references: counts of each pair in Arrow batches, figures of a corpus as sums of them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.shared import map_batches

#: Longest n-grams of tokens (BLEU), of characters and of words (chrF).
BLEU, CHARS, WORDS = 4, 6, 2


def grams(items: Sequence, n: int) -> Counter:
    return Counter(zip(*(items[i:] for i in range(n))))


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a bit for each place of ``a``: a step of ``b`` is one addition."""
    places: dict[object, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def _f1(shared: int, a: int, b: int) -> float:
    return 2 * shared / (a + b) if shared else 0.0


def pair_counts(candidate: str, reference: str) -> tuple[float, float, float, list[int], list[int], list[int]]:
    """ROUGE-1, ROUGE-2 and ROUGE-L (F1, lower-cased words, no stemming); for each order (shared, candidate's, reference's) of BLEU, characters and words."""
    words = [re.findall(r"\w+", t.lower()) for t in (candidate, reference)]
    tokens = [re.findall(r"\w+|[^\w\s]", t) for t in (candidate, reference)]
    chars = ["".join(t.split()) for t in (candidate, reference)]

    def counts(of: Sequence[Sequence], most: int) -> list[int]:
        both = [[grams(x, n) for x in of] for n in range(1, most + 1)]
        return [v for c, r in both for v in ((c & r).total(), c.total(), r.total())]

    n = counts(words, 2)
    return _f1(*n[:3]), _f1(*n[3:]), _f1(common_subsequence(*words), *map(len, words)), counts(tokens, BLEU), counts(chars, CHARS), counts(tokens, WORDS)


def scored(df: DataFrame, keys: list[str], candidate: str, reference: str) -> DataFrame:
    """``rouge1, rouge2, rouge_l`` of each pair beside its keys, and the counts that ``corpus_scores`` adds up; null texts are empty."""
    kinds = ["float64"] * 3 + ["list"] * 3
    names = ["rouge1", "rouge2", "rouge_l", "bleu", "chars", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [pair_counts(c or "", r or "") for c, r in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist())]
            made = [pa.array([r[i] for r in rows], pa.float64() if k == "float64" else pa.list_(pa.int64())) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *made], [*keys, *names])

    of_keys = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    return map_batches(df.select(*keys, candidate, reference), run, ", ".join([*of_keys, *(f"{n} double" for n in names[:3]), *(f"{n} array<long>" for n in names[3:])]))


def _bleu(n: list[tuple[Column, Column, Column]]) -> Column:
    """0 to 100; orders without a gram don't count, orders without a match have half a match, a quarter, and so on."""
    zeros, logs = F.lit(0.0), []
    for shared, made, _ in n:
        zeros = zeros + F.when((shared == 0) & (made > 0), 1.0).otherwise(0.0)
        logs.append(F.when(made > 0, F.when(shared > 0, F.ln(shared / F.greatest(made, F.lit(1)))).otherwise(-F.ln(F.pow(F.lit(2.0), zeros) * F.greatest(made, F.lit(1))))))
    known = F.array_compact(F.array(*logs))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(known), F.lit(1))
    _, c, r = n[0]
    brevity = F.when(c >= r, 1.0).otherwise(F.exp(1 - F.try_divide(r, c)))
    return F.when(reduce(lambda a, b: a + b, [s for s, _, _ in n]) == 0, 0.0).otherwise(100 * brevity * F.exp(mean))


def _chrf(n: list[tuple[Column, Column, Column]], beta: float) -> Column:
    """0 to 100: F-beta of the mean precision and recall over the orders that both sides have."""
    both = [(made > 0) & (real > 0) for _, made, real in n]
    mean = lambda i: F.try_divide(sum((F.when(ok, x[0] / F.greatest(x[i], F.lit(1))).otherwise(0.0) for ok, x in zip(both, n)), F.lit(0.0)), sum((ok.cast("int") for ok in both), F.lit(0)))
    p, r = F.coalesce(mean(1), F.lit(0.0)), F.coalesce(mean(2), F.lit(0.0))
    return F.coalesce(100 * (1 + beta**2) * F.try_divide(p * r, beta**2 * p + r), F.lit(0.0))


def corpus_scores(pairs: DataFrame, by: list[str], beta: float = 3.0) -> DataFrame:
    """``n``, mean ROUGE, and BLEU, chrF and chrF++ of all pairs of a group together, from the sums of their counts."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, most in (("bleu", BLEU), ("chars", CHARS), ("words", WORDS)) for i in range(3 * most)]
    added = pairs.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rouge_l")], *sums)
    orders = lambda c, most: [tuple(F.col(f"{c}{3 * i + j}") for j in range(3)) for i in range(most)]
    chars, words = orders("chars", CHARS), orders("words", WORDS)
    return added.select(*by, "n", "rouge1", "rouge2", "rouge_l", _bleu(orders("bleu", BLEU)).alias("bleu"), _chrf(chars, beta).alias("chrf"), _chrf(chars + words, beta).alias("chrf_pp"))
