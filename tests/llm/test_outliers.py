"""Robust outliers: base statistics and estimates against plain versions."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from loamline.llm import outliers


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def shape(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base(more_documents):
    texts = {r.doc_id: r.text for r in more_documents.collect()}
    rows = outliers.judge(more_documents).collect()
    assert len(rows) == len(texts) and all(shape(r) == base(texts[r.doc_id]) for r in rows)


def test_base_of_odd(odd):
    texts = Counter((r.doc_id, base(r.text)) for r in odd.collect())
    rows = outliers.judge(odd).collect()
    assert Counter((r.doc_id, shape(r)) for r in rows) == texts
    assert not any(r.kept for r in rows)


def test_none(none):
    assert outliers.judge(none).collect() == []


def concentrate(x, m, s, share, most=60):
    """Concentration steps until the determinant settles: centre, scatter."""
    floors, det = np.diag(outliers.FLOORS), np.inf
    quantile = lambda v, p: np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]
    for _ in range(most):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        near = x[d <= quantile(d, share)]
        m, s = near.mean(0), np.cov(near.T, bias=True) / outliers.CENTRAL[share] + floors
        if abs(np.log(np.linalg.det(s)) - det) < 1e-6:
            break
        det = np.log(np.linalg.det(s))
    return m, s


def slow_estimate(x, share=0.75, starts=300, seed=1):
    """Minimum covariance determinant from many random starts of five rows: distances, log determinant."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        some = x[rng.choice(len(x), 5, replace=False)]
        m, s = concentrate(x, some.mean(0), np.cov(some.T, bias=True) + np.diag(outliers.FLOORS), share)
        if best is None or np.linalg.det(s) < np.linalg.det(best[1]):
            best = m, s
    m, s = best
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m), np.log(np.linalg.det(s))


def test_least_determinant(spark):
    """A fifth of a group are outliers close together: the determinant is as small as random starts find, and they are far off."""
    rng = np.random.default_rng(4)
    good = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    x = np.concatenate([good, rng.normal(size=(100, 4)) * 0.3 + [9, -9, 9, 9]])
    df = spark.createDataFrame([("g", *map(float, r)) for r in x] + [("h", *map(float, r)) for r in good], "grp string, x0 double, x1 double, x2 double, x3 double")
    model = outliers.estimates(df)
    found = {r.grp: r.logdet for r in model.collect()}
    assert found["g"] <= slow_estimate(x)[1] + 0.02 and found["h"] <= slow_estimate(good)[1] + 0.02
    d = [r.d for r in df.filter("grp = 'g'").join(model, "grp").select("x0", outliers.distance().alias("d")).collect()]
    assert sum(v > 25 for v in d) in range(100, 104)


def test_distances(spark, more_documents):
    """All documents as one language and source: one group, the same steps in NumPy."""
    rows = outliers.judge(more_documents.selectExpr("doc_id", "text", "'x' as lang", "'y' as source")).collect()
    fit = [r for r in rows if not r.base_failed]
    n = np.array([[r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in fit], float)
    x = np.stack([np.log((n[:, 1] + 1) / n[:, 0]), *(np.sqrt(n[:, i] / n[:, 0]) for i in (2, 3, 4))], axis=1)
    want, _ = slow_estimate(x)
    got = np.array([r.distance for r in fit])
    assert np.allclose(got, want, rtol=0.05, atol=0.05)


def test_junk_goes_and_clean_stays(more_documents, labels):
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in outliers.judge(more_documents).collect() if r.doc_id in quality and not r.base_failed]
    clean, junk = ([r.kept for r in rows if quality[r.doc_id] == q] for q in (1, 0))
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.2


def test_consistency_factor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 4))
    d = (x**2).sum(1)
    inner = x[d <= np.quantile(d, 0.75)]
    assert abs(inner.var() - outliers.CENTRAL[0.75]) < 0.01
