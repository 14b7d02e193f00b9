"""Language, quality and toxicity: held-out accuracy, defined results for odd rows, and what each method promises."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamline.llm import langid, quality, toxicity, words


def test_language(more_documents):
    truth = {r.doc_id: r.lang for r in more_documents.collect()}
    rows = langid.identify(more_documents).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.01


def test_language_odd(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {2, 3, 4} <= und and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.identify(none).collect() == []
    assert all(r.lang_pred == "und" for r in langid.identify(odd.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect())


FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita",
    "Wszyscy ludzie rodza sie wolni i rowni w swojej godnosci i prawach, sa oni obdarzeni rozumem",
    "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu",
    "Butun insanlar hur, haysiyet ve haklar bakimindan esit dogarlar, akil ve vicdana sahiptirler",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa, wote wamejaliwa akili na dhamiri",
    "Minden emberi leny szabadon szuletik es egyenlo meltosaga es joga van",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
]


def test_unlearned_languages_are_rejected(more_documents):
    model = langid.fit(more_documents.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    for size in (64, 1000):
        assert model.judge(pa.array([t[:size] for t in FOREIGN]))[2].all()
    held = [r.text for r in more_documents.filter("crc32(cast(doc_id as string)) % 4 = 2").collect()]
    for size in (32, 100, 10**6):
        assert model.judge(pa.array([t[:size] for t in held]))[2].mean() < 0.06


def test_few_outliers_take_no_clusters():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(0, 0.1, (203, 40))).astype("float32")
    for i in range(200):
        x[i, i % 4 * 5] += 1
    for i in range(200, 203):
        x[i, 30 + i - 200] += 5
    c, own = langid._cluster(langid._unit(x), 4)
    assert np.bincount(own, minlength=4).min() >= 45


def test_language_counts():
    n = langid.counts(pa.array(["ab", "Ab!! ", None, "", "12 34", "x" * 5000]))
    assert (n[0] == n[1]).all() and not n[2:5].any() and n[5].sum() > 10_000


def held_out_auc(rows, truth):
    pos = np.array([r.score for r in rows if r.held_out and truth.get(r.doc_id) == 1])
    neg = np.array([r.score for r in rows if r.held_out and truth.get(r.doc_id) == 0])
    return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    assert held_out_auc(rows, truth) > 0.98
    assert np.mean([r.predicted for r in rows if truth.get(r.doc_id) == 1]) > 0.99


def test_quality_odd(spark, odd, none, labels):
    some = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 1, 0), (8, None, None), (None, 1, 1), (9, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, some).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert quality.classify(none, labels).collect() == []
    assert all(0 <= r.score <= 1 for r in quality.classify(odd, some.filter("quality = 1")).collect())


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    w = {"W": rng.normal(size=(quality.FEATURES, 5)) * 0.2, "b": np.zeros(5), "V": rng.normal(size=(5, 3)), "U": rng.normal(size=(5, 3)), "w": rng.normal(size=3), "c": rng.normal(size=5), "d": np.zeros(1)}

    def loss(w):
        p = quality._forward(w, x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = quality._gradients(w, x, first, y, np.ones(3), 0.0)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - grads[k][at]) < 1e-6


def test_quality_passages_by_hand():
    text = " ".join(["ab"] * 70) + "\n" + "X!! " * 3
    x, first = quality.features(pa.array([text, "", None, "a"]))
    assert first.tolist() == [0, 2, 3, 4, 5]
    assert abs(x[0, : quality._KINDS].sum() - 1) < 1e-6 and x[0, quality._KINDS + quality._LENGTHS] == np.float32(1 / 64)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 1]) > 0.85
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 0]) < 0.01


def test_toxicity_odd(spark, odd, none, labels):
    some = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 1, 0), (8, None, None), (None, 1, 1), (9, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(odd, some).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(none, labels).collect() == []
    assert len({r.score for r in toxicity.classify(odd, some.filter("toxic = 5")).collect()}) == 1


def test_mentions_of_groups_move_no_score():
    """Insults go with one group in the labels; counterfactual pairs keep the group's name out of the score."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    bags, y = [], []
    for i in range(800):
        bad = i % 2
        group = "women" if bad == (rng.random() < 0.9) else "men"
        bags.append(sorted({*rng.choice(words, 12), group, *(["idiot"] if bad and rng.random() < 0.8 else [])}))
        y.append(float(bad))
    fair, plain = toxicity.train(bags, np.array(y)), toxicity.train(bags, np.array(y), pair_weight=0.0)
    gap = lambda m: float(np.subtract(*m.score(pa.array(["w1 w2 women", "w1 w2 men"]))))
    assert abs(gap(fair)) < 0.3 * abs(gap(plain)) and fair.score(pa.array(["w1 idiot"]))[0] > 0.7


def test_toxicity_counts_once_or_again():
    m = toxicity.Model({"bad": 2.0, "bad+": 1.0, "wors*": 4.0}, -3.0)
    logit = lambda p: np.log(p / (1 - p))
    got = logit(m.score(pa.array(["x", "Bad.", "bad BAD bad!", "worse worst", None, ""])))
    assert np.allclose(got, [-3, -1, 0, 1, -3, -3])


def test_bound_holds_for_repeated_rows(spark):
    """One labelled id repeated 5,000 times and ids without a document take no more than their place."""
    docs = spark.createDataFrame([(1, f"again {i % 7}") for i in range(5000)] + [(i, f"text {i}") for i in range(2, 40)] + [(40, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 41)] + [(i, 1, 0) for i in range(1000, 1400)], "doc_id long, quality int, toxic int")
    sample = words.labelled_sample(docs, labels, "quality", F.lit(True), 39)
    assert len({r.doc_id for r in sample.collect()}) == 39
    kept = words.one_of_each(sample, "text", F.lit(1), 10).collect()
    assert len(kept) == 10 == len({r.doc_id for r in kept})
    assert len(words.one_of_each(sample, "text", F.lit(1), 10**6).collect()) == 39
    whole = words.one_of_each(words.labelled_sample(docs, labels, "quality", F.lit(True), 100), "text", F.length("text"), 10**6).collect()
    assert {r.doc_id for r in whole} == set(range(1, 41)) and {r.text for r in whole if r.doc_id in (1, 40)} == {"again 0", ""}


def _plain_passages(text):
    """Feature rows of a text, one word at a time."""
    tokens, word = [], ""
    for c in text:  # words with what stands behind them; what stands in front of the first goes with it
        space = c in " \t\n\x0b\f\r"
        if not space and (not tokens or tokens[-1][1]):
            tokens.append(["" if tokens else word, ""])
        if tokens and not space:
            tokens[-1][0] += c
        elif tokens:
            tokens[-1][1] += c
        else:
            word += c
    if not tokens:
        tokens = [["", text]]
    rows, some = [], [tokens[i : i + quality.PASSAGE] for i in range(0, len(tokens), quality.PASSAGE)]
    for p in some:
        raw = "".join(a + b for a, b in p).encode()
        kinds = [sum(int(quality._KIND[b]) == k for b in raw) / max(1, len(raw)) for k in range(quality._KINDS)]
        ws = [a.lstrip(" \t\n\x0b\f\r").encode() for a, _ in p if a.strip(" \t\n\x0b\f\r")]
        n = max(1, len(ws))
        lengths = [sum(min(len(w) - 1, 15) * (quality._LENGTHS - 1) // 15 == k for w in ws) / n for k in range(quality._LENGTHS)]
        wording = [(sum(zlib.crc32(w.lower()) % quality._WORDING == k for w in ws) / n) ** 0.5 for k in range(quality._WORDING)]
        rows.append([*kinds, *lengths, len(set(ws)) / n, sum(a == b for a, b in zip(ws, ws[1:])) / n, sum(map(len, ws)) / n / 10, len(ws) / quality.PASSAGE, min(len(some), 32) / 32, *wording])
    return rows


def test_quality_against_plain_loops(documents):
    """Features, attention and score, a passage at a time."""
    rng = np.random.default_rng(2)
    w = {"W": rng.normal(size=(quality.FEATURES, 5)) * 0.3, "b": rng.normal(size=5), "V": rng.normal(size=(5, 3)), "U": rng.normal(size=(5, 3)), "w": rng.normal(size=3), "c": rng.normal(size=5), "d": np.array([0.2])}
    model = quality.Model(rng.normal(size=quality.FEATURES), rng.random(quality.FEATURES) + 0.5, w, 0.5)
    texts = [r.text for r in documents.orderBy("doc_id").limit(40).collect()] + ["", None, " \n", "  one  two ", "x" * 50]
    got = model.score(*quality.features(pa.array(texts)))
    for text, s in zip(texts, got):
        hs, es = [], []
        for x in _plain_passages(text or ""):
            x = [(a - m) / sd for a, m, sd in zip(x, model.mean, model.scale)]
            h = [math.tanh(sum(x[i] * w["W"][i, j] for i in range(len(x))) + w["b"][j]) for j in range(5)]
            t = [math.tanh(sum(h[j] * w["V"][j, k] for j in range(5))) for k in range(3)]
            g = [1 / (1 + math.exp(-sum(h[j] * w["U"][j, k] for j in range(5)))) for k in range(3)]
            hs.append(h)
            es.append(sum(t[k] * g[k] * w["w"][k] for k in range(3)))
        total = sum(math.exp(e) for e in es)
        z = [sum(math.exp(e) / total * h[j] for e, h in zip(es, hs)) for j in range(5)]
        assert abs(1 / (1 + math.exp(-(sum(z[j] * w["c"][j] for j in range(5)) + 0.2))) - s) < 1e-4


def test_language_against_plain_counting(documents):
    """TF-IDF, cosine and the nearest centroid with dictionaries, a text at a time."""
    docs = documents.orderBy("doc_id").limit(60)
    model = langid.fit(docs, per_language=20, clusters=2)
    rows = docs.collect()
    texts = [r.text for r in rows] + ["", None, "12 !!", "ab", "A-b c"]

    def grams(text):
        s = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
        found = Counter()
        padded = " " + " ".join(s.split()) + " "
        for i in range(len(padded)):
            for n in (1, 2, 3):
                g = padded[i : i + n]
                if len(g) == n and g.strip() and not (n == 3 and g[1] == " "):
                    found[g] += 1
        return found

    want = langid.counts(pa.array(texts))
    assert [sum(grams(t).values()) for t in texts] == want.sum(1).tolist()
    n_docs = len([r for r in rows if r.text is not None])
    idf = [math.log((1 + n_docs) / (1 + sum(bool(want[i][k]) for i in range(len(rows))))) + 1 for k in range(langid.DIM)]
    assert np.allclose(idf, model.idf)
    best, cosine, _ = model.judge(pa.array(texts))
    for i in range(len(texts)):
        v = {k: math.log1p(int(c)) * idf[k] for k, c in enumerate(want[i]) if c}
        norm = math.sqrt(sum(x * x for x in v.values()))
        all_ = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model.centroids] if v else []
        assert (best[i] == -1) == (not v) and (not v or abs(max(all_) - cosine[i]) < 1e-4 and all_[best[i]] > max(all_) - 1e-5)


def test_toxicity_against_a_plain_sum(documents):
    rng = np.random.default_rng(6)
    texts = [r.text for r in documents.orderBy("doc_id").limit(60).collect()] + ["", None, "!!", "and and"]
    some = sorted({f for t in texts[:30] for w in t.split() for f in toxicity.features_of(w.encode())})[::3]
    m = toxicity.Model({f + end: float(rng.normal()) * 0.1 for f in some for end in ("", toxicity.AGAIN)}, -0.5)
    for text, s in zip(texts, m.score(pa.array(texts))):
        met = Counter(f for w in re.split("[ \t\n\x0b\f\r]+", text or "") for f in toxicity.features_of(w.encode()))
        total = -0.5 + sum(m.weights.get(f, 0) + (n > 1) * m.weights.get(f + toxicity.AGAIN, 0) for f, n in met.items())
        assert abs(1 / (1 + math.exp(-total)) - s) < 1e-9


def test_counterfactuals_swap_every_form(monkeypatch):
    """"women" and "women," in one text are both swapped, punctuation stays, and no counterfactual names the group."""
    seen = []
    plain = toxicity.features_of
    monkeypatch.setattr(toxicity, "features_of", lambda w: seen.append(w.decode()) or plain(w))
    toxicity.train([["women", "women", "women,", "(men)", "x"], ["y"]] * 10, np.array([1.0, 0.0] * 10))
    swapped = {w for w in seen if w.strip("(),") not in ("women", "men", "x", "y")} - {t for g in toxicity.IDENTITY_TERMS for t in g}
    assert {w.strip("(),") for w in swapped} <= {"girls", "boys"} and any(w.endswith(",") for w in swapped) and any(w.startswith("(") for w in swapped | set(seen))
