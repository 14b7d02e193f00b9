"""Texts worked on in parts give what they give as a whole."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loamline.llm import encoding, langid, quality, simhash, toxicity, words


def texts():
    rng = random.Random(3)
    pick = lambda n: "".join(rng.choice(["alpha", "Beta", " ", "  ", "\n", "gamma,", "x|", "!!", "é", "idiot", " a. b", "\t"]) for _ in range(n))
    return [pick(700), "", "short", " " * 50, pick(90), "z" * 500, pick(400) + " "]


def test_parts_join():
    for t in texts():
        parts = list(words.parts_of(t.encode(), 40))
        assert b"".join(parts) == t.encode() and all(p[:1].isspace() for p in parts[1:])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding(monkeypatch, name):
    e, a = encoding.PieceEncoder(public_tokenizers.path(name)), pa.array(texts())
    want = e.encode(a)
    monkeypatch.setattr(encoding, "_LONG", 37)
    got = e.encode(a)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert got[0].tobytes() == b"".join(e.plain(texts()))


def test_simhash(monkeypatch):
    want = [simhash.fingerprint(t.encode()) for t in texts()]
    monkeypatch.setattr(simhash, "_PART", 30)
    assert [simhash.fingerprint(t.encode()) for t in texts()] == want


def test_quality(monkeypatch):
    a = pa.array(texts())
    want = quality.features(a)
    monkeypatch.setattr(quality, "_PART", 400)
    got = quality.features(a)
    assert (got[1] == want[1]).all() and np.allclose(got[0], want[0])


def test_toxicity(monkeypatch):
    m, a = toxicity.Model({"idiot": 1.0, "idiot+": 2.0, "gamm*": 0.5, "beta+": 0.25}, -1.0), pa.array(texts())
    want = m.score(a)
    monkeypatch.setattr(toxicity, "_PART", 33)
    assert np.allclose(m.score(a), want)


@pytest.mark.parametrize("size", [2, 3, 5, 7, 64, 600])
def test_language(monkeypatch, size):
    a = pa.array(["ab cd " * 300, "x", "abcdefghij" * 20, None, "", "..a..", *texts()])
    want = langid.counts(a)
    monkeypatch.setattr(langid, "PART_CHARS", size)
    assert (langid.counts(a) == want).all()
