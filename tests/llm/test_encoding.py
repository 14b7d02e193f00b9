"""Ids put together from pieces are those of the library on the whole text."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm.encoding import PieceEncoder, slices

FILES = {"byte_bpe_50k.json": "spaced", "word_bpe_49k.json": "dropped"}
ENCODERS = {f: PieceEncoder(public_tokenizers.path(f), keep=50) for f in FILES}
TRICKY = ["", None, " ", "a", "\n\n x  y", "foo\xa0 bar", "foo\xa0  bar", "a.b,c. .,d", "it's I'M don't.", "²,x", "H\u0331ello H\u0331", "x\u2003 y", "<|endoftext|> z", "日本 語。ok", "a\x0b\x0cb\r\n", "e\u0301\u0301. É,", "tab\t\tx ", "'s,'s", "a'", "ΣΑΣ. Σ", "x" * 300, "\x1c a", "İstanbul. DŽ", "a\u200d b"]


def both(name, texts):
    e = ENCODERS[name]
    ids, start = e.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tobytes() for a, b in zip(start, start[1:])], e.plain([t or "" for t in texts])


@pytest.mark.parametrize("name", FILES)
def test_kind(name):
    assert ENCODERS[name].kind == FILES[name]


@pytest.mark.parametrize("name", FILES)
def test_tricky(name):
    got, want = both(name, TRICKY)
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r.,'aAbBsStT0é\u0301Σß日\xa0\u2003|#"), st.characters(exclude_categories=("Cs",))), max_size=40), max_size=6))
def test_any_text(texts):
    for name in FILES:
        got, want = both(name, texts)
        assert got == want


def test_sliced_array():
    a = pa.array(TRICKY, pa.string()).slice(3, 9)
    ids, start = ENCODERS["byte_bpe_50k.json"].encode(a)
    assert [ids[x:y].tobytes() for x, y in zip(start, start[1:])] == ENCODERS["byte_bpe_50k.json"].plain(TRICKY[3:12])


def test_slices_cover():
    a = pa.array(["x" * n for n in (1, 5000, 2, 3, 9000, 1)])
    got = list(slices(a, 4000))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(6))
    assert np.all([hi > lo for lo, hi in got])
