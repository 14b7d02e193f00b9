"""Every operator has one query, with the columns that it promises."""

from __future__ import annotations

import re

import pytest

from loamline.llm import queries

COLUMNS = {
    "1": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "2": {"doc_id", "held_out", "lang_pred", "score"},
    "3": {"doc_id", "source", "pass", "block_rank"},
    "4": {"doc_id", "held_out", "score", "predicted"},
    "5": {"doc_id", "fingerprint", "component_id"},
    "6": {"page_id", "host", "path", "rule", "verdict"},
    "7": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "8": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "9": {"doc_id", "held_out", "score", "predicted"},
    "10": {"query_id", "rank", "vec_id", "score"},
}
NAMES = {re.match(r"op(\d+)_", n)[1]: n for n in queries.QUERIES}


def test_all_there():
    assert set(NAMES) == set(COLUMNS) and len(queries.QUERIES) == 10


@pytest.mark.parametrize("n", sorted(COLUMNS, key=int))
def test_columns(spark, n):
    out = queries.QUERIES[NAMES[n]](spark, "/root/testdata/sf0.001")
    assert COLUMNS[n] <= set(out.columns)
    assert out.count() > 0
