"""The pipeline: each stage against a plain version of what it does, on whatever it gets."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from test_near_copies import slow_components
from tokenizers import Tokenizer

import corpus_pipeline
from loamline.llm import langid, quality
from loamline.llm.words import fold_of

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages(spark, documents, labels):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "language ID", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    docs = documents
    # quality: the model's scores in the driver
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), fold_of("doc_id", 5) != 0)
    got = stages["quality classifier"](spark, docs, SF)
    assert got.columns == docs.columns
    assert ids(got) == sorted(r.doc_id for r in docs.collect() if model.score(*quality.features(pa.array([r.text])))[0] >= 0.3)
    docs = got
    known = langid.fit(docs.filter(fold_of("doc_id", 4) != 2))
    got = stages["language ID"](spark, docs, SF)
    rows = docs.collect()
    keep = ~known.judge(pa.array([r.text for r in rows]))[2]
    assert got.columns == docs.columns and ids(got) == sorted(r.doc_id for r, k in zip(rows, keep) if k)
    docs = got
    got = stages["SimHash near-dedup"](spark, docs, SF)
    rows = docs.collect()
    label = slow_components({r.doc_id: r.text for r in rows})  # five-word shingles, similarity 0.8 or more, all pairs
    assert got.columns == docs.columns and ids(got) == sorted(set(label.values()))
    docs = got
    got = stages["mixing sources to target weights"](spark, docs, SF)
    assert got.columns == docs.columns and set(ids(got)) == set(ids(docs))
    docs = got
    rows = stages["best-fit packing"](spark, docs, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in rows) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_odd_rows_pass_every_stage(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs2 = stage(spark, docs, SF)
            assert docs2.columns == docs.columns
            docs2.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
