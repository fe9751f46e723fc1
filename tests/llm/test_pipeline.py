"""The pipeline's stages on a small corpus, each against what its operator says of its own input."""

import os

import pytest

import corpus_pipeline
from mosaiq.llm import decontam, packing, pii, quality, simhash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    columns, out = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(n)))
        docs = out[name] = spark.read.parquet(str(tmp_path / str(n)))
        if name != "packing":
            assert docs.columns == columns
        if name == "quality rules":
            want = sorted(r.doc_id for r in before.collect() if not quality.rejected(quality.Text(r.text), quality.BASE_RULES + quality.RULES))
            assert ids(docs) == want
        if name == "near dedup":
            assert ids(docs) == sorted({r.component_id for r in simhash.near_duplicates(before).collect()})
        if name == "decontamination":
            assert set(ids(before)) - set(ids(docs)) == set(ids(decontam.matches(before, bench)))
        if name == "private data":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.text == pii.redacted(texts[r.doc_id]) and r.n_chars == len(r.text) for r in docs.collect())
        if name == "packing":
            tokens = before.select(packing.word_tokens().alias("n")).agg({"n": "sum"}).first()[0]
            assert docs.agg({"n_tokens": "sum"}).first()[0] == tokens
    run = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, out["packing"].select(run.columns).collect()))


@pytest.mark.parametrize("tables", [("documents", "benchmark"), ("documents", "benchmark", "labels")])
def test_empty(spark, tmp_path, tables):
    for name in tables:
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
