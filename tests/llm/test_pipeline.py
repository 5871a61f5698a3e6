"""The pipeline: each stage's decisions against the operators' own tests' brute force, and its edges."""

import os

import public_tokenizers
import pytest
import tiktoken
from brute import jaccard

import corpus_pipeline as pipeline
from loglane.llm import bpe
from loglane.llm.shared import store, table

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, steps = docs.columns, {}
    for name, stage in pipeline.STAGES:
        steps[name] = docs = store(stage(spark, docs, FOLDER))
        assert name == "byte_bpe" or docs.columns == columns
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in steps.items()}
    assert len(ids["language_id"]) >= 195
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    held = [d for d in ids["language_id"] if labels.get(d) == 1]
    assert set(held) <= set(ids["quality_classifier"])
    dropped = set(ids["language_id"]) - set(ids["quality_classifier"])
    assert all(labels.get(d, 0) == 0 for d in dropped)
    rows = [(r.doc_id, r.text) for r in steps["quality_classifier"].collect()]
    assert ids["ngram_jaccard_join"] == sorted(d for d, _, c in jaccard(rows) if d == c)
    mix = ids["mix_sources"]
    assert set(mix) <= set(ids["ngram_jaccard_join"]) and max(map(mix.count, mix)) <= 2 and mix == ids["byte_bpe"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in steps["mix_sources"].collect()}
    assert all(list(r.ids) == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in docs.collect())


def test_no_documents(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = store(stage(spark, docs, FOLDER))
        assert docs.count() == 0


def test_odd_documents(spark):
    good = [r.text for r in table(spark, FOLDER, "documents").filter("lang = 'en'").limit(4).collect()]
    rows = [(1, good[0], "en", "a", None), (1, good[0], "en", "a", None), (None, good[1], None, None, 3), (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, " 12 ", None, "b", 1)]
    docs = spark.createDataFrame(rows, table(spark, FOLDER, "documents").schema)
    for _, stage in pipeline.STAGES[:4]:
        docs = store(stage(spark, docs, FOLDER))
    assert {r.doc_id for r in docs.collect()} <= {1, None}
