"""The pipeline: its stages, and its result against plain versions of them."""

import hashlib

import public_tokenizers
import tiktoken
from odd import components, kept_lines
from pyspark.sql import functions as F

import corpus_pipeline
from cohortline.llm import byte_bpe, mixing

FOLDER = "/root/testdata/sf0.001"


def test_run_agrees_with_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = corpus_pipeline.without_toxic(spark, docs, FOLDER)
    assert clean.columns == docs.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    lost = docs.join(clean, "doc_id", "left_anti").join(labels, "doc_id").select("toxic").collect()
    assert sum(1 - r.toxic for r in lost) <= 1
    rows = {r.doc_id: r for r in clean.collect()}
    lines = kept_lines([(d, r.text) for d, r in rows.items()])
    found = components(list(lines.items()))
    first = [d for d in lines if found[d][0] == 0 or found[d][1] == d]
    mixed = spark.createDataFrame([(d, lines[d], rows[d].source) for d in first], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(mixed).collect()}
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d in first:
        ids = encoding.encode_ordinary(lines[d])
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want += [(d, len(ids), listed, hashlib.sha256(lines[d].encode()).hexdigest())] * copies[d]
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert out.filter(F.col("n_chars") != F.char_length("text")).count() == 0
