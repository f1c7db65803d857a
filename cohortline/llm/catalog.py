"""The operators over the supplied tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cohortline.llm import (
    byte_bpe,
    line_dedup,
    mixing,
    near_duplicates,
    oracles,
    packing,
    periodic_runs,
    personal_data,
    quality_rules,
    resampling,
    substring_dedup,
    token_alignment,
    toxicity,
    vector_search,
)
from cohortline.sources.io import load

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def documents(spark, folder):
    return load(spark, folder, "documents")


def pareto_mix(spark, folder):
    return mixing.mix(documents(spark, folder), weights=(3, 1, 2), share=1.5, most=2)


def toxicity_grammar(spark, folder):
    return toxicity.judge(documents(spark, folder), load(spark, folder, "labels"))


def line_deletion_join(spark, folder):
    kept = line_dedup.dedup_lines(documents(spark, folder))
    return kept.select(
        "doc_id",
        F.col("_kept_lines").alias("n_kept"),
        F.col("_dropped_lines").alias("n_dropped"),
        F.md5("text").alias("kept_md5"),
    )


def parity_join(spark, folder):
    return near_duplicates.near_duplicates(documents(spark, folder))


def importance_resampling(spark, folder):
    good = load(spark, folder, "labels").filter("quality = 1")
    return resampling.resample(documents(spark, folder), good, share=0.85)


def impact_search(spark, folder):
    return vector_search.top_k(load(spark, folder, "embeddings"), F.col("id") % 50 == 0, k=5)


def pii_anchors(spark, folder):
    return personal_data.digest(documents(spark, folder))


def perplexity_rules(spark, folder):
    return quality_rules.judge(documents(spark, folder))


def rank_queue_bpe(spark, folder):
    return byte_bpe.digest(documents(spark, folder), RANKS, PATTERN)


def suffix_dedup(spark, folder):
    return substring_dedup.dedup_substrings(documents(spark, folder), keep_bytes=False)


def periodic(spark, folder):
    texts = periodic_runs.with_planted_repeats(documents(spark, folder))
    return periodic_runs.digest(periodic_runs.find_runs(texts))


def best_fit_packing(spark, folder):
    pieces = packing.pieces(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    sums = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(sums, capacity=4096).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def alignment(spark, folder):
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align(documents(spark, folder), *paths)


QUERIES = {
    "op1_pareto_mix": pareto_mix,
    "op2_toxicity_grammar": toxicity_grammar,
    "op3_line_deletion_join": line_deletion_join,
    "op4_parity_join": parity_join,
    "op5_importance_resampling": importance_resampling,
    "op6_impact_search": impact_search,
    "op7_pii_anchors": pii_anchors,
    "op8_perplexity_rules": perplexity_rules,
    "op9_rank_queue_bpe": rank_queue_bpe,
    "op10_suffix_dedup": suffix_dedup,
    "op11_periodic_runs": periodic,
    "op12_best_fit_packing": best_fit_packing,
    "op13_token_alignment": alignment,
}

ORACLES = {
    "op1_pareto_mix": oracles.MIX_SQL,
    "op3_line_deletion_join": oracles.LINE_SQL,
    "op4_parity_join": oracles.COMPONENT_SQL,
    "op6_impact_search": oracles.SEARCH_SQL,
}
