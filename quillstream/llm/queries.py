"""The queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import bitplanes, html_layout, langid, lm_difference, nbest, ngram_join, packing, pu_classifier, rules, vector_graph

TOKENIZER_DIR = os.environ.get("QUILLSTREAM_TOKENIZERS", "")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the folder may be set by QUILLSTREAM_TOKENIZERS."""
    if TOKENIZER_DIR:
        return os.path.join(TOKENIZER_DIR, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.bitplane_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality; background: all documents."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_difference.cross_entropy_difference(table(spark, sf_dir, "documents"), good, tokenizer_path("byte_bpe_50k.json"))


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.render_pages(table(spark, sf_dir, "pages").select("page_id", "html"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pattern_packing(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, size=2048)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    return nbest.digest(nbest.segment(table(spark, sf_dir, "documents"), model, with_text=True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents")).drop("row_key")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_dedup(table(spark, sf_dir, "embeddings"))


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pu_classifier.train(docs, table(spark, sf_dir, "labels"))
    return pu_classifier.score(docs, model).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bitplane_ids": op1_bitplane_ids,
        "op2_nbest_segmentation": op2_nbest_segmentation,
        "op3_language_id": op3_language_id,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_cross_entropy_difference": op5_cross_entropy_difference,
        "op6_html_layout": op6_html_layout,
        "op7_pattern_packing": op7_pattern_packing,
        "op8_quality_rules": op8_quality_rules,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_quality_pu": op10_quality_pu,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": rules.oracle_sql()}
