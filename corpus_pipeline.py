"""The corpus pipeline: STAGES are applied to the table ``documents`` one after another.

Each stage works on all rows that its predecessor kept; all but the last return the columns of
their input, with its values, whatever else the table has (columns are never overwritten, as the
stages add none). Labels (for the classifier) come from ``labels`` beside the documents.

Null and empty texts have no words, so the rules reject them. Repeated rows are judged row by row
up to the n-gram join, where rows equal in id and text are one (of rows that differ in other
columns then any one stays); rows with null ids are rows as any other. Of a group of copies the row
with the least id stays, of equal ids the one whose hash is least. Without a positive label to
learn from the classifier keeps all rows. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import ngram_join, packing, pu_classifier, rules
from quillstream.llm.common import release, row_key, stored, unused
from quillstream.llm.queries import table, tokenizer_path

THRESHOLD = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return docs.filter(rules.passes(F.col("text")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier, learnt on the rows at hand, predicts to be good."""
    model = pu_classifier.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(pu_classifier.score_of(F.col("text"), model) >= THRESHOLD)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (rows equal in id and text are one)."""
    key = unused(docs, "row_key")
    stays = ngram_join.ngram_groups(docs).filter("kept").select(F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), F.col("text")))
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).drop(key)


def pattern_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 2048 tokens."""
    return packing.pattern_packing(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, size=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("best-fit packing", pattern_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each but the last keeps is written and read again."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, kept = kept, stored(docs, "stage")
            docs = kept
            if before is not None:
                release(before)
    return docs


#: The classifier's training and the packing plan can't be expressed in SQL; tests hold each
#: stage against a brute-force version.
ORACLE_SQL = None
