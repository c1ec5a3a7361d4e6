"""The corpus pipeline: stages that each work on all their predecessor kept, over the whole of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, jaccard, langid, spm, toxic
from plumbline.llm.common import fold, stored, table

#: A text whose n-grams the best language explains to a smaller part is in none of the learned languages.
LEAST_SHARE = 0.2
PIECES = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the model learns from labelled rows outside the held-out fold."""
    return toxic.without_toxic(docs, toxic.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in one of the languages that the others are labelled with; too short ones to tell stay."""
    return langid.in_language(docs, langid.train(docs.filter(F.coalesce(fold("doc_id", 5) != 0, F.lit(True)))), LEAST_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return jaccard.one_of_each(docs, n=5, num=8, den=10)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of what is left."""
    coded = spm.encode(docs, public_tokenizers.path(PIECES), ["doc_id", "lang", "source"])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode)]

#: Learned models are beyond SQL: tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
