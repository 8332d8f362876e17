"""A pipeline for training data: quality, language, near-duplicates, mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of ``documents``.

Cases: a row without an id takes part everywhere and stands for its group of near-duplicates if no row with an id is in
it; rows that share an id but not a text are rows of their own; rows equal in all columns are one row after the
near-duplicate stage; a null text counts as empty, has no letter and leaves at the language stage at the latest; columns
beyond those of ``documents`` pass, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrydeck.llm import crf_langid, piece_codec, simhash_dedup, source_mix, subword_quality
from quarrydeck.llm._common import crc_mod, free_name, shared_folder, table
from quarrydeck.llm.queries import QUALITY_CUT, TOKENIZERS

#: A text in a learned language has a mean marginal far above this, and a word or two of one stay above it as well; noise
#: spreads over the languages.
LANGUAGE_CUT = 0.35


def same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is below the cut go."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = subword_quality.fit_quality(docs, labels)
    score = free_name("score", docs)
    return same_columns(subword_quality.score_quality(docs, model, score_col=score).where(F.col(score) >= QUALITY_CUT), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without letters or without a clear language go."""
    model = crf_langid.fit_language(docs.where(crc_mod("doc_id", 4) != 2))
    lang, score = free_name("lang_pred", docs), free_name("score", docs)
    found = crf_langid.identify_language(docs, model, lang_col=lang, score_col=score)
    return same_columns(found.where((F.col(lang) != "und") & (F.col(score) >= LANGUAGE_CUT)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row stays: the smallest id, rows without an id last."""
    return simhash_dedup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat or go, so that the sources reach their targets."""
    return source_mix.sample_mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding gives the text back."""
    model = piece_codec.load_model(os.path.join(TOKENIZERS, "piece_bpe_32k.model"))
    back = free_name("decoded", docs)
    done = piece_codec.round_trip(docs, model, decoded_col=back)
    return done.withColumn("round_trip", F.col(back) == F.coalesce("text", F.lit(""))).drop(back)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("pieces", pieces)]

#: Trained classifiers can't be expressed in SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared checkpoint folder and read again."""
    root = shared_folder(spark)
    docs, at = table(spark, sf_dir, "documents"), f"{root}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return docs
