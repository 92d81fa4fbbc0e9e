"""A training corpus from `documents`: toxic texts go, near-duplicates leave one each, repeated passages are cut, sources are
mixed to their weights, and what stays is encoded. Every stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, minhash, mixing, substring, toxicity
from tarn.llm.queries import _tokenizers, _toxicity_model
from tarn.llm.shared import folded, read, shared_dir
from tarn.ship import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5.

    Null and empty texts, and those without letters or digits, score 0 and stay; repeated rows are judged alike; very long texts are
    scored whole; an empty table stays empty. Where no labelled document is in `docs`, nothing goes.
    """
    slim, column = folded(docs, "text")
    scored = toxicity.score_texts(slim, _toxicity_model(spark, docs, sf_dir), "__toxicity")
    return scored.filter(F.col("__toxicity") < 0.5).select(*map(column, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest id's, null ids last.

    Of rows that repeat both id and text one stays, if they have words; texts without words (null ones too) all stay. Very long
    texts are compared whole; an empty table stays empty.
    """
    return minhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; n_chars follows.

    Every row stays. Null, empty and short texts are not touched, nor rows that repeat another's id and text; very long texts are
    searched whole; an empty table stays empty.
    """
    return substring.cut_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most.

    Texts without words have no size and are not taken; a null source is one of its own; rows that repeat id and text are taken
    together; the order of equal finish times is fixed, so reruns agree; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, mixing.plan_mix(docs))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row; decoding gives each text's bytes back.

    Null and empty texts have no ids; repeated rows repeat their ids; very long texts are encoded whole; other columns are not kept.
    """
    tok = _tokenizers()
    done = bpe.encode(docs.select("doc_id", "text"), tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN)
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeated_passages), ("mixing", mix_sources), ("encoding", encode_texts)]

#: Trained models and edit alignment have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
