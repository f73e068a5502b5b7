"""The corpus pipeline: each stage reads what the one before wrote.

All stages but the last return the columns of ``documents``; each works on every row its predecessor kept.  Nulls,
empty and repeated rows are treated as the operators' docstrings say: a null text is empty, and an empty text is
rejected by the language stage, as it has no letter.  Columns beyond those of ``documents`` are carried along,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm import bpe, decontaminate, langid, line_crf, near_dedup
from tailwright.llm.session import documents, table

#: A document whose language is less certain is rejected.
LANGUAGE_SCORE = 0.5


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted on all labels, predicts to be good."""
    field = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return line_crf.score(docs, field, [_row(docs)]).where("predicted = 1").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; what has no letter or fits none of them goes."""
    net = langid.train(docs.select("text", "lang"))
    found = langid.predict(docs, net, keep=[_row(docs)])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id."""
    return near_dedup.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, as counts and digests."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("encode", encode),
]

#: SQL can't state the stages' models and hashes; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
