"""Exact length histogram: documents by encoded length, and suffix sums that answer every context limit."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailwright.llm import bpe
from tailwright.llm.session import documents, table

#: Lengths that one task sums; the sums of whole ranges are few and are joined in.
RANGE = 4096


def length_histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(length, n_docs): one row for each encoded length that occurs (a null length counts as 0).

    Every row counts, repeated and null ids included; no other column is read, and an empty table has no rows."""
    return counts.groupBy(F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("length")).agg(F.count("*").alias("n_docs"))


def context_answers(histogram: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """What each context limit costs, from the histogram alone.

    One row for every length that occurs, taken as the limit, and for every other value in ``limits(limit long)``:
    ``n_docs`` of just that length, ``docs_within`` and ``tokens_within`` the limit, ``docs_above`` and
    ``tokens_above``, ``truncated_total`` (tokens when longer documents are cut at the limit), ``quantile`` (share
    of documents within it), ``total_docs`` and ``total_tokens``.  An empty table has no rows.

    Suffix sums are taken inside ranges of 4,096 lengths; the totals of later ranges (one row a range) are added,
    so no task sees more than one range however many lengths there are.
    """
    h = histogram.select("length", "n_docs")
    if limits is not None:
        h = h.unionByName(limits.select(F.col("limit").cast("long").alias("length"), F.lit(0).cast("long").alias("n_docs"))).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    h = h.withColumn("span", F.floor(F.col("length") / RANGE))
    per = h.groupBy("span").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("span", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("later_tokens"), F.sum("docs").over(whole).alias("total_docs"), F.sum("tokens").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(per, "span").withColumns(
        {
            "docs_above": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("later_docs"),
            "tokens_above": F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(inside), F.lit(0)) + F.col("later_tokens"),
        }
    )
    within = F.col("total_tokens") - F.col("tokens_above")
    return h.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        (F.col("total_docs") - F.col("docs_above")).alias("docs_within"),
        within.alias("tokens_within"),
        "docs_above",
        "tokens_above",
        (within + F.col("docs_above") * F.col("length")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_above")) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length within which at least that share of the documents lies."""
    a = context_answers(histogram)
    return a.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("context_limit"))).alias(f"q{k}") for k, q in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.col(f"q{k}").alias("length")) for k, q in enumerate(shares)])).alias("x")
    ).select("x.*")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in ids of the many-language byte vocabulary, over every whole text of ``documents``."""
    counts = bpe.token_counts(documents(spark, sf_dir), public_tokenizers.path(bpe.RANKS))
    return context_answers(table(length_histogram(counts), "lengths"))
