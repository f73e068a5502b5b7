"""Wide count tables of what was added or exchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwright.functions.sequence import kmers, substitutions, to_rna

OTHER = "Ns"


def _pivot(counts: DataFrame, key, names: list[str], rows: list[str]) -> DataFrame:
    """One row per ``rows``, a column for each name in the order given; keys with an N go to ``Ns``, others nowhere."""
    name = F.when(key.isin(names), key).when(key.contains("N"), OTHER)
    columns = [F.coalesce(F.sum(F.when(F.col("k") == x, F.col("n"))), F.lit(0)).alias(x) for x in [*names, OTHER]]
    small = counts.withColumn("k", name).groupBy(*rows, "k").agg(F.sum("n").alias("n"))
    return small.groupBy(*rows).agg(*columns)


def kmer_matrix(counts: DataFrame, rows: list[str], longest: int = 3) -> DataFrame:
    """Counts by added bases (U for T): all strings of up to three bases, then Ns; the column list is fixed, so there
    is no job to find it."""
    return _pivot(counts, to_rna("alt"), kmers(longest), rows)


def substitution_matrix(counts: DataFrame, rows: list[str]) -> DataFrame:
    """Counts by ``ref>alt`` (U for T): the twelve pairs in fixed order, then Ns."""
    return _pivot(counts, F.concat(to_rna("ref"), F.lit(">"), to_rna("alt")), substitutions(), rows)
