"""Collapsing reads, library depth and multi-mapping weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., seq, abundance): one row for each distinct sequence.  The largest saving there is, so it comes first."""
    return reads.groupBy(*by, "seq").agg(F.count("*").alias("abundance"))


def library_depth(alignments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., depth): copies of all mapped reads, each read once however often it maps."""
    return alignments.groupBy(*by, "read_id").agg(F.max("abundance").alias("abundance")).groupBy(*by).agg(F.sum("abundance").alias("depth"))


def multimap_weights(alignments: DataFrame, read: str = "read_id") -> DataFrame:
    """``alignments`` with ``loci`` (how many this read has) and ``weight`` (its reciprocal).

    Counted by aggregate and join rather than by a window: the count is combined map-side, and a read with very many
    loci is not one task.
    """
    counts = alignments.groupBy(read).agg(F.count("*").alias("loci"))
    return alignments.join(counts, read).withColumn("weight", 1.0 / F.col("loci"))
