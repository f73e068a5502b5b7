"""Structured Streaming forms of collapsing and annotating, for sequencers that deliver files as they go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.operators import annotate

ALIGNED = "read_id string, abundance bigint, chrom string, strand string, read_start bigint, read_end bigint, nte5 string, nte3 string, nm int, md string, seq string"


def aligned(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New Parquet files of alignments in a folder, so many a trigger at most."""
    return spark.readStream.schema(ALIGNED).option("maxFilesPerTrigger", files).parquet(path)


def collapsed(reads: DataFrame) -> DataFrame:
    """Running abundance of each sequence (state grows with the distinct sequences; write in update mode)."""
    return reads.groupBy("seq").agg(F.count("*").alias("abundance"))


def class_counts(stream: DataFrame, annotations: DataFrame, priority: DataFrame, out: str, checkpoint: str):
    """Starts a query that annotates each batch and appends its reads per class, with the batch's number, to ``out``.

    Annotating needs all candidate annotations of an alignment together but nothing of other batches, so it runs per
    batch; sums over the table of batches are exact, and a repeated batch overwrites its own part.
    """

    def one(batch: DataFrame, number: int) -> None:
        picked = annotate.annotate(batch, annotations, priority)
        counts = picked.groupBy("species").agg(F.sum("abundance").alias("reads"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
