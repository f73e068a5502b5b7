"""Annotations whose reads agree on one 3' end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwright.functions.modifications import end_without_nte3

#: Least share of reads at the commonest 3' end.
SHARE = 0.5


def end_counts(annotated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., anno_name, chrom, strand, end_position, reads)."""
    return annotated.withColumn("end_position", end_without_nte3("strand", "read_start", "read_end", "nte3")).groupBy(*by, "anno_name", "chrom", "strand", "end_position").agg(F.sum("abundance").alias("reads"))


def canonical_summary(annotated: DataFrame, depth: DataFrame | None = None, share: float = SHARE, by: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """One row per annotation: all reads, those at the commonest end (on a tie the least position), and the decision.

    With the one-row ``depth`` also reads per million; ``compat`` multiplies by the depth instead.
    """
    best = F.max(F.struct(F.col("reads"), (-F.col("end_position")).alias("minus"), "chrom", "strand"))
    out = end_counts(annotated, by).groupBy(*by, "anno_name").agg(F.sum("reads").alias("total_reads"), F.count("*").alias("end_positions"), best.alias("b"))
    out = out.select(*by, "anno_name", "total_reads", F.col("b.reads").alias("canonical_reads"), "end_positions", (-F.col("b.minus")).alias("canonical_end"), F.col("b.chrom").alias("chrom"), F.col("b.strand").alias("strand"))
    part = F.col("canonical_reads") / F.col("total_reads")
    out = out.withColumns({"canonical_share": part, "decision": F.when(part >= share, "KEEP").otherwise("REMOVE")})
    if depth is not None:
        per = (lambda c: F.col(c) * F.col("depth") / 1e6) if compat else (lambda c: F.col(c).cast("double") * 1e6 / F.col("depth").cast("double"))
        out = out.crossJoin(F.broadcast(depth)).withColumns({"rpm_total": F.round(per("total_reads"), 2), "rpm_canonical": F.round(per("canonical_reads"), 2)})  # one row
    return out


def canonical_reads(annotated: DataFrame, share: float = SHARE, by: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """Reads that end at the commonest 3' end of an annotation that is kept.  ``compat``: chosen by read id alone."""
    kept = canonical_summary(annotated, share=share, by=by).where("decision = 'KEEP'").select(*by, "anno_name", F.col("canonical_end").alias("end_position"))
    at = annotated.withColumn("end_position", end_without_nte3("strand", "read_start", "read_end", "nte3"))
    own = at.join(kept, [*by, "anno_name", "end_position"], "left_semi").drop("end_position")
    return annotated.join(own.select(*by, "read_id").distinct(), [*by, "read_id"], "left_semi") if compat else own
