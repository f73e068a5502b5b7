"""What was found on each annotation: read totals and modification counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwright.functions.modifications import SITE, change_text
from tailwright.functions.sequence import rna_orientation
from tailwright.operators.align import fetch

#: mod_type of the long table.
NTE5, NTE3, INTERNAL = 0, 1, 2
KEY = ["chrom", "strand", "pos_from", "pos_to", "ref", "alt"]


def is_perfect() -> Column:
    """No mismatch in the alignment and nothing added at either end."""
    return (F.col("nm") == 0) & F.col("nte5").isNull() & F.col("nte3").isNull()


def read_modifications(reads: DataFrame) -> DataFrame:
    """One row for each modification of each read that isn't perfect: the read's columns, mod_type and the site."""
    of = lambda kind, site: F.struct(F.lit(kind).alias("mod_type"), site.cast(SITE).alias("site"))
    internal = F.transform("sites", lambda s: of(INTERNAL, s))
    all_ = F.filter(F.concat(F.array(of(NTE5, F.col("site5")), of(NTE3, F.col("site3"))), internal), lambda x: x["site"].isNotNull())
    return reads.where(~is_perfect()).withColumn("m", F.explode(all_)).select("*", "m.mod_type", "m.site.*").drop("m", "site5", "site3", "sites")


def modification_counts(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., anno_name, mod_type, chrom, strand, pos_from, pos_to, ref, alt, n): the long form of the summary."""
    return read_modifications(reads).groupBy(*by, "anno_name", "mod_type", *KEY).agg(F.sum("abundance").alias("n"))


def cells(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., anno_name, total_nte5, total_nte3, total_internal, nte5, nte3, internal): modifications as text cells.

    An annotation's different modifications are gathered, which its length bounds.
    """
    text = F.concat(change_text(F.struct("pos_from", "pos_to", "ref", "alt")), F.lit(":"), F.col("n").cast("string"))
    names = {NTE5: "nte5", NTE3: "nte3", INTERNAL: "internal"}
    total = [F.coalesce(F.sum(F.when(F.col("mod_type") == k, F.col("n"))), F.lit(0)).alias(f"total_{v}") for k, v in names.items()]
    cell = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("mod_type") == k, text))), "|").alias(v) for k, v in names.items()]
    out = counts.groupBy(*by, "anno_name").agg(*total, *cell)
    return out.withColumns({v: F.coalesce(F.nullif(F.col(v), F.lit("")), F.lit("0")) for v in names.values()})


def annotation_summary(reads: DataFrame, depth: DataFrame, by: tuple[str, ...] = (), counts: DataFrame | None = None) -> DataFrame:
    """One row per annotation with reads: place, class, all, perfect and other reads, RPM, and modification cells.

    ``counts``: the reads' modification_counts(), where the caller has them stored.
    """
    first = F.min(F.struct("chrom", "strand", "anno_start", "anno_end", "species")).alias("a")
    base = reads.groupBy(*by, "anno_name").agg(first, F.sum("abundance").alias("total_reads"), F.sum(F.when(is_perfect(), F.col("abundance")).otherwise(0)).alias("perfect_reads"))
    base = base.select(*by, "anno_name", "a.*", "total_reads", "perfect_reads", (F.col("total_reads") - F.col("perfect_reads")).alias("mismatch_reads"))
    out = base.join(cells(modification_counts(reads, by) if counts is None else counts, by), [*by, "anno_name"], "left").crossJoin(F.broadcast(depth))  # one row
    return out.select(
        *base.columns,
        F.round(F.col("total_reads").cast("double") * 1e6 / F.col("depth").cast("double"), 1).alias("rpm"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_nte5", "total_nte3", "total_internal")],
        *[F.coalesce(c, F.lit("0")).alias(c) for c in ("nte5", "nte3", "internal")],
    )


def with_modifications(summary: DataFrame, counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``summary`` with the modification cells and their totals of ``counts``, which a filter has thinned out; read
    totals stay as they were."""
    names = ("total_nte5", "total_nte3", "total_internal", "nte5", "nte3", "internal")
    new = cells(counts, by).withColumnsRenamed({c: f"new_{c}" for c in names})
    out = summary.join(new, [*by, "anno_name"], "left")
    value = lambda c: F.coalesce(f"new_{c}", F.lit(0) if c.startswith("total") else F.lit("0")).alias(c)
    return out.select(*[value(c) if c in names else F.col(c) for c in summary.columns])


def with_sequence(summary: DataFrame, tiles: DataFrame) -> DataFrame:
    """Adds ``anno_sequence`` in RNA orientation from genome tiles; null where the genome has none."""
    found = fetch(summary, tiles, F.col("anno_start"), F.col("anno_end") - F.col("anno_start") + 1, "anno_sequence", how="left")
    return found.withColumn("anno_sequence", rna_orientation("anno_sequence", "strand"))
