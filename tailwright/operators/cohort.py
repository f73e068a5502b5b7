"""Modifications that several samples support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least reads in a sample, and least samples (all of them if there are fewer).
READS, SAMPLES = 2, 5


def support(counts: DataFrame, key: list[str], reads: int = READS, compat: bool = False) -> DataFrame:
    """(grp, key..., samples, total_samples): samples of the group with at least ``reads`` reads of the modification.

    ``counts(grp, sample, ..., key..., n)``.  Samples are told apart by a distinct before the count, both combined
    map-side.  ``compat``: every summary row counts, so a sample may count twice.
    """
    enough = counts.where(F.col("n") >= reads)
    rows = enough if compat else enough.select("grp", "sample", *key).distinct()
    total = counts.select("grp", "sample").distinct().groupBy("grp").agg(F.count("*").alias("total_samples"))
    return rows.groupBy("grp", *key).agg(F.count("*").alias("samples")).join(total, "grp")


def credible(supported: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The modifications with enough samples."""
    return supported.where(F.col("samples") >= F.least(F.lit(samples), F.col("total_samples")))


def credible_counts(counts: DataFrame, key: list[str], reads: int = READS, samples: int = SAMPLES, compat: bool = False) -> DataFrame:
    """``counts`` of at least ``reads`` reads whose modification is credible in the group."""
    ok = credible(support(counts, key, reads, compat), samples).select("grp", *key)
    return counts.where(F.col("n") >= reads).join(ok, ["grp", *key], "left_semi")


def credible_reads(reads: DataFrame, ok: DataFrame, by: tuple[str, ...] = (), rows: tuple[str, ...] = ("read_id", "anno_name", "read_start")) -> DataFrame:
    """Reads that are perfect (no mismatch) or keep a modification; what isn't credible becomes none.

    ``reads`` carry nte5, nte3, site5, site3, sites and chrom, strand; ``ok(by..., mod_type, chrom, strand, pos_from,
    pos_to, ref, alt)`` is the credible set, of each group where ``by`` names its column.  ``rows`` tell reads apart.
    Membership is tested by left joins on the place; internal mismatches one by one.
    """
    rows, where = list(rows), [*by, "chrom", "strand"]
    sided = reads
    for kind, site in ((0, "site5"), (1, "site3")):
        one = ok.where(F.col("mod_type") == kind).select(*where, F.struct("pos_from", "pos_to", "ref", "alt").alias(site), F.lit(True).alias(f"{site}_ok"))
        sided = sided.join(one, [*where, site], "left")
    inner = ok.where(F.col("mod_type") == 2).select(*where, F.struct("pos_from", "pos_to", "ref", "alt").alias("site"))
    kept = reads.select(*dict.fromkeys([*rows, *where]), F.posexplode("sites").alias("at", "site")).join(inner, [*where, "site"], "left_semi").groupBy(*rows).agg(F.array_sort(F.collect_list(F.struct("at", "site"))).alias("s"))  # a read's own few sites
    out = sided.join(kept, rows, "left").withColumn("sites_ok", F.coalesce(F.transform("s", lambda x: x["site"]), F.slice("sites", 1, 0)))
    perfect = F.col("nm") == 0
    keep = lambda ok, value: F.when(perfect | F.col(ok), F.col(value)).alias(value)
    out = out.where(perfect | F.col("site5_ok") | F.col("site3_ok") | (F.size("sites_ok") > 0))
    return out.select(*[c for c in reads.columns if c not in ("nte5", "nte3", "site5", "site3", "sites")], keep("site5_ok", "nte5"), keep("site3_ok", "nte3"), keep("site5_ok", "site5"), keep("site3_ok", "site3"), F.when(perfect, F.col("sites")).otherwise(F.col("sites_ok")).alias("sites"))
