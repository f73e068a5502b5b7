"""Removing modifications that look like genomic variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwright.operators.summary import KEY, NTE3, NTE5


def bases(modifications: DataFrame) -> DataFrame:
    """One row for each base of each modification, alleles on the + strand: snp_pos, snp_ref, snp_alt."""
    minus = F.col("strand") == "-"
    place = lambda i: F.when(minus, F.col("pos_from") - i).otherwise(F.col("pos_from") + i)
    letter = lambda c, i: F.when(minus, F.translate(F.substring(c, i + 1, F.lit(1)), "ACGT", "TGCA")).otherwise(F.substring(c, i + 1, F.lit(1)))
    each = F.transform(F.sequence(F.lit(0), F.length("alt") - 1), lambda i: F.struct(place(i).alias("snp_pos"), letter(F.col("ref"), i).alias("snp_ref"), letter(F.col("alt"), i).alias("snp_alt")))
    return modifications.withColumn("base", F.explode(each)).select("*", "base.*").drop("base")


def within_reach(snps: DataFrame, modifications: DataFrame) -> DataFrame:
    """The variants that lie between the first and the last modification of a chromosome.

    These spans are looked up first, a row a chromosome, and become a filter of the variants' scan: folders of other
    chromosomes aren't read, nor are row groups of other places where the table is sorted (writers.snp_table()).
    ``modifications`` should come from a stored table, as they are read for it.
    """
    low, high = F.least("pos_from", "pos_to"), F.greatest("pos_from", "pos_to")
    spans = modifications.groupBy("chrom").agg(F.min(low).alias("low"), F.max(high).alias("high")).collect()
    own = sorted((r for r in spans if r["chrom"] is not None), key=lambda r: r["chrom"])
    each = [(F.col("chrom") == r["chrom"]) & F.col("pos").between(r["low"], r["high"]) for r in own]
    while len(each) > 1:  # by halves, so that many chromosomes are no deep expression
        each = [a | b for a, b in zip(each[::2], each[1::2], strict=False)] + each[len(each) // 2 * 2 :]
    return snps.where(each[0] if each else F.lit(False))


def without_snps(modifications: DataFrame, snps: DataFrame, compat_order: str | None = None) -> DataFrame:
    """``modifications`` without those of which any base is in ``snps(chrom, pos, ref, alt)``.

    Place and alleles are the join key, so only keys travel; SNP tables partitioned by chromosome are pruned.
    With ``compat_order``, a column that gives the order of annotations, the first annotation of each chromosome keeps
    all that it has.
    """
    known = snps.select("chrom", F.col("pos").alias("snp_pos"), F.col("ref").alias("snp_ref"), F.col("alt").alias("snp_alt"))
    hit = bases(modifications.select(*KEY).distinct()).join(known, ["chrom", "snp_pos", "snp_ref", "snp_alt"], "left_semi").select(*KEY).distinct()
    if compat_order is None:
        return modifications.join(hit, KEY, "left_anti")
    first = modifications.groupBy("chrom").agg(F.min_by("anno_name", compat_order).alias("first"))
    marked = modifications.join(hit.withColumn("known", F.lit(True)), KEY, "left").join(first, "chrom")
    return marked.where(F.col("known").isNull() | (F.col("anno_name") == F.col("first"))).select(*modifications.columns)


def cut_at_snps(modifications: DataFrame, snps: DataFrame) -> DataFrame:
    """``modifications(..., mod_type, key..., n)`` with end modifications cut at their variants: from the RNA's end inward
    the first base in ``snps(chrom, pos, ref, alt)`` stops, and what lies outside it is kept.

    An end modification whose outermost base is a variant goes, as does an internal one that is a variant.  What is
    kept of different modifications may be the same: their counts are added.  The variants of a modification are an
    aggregate of its bases' indexes, the last one of a 3' end and the first one of a 5' end.
    """
    known = snps.select("chrom", F.col("pos").alias("snp_pos"), F.col("ref").alias("snp_ref"), F.col("alt").alias("snp_alt"))
    key = ["mod_type", *KEY]
    hit = bases(modifications.select(*key).distinct()).join(known, ["chrom", "snp_pos", "snp_ref", "snp_alt"], "left_semi")
    at = F.abs(F.col("snp_pos") - F.col("pos_from")).cast("int")
    stop = hit.groupBy(*key).agg(F.max(at).alias("last"), F.min(at).alias("first"))
    both = modifications.join(stop, key, "left")
    n = F.length("alt")
    begin = F.when(F.col("last").isNotNull() & (F.col("mod_type") == NTE3), F.col("last") + 1).otherwise(F.lit(0))
    end = F.when(F.col("last").isNull() | (F.col("mod_type") == NTE3), n).when(F.col("mod_type") == NTE5, F.col("first")).otherwise(F.lit(0))
    both = both.withColumns({"_begin": begin, "_n": end - begin}).where("_n > 0")
    step = F.when(F.col("strand") == "-", F.lit(-1)).otherwise(F.lit(1))
    part = lambda c: F.substring(c, F.col("_begin") + 1, F.col("_n"))
    kept = {"pos_from": F.col("pos_from") + step * F.col("_begin"), "pos_to": F.col("pos_from") + step * (F.col("_begin") + F.col("_n") - 1), "ref": part("ref"), "alt": part("alt")}
    out = both.withColumns({c: x.cast(modifications.schema[c].dataType) for c, x in kept.items()})
    by = [c for c in modifications.columns if c != "n"]
    return out.groupBy(*by).agg(F.sum("n").alias("n")).select(*modifications.columns)


def without_zygous(modifications: DataFrame, totals: DataFrame, least: int = 100, most: int = 100, by: tuple[str, ...] = ("anno_name",)) -> DataFrame:
    """``modifications`` without those that all reads of their annotation have (homozygous), or a whole percentage of
    them from ``least`` to ``most`` (heterozygous).  ``totals(by..., total_reads)``; a zero total removes nothing."""
    both = modifications.join(totals.select(*by, "total_reads"), list(by))
    return both.where(~zygosity(least, most).isNotNull()).drop("total_reads")


def zygosity(least: int, most: int):
    percent = F.expr("try_divide(n * 100, total_reads)")
    return F.when(F.col("n") == F.col("total_reads"), "homozygous").when(F.floor(percent).between(least, most), "heterozygous")


def removed_counts(modifications: DataFrame, totals: DataFrame, least: int = 100, most: int = 100, by: tuple[str, ...] = ("anno_name",)) -> DataFrame:
    """(kind, modifications): how many without_zygous() removes."""
    both = modifications.join(totals.select(*by, "total_reads"), list(by)).withColumn("kind", zygosity(least, most))
    return both.where("kind is not null").groupBy("kind").agg(F.count("*").alias("modifications"))
