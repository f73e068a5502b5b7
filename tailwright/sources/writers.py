"""Writers: DataFrames as the tab-separated tables that other tools read, or as Parquet.

Missing values become ``0`` here and nowhere else.  Files are written by all tasks; a table comes as a folder of
parts, each with the header line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwright.functions import modifications as M
from tailwright.functions.sequence import kmers, substitutions
from tailwright.operators.summary import with_modifications
from tailwright.sources.readers import SUMMARY, SUMMARY_HEADER


def tsv(df: DataFrame, path: str, header: bool = True, by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Tab-separated, without quoting or escaping, as quotes and backslashes are legal quality signs."""
    w = df.write.mode(mode).option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").option("comment", "\x01").option("header", header)
    (w.partitionBy(*by) if by else w).csv(path)


def _profile(site: str) -> Column:
    return M.zero_if_none(M.profile_text("chrom", "strand", F.col(site)))


def _internal(part) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.transform("sites", part), "|"), F.lit("")), F.lit("0"))


def nte_sam(alignments: DataFrame) -> DataFrame:
    """Alignment lines with the end modifications in columns 7 and 8."""
    flag = F.when(F.col("strand") == "+", 0).otherwise(16)
    return alignments.select("read_id", flag.alias("flag"), "chrom", F.col("read_start").alias("start"), F.lit(255).alias("mapq"), F.concat(F.length("seq"), F.lit("M")).alias("cigar"), "trim_step", M.zero_if_none(F.col("nte5")).alias("nte5"), M.zero_if_none(F.col("nte3")).alias("nte3"), "seq", F.lit("*").alias("qual"), F.lit("*").alias("other"), F.concat(F.lit("MD:Z:"), "md").alias("md"), F.concat(F.lit("NM:i:"), "nm").alias("nm"))


def annotated_reads(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Reads with annotation, profiles and, if there, the verdict of the second aligner.  ``by`` columns come first, to
    write a folder for each sample.

    The header names are fixed values, although two of them don't say what the columns hold.
    """
    zero = lambda c: M.zero_if_none(F.col(c)).alias(c)
    out = reads.select(
        *by, F.col("chrom").alias("#chr"), "strand", F.col("read_start").alias("start"), F.col("read_end").alias("end"), F.col("read_id").alias("ID"), zero("nte5"), zero("nte3"),
        F.concat(F.lit("NM:i:"), "nm").alias("mismatch_position"), F.concat(F.lit("MD:Z:"), "md").alias("mismatch_type"), F.col("seq").alias("sequence"), F.col("anno_name").alias("ann_name"), F.col("chrom").alias("ann_chr"), F.col("anno_start").alias("ann_start"), F.col("anno_end").alias("ann_end"), "species",
        _profile("site5").alias("nte5_profile"), _profile("site3").alias("nte3_profile"), _internal(lambda s: M.profile_text("chrom", "strand", s)).alias("internal_profile"), _internal(lambda s: s["alt"]).alias("INTERNAL"),
        *[c for x in ("consensus", "alt_locus") if x in reads.columns for c in [F.col(x).alias(x.upper())]],
    )
    return out


def read_summary(depth: DataFrame, classes: DataFrame) -> DataFrame:
    """Depth, then reads of each class: the two columns of the read summary."""
    return depth.select(F.lit("total number of reads:").alias("item"), F.col("depth").cast("string").alias("reads")).unionByName(classes.select(F.col("species").alias("item"), F.col("reads").cast("string").alias("reads")))


def query_fasta(reads: DataFrame, species: str = "mirna", compat: bool = False) -> DataFrame:
    """``value`` lines for the second aligner: the + strand sequences of one class.

    ``compat``: of all lines that hold its name anywhere, as in an annotation's name.
    """
    if compat:
        line = F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in annotated_reads(reads).columns])
        own = annotated_reads(reads).where(line.contains(species)).select(F.col("ID").alias("read_id"), F.col("sequence").alias("seq"))
    else:
        own = reads.where(F.col("species") == species)
    return own.select(F.concat(F.lit(">"), "read_id", F.lit("\n"), "seq").alias("value"))


def snp_table(snps: DataFrame, path: str, mode: str = "error") -> None:
    """Known variants as Parquet, a folder for each chromosome, so that readers of some chromosomes read no others, sorted
    by place, so that readers of some places pass over the others' row groups."""
    snps.repartition("chrom", F.floor(F.col("pos") / 10_000_000)).sortWithinPartitions("chrom", "pos").write.mode(mode).partitionBy("chrom").parquet(path)


def repeat_bed(alignments: DataFrame) -> DataFrame:
    """Alignments as 0-based intervals."""
    return alignments.select("chrom", (F.col("read_start") - 1).alias("start0"), F.col("read_end").alias("end0"), "read_id", "anno_name", "strand")


def best_hits(hits: DataFrame) -> DataFrame:
    """The sixteen columns of the best-hit table."""
    joined = lambda c: F.array_join(c, ",")
    offsets = F.transform("t_starts", lambda x: x - F.col("t_start"))
    return hits.select(F.col("t_name").alias("chrom"), "t_start", "t_end", F.col("q_name").alias("read_id"), "q_size", "score", "matches", "strand", "q_start", "q_end", "mismatches", "block_count", joined("block_sizes").alias("block_sizes"), joined(offsets).alias("block_offsets"), "q_num_insert", "t_num_insert")


def annotation_summary(summary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The seventeen columns of the annotation summary; without a sequence that column is 0.  ``by`` columns come
    first, to write a folder for each sample."""
    have = set(summary.columns)
    return summary.select(*by, *[(F.coalesce(F.col(c).cast("string"), F.lit("0")) if c in have else F.lit("0")).alias(n) for c, n in zip(SUMMARY, SUMMARY_HEADER, strict=True)])


#: Columns of the table of annotations' commonest ends: fixed values.
ENDS = ["annotation_ID", "total_read_count", "canonical_end_count", "percent_canonical_end_count", "library_depth", "RPM_total_reads", "RPM_canonical", "number_end_positions", "canonical_end_position", "decision"]


def canonical_summary(summary: DataFrame) -> DataFrame:
    """The ten columns of the table of commonest ends, of canonical_summary() with a depth.

    The reads at those ends are written as annotated_reads(), without a header.
    """
    place = F.concat_ws(":", "chrom", "strand", "canonical_end")
    values = ["anno_name", "total_reads", "canonical_reads", F.round(F.col("canonical_share"), 2) * 100, "depth", "rpm_total", "rpm_canonical", "end_positions", place, "decision"]
    return summary.select(*[(F.col(v) if isinstance(v, str) else v).alias(n) for v, n in zip(values, ENDS, strict=True)])


def filtered_summary(summary: DataFrame, counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The seventeen columns with the modifications left in ``counts``: known variants, zygosity and quality all write
    this table.  ``by`` columns come first, to write a folder for each sample."""
    return annotation_summary(with_modifications(summary, counts, by), by)


def credible_summary(summary: DataFrame, counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As filtered_summary(), with the reads of the removed modifications taken off the total.

    A read with two removed modifications is taken off twice, as the table always had it.
    """
    left = with_modifications(summary, counts, by)
    sums = [f"total_{k}" for k in ("nte5", "nte3", "internal")]
    before = summary.select(*by, "anno_name", sum(F.col(c).cast("long") for c in sums).alias("_before"))
    out = left.join(before, [*by, "anno_name"]).withColumn("total_reads", F.col("total_reads") - (F.col("_before") - sum(F.col(c).cast("long") for c in sums)))
    return annotation_summary(out.drop("_before"), by)


def suffix(kind: str, **limits) -> str:
    """The ending of a table's name: fixed values with the step's limits."""
    return {"nosnp": ".nosnp", "snv": ".snv-m{least}M{most}", "phred": ".phred{quality}", "credible": ".credible-r{reads}-N{samples}", "ends": ".t{share}.canonical_end", "level": ".lvl{level}"}[kind].format(**limits)


def support_table(supported: DataFrame, label: str = "grp") -> DataFrame:
    """Modification, samples with it, all samples, group; the names are fixed values."""
    site = F.struct(F.col("pos_from"), F.col("pos_to"), F.col("ref"), F.col("alt"))
    return supported.select(M.profile_text("chrom", "strand", site).alias("modification"), F.col("samples").alias("sample_count"), F.col("total_samples").alias("total_num_samples_tested"), F.col(label).alias("group_label"))


def kmer_table(matrix: DataFrame, rows: list[str]) -> DataFrame:
    return matrix.select(*rows, *kmers(), "Ns")


def substitution_table(matrix: DataFrame, rows: list[str]) -> DataFrame:
    return matrix.select(*rows, *[f"`{s}`" for s in substitutions()], "Ns")
