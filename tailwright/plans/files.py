"""From files to files: every table of one sample's analysis, and of a cohort's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.operators import align, annotate, cohort, ends, hits
from tailwright.operators.reads import collapse
from tailwright.operators.summary import KEY
from tailwright.plans.pipeline import Pipeline, Settings, cohort_profiles
from tailwright.sources import readers, writers
from tailwright.sources.paths import files_of


def sample(spark: SparkSession, reads_path: str, genome: str, annotations: str, priority: str, settings: Settings | None = None, repeats: str | None = None, psl: str | None = None, snps: str | None = None, fastq: str | None = None, aligner: str | None = None) -> Pipeline:
    """One sample's steps from the paths of its inputs; reads may be FASTA, FASTQ or alignments, as their content
    shows (or the name's end, ``.bam``), ``annotations`` is a list of paths and ``aligner`` a file of aligner commands."""
    s = settings or Settings()
    kind = "bam" if reads_path.endswith(".bam") else readers.sniff(spark, reads_path)
    known = {"annotations": readers.annotations(spark, readers.manifest(spark, annotations)), "priority": readers.priority(spark, priority), "settings": s}
    if repeats:
        known["repeats"] = readers.bed(spark, repeats)
    if psl:
        best = hits.extended(hits.best_hits(readers.psl(spark, psl)))
        known["hits"] = best.select(F.col("q_name").alias("read_id"), F.col("t_name").alias("chrom"), "strand", "full_start", "full_end", "ordinal")
    if snps:
        known["snps"] = readers.snps(spark, snps)
    if fastq:
        known["fastq"] = readers.fastq(spark, fastq)
    if kind in ("sam", "bam"):
        none = F.lit(None).cast("string")
        return Pipeline(getattr(readers, kind)(spark, reads_path).withColumns({"nte5": none, "nte3": none, "trim_step": F.lit(align.ROUNDS[0][3])}), **known)
    collapsed = readers.fasta(spark, reads_path) if kind == "fasta" else collapse(readers.fastq(spark, reads_path)).withColumn("read_id", F.concat_ws("|", F.md5("seq"), "abundance"))
    limits = readers.aligner_options(spark, aligner) if aligner else {}
    return Pipeline.from_reads(collapsed, (readers.genome if genome.endswith(".gz") else readers.genome_tiles)(spark, genome), limits=limits, **known)


def write(p: Pipeline, out: str) -> dict[str, str]:
    """Writes each table of a sample to a folder under ``out`` and gives their paths by name; steps without their input
    are left out."""
    s = p.settings
    paths: dict[str, str] = {}

    def put(name: str, df: DataFrame, header: bool = True) -> None:
        paths[name] = f"{out}/{name}"
        writers.tsv(df, paths[name], header)

    put("NTE.sam", writers.nte_sam(p.alignments), header=False)
    put("anno_overlap", writers.annotated_reads(p.annotated))
    put("summary", writers.read_summary(p.depth, annotate.class_counts(p.annotated, p.depth)), header=False)
    put("anno_counts", annotate.annotation_counts(p.annotated, p.annotations, p.depth))
    paths["query.fa"] = f"{out}/query.fa"
    writers.query_fasta(p.annotated, s.species, s.compat).write.text(paths["query.fa"])
    if p.hits is not None:
        put("results", writers.annotated_reads(p.judged))
        put("results.summary", hits.concordance_summary(p.judged))
        put("results" + writers.suffix("level", level=s.level), writers.annotated_reads(p.stringent))
    name = "reads" + writers.suffix("ends", share=s.share)
    put(name, writers.annotated_reads(p.canonical), header=False)
    put(name + ".summary", writers.canonical_summary(ends.canonical_summary(p.stringent, p.depth, s.share, compat=s.compat)))
    put("anno_summary", writers.annotation_summary(p.summary))
    steps = [("nosnp", p.without_snps, p.snps is not None), ("snv", p.without_zygous, True), ("phred", p.modifications, p.fastq is not None)]
    name = "anno_summary"
    for kind, counts, wanted in steps:
        if wanted:
            name += writers.suffix(kind, least=s.least_percent, most=s.most_percent, quality=s.quality)
            put(name, writers.filtered_summary(p.summary, counts))
    return paths


def cohort_samples(spark: SparkSession, samples: dict[tuple[str, str], str]) -> DataFrame:
    """(path, grp, sample) of the files of the cohort's tables, by (group, sample)."""
    rows = [(part, str(grp), str(sample)) for (grp, sample), path in samples.items() for part, _ in files_of(path)]
    return spark.createDataFrame(rows, "path string, grp string, sample string")


def _by_sample(df: DataFrame, named: DataFrame) -> DataFrame:
    """Rows with the group and sample of the file that they come from."""
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    own = named.select(plain(F.col("path")).alias("_path"), "grp", "sample")
    there = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return df.withColumn("_path", plain(there)).join(own, "_path").drop("_path", "path")


def write_cohort(spark: SparkSession, samples: dict[tuple[str, str], str], out: str, settings: Settings | None = None, reads: dict[tuple[str, str], str] | None = None) -> dict[str, str]:
    """The cohort's tables from the annotation summaries of ``samples``, paths by (group, sample); with the paths of their
    annotated ``reads`` also those reads with nothing but credible modifications.

    All samples are one read of all paths, joined to their names by the files' paths.
    """
    s = settings or Settings()
    whole = _by_sample(readers.summary(spark, list(dict.fromkeys(samples.values()))), cohort_samples(spark, samples))
    counts = readers.long_counts(whole, ("grp", "sample"))
    made = cohort_profiles(counts, s)
    paths: dict[str, str] = {}

    def put(name: str, df: DataFrame, by: tuple[str, ...] = ()) -> None:
        paths[name] = f"{out}/{name}"
        writers.tsv(df, paths[name], by=by)

    rows = ["grp", "sample", "anno_name"]
    put(f"sample_count-r{s.reads}-N{s.samples}.sample_count", writers.support_table(made["support"]))
    for kind, name in (("nte5", "nte5_counts"), ("nte3", "nte3_counts"), ("internal", "internal_mm_counts")):
        put(name, writers.kmer_table(made[kind], rows))
    put("internal_mm_compsition", writers.substitution_table(made["substitutions"], rows))
    name = "anno_summary" + writers.suffix("credible", reads=s.reads, samples=s.samples)
    put(name, writers.credible_summary(whole, made["credible"], ("grp", "sample")), ("grp", "sample"))
    if reads:
        own = _by_sample(readers.annotated_sites(spark, list(dict.fromkeys(reads.values()))), cohort_samples(spark, reads))
        ok = made["credible"].select("grp", "mod_type", *KEY).distinct()
        kept = cohort.credible_reads(own, ok, by=("grp",), rows=("grp", "sample", "read_id", "anno_name", "read_start"))
        put("reads" + writers.suffix("credible", reads=s.reads, samples=s.samples), writers.annotated_reads(kept, ("grp", "sample")), ("grp", "sample"))
    return paths
