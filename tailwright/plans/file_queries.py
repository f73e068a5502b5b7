"""Registered queries that go through files: bridge tables are written in each format, read again, and held against the
SQL of what was written.  Importing this module adds them to the registry."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.functions import sequence as S
from tailwright.operators import annotate, cohort, ends, hits, profiles, summary, variants
from tailwright.plans.bridge import bridge
from tailwright.plans.queries import CANONICAL, _wide, alignments, annotated, depth, judged, profiled, query, sample_counts, stored_profiled
from tailwright.plans.store import own_dir, table
from tailwright.sources import readers, writers


def place(spark: SparkSession, name: str) -> str:
    """A new folder of this application's."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put_lines(spark: SparkSession, lines: DataFrame, name: str, packed: bool = False) -> str:
    """The path of a text of ``lines(value)``, as one gzip stream a part if ``packed``."""
    path = place(spark, name)
    lines.write.option("compression", "gzip" if packed else "none").text(path)
    return path


def put_tsv(spark: SparkSession, df: DataFrame, name: str, header: bool = True) -> str:
    path = place(spark, name)
    writers.tsv(df, path, header)
    return path


def tabbed(*fields: Column | str) -> Column:
    return F.concat_ws("\t", *[S.col(f).cast("string") for f in fields]).alias("value")


# Reads and alignments


@query("select read_id, abundance, seq from aln")
def file_fasta(spark, d):
    rows = bridge(spark, d, "aln").select(F.concat(F.lit(">"), "read_id", F.lit("\n"), F.left("seq", F.lit(10)), F.lit("\n"), F.substring("seq", F.lit(11), F.lit(200))).alias("value"))
    return readers.fasta(spark, put_lines(spark, rows, "fasta"))


@query("select name, seq, qual from fastq")
def file_fastq(spark, d):
    rows = bridge(spark, d, "fastq").select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))
    return readers.fastq(spark, put_lines(spark, rows, "fastq"), 1 << 16)


@query("select name, seq, qual from fastq")
def file_fastq_gzip(spark, d):
    rows = bridge(spark, d, "fastq").select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))
    return readers.fastq(spark, put_lines(spark, rows, "fastq", packed=True))


@query("select read_id, abundance, strand, chrom, cast(read_start as bigint) read_start, cast(read_end as bigint) read_end, seq, md, cast(nm as int) nm from aln where ln <> 3")
def file_sam(spark, d):
    """Reads on line 3 are written as unmapped."""
    a = bridge(spark, d, "aln")
    flag = F.when(F.col("ln") == 3, 4).when(F.col("strand") == "-", 16).otherwise(0)
    rows = a.select(tabbed("read_id", flag, "chrom", "read_start", F.lit(255), F.concat(F.length("seq").cast("string"), F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), "seq", F.lit("*"), F.concat(F.lit("NM:i:"), "nm"), F.concat(F.lit("MD:Z:"), "md")))
    head = spark.sql("select '@HD\tVN:1.0' value")
    return readers.sam(spark, put_lines(spark, rows.unionByName(head), "sam")).select("read_id", "abundance", "strand", "chrom", "read_start", "read_end", "seq", "md", "nm")


@query("select read_id, abundance, chrom, strand, cast(read_start as bigint) read_start, cast(read_end as bigint) read_end, seq, nullif(nte3, '0') nte3, cast(nm as int) nm, md, 'init-mapping-0' trim_step from nte")
def file_nte_sam(spark, d):
    path = put_tsv(spark, writers.nte_sam(alignments(spark, d).withColumn("trim_step", F.lit("init-mapping-0"))), "nte", header=False)
    return readers.nte_sam(spark, path).drop("nte5")


@query("select read_id, abundance, chrom, strand, cast(read_start as bigint) read_start, cast(read_end as bigint) read_end, seq, k nm, md from aln")
def file_native(spark, d):
    """The aligner's own table: mismatches by their distance from the read's 5' end."""
    a = bridge(spark, d, "aln").withColumn("m", S.md_mismatches("md"))
    one = lambda m: F.concat(F.when(F.col("strand") == "-", F.length("seq") - 1 - m["offset"]).otherwise(m["offset"]).cast("string"), F.lit(":"), m["ref"], F.lit(">"), F.substring("seq", m["offset"] + 1, F.lit(1)))
    found = F.array_join(F.transform("m", one), ",")
    rows = a.select(tabbed("read_id", "strand", "chrom", F.col("read_start") - 1, "seq", F.repeat(F.lit("I"), F.length("seq")), F.lit(0), found))
    return readers.native_alignments(spark, put_lines(spark, rows, "native")).select("read_id", "abundance", "chrom", "strand", "read_start", "read_end", "seq", "nm", "md")


@query("select read_id, abundance, seq from ann where species = 'mirna'")
def file_query_fasta(spark, d):
    return readers.fasta(spark, put_lines(spark, writers.query_fasta(annotated(spark, d)), "query"))


# Annotations, repeats, hits, variants, genome


@query("select chrom, strand, cast(anno_start as bigint) anno_start, cast(anno_end as bigint) anno_end, species, anno_name from anno")
def file_annotations(spark, d):
    a = bridge(spark, d, "anno")
    head = spark.sql("select 'chr strand start end class name' value")
    path = put_lines(spark, a.select(F.concat_ws(" ", "chrom", "strand", "anno_start", "anno_end", "species", "anno_name").alias("value")).unionByName(head), "anno")
    manifest = put_lines(spark, spark.createDataFrame([("# annotations",), (path,)], "value string").coalesce(1), "manifest")
    return readers.annotations(spark, readers.manifest(spark, manifest)).drop("aid")


@query("select species, rnk from prio")
def file_priority(spark, d):
    p = bridge(spark, d, "prio")
    return readers.priority(spark, put_lines(spark, p.coalesce(1).sortWithinPartitions("rnk").select(F.col("species").alias("value")), "priority"))


@query("""select read_id, abundance, chrom, strand, cast(read_start as bigint) read_start, cast(read_end as bigint) read_end, nullif(nte3, '0') nte3, cast(nm as int) nm, md, seq,
       anno_name, cast(anno_start as bigint) anno_start, cast(anno_end as bigint) anno_end, species,
       case when k > 0 then concat(chrom, ':', strand, ':', case when p_from = p_to then cast(p_from as varchar) else concat(p_from, '-', p_to) end, ':', nte3_ref, '>', nte3) end nte3_profile from ann""")
def file_annotated_reads(spark, d):
    back = readers.annotated_reads(spark, put_tsv(spark, writers.annotated_reads(profiled(spark, d)), "overlap"))
    return back.select("read_id", "abundance", "chrom", "strand", "read_start", "read_end", "nte3", "nm", "md", "seq", "anno_name", "anno_start", "anno_end", "species", "nte3_profile")


@query("""select q_name read_id, t_name chrom, cast(t_start as bigint) t_start, cast(t_end as bigint) t_end, cast(q_size as int) q_size, cast(q_start as int) q_start, cast(q_end as int) q_end from (
  select p.*, rank() over (partition by q_name order by matches - mismatches - q_num_insert - t_num_insert desc) rk from psl p) x where rk = 1""")
def file_best_hits(spark, d):
    """Hits in their own format, then the best ones in theirs."""
    p = bridge(spark, d, "psl")
    zero = F.lit(0)
    size, text = F.col("q_end") - F.col("q_start"), lambda c: F.concat(c.cast("string"), F.lit(","))
    rows = p.select(tabbed("matches", "mismatches", zero, zero, "q_num_insert", zero, "t_num_insert", zero, F.lit("+"), "q_name", "q_size", "q_start", "q_end", F.concat("t_name", F.lit(".fa")), F.lit(10**6), "t_start", "t_end", F.lit(1), text(size), text(F.col("q_start")), text(F.col("t_start"))))
    best = hits.best_hits(readers.psl(spark, put_lines(spark, rows, "psl")))
    return readers.best_hit_table(spark, put_tsv(spark, writers.best_hits(best), "best", header=False)).select("read_id", "chrom", "t_start", "t_end", "q_size", "q_start", "q_end")


@query("select chrom, cast(read_start - 1 as bigint) start0, cast(read_end as bigint) end0, read_id as name, anno_name score, strand from ann")
def file_bed(spark, d):
    return readers.bed(spark, put_tsv(spark, writers.repeat_bed(annotated(spark, d)), "bed", header=False))


@query("select chrom, cast(pos as bigint) pos, ref, alt, 'known' source from snp")
def file_snps(spark, d):
    """As lines, then as folders by chromosome."""
    s = bridge(spark, d, "snp")
    lines = readers.snps(spark, put_lines(spark, s.select(F.concat_ws(" ", "chrom", "pos", F.concat("ref", F.lit(">"), "alt"), F.lit("known")).alias("value")), "snps", packed=True))
    path = place(spark, "snp_table")
    writers.snp_table(lines, path)
    return readers.snp_table(spark, path)


@query("select concat('piece', p_partkey) chrom, cast(t * 16 + 1 as bigint) as \"first\", substr(seq64, cast(t * 16 + 1 as int), 24) bases from locus cross join range(0, 4) r(t)")
def file_genome(spark, d):
    """Each piece as a chromosome in lines of 20 bases, read in ranges of 50,000 bytes."""
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.substring("seq64", k * 20 + 1, F.lit(20))), "\n")
    path = put_lines(spark, bridge(spark, d, "locus").select(F.concat(F.lit(">piece"), "p_partkey", F.lit(" x\n"), lines).alias("value")), "genome")
    return readers.genome_tiles(spark, path, 16, 8, 50_000).select("chrom", "first", "bases")


# Tables of the steps


@query("select cast(sum(abundance) as bigint) depth from aln")
def file_read_summary(spark, d):
    both = writers.read_summary(depth(spark, d), annotate.class_counts(annotated(spark, d), depth(spark, d)))
    return readers.library_depth(spark, put_tsv(spark, both.coalesce(1), "summary", header=False))


COUNTS = "select anno_name, 1 mod_type, chrom, strand, cast(p_from as bigint) pos_from, cast(p_to as bigint) pos_to, ref, alt, n from mods"


def long_again(spark: SparkSession, table: DataFrame) -> DataFrame:
    return readers.long_counts(readers.summary(spark, put_tsv(spark, table, "anno_summary")))


@query(COUNTS)
def file_annotation_summary(spark, d):
    return long_again(spark, writers.annotation_summary(summary.annotation_summary(stored_profiled(spark, d), depth(spark, d))))


@query(COUNTS + """ m where not exists (select 1 from snp s join (values (0), (1)) t(i) on i < length(m.alt)
    where s.chrom = m.chrom and s.pos = case when m.strand = '-' then m.p_from - i else m.p_from + i end
      and s.ref = case when m.strand = '-' then translate(substr(m.ref, i + 1, 1), 'ACGT', 'TGCA') else substr(m.ref, i + 1, 1) end
      and s.alt = case when m.strand = '-' then translate(substr(m.alt, i + 1, 1), 'ACGT', 'TGCA') else substr(m.alt, i + 1, 1) end)""")
def file_without_snps(spark, d):
    r = stored_profiled(spark, d)
    counts = table(summary.modification_counts(r), "modifications")
    made = summary.annotation_summary(r, depth(spark, d), counts=counts)
    return long_again(spark, writers.filtered_summary(made, variants.without_snps(counts, bridge(spark, d, "snp"))))


@query("select read_id, anno_name, consensus from judged")
def file_results(spark, d):
    path = put_tsv(spark, writers.annotated_reads(judged(spark, d)), "results")
    return readers.annotated_reads(spark, path).select("read_id", "anno_name", "consensus")


@query(CANONICAL + """select anno_name "annotation_ID", cast(total as varchar) total_read_count, cast(best as varchar) canonical_end_count, cast(kinds as varchar) number_end_positions,
       (select concat(a.chrom, ':', a.strand, ':', p.pos) from ann a where a.anno_name = p.anno_name limit 1) canonical_end_position,
       case when best / total >= 0.5 then 'KEEP' else 'REMOVE' end decision from pick p""")
def file_canonical_summary(spark, d):
    path = put_tsv(spark, writers.canonical_summary(ends.canonical_summary(annotated(spark, d), depth(spark, d))), "ends")
    return spark.read.csv(path, sep="\t", header=True).select("annotation_ID", "total_read_count", "canonical_end_count", "number_end_positions", "canonical_end_position", "decision")


def placed_counts(spark: SparkSession, d: str) -> DataFrame:
    """The cohort's counts at made-up places: one chromosome, its + strand."""
    return sample_counts(spark, d).select("grp", "sample", F.col("aid").cast("string").alias("anno_name"), "mod_type", F.lit("chr1").alias("chrom"), F.lit("+").alias("strand"), F.col("pos").alias("pos_from"), F.col("pos").alias("pos_to"), "ref", "alt", "n")


@query("""select concat('chr1:+:', pos, ':', ref, '>', alt) modification, cast(count(distinct sample) as varchar) sample_count, cast(t.total as varchar) total_num_samples_tested, cast(s.grp as varchar) group_label
from smod s join (select grp, count(distinct sample) total from smod group by grp) t on t.grp = s.grp where cnt >= 2 group by s.grp, mod_type, pos, ref, alt, t.total""")
def file_support(spark, d):
    path = put_tsv(spark, writers.support_table(cohort.support(placed_counts(spark, d), ["mod_type", *summary.KEY])), "support")
    return spark.read.csv(path, sep="\t", header=True)


def _as_text(sql: str) -> str:
    return f"select columns(*)::varchar from ({sql}) w"


@query(_as_text(_wide(S.kmers(), "translate(alt, 'T', 'U')", 1)))
def file_kmer_table(spark, d):
    m = profiles.kmer_matrix(sample_counts(spark, d).where("mod_type = 1"), ["grp", "sample", "aid"])
    return spark.read.csv(put_tsv(spark, writers.kmer_table(m, ["grp", "sample", "aid"]), "kmers"), sep="\t", header=True)


@query(_as_text(_wide(S.substitutions(), "concat(translate(ref, 'T', 'U'), '>', translate(alt, 'T', 'U'))", 2)))
def file_substitution_table(spark, d):
    m = profiles.substitution_matrix(sample_counts(spark, d).where("mod_type = 2"), ["grp", "sample", "aid"])
    return spark.read.csv(put_tsv(spark, writers.substitution_table(m, ["grp", "sample", "aid"]), "substitutions"), sep="\t", header=True)
