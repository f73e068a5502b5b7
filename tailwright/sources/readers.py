"""Readers: text formats as DataFrames with declared schemas.  Gzip is read as it is; every path may be a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.functions import modifications as M
from tailwright.functions.sequence import abundance, md_render, tag_value
from tailwright.operators.align import MARGIN, TILE, options
from tailwright.sources import bam as _bam
from tailwright.sources import fastq as _fastq
from tailwright.sources import genome as _genome

Paths = str | list[str]


def _lines(spark: SparkSession, path: Paths, skip: str | None = None) -> DataFrame:
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.where(~F.col("value").rlike(skip)) if skip else rows


def _fields(spark: SparkSession, path: Paths, names: dict[int, tuple[str, str]], skip: str | None = None, by: str = r"\s+") -> DataFrame:
    """Fields by 0-based place: {place: (name, type)}; a missing field is null, and one that isn't of its type an error.
    Quotes and backslashes mean nothing."""
    parts = F.split(F.trim("value"), by)
    field = lambda k: F.try_element_at(parts, F.lit(k + 1))
    picked = [field(k).cast(kind).alias(name) for k, (name, kind) in names.items()]
    return _lines(spark, path, skip).select(*picked)


def fasta(spark: SparkSession, path: Paths) -> DataFrame:
    """(read_id, abundance, seq) of records ``>id|copies`` and a sequence, which may run over several lines."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    name = F.trim(lines[0])
    return rows.select(name.alias("read_id"), abundance(name).alias("abundance"), F.upper(F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), F.trim), "")).alias("seq"))


def fastq(spark: SparkSession, path: str, range_bytes: int = _fastq.RANGE) -> DataFrame:
    """(name, seq, qual)."""
    _fastq.register(spark)
    return spark.read.format("fastq").option("rangeBytes", str(range_bytes)).load(path)


def sniff(spark: SparkSession, path: Paths) -> str:
    """'fasta', 'fastq' or 'sam', by the first lines; raises for anything else.  One record is enough."""
    head = [r["value"] for r in spark.read.text(path).limit(4).collect()]
    bases = lambda s: bool(s) and set(s.strip().upper()) <= set("ACGTN")
    if len(head) > 1 and head[0].startswith(">") and bases(head[1]):
        return "fasta"
    if len(head) > 3 and head[0].startswith("@") and bases(head[1]) and head[2].startswith("+"):
        return "fastq"
    if head and (head[0].startswith("@") and head[0][1:3].isupper() and "\t" in head[0] or head[0].count("\t") >= 10):
        return "sam"
    raise ValueError(f"{path}: neither FASTA, FASTQ nor SAM")


def strand_of(flag: Column) -> Column:
    return F.when(flag.bitwiseAND(16) == 0, "+").otherwise("-")


def sam(spark: SparkSession, path: Paths) -> DataFrame:
    """Mapped alignments of a SAM file: header lines and unmapped reads (flag 4) are left out.

    Tags are found by name wherever they stand.  ``read_end`` follows from the sequence's length.
    """
    parts = F.split("value", "\t")
    tag = lambda name: tag_value(F.try_element_at(F.filter(parts, lambda x: x.startswith(name)), F.lit(1)))
    rows = _lines(spark, path, "^@").select(parts.alias("p"), tag("MD:Z:").alias("md"), tag("NM:i:").cast("int").alias("nm")).withColumn("flag", F.col("p")[1].cast("int")).where(F.col("flag").bitwiseAND(4) == 0)
    p = F.col("p")
    out = rows.select(p[0].alias("read_id"), abundance(p[0]).alias("abundance"), strand_of(F.col("flag")).alias("strand"), p[2].alias("chrom"), p[3].cast("long").alias("read_start"), p[9].alias("seq"), p[10].alias("qual"), "md", "nm")
    return out.withColumn("read_end", F.col("read_start") + F.length("seq") - 1)


def bam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, range_bytes: int = _bam.RANGE) -> DataFrame:
    """Mapped alignments of binary files, with the columns of sam(); with a ``region`` those that begin in it (chromosome,
    first and last place), of which a file with an index beside it reads little else."""
    _bam.register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    source = spark.read.format("bam").options(rangeBytes=str(range_bytes), pushed=pushed.lower())
    if region:
        source = source.options(chrom=region[0], start=str(region[1]), end=str(region[2]))
    rows = source.load(path).where(F.col("flag").bitwiseAND(4) == 0)
    return rows.select(F.col("name").alias("read_id"), abundance("name").alias("abundance"), strand_of(F.col("flag")).alias("strand"), "chrom", F.col("pos").alias("read_start"), "seq", "qual", "md", "nm", (F.col("pos") + F.length("seq") - 1).alias("read_end"))


#: Places of the fields in alignments with end modifications: fixed values.
NTE_SAM = {0: ("read_id", "string"), 1: ("flag", "int"), 2: ("chrom", "string"), 3: ("read_start", "long"), 6: ("trim_step", "string"), 7: ("nte5", "string"), 8: ("nte3", "string"), 9: ("seq", "string"), 12: ("md", "string"), 13: ("nm", "string")}


def nte_sam(spark: SparkSession, path: Paths) -> DataFrame:
    """Alignments with end modifications, as the aligner's writer leaves them."""
    rows = _fields(spark, path, NTE_SAM, r"^[@#]", "\t")
    return rows.select("read_id", abundance("read_id").alias("abundance"), "chrom", strand_of(F.col("flag")).alias("strand"), "read_start", (F.col("read_start") + F.length("seq") - 1).alias("read_end"), "seq", M.none_if_zero("nte5").alias("nte5"), M.none_if_zero("nte3").alias("nte3"), tag_value("nm").cast("int").alias("nm"), tag_value("md").alias("md"), "trim_step")


def native_alignments(spark: SparkSession, path: Paths) -> DataFrame:
    """The aligner's own table: id, strand, chromosome, 0-based place, sequence, ..., mismatches ``offset:ref>alt,...``.

    Mismatch offsets count from the read's 5' end; they come out as + strand offsets with a mismatch string.
    """
    rows = _fields(spark, path, {0: ("read_id", "string"), 1: ("strand", "string"), 2: ("chrom", "string"), 3: ("place", "long"), 4: ("seq", "string"), 7: ("found", "string")}, r"^[@#]", "\t")
    n = F.length("seq")
    each = F.filter(F.split(F.coalesce("found", F.lit("")), ","), lambda x: x != "")
    minus = F.col("strand") == "-"

    def one(x: Column) -> Column:
        at = F.split_part(x, F.lit(":"), F.lit(1)).cast("int")
        return F.struct(F.when(minus, n - 1 - at).otherwise(at).cast("int").alias("offset"), F.split_part(F.split_part(x, F.lit(":"), F.lit(2)), F.lit(">"), F.lit(1)).alias("ref"))

    rows = rows.withColumn("mismatches", F.array_sort(F.transform(each, one)))
    return rows.select("read_id", abundance("read_id").alias("abundance"), "chrom", "strand", (F.col("place") + 1).alias("read_start"), (F.col("place") + n).alias("read_end"), "seq", F.size("mismatches").alias("nm"), md_render(F.col("mismatches"), n).alias("md"))


def annotations(spark: SparkSession, path: Paths) -> DataFrame:
    """(chrom, strand, anno_start, anno_end, species, anno_name, aid) of tables with a header line.

    ``aid`` is the order in the files given, by file and then by line; it decides between equal ranks.
    """
    paths = [path] if isinstance(path, str) else path
    out = None
    for k, one in enumerate(paths):
        rows = _fields(spark, one, {0: ("chrom", "string"), 1: ("strand", "string"), 2: ("anno_start", "string"), 3: ("anno_end", "string"), 4: ("species", "string"), 5: ("anno_name", "string")}, r"^\s*#")
        rows = rows.withColumn("aid", F.monotonically_increasing_id() + F.lit(k).cast("long") * F.lit(1 << 50))
        number = lambda c: F.coalesce(F.col(c).rlike("^[0-9]+$"), F.lit(False))
        rows = rows.where(number("anno_start") | number("anno_end"))  # a header has no number there; a damaged line is an error
        rows = rows.withColumns({c: F.col(c).cast("long") for c in ("anno_start", "anno_end")})
        out = rows if out is None else out.unionByName(rows)
    return out


def manifest(spark: SparkSession, path: str) -> list[str]:
    """Paths listed in a file, one a line; ``#`` comments out."""
    return [r["value"].split()[0] for r in _lines(spark, path, r"^\s*#").collect()]


def aligner_options(spark: SparkSession, path: str) -> dict[str, int]:
    """``mismatches`` and ``most`` of the last line of a file of aligner commands; lines that begin with # are skipped."""
    lines = spark.read.text(path, wholetext=True).first().value.splitlines()
    used = [x for x in lines if x.strip() and not x.startswith("#")]
    if not used:
        raise ValueError("no command in the file")
    return options(used[-1])


def priority(spark: SparkSession, path: str) -> DataFrame:
    """(species, rnk) of a short list: one class a line, or rank and class; the order is the rank."""
    lines = [r["value"].split() for r in _lines(spark, path, r"^\s*#").coalesce(1).collect()]
    return spark.createDataFrame([(x[-1], k) for k, x in enumerate(lines)], "species string, rnk int")


#: Columns of annotated reads, in file order: fixed values.
OVERLAP = ["chrom", "strand", "read_start", "read_end", "read_id", "nte5", "nte3", "nm", "md", "seq", "anno_name", "anno_chrom", "anno_start", "anno_end", "species", "nte5_profile", "nte3_profile", "internal_profile", "internal", "consensus", "alt_locus"]
_LONGS = {"read_start", "read_end", "anno_start", "anno_end"}


def annotated_reads(spark: SparkSession, path: Paths) -> DataFrame:
    """Reads with annotations as text tables hold them (15 columns or more); profile texts stay texts."""
    rows = _fields(spark, path, {k: (n, "long" if n in _LONGS else "string") for k, n in enumerate(OVERLAP)}, r"^#", "\t")
    zero = [M.none_if_zero(n).alias(n) if n in ("nte5", "nte3", "nte5_profile", "nte3_profile", "internal_profile", "internal") else F.col(n) for n in OVERLAP if n not in ("nm", "md")]
    return rows.select(*zero, tag_value("nm").cast("int").alias("nm"), tag_value("md").alias("md"), abundance("read_id").alias("abundance"))


def annotated_sites(spark: SparkSession, path: Paths) -> DataFrame:
    """Annotated reads with their modifications as sites again: site5, site3 and sites, and the file's name in ``path``."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select("value", F.input_file_name().alias("path")).where((F.trim("value") != "") & ~F.col("value").rlike("^#"))
    field = lambda n: F.try_element_at(parts, F.lit(OVERLAP.index(n) + 1)).cast("long" if n in _LONGS else "string").alias(n)
    rows = rows.select("path", *[field(n) for n in OVERLAP[:18]])
    none = lambda c: M.none_if_zero(c)
    site = lambda c: M.parse_profile(none(c))
    each = F.filter(F.transform(F.split(F.coalesce(none("internal_profile"), F.lit("")), r"\|"), M.parse_profile), lambda x: x.isNotNull())
    found = rows.withColumns({"site5": site("nte5_profile"), "site3": site("nte3_profile"), "sites": each})
    own = {"nte5": none("nte5"), "nte3": none("nte3"), "nm": tag_value("nm").cast("int"), "md": tag_value("md")}
    return found.withColumns(own).drop("nte5_profile", "nte3_profile", "internal_profile", "anno_chrom").withColumn("abundance", abundance("read_id"))


#: The 21 columns of the PSL format, with types: fixed values.
PSL = ["matches:int", "mismatches:int", "rep_matches:int", "n_count:int", "q_num_insert:int", "q_base_insert:int", "t_num_insert:int", "t_base_insert:int", "strand:string", "q_name:string", "q_size:int", "q_start:int", "q_end:int", "t_name:string", "t_size:long", "t_start:long", "t_end:long", "block_count:int", "block_sizes:string", "q_starts:string", "t_starts:string"]


def psl(spark: SparkSession, path: Paths) -> DataFrame:
    """Hits of the second aligner; header lines are skipped and ``.fa`` is cut off target names.  ``ordinal`` is the order
    of lines in a file, files by name."""
    rows = _fields(spark, path, {k: tuple(x.split(":")) for k, x in enumerate(PSL)}, r"^psL|^\s*match|^----", "\t")
    rows = rows.withColumn("ordinal", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    numbers = lambda c, kind: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast(kind)).alias(c)
    out = rows.withColumn("t_name", F.regexp_replace("t_name", r"\.fa$", ""))
    return out.select(*[c for c in out.columns if c not in ("block_sizes", "q_starts", "t_starts")], numbers("block_sizes", "int"), numbers("q_starts", "int"), numbers("t_starts", "long"))


BED = {0: ("chrom", "string"), 1: ("start0", "long"), 2: ("end0", "long"), 3: ("name", "string"), 4: ("score", "string"), 5: ("strand", "string")}


def bed(spark: SparkSession, path: Paths) -> DataFrame:
    """Intervals, 0-based with the end excluded."""
    return _fields(spark, path, BED, r"^#|^track|^browser", "\t")


#: Places of the fields in the best-hit table: fixed values.
HITS = {0: ("chrom", "string"), 1: ("t_start", "long"), 2: ("t_end", "long"), 3: ("read_id", "string"), 4: ("q_size", "int"), 7: ("strand", "string"), 8: ("q_start", "int"), 9: ("q_end", "int")}


def best_hit_table(spark: SparkSession, path: Paths) -> DataFrame:
    """Best hits as their writer leaves them, with the input order for the compat form."""
    return _fields(spark, path, HITS, r"^#", "\t").withColumn("ordinal", F.monotonically_increasing_id())


def snps(spark: SparkSession, path: Paths) -> DataFrame:
    """(chrom, pos, ref, alt, source) of lines ``chrom pos ref>alt source``; one file per chromosome or one for all."""
    rows = _fields(spark, path, {0: ("chrom", "string"), 1: ("pos", "long"), 2: ("change", "string"), 3: ("source", "string")}, r"^#")
    return rows.select("chrom", "pos", F.split_part("change", F.lit(">"), F.lit(1)).alias("ref"), F.split_part("change", F.lit(">"), F.lit(2)).alias("alt"), "source")


def snp_table(spark: SparkSession, path: str) -> DataFrame:
    """The same from the folders that writers.snp_table() makes; a filter on ``chrom`` chooses folders."""
    kinds = "pos long, ref string, alt string, source string, chrom string"
    return spark.read.schema(kinds).parquet(path).select("chrom", "pos", "ref", "alt", "source")


#: Columns of the annotation summary, in file order: fixed values.
SUMMARY = ["anno_name", "species", "chrom", "strand", "anno_start", "anno_end", "anno_sequence", "total_reads", "perfect_reads", "mismatch_reads", "rpm", "total_nte5", "total_nte3", "total_internal", "nte5", "nte3", "internal"]
SUMMARY_HEADER = ["annotation_name", "species", "chromosome", "strand", "start", "end", "anno_sequence", "total_read_count", "perfect_match_count", "anno_mismatch_count", "RPM", "total_nte5_count", "total_nte3_count", "total_internal_count", "nte5", "nte3", "internal_mismatch"]
_SUMMARY_LONGS = {"anno_start", "anno_end", "total_reads", "perfect_reads", "mismatch_reads", "total_nte5", "total_nte3", "total_internal"}


def summary(spark: SparkSession, path: Paths) -> DataFrame:
    """Annotation summaries, with the file's name in ``path``; cells stay texts."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("path")).where((F.trim("value") != "") & ~F.col("value").rlike(r"^(#|anno)"))
    parts = F.split("value", "\t")
    return rows.select("path", *[F.try_element_at(parts, F.lit(k + 1)).cast("long" if n in _SUMMARY_LONGS else "double" if n == "rpm" else "string").alias(n) for k, n in enumerate(SUMMARY)])


def long_counts(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The modifications of summaries as rows: (by..., anno_name, mod_type, chrom, strand, pos_from, pos_to, ref, alt, n)."""
    cells = F.array(*[F.struct(F.lit(k).alias("mod_type"), M.parse_cells(c).alias("cells")) for k, c in enumerate(("nte5", "nte3", "internal"))])
    x = summaries.select(*by, "anno_name", "chrom", "strand", F.explode(cells).alias("x")).select(*by, "anno_name", "chrom", "strand", "x.mod_type", F.explode("x.cells").alias("c"))
    return x.select(*by, "anno_name", "mod_type", "chrom", "strand", "c.*")


def sample_manifest(spark: SparkSession, path: str, grp: str = "all") -> DataFrame:
    """(sample, grp, summary_path, overlap_path) of lines with two paths; the sample is the order."""
    lines = [r["value"].split() for r in _lines(spark, path, r"^\s*#").coalesce(1).collect()]
    return spark.createDataFrame([(k, grp, x[0], x[1] if len(x) > 1 else None) for k, x in enumerate(lines)], "sample int, grp string, summary_path string, overlap_path string")


def genome(spark: SparkSession, path: Paths) -> DataFrame:
    """(chrom, offset, seq) of a small FASTA genome, packed or not, one piece a chromosome; the aligner cuts it into tiles."""
    return fasta(spark, path).select(F.split("read_id", r"\s+")[0].alias("chrom"), F.lit(1).cast("long").alias("offset"), "seq")


def genome_tiles(spark: SparkSession, path: Paths, tile: int = TILE, margin: int = MARGIN, range_bytes: int = _genome.RANGE) -> DataFrame:
    """The tiles of a FASTA genome of any size, read in byte ranges: no row holds more than a tile and its margin."""
    return _genome.genome_tiles(spark, path, tile, margin, range_bytes)


def library_depth(spark: SparkSession, path: str) -> DataFrame:
    """(depth): the number in the first line of a read summary."""
    return spark.read.text(path).limit(1).select(F.regexp_extract("value", r"([0-9]+)\s*$", 1).cast("long").alias("depth"))
