"""The whole analysis as one lazy object; ``sample`` and ``grp`` are columns, so all samples are one job.

Alignments, and the reads that are left after all filters, are used by several results: they are written once to the
shared folder, when first asked for, and read from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwright.operators import align, annotate, cohort, ends, hits, intervals, phred, profiles, reads, summary, variants
from tailwright.operators.summary import KEY
from tailwright.plans.store import table


@dataclass
class Settings:
    """Limits of the steps; the values are the usual ones."""

    species: str = "mirna"
    level: int = 1
    share: float = ends.SHARE
    least_percent: int = 100
    most_percent: int = 100
    quality: int = 30
    reads: int = cohort.READS
    samples: int = cohort.SAMPLES
    compat: bool = False
    snp_rule: str = "any"

    def __post_init__(self) -> None:
        checks = {
            "level is 1, 2 or 3": self.level in (1, 2, 3),
            "share is 0 to 1": 0 <= self.share <= 1,
            "percentages are 0 to 100, the least first": 0 <= self.least_percent <= self.most_percent <= 100,
            "a quality limit is 0 to 42": 0 <= self.quality <= 42,
            "reads and samples are at least 1": self.reads >= 1 and self.samples >= 1,
            "a variant rule is 'any' or 'end'": self.snp_rule in ("any", "end"),
        }
        for text, ok in checks.items():
            if not ok:
                raise ValueError(text)


@dataclass
class Pipeline:
    """Steps of one sample from alignments on; inputs that are None leave their step out."""

    alignments: DataFrame
    annotations: DataFrame
    priority: DataFrame
    repeats: DataFrame | None = None
    hits: DataFrame | None = None
    snps: DataFrame | None = None
    fastq: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    @classmethod
    def from_reads(cls, collapsed: DataFrame, genome: DataFrame, annotations: DataFrame, priority: DataFrame, limits: dict | None = None, **more) -> Pipeline:
        """Aligns ``collapsed(read_id, abundance, seq)`` first, to ``genome``: pieces (chrom, offset, seq) or the tiles of
        readers.genome_tiles(); ``limits`` are those of trim_cascade()."""
        tiled = genome if "bases" in genome.columns else align.tiles(genome)
        return cls(table(align.resolve_ends(align.trim_cascade(collapsed, tiled, **(limits or {})), tiled), "alignments"), annotations, priority, **more)

    @cached_property
    def depth(self) -> DataFrame:
        return reads.library_depth(self.alignments)

    @cached_property
    def annotated(self) -> DataFrame:
        s = self.settings
        out = annotate.with_profiles(annotate.annotate(self.alignments.select(*annotate.ALIGNMENT), self.annotations, self.priority, s.compat), s.compat)
        return intervals.without_repeats(out, self.repeats, s.compat) if self.repeats is not None else out

    @cached_property
    def judged(self) -> DataFrame:
        """Reads of the class with the second aligner's verdict; stored if more than the first level asks for them."""
        s = self.settings
        out = hits.concordance(self.annotated, self.hits, s.species, s.compat)
        return table(out, "judged") if s.level > 1 else out

    @cached_property
    def stringent(self) -> DataFrame:
        s = self.settings
        if self.hits is None:
            return self.annotated
        return hits.stringency(self.judged, s.level, s.compat)

    @cached_property
    def canonical(self) -> DataFrame:
        return table(ends.canonical_reads(self.stringent, self.settings.share, compat=self.settings.compat), "canonical")

    @cached_property
    def summary(self) -> DataFrame:
        return summary.annotation_summary(self.canonical, self.depth)

    @cached_property
    def counted(self) -> DataFrame:
        """The modification counts."""
        return summary.modification_counts(self.canonical)

    @cached_property
    def without_snps(self) -> DataFrame:
        """Without known variants, or (``snp_rule`` "end") cut at them; ``compat`` keeps the first annotation's of each
        chromosome, in the order of the annotations' files."""
        if self.snps is None:
            return self.counted
        snps = variants.within_reach(self.snps, self.counted)
        if self.settings.snp_rule == "end":
            return variants.cut_at_snps(self.counted, snps)
        if not self.settings.compat:
            return variants.without_snps(self.counted, snps)
        order = self.canonical.groupBy("anno_name").agg(F.min("aid").alias("aid"))
        return variants.without_snps(self.counted.join(order, "anno_name"), snps, compat_order="aid").select(*self.counted.columns)

    @cached_property
    def without_zygous(self) -> DataFrame:
        totals = self.canonical.groupBy("anno_name").agg(F.sum("abundance").alias("total_reads"))
        return variants.without_zygous(self.without_snps, totals, self.settings.least_percent, self.settings.most_percent)

    @cached_property
    def modifications(self) -> DataFrame:
        """What is left of the modification counts after known variants, zygosity and base quality."""
        s = self.settings
        return phred.recount(self.canonical, self.without_zygous, self.fastq, s.quality, compat=s.compat) if self.fastq is not None else self.without_zygous

    @cached_property
    def filtered_summary(self) -> DataFrame:
        """The summary with what is left of its modifications."""
        return summary.with_modifications(self.summary, self.modifications)


def cohort_profiles(counts: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """From ``counts(grp, sample, anno_name, mod_type, key..., n)`` of all samples, one frame: support, credible counts,
    and the wide tables of the latter.  The plan is the same for any number of samples."""
    s = settings or Settings()
    key = ["mod_type", *KEY]
    good = cohort.credible_counts(counts, key, s.reads, s.samples, s.compat)
    rows = ["grp", "sample", "anno_name"]
    wide = lambda kind: profiles.kmer_matrix(good.where(F.col("mod_type") == kind), rows)
    return {
        "support": cohort.support(counts, key, s.reads, s.compat),
        "credible": good,
        "nte5": wide(summary.NTE5),
        "nte3": wide(summary.NTE3),
        "internal": wide(summary.INTERNAL),
        "substitutions": profiles.substitution_matrix(good.where(F.col("mod_type") == summary.INTERNAL), rows),
    }
