"""Assigning one annotation to each alignment, and what is counted from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwright.functions import modifications as M
from tailwright.functions.sequence import bin_of
from tailwright.operators.intervals import containing_pairs

#: Slack in bases at either end, and the length above which an annotation need only contain the read.
SLACK, LONG = 3, 50
#: Bins of the older tools, whose edges show in the compat form.
BIN = 1000
#: Rank of classes that no list names.
UNLISTED = 2**31 - 1
ALIGNMENT = ["read_id", "abundance", "chrom", "strand", "read_start", "read_end", "nte5", "nte3", "nm", "md", "seq"]


def fits(start: Column, end: Column, anno_start: Column, anno_end: Column) -> Column:
    """Long annotations contain the read, short ones end where it does; both within the slack."""
    within = (start >= anno_start - SLACK) & (end <= anno_end + SLACK)
    same = (F.abs(start - anno_start) <= SLACK) & (F.abs(end - anno_end) <= SLACK)
    return F.when(anno_end - anno_start + 1 > LONG, within).otherwise(same)


def candidates(alignments: DataFrame, annotations: DataFrame, compat: bool = False) -> DataFrame:
    """All (alignment, annotation) pairs that fit.

    A fitting annotation covers the read's start up to the slack, so that place is looked up among annotations by
    hierarchical bins; an annotation is two rows at most, however long it is, and no pair appears twice.
    ``compat``: an annotation must also touch the bin in which the alignment starts without the slack.
    """
    b = annotations.withColumnsRenamed({"chrom": "b_chrom", "strand": "b_strand"}).withColumns({"b_low": F.col("anno_start") - SLACK, "b_high": F.col("anno_end") + SLACK})
    hit = fits(F.col("read_start"), F.col("read_end"), F.col("anno_start"), F.col("anno_end"))
    if compat:
        hit &= bin_of("read_start", BIN).between(bin_of("anno_start", BIN), bin_of("anno_end", BIN))
    return containing_pairs(alignments, b, F.col("read_start"), ("chrom", "strand"), hit).drop("b_chrom", "b_strand", "b_low", "b_high")


def annotate(alignments: DataFrame, annotations: DataFrame, priority: DataFrame, compat: bool = False) -> DataFrame:
    """Alignments with one annotation each: that of the best class rank, then of the first place in the file.

    One row for each alignment that fits any annotation, equal ones included.
    ``annotations(chrom, strand, anno_start, anno_end, anno_name, aid, species)`` with ``aid`` the file order;
    ``priority(species, rnk)``; classes not listed come last.  Picking is a rank by (rank, order) within an alignment's own
    few pairs: one sort, where an aggregate of structs would sort as well, for each of its halves; ties are equal alignments
    and stay.  ``compat``: the rank of the first hit is kept for all comparisons, so the last hit with a better rank than
    the first wins.
    """
    keys, place = alignments.columns, ["rnk", "aid", "anno_name", "anno_start", "anno_end", "species"]
    ranked = annotations.join(priority, "species", "left").withColumn("rnk", F.coalesce("rnk", F.lit(UNLISTED)))
    pairs = candidates(alignments, ranked, compat).repartition("read_id", "chrom", "read_start")
    if not compat:
        best = pairs.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(*place))).where("_rank = 1")
        return best.select(*keys, "anno_name", "anno_start", "anno_end", "species", "aid")
    # in the same shuffle: how often each pair comes up, which is how many equal alignments there are, then the best
    each = pairs.groupBy(*keys, *place).agg(F.count("*").cast("int").alias("_times"))
    byfile = F.struct("aid", "rnk", "anno_name", "anno_start", "anno_end", "species", "_times")
    best = each.groupBy(*keys).agg(F.array_sort(F.collect_list(byfile)).alias("all")).withColumn("better", F.filter("all", lambda x: x["rnk"] < F.col("all")[0]["rnk"]))  # an alignment's own few annotations
    best = best.withColumn("a", F.when(F.size("better") > 0, F.element_at("better", -1)).otherwise(F.col("all")[0])).drop("all", "better")
    again = F.explode(F.array_repeat(F.lit(0), F.col("a._times")))
    return best.withColumn("_time", again).select(*keys, "a.anno_name", "a.anno_start", "a.anno_end", "a.species", "a.aid")


def with_profiles(annotated: DataFrame, compat: bool = False) -> DataFrame:
    """Adds ``site5``, ``site3`` (null if none) and ``sites`` (internal mismatches)."""
    return annotated.withColumns(
        {
            "site5": M.nte5_site("strand", "read_start", "read_end", "nte5", "md", compat),
            "site3": M.nte3_site("strand", "read_start", "read_end", "nte3", "md"),
            "sites": M.internal_sites("strand", "read_start", "seq", "md", "nte5", "nte3", compat),
        }
    )


def class_counts(annotated: DataFrame, depth: DataFrame) -> DataFrame:
    """(species, reads, rpm) for each class with reads; ``depth`` is the one-row library depth."""
    return annotated.groupBy("species").agg(F.sum("abundance").alias("reads")).crossJoin(F.broadcast(depth)).select("species", "reads", F.round(F.col("reads").cast("double") * 1e6 / F.col("depth").cast("double"), 2).alias("rpm"))


def listed_class_counts(annotated: DataFrame, priority: DataFrame, depth: DataFrame) -> DataFrame:
    """The same for every listed class, zero where it has no read."""
    counts = class_counts(annotated, depth)
    return priority.join(counts, "species", "left").select("species", F.coalesce("reads", F.lit(0)).alias("reads"), F.coalesce("rpm", F.lit(0.0)).alias("rpm"))


def annotation_counts(annotated: DataFrame, annotations: DataFrame, depth: DataFrame) -> DataFrame:
    """(anno_name, species, reads, rpm) for every annotation, zero where it has no read, most read first."""
    weight = F.col("abundance") / F.col("loci") if "loci" in annotated.columns else F.col("abundance").cast("double")
    counts = annotated.groupBy("aid").agg(F.sum(weight).alias("reads"))
    every = annotations.join(counts, "aid", "left").crossJoin(F.broadcast(depth))  # one row
    out = every.select("anno_name", "species", F.coalesce("reads", F.lit(0.0)).alias("reads"), F.round(F.coalesce("reads", F.lit(0.0)) * 1e6 / F.col("depth").cast("double"), 2).alias("rpm"))
    return out.orderBy(F.desc("reads"), "anno_name")
