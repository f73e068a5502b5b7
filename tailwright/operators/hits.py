"""Second-aligner hits: the best ones, agreement with the first aligner, and filters by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwright.functions import modifications as M

#: The verdict that filters keep; it and the other verdicts below are fixed values.
CORRECT = "CORRECT"


def best_hits(hits: DataFrame) -> DataFrame:
    """All hits of each query with its best score, ties kept.

    The score is matches less mismatches and insertions; matches in repeats don't count.  The best score is an
    aggregate joined back, combined map-side, so a query with very many hits is not one task's window.
    """
    scored = hits.withColumn("score", F.col("matches") - F.col("mismatches") - F.col("q_num_insert") - F.col("t_num_insert"))
    best = scored.groupBy("q_name").agg(F.max("score").alias("score"))
    return scored.join(best, ["q_name", "score"], "left_semi")


def extended(hits: DataFrame) -> DataFrame:
    """Adds the 1-based span that the whole query would cover."""
    return hits.withColumns({"full_start": F.col("t_start") - F.col("q_start") + 1, "full_end": F.col("t_end") + F.col("q_size") - F.col("q_end")})


def block_offsets(hits: DataFrame) -> DataFrame:
    """Adds the starts of the target blocks counted from the hit's own start."""
    return hits.withColumn("block_offsets", F.transform("t_starts", lambda x: x - F.col("t_start")))


def concordance(annotated: DataFrame, hits: DataFrame, species: str = "mirna", compat: bool = False) -> DataFrame:
    """Reads of one class with ``consensus`` and, where the only hit lies elsewhere, ``alt_locus``.

    ``hits(read_id, chrom, strand, full_start, full_end)`` are the best hits.  A hit agrees if chromosome and span
    are the read's and it lies on +, as the query was the + strand sequence.  ``compat``: only the first hit (least
    ``ordinal``) can agree.  Agreement is summed for each read by an aggregate; hits are not gathered.
    """
    reads = annotated.where(F.col("species") == species)
    keys = ["read_id", "chrom", "read_start", "read_end"]
    h = hits.select("read_id", F.col("chrom").alias("h_chrom"), F.col("strand").alias("h_strand"), "full_start", "full_end", F.col("ordinal") if compat else F.lit(0).alias("ordinal"))
    agrees = (F.col("h_chrom") == F.col("chrom")) & (F.col("h_strand") == "+") & (F.col("full_start") == F.col("read_start")) & (F.col("full_end") == F.col("read_end"))
    place = F.struct("ordinal", "h_chrom", "h_strand", "full_start", "full_end")
    state = (
        reads.select(*keys)
        .distinct()
        .join(h, "read_id")
        .groupBy(*keys)
        .agg(F.count("*").alias("hits"), (F.min(F.struct("ordinal", (~agrees).alias("not"))).getField("not") == F.lit(False) if compat else F.max(agrees.cast("int")) == 1).alias("same"), F.min(place).alias("one"))
    )
    many = F.col("hits") > 1
    verdict = F.when(F.col("hits").isNull(), "NO_BLAT_RESULT").when(F.col("same") & many, "SAME-MULTIMAPP").when(F.col("same"), CORRECT).when(many, "DIFF-MULTIMAPP").otherwise("DIFF-UNIQ")
    alt = F.when(F.col("consensus") == "DIFF-UNIQ", F.concat_ws(":", "one.h_chrom", "one.h_strand", F.concat_ws("-", "one.full_start", "one.full_end")))
    return reads.join(state, keys, "left").withColumn("consensus", verdict).withColumn("alt_locus", alt).drop("hits", "same", "one")


#: Rows of the summary and the verdicts they count: fixed values.
RESULTS = [("Correct", "uniq", CORRECT), ("Correct", "multimapped", "SAME-MULTIMAPP"), ("Different", "multimapped", "DIFF-MULTIMAPP"), ("Different", "uniq", "DIFF-UNIQ"), ("None", "None", "NO_BLAT_RESULT")]


def concordance_summary(judged: DataFrame) -> DataFrame:
    """Five rows: sequences and reads of each verdict, and as a share of those with one mismatch (null if none)."""
    one = F.col("nm") == 1
    totals = [F.sum(F.when(~one, 1).otherwise(0)).alias("perfect_sequences"), F.sum(F.when(~one, F.col("abundance")).otherwise(0)).alias("perfect_reads"), F.sum(F.when(one, 1).otherwise(0)).alias("mismatch_sequences"), F.sum(F.when(one, F.col("abundance")).otherwise(0)).alias("mismatch_reads")]
    per = [x for k, (_, _, v) in enumerate(RESULTS) for x in (F.sum(F.when(F.col("consensus") == v, 1).otherwise(0)).alias(f"s{k}"), F.sum(F.when(F.col("consensus") == v, F.col("abundance")).otherwise(0)).alias(f"r{k}"))]
    row = judged.agg(*totals, *per)
    each = F.array(*[F.struct(F.lit(a).alias("result"), F.lit(b).alias("mapping"), F.col(f"s{k}").alias("sequences"), F.col(f"r{k}").alias("reads")) for k, (a, b, _) in enumerate(RESULTS)])
    share = lambda x, y: F.round(F.try_divide(F.col(x).cast("double") * 100, F.col(y).cast("double")), 2)
    flat = row.select(F.explode(each).alias("x"), "perfect_sequences", "perfect_reads", "mismatch_sequences", "mismatch_reads").select("x.*", "perfect_sequences", "perfect_reads", "mismatch_sequences", "mismatch_reads")
    return flat.withColumns({"sequences_percent": share("sequences", "mismatch_sequences"), "reads_percent": share("reads", "mismatch_reads")})


def stringency(judged: DataFrame, level: int = 1, compat: bool = False) -> DataFrame:
    """Reads on which both aligners agree, by level.

    1: just those.  2: their modifications that also appear in disagreeing reads with a mismatch become none.  3: as 2,
    and annotations that have a disagreeing perfect read are dropped.  ``judged`` carries site5, site3 and sites.  ``compat``: internal mismatches are read from the mismatch string
    again, so that a base taken from an end modification turns up as one of them.
    """
    if level not in (1, 2, 3):
        raise ValueError("level is 1, 2 or 3")
    kept = judged.where(F.col("consensus") == CORRECT)
    if level == 1:
        return kept
    wrong = judged.where(F.col("consensus") != CORRECT)
    if level == 3:
        kept = kept.join(wrong.where("nm = 0").select("anno_name").distinct(), "anno_name", "left_anti")
    key = lambda s: F.when(s.isNotNull(), F.struct(F.col("chrom"), F.col("strand"), s["pos_from"], s["pos_to"], s["ref"], s["alt"]).cast("struct<c:string,s:string,f:bigint,t:bigint,r:string,a:string>"))
    sites = lambda: F.filter(F.concat(F.array(key(F.col("site5")), key(F.col("site3"))), F.transform("sites", key)), lambda x: x.isNotNull())
    bad = wrong.where("nm <> 0").select(F.explode(sites()).alias("k")).distinct()
    per = kept.select("read_id", "anno_name", "read_start", F.explode(sites()).alias("k")).join(bad, "k", "left_semi").groupBy("read_id", "anno_name", "read_start").agg(F.collect_set("k").alias("removed"))  # a read's own few sites
    out = kept.join(per, ["read_id", "anno_name", "read_start"], "left")
    gone = lambda s: F.coalesce(F.array_contains("removed", key(s)), F.lit(False))
    gone5, gone3 = gone(F.col("site5")), gone(F.col("site3"))
    any_ = F.exists("sites", gone)
    out = out.select(
        *[c for c in kept.columns if c not in ("nte5", "nte3", "site5", "site3", "sites")],
        F.when(~gone5, F.col("nte5")).alias("nte5"),
        F.when(~gone3, F.col("nte3")).alias("nte3"),
        F.when(~gone5, F.col("site5")).alias("site5"),
        F.when(~gone3, F.col("site3")).alias("site3"),
        F.when(any_, F.array().cast(f"array<{M.SITE}>")).otherwise(F.col("sites")).alias("sites"),
    )
    return out.withColumn("sites", M.internal_sites("strand", "read_start", "seq", "md", "nte5", "nte3", compat)) if compat else out
