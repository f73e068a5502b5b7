"""Counting modifications again from raw reads whose modified bases are of good quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwright.functions.modifications import base_indexes
from tailwright.functions.sequence import rna_orientation
from tailwright.operators.summary import KEY, read_modifications

LOWEST, HIGHEST = 33, 126


#: Bases of a mask's word, so that it is never negative.
BITS = 62


def good_mask(quality: Column, least: int) -> Column:
    """A text with 1 for each base of at least that quality (phred+33), else 0."""
    if not 0 <= least <= 42:
        raise ValueError("a quality limit is 0 to 42")
    signs = [chr(c) for c in range(LOWEST, HIGHEST + 1)]
    return F.translate(quality, "".join(signs), "".join("01"[ord(c) - 33 >= least] for c in signs))


def good_words(quality: Column, least: int) -> Column:
    """The same as words of bits, the first base highest: one long for up to BITS bases, as nearly all reads have."""
    mask = good_mask(quality, least)
    word = lambda k: F.conv(F.rpad(F.substring(mask, k * BITS + 1, F.lit(BITS)), F.lit(BITS), F.lit("0")), 2, 10).cast("long")
    one = F.array(word(F.lit(0)))
    return F.when(F.length(mask) <= BITS, one).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(mask) - 1) / BITS).cast("int")), word))


def needed_words(indexes: Column) -> Column:
    """The words of bits of the bases with these 0-based indexes, as many as the last of them needs."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(BITS - 1) - i % BITS).cast("int"))
    of = lambda k: F.aggregate(F.filter(indexes, lambda i: F.floor(i / BITS) == k), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i)))
    return F.transform(F.sequence(F.lit(0), F.floor(F.array_max(indexes) / BITS).cast("int")), of)


def all_good(words: Column, needed: Column) -> Column:
    """Whether a mask has all the bits that are needed; a mask of a shorter read lacks them."""
    first = words[0].bitwiseAND(needed[0]) == needed[0]
    more = F.forall(F.sequence(F.lit(1), F.size(needed) - 1), lambda k: F.coalesce(F.get(words, k).bitwiseAND(needed[k]) == needed[k], F.lit(False)))
    return F.when(F.size(needed) == 1, first).otherwise(first & more)


def recount(reads: DataFrame, modifications: DataFrame, fastq: DataFrame, least: int = 30, by: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """(by..., anno_name, mod_type, key..., n): raw reads in which every base of the modification is good.

    ``reads`` carry profiles, ``fastq(by..., seq, qual)`` is in RNA orientation.  Raw reads are first counted by
    sequence and quality mask, map-side, so the commonest sequence is a few rows however deep the library is; masks
    and what modifications need are bits, tested by one AND in the join.
    ``compat``: a modification listed by several annotations is counted once for each.
    """
    place = [*by, "mod_type", *KEY]
    wanted = modifications.select(*place) if compat else modifications.select(*place).distinct()
    own = read_modifications(reads).withColumn("rna", rna_orientation("seq", "strand")).withColumn("needed", needed_words(base_indexes("strand", "read_start", "read_end", "pos_from", "pos_to")))
    own = own.select(*by, "anno_name", "mod_type", *KEY, "rna", "needed", "read_id")
    own = own.join(wanted, place) if compat else own.join(wanted, place, "left_semi")
    masks = fastq.select(*by, F.col("seq").alias("rna"), good_words(F.col("qual"), least).alias("mask")).groupBy(*by, "rna", "mask").agg(F.count("*").alias("raw"))
    return own.join(masks, [*by, "rna"]).where(all_good(F.col("mask"), F.col("needed"))).groupBy(*by, "anno_name", "mod_type", *KEY).agg(F.sum("raw").alias("n"))
