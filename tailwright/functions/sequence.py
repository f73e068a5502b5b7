"""Column functions on sequences, mismatch strings and read ids.  All stay in generated JVM code."""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "AUGC"  # order of the profile columns: a fixed value


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: Column | str) -> Column:
    """Complement in upper case; letters outside ACGTN give null."""
    up = F.upper(col(seq))
    return F.when(up.rlike("^[ACGTN]*$"), F.translate(up, "ACGT", "TGCA"))


def reverse_complement(seq: Column | str) -> Column:
    """Reverse complement in upper case; letters outside ACGTN give null."""
    return F.reverse(complement(seq))


def rna_orientation(seq: Column | str, strand: Column | str) -> Column:
    """A + strand sequence as the RNA reads."""
    return F.when(col(strand) == "-", reverse_complement(seq)).otherwise(F.upper(col(seq)))


def to_rna(seq: Column | str) -> Column:
    return F.translate(col(seq), "T", "U")


def tag_value(tag: Column | str) -> Column:
    """The value of an alignment tag such as ``MD:Z:22`` or ``NM:i:1``; a bare value is itself."""
    t = col(tag)
    return F.when(t.contains(":"), F.split_part(t, F.lit(":"), F.lit(3))).otherwise(t)


def md_lengths(md: Column | str) -> Column:
    """Lengths of the matching runs, one more than there are mismatches."""
    return F.transform(F.split(tag_value(md), "[ACGTN]"), lambda x: x.cast("int"))


def md_refs(md: Column | str) -> Column:
    """The reference letters of the mismatches, + strand, as one string."""
    return F.regexp_replace(tag_value(md), "[^A-Za-z]", "")


def md_mismatches(md: Column | str) -> Column:
    """array<struct<offset int, ref string>>: mismatches by 0-based offset from the left end of the alignment."""
    lengths, refs = md_lengths(md), md_refs(md)

    def of(v: Column) -> Column:
        total = lambda k: F.aggregate(F.slice(v["lengths"], 1, k + 1), F.lit(0), lambda a, x: a + x)
        return F.transform(F.sequence(F.lit(0), F.length(v["refs"]) - 1), lambda k: F.struct((total(k) + k).cast("int").alias("offset"), F.substring(v["refs"], k + 1, F.lit(1)).alias("ref")))

    # both are named once, or the text would be split again for every mismatch
    at = F.transform(F.array(F.struct(lengths.alias("lengths"), refs.alias("refs"))), of)[0]
    return F.when(F.length(refs) > 0, at).otherwise(F.array().cast("array<struct<offset:int,ref:string>>"))


def md_render(mismatches: Column, length: Column) -> Column:
    """The mismatch string of an array as md_mismatches() gives, for an alignment of ``length`` bases."""
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda s, m: F.struct(F.concat(s["text"], (m["offset"] - s["at"]).cast("string"), m["ref"]).alias("text"), (m["offset"] + 1).alias("at"))
    return F.aggregate(mismatches, state, step, lambda s: F.concat(s["text"], (length - s["at"]).cast("string")))


def abundance(read_id: Column | str) -> Column:
    """Copies of a collapsed read ``id|copies``; 1 without that part."""
    return F.coalesce(F.try_to_number(F.nullif(F.split_part(col(read_id), F.lit("|"), F.lit(2)), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(1).cast("long"))


def trim(seq: Column | str, five: int = 0, three: int = 0) -> Column:
    """Without ``five`` first and ``three`` last bases; empty if nothing is left."""
    s = col(seq)
    return F.substring(s, F.lit(five + 1), F.greatest(F.length(s) - five - three, F.lit(0)))


def phred(quality: Column, index: Column, offset: int = 33) -> Column:
    """Base quality at a 0-based index."""
    return F.ascii(F.substring(quality, index + 1, F.lit(1))) - offset


def alternative(change: Column | str) -> Column:
    """The part after ``>``."""
    return F.split_part(col(change), F.lit(">"), F.lit(2))


def bin_of(position: Column | str, width: int = 1000) -> Column:
    return F.floor(col(position) / width)


def kmers(longest: int = 3, bases: str = BASES) -> list[str]:
    """All strings of 1 to ``longest`` bases, shorter ones first, each length in the order of ``bases``."""
    return ["".join(p) for n in range(1, longest + 1) for p in product(bases, repeat=n)]


def substitutions(bases: str = BASES) -> list[str]:
    """All ordered pairs of different bases, as ``A>U``."""
    return [f"{a}>{b}" for a, b in permutations(bases, 2)]
