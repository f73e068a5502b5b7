"""Column functions on modifications.

A modification site is struct<pos_from, pos_to, ref, alt>, in RNA orientation: ``pos_from`` is the base nearer to
the left of the RNA text on + and, on -, to the right of the genome; for one base both are equal.  Null means none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailwright.functions.sequence import col, md_lengths, md_mismatches, md_refs, reverse_complement

SITE = "struct<pos_from:bigint,pos_to:bigint,ref:string,alt:string>"


def none_if_zero(x: Column | str) -> Column:
    """'0' and the empty text, the marks of a missing value in text files, as null."""
    c = col(x)
    return F.when((c != "0") & (c != ""), c)


def zero_if_none(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("0"))


def size(nte: Column | str) -> Column:
    return F.coalesce(F.length(col(nte)), F.lit(0))


def resolved(ref: Column | str, alt: Column | str) -> Column:
    """``alt`` if it differs from ``ref`` at every base, else null: one match voids an end modification."""
    r, a = F.upper(col(ref)), F.upper(col(alt))
    differs = F.forall(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(r, i, F.lit(1)) != F.substring(a, i, F.lit(1)))
    return F.when((F.length(a) > 0) & (F.length(a) == F.length(r)) & differs, a)


def _site(pos_from: Column, pos_to: Column, ref: Column, alt: Column, present: Column) -> Column:
    return F.when(present, F.struct(pos_from.cast("long").alias("pos_from"), pos_to.cast("long").alias("pos_to"), ref.alias("ref"), alt.alias("alt")))


def nte3_site(strand: Column | str, start: Column | str, end: Column | str, nte3: Column | str, md: Column | str) -> Column:
    """Genomic place and reference of a 3' modification (the right end on +, the left end on -)."""
    s, a, b, n, refs = col(strand), col(start), col(end), col(nte3), md_refs(md)
    k = F.length(n)
    plus = _site(b - k + 1, b, F.right(refs, k), n, n.isNotNull())
    minus = _site(a + k - 1, a, reverse_complement(F.left(refs, k)), n, n.isNotNull())
    return F.when(s == "+", plus).otherwise(minus)


def nte5_site(strand: Column | str, start: Column | str, end: Column | str, nte5: Column | str, md: Column | str, compat: bool = False) -> Column:
    """Genomic place and reference of a 5' modification (the left end on +, the right end on -).

    ``compat``: on + the reference letters of several bases come in reverse.
    """
    s, a, b, n, refs = col(strand), col(start), col(end), col(nte5), md_refs(md)
    k = F.length(n)
    left = F.left(refs, k)
    plus = _site(a, a + k - 1, F.reverse(left) if compat else left, n, n.isNotNull())
    minus = _site(b, b - k + 1, reverse_complement(F.right(refs, k)), n, n.isNotNull())
    return F.when(s == "+", plus).otherwise(minus)


def internal_sites(strand: Column | str, start: Column | str, seq: Column | str, md: Column | str, nte5: Column | str, nte3: Column | str, compat: bool = False) -> Column:
    """Mismatches that belong to neither end modification, left to right; an empty array if there are none.

    ``compat``: a position counts only the matching run right before the mismatch, not the runs before that.
    """
    s, a, q = col(strand), col(start), F.upper(col(seq))
    n5, n3 = size(nte5), size(nte3)
    skip, drop = F.when(s == "+", n5).otherwise(n3), F.when(s == "+", n3).otherwise(n5)
    n = F.length(md_refs(md))
    inner = F.slice(md_mismatches(md), skip + 1, F.greatest(n - skip - drop, F.lit(0)))
    lengths = md_lengths(md)

    def site(m: Column, k: Column) -> Column:
        offset = F.element_at(lengths, (skip + k + 1).cast("int")) + skip if compat else m["offset"]
        letter = F.substring(q, offset + 1 + (k if compat else F.lit(0)), F.lit(1))
        at = (a + offset).cast("long")
        turned = lambda x: F.when(s == "-", F.translate(x, "ACGT", "TGCA")).otherwise(x)
        return F.struct(at.alias("pos_from"), at.alias("pos_to"), turned(m["ref"]).alias("ref"), turned(letter).alias("alt"))

    # most reads have none, and their mismatch string isn't taken apart
    return F.when(n > skip + drop, F.transform(inner, site)).otherwise(F.array().cast(f"array<{SITE}>"))


def position_text(site: Column) -> Column:
    """``pos`` or ``from-to``."""
    return F.when(site["pos_from"] == site["pos_to"], site["pos_from"].cast("string")).otherwise(F.concat_ws("-", site["pos_from"].cast("string"), site["pos_to"].cast("string")))


def change_text(site: Column) -> Column:
    """``pos[-pos2]:ref>alt``, the key within an annotation."""
    return F.when(site.isNotNull(), F.concat(position_text(site), F.lit(":"), site["ref"], F.lit(">"), site["alt"]))


def profile_text(chrom: Column | str, strand: Column | str, site: Column) -> Column:
    """``chrom:strand:pos[-pos2]:ref>alt``."""
    return F.when(site.isNotNull(), F.concat_ws(":", col(chrom), col(strand), change_text(site)))


def parse_profile(text: Column | str) -> Column:
    """The site of what profile_text() gives; null for a null or empty text."""
    x = F.nullif(col(text), F.lit(""))
    place, change = F.split_part(x, F.lit(":"), F.lit(3)), F.split_part(x, F.lit(":"), F.lit(4))
    first = F.split_part(place, F.lit("-"), F.lit(1)).cast("long")
    last = F.coalesce(F.nullif(F.split_part(place, F.lit("-"), F.lit(2)), F.lit("")).cast("long"), first)
    site = F.struct(first.alias("pos_from"), last.alias("pos_to"), F.split_part(change, F.lit(">"), F.lit(1)).alias("ref"), F.split_part(change, F.lit(">"), F.lit(2)).alias("alt"))
    return F.when(x.isNotNull(), site)


def end_without_nte3(strand: Column | str, start: Column | str, end: Column | str, nte3: Column | str) -> Column:
    """Where the 3' end lies without its modification."""
    return F.when(col(strand) == "+", col(end) - size(nte3)).otherwise(col(start) + size(nte3))


def base_indexes(strand: Column | str, start: Column | str, end: Column | str, pos_from: Column | str, pos_to: Column | str) -> Column:
    """0-based places of a modification's bases in the read as the RNA reads."""
    lo, hi = F.least(col(pos_from), col(pos_to)), F.greatest(col(pos_from), col(pos_to))
    return F.transform(F.sequence(lo, hi), lambda p: F.when(col(strand) == "+", p - col(start)).otherwise(col(end) - p).cast("int"))


CELLS = "array<struct<pos_from:bigint,pos_to:bigint,ref:string,alt:string,n:bigint>>"


def parse_cells(cell: Column | str) -> Column:
    """``pos[-pos2]:ref>alt:n|...`` or ``0`` as an array of sites with counts."""
    def one(x: Column) -> Column:
        place = F.split_part(x, F.lit(":"), F.lit(1))
        first = F.split_part(place, F.lit("-"), F.lit(1)).cast("long")
        last = F.coalesce(F.nullif(F.split_part(place, F.lit("-"), F.lit(2)), F.lit("")).cast("long"), first)
        change = F.split_part(x, F.lit(":"), F.lit(2))
        return F.struct(first.alias("pos_from"), last.alias("pos_to"), F.split_part(change, F.lit(">"), F.lit(1)).alias("ref"), F.split_part(change, F.lit(">"), F.lit(2)).alias("alt"), F.split_part(x, F.lit(":"), F.lit(3)).cast("long").alias("n"))

    held = none_if_zero(cell)
    return F.coalesce(F.transform(F.split(held, r"\|"), one), F.array().cast(CELLS))


def render_cells(cells: Column) -> Column:
    """The reverse of parse_cells(), in text order; ``0`` if there are none."""
    text = F.array_join(F.array_sort(F.transform(cells, lambda c: F.concat(change_text(c), F.lit(":"), c["n"].cast("string")))), "|")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("0"))
