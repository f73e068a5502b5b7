"""Bases packed into integers, two bits each, and their mismatches counted by XOR.

A word is a long that holds WORD bases, the first one highest; what is missing at its end counts as A.  A letter other
than A, C, G or T is packed as A and marked in a second word, and never equals anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of a word: 62 bits, so that it is never negative.
WORD = 31
#: The lower bit of every base.
LOWS = sum(1 << 2 * k for k in range(WORD))
WINDOWS = "chrom string, pos long, room int, word long, odd long"
#: What is before a place: how many bases of its tile, all of them and up to a word, and these, the last one lowest.
BEFORE = "inside long, back_room int, back long, back_odd long"

_CODES = np.zeros(256, np.int64)
_ODD = np.ones(256, np.int64)
for _k, _base in enumerate(b"ACGT"):
    _CODES[_base], _ODD[_base] = _k, 0


def span(first: int, last: int) -> int:
    """The bits of the bases from ``first`` up to ``last``, not included."""
    return sum(3 << 2 * (WORD - 1 - k) for k in range(first, last))


#: The letters that are packed as A.
OTHERS = "BDEFHIJKLMNOPQRSUVWXYZ"


def word_of(seq: Column) -> Column:
    """The word of the first bases of a text of upper-case letters."""
    digits = F.translate(F.left(seq, F.lit(WORD)), "ACGT" + OTHERS, "0123" + "0" * len(OTHERS))
    return F.conv(F.rpad(digits, F.lit(WORD), F.lit("0")), 4, 10).cast("long")


def odd_of(seq: Column) -> Column:
    """The marks of the first bases that aren't A, C, G or T."""
    marks = F.regexp_replace(F.translate(F.left(seq, F.lit(WORD)), "ACGT", "0000"), "[^0]", "1")
    return F.when(F.left(seq, F.lit(WORD)).rlike("[^ACGT]"), F.conv(F.rpad(marks, F.lit(WORD), F.lit("0")), 4, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def first_bases(n: Column) -> Column:
    """The lower bits of the first n bases, of a word at most."""
    gone = (F.lit(2 * WORD) - F.least(n, F.lit(WORD)) * 2).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", F.lit(LOWS), gone), gone)


def mismatches(a: Column, b: Column, odd_a: Column, odd_b: Column, within: Column) -> Column:
    """Bases ``within`` (lower bits) at which two words differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.call_function("shiftright", x, F.lit(1))).bitwiseOR(odd_a).bitwiseOR(odd_b).bitwiseAND(within))


def text_mismatches(a: Column, b: Column) -> Column:
    """The same for two upper-case texts of one length, whatever it is."""
    starts = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / WORD).cast("int"))
    part = lambda x, k: F.substring(x, k * WORD + 1, F.lit(WORD))
    each = F.transform(starts, lambda k: mismatches(word_of(part(a, k)), word_of(part(b, k)), odd_of(part(a, k)), odd_of(part(b, k)), F.lit(LOWS)))
    return F.when(F.length(a) == 0, F.lit(0)).otherwise(F.aggregate(each, F.lit(0), lambda s, x: s + x))


def _gathered(codes: np.ndarray) -> np.ndarray:
    """The WORD codes from each place on, in one number; places near the end take in zeros."""
    have, size, out, done = codes, 1, None, 0
    rest = WORD
    while rest:
        if rest & 1:  # the next ``size`` bases of the word
            moved = np.concatenate([have[done:], np.zeros(min(done, len(have)), np.int64)])
            out = moved if out is None else (out << 2 * size) | moved
            done += size
        rest >>= 1
        if rest:
            later = np.concatenate([have[size:], np.zeros(min(size, len(have)), np.int64)])
            have, size = (have << 2 * size) | later, 2 * size
    return out


def windows(tiled: DataFrame, own: int, least: int, before: bool = False, wanted: list[tuple[int, np.ndarray]] | None = None) -> DataFrame:
    """WINDOWS: a row for each place of the tiles' first ``own`` bases with ``least`` bases from there on: how many there
    are in its tile, up to a word, and their word; ``before`` adds BEFORE.  ``tiled(chrom, first, bases)`` is cut up in numpy, by whole batches,
after it is dealt out: it has few bytes, so few tasks may have made it, and each byte becomes a row.  ``wanted`` are bits of a word and,
in their order, the numbers that these may be: other places are left out, and ``which`` has a bit for each of these that holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            sizes = np.diff(ends)
            take = np.clip(np.minimum(sizes - least + 1, own), 0, None)
            row = np.repeat(np.arange(len(sizes)), take)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            at = ends[:-1][row] + inside
            room = np.minimum(sizes[row] - inside, WORD)
            # bases of the next tile beyond the room are cut off
            kept = ~((np.int64(1) << 2 * (WORD - room)) - 1)
            codes, odds = _gathered(_CODES[raw]), _gathered(_ODD[raw])
            word, odd = codes[at] & kept, odds[at] & kept
            if wanted is not None:
                which = np.zeros(len(word), np.int64)
                for k, (bits, numbers) in enumerate(wanted):
                    found = np.searchsorted(numbers, word & bits)
                    which |= (numbers[np.minimum(found, len(numbers) - 1)] == word & bits).astype(np.int64) << k
                row, inside, at, room, word, odd, which = (v[which != 0] for v in (row, inside, at, room, word, odd, which))
            pos = batch.column(1).to_numpy()[row] + inside
            made = {"chrom": batch.column(0).take(pa.array(row)), "pos": pa.array(pos), "room": pa.array(room.astype(np.int32)), "word": pa.array(word), "odd": pa.array(odd)}
            if before:
                b = np.minimum(inside, WORD)
                made |= {"inside": pa.array(inside), "back_room": pa.array(b.astype(np.int32)), "back": pa.array(codes[at - b] >> 2 * (WORD - b)), "back_odd": pa.array(odds[at - b] >> 2 * (WORD - b))}
            if wanted is not None:
                made["which"] = pa.array(which)
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    columns = ", ".join([WINDOWS, *([BEFORE] if before else []), *(["which long"] if wanted is not None else [])])
    return tiled.select("chrom", F.col("first").cast("long").alias("first"), "bases").repartition("chrom", "first").mapInArrow(run, columns)
