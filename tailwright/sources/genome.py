"""A genome in FASTA as tiles, read in byte ranges.

Two passes over the ranges.  The first tells, for each range, how many bases stand before its first header and after
each of its headers; from these few numbers follow the chromosome and the base with which each range begins, however
lines are wrapped, and even if a chromosome is a single line.  The second gives the tiles that begin in a range; it
reads on past the range's end for the rest of the last tile and its margin.  No row is longer than a tile and its margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.sources.paths import files_of, opened

#: Bytes of a range; bytes that are read on at once past its end; tiles handed to Spark at once.
RANGE, FURTHER, ROWS = 64 << 20, 1 << 16, 4096
COUNTS = "k int, lead long, open boolean, known boolean, body long, names array<string>, bases array<long>, heading boolean"
TILES = "chrom string, first long, bases string"

_BASE = np.ones(256, bool)  # blanks and ends of lines are no bases
_BASE[list(b" \t\r\n\x0b\x0c")] = False


@dataclass
class Range:
    path: str
    start: int
    end: int
    #: What the range begins with: chromosome, bases of it before, and whether it begins inside a header.
    chrom: str | None = None
    before: int = 0
    heading: bool = False


@dataclass
class Lines:
    """A range's bytes: where its headers are, and up to where its first line goes if that begins before the range."""

    raw: np.ndarray
    lead: int
    open: bool
    known: bool
    heads: list[tuple[int, int]]


def _name(line: bytes) -> str:
    return (line[1:].split() or [b""])[0].decode()


def _lines(f, r: Range) -> Lines:
    f.seek(max(0, r.start - 1))
    raw = f.read(r.end - max(0, r.start - 1))
    known = r.start == 0 or raw[:1] == b"\n"
    raw = raw if r.start == 0 else raw[1:]
    end = 0 if known else raw.find(b"\n") + 1
    heads, at = [], raw.find(b">", 0 if known else end)
    while at >= 0 and (known or end):
        if at == 0 or raw[at - 1 : at] == b"\n":
            stop = raw.find(b"\n", at)
            heads.append((at, len(raw) if stop < 0 else stop))
            at = raw.find(b">", len(raw) if stop < 0 else stop)
        else:
            at = raw.find(b">", at + 1)
    return Lines(np.frombuffer(raw, np.uint8), len(raw) if not known and not end else end, not known and not end, known, heads)


def _whole_name(f, r: Range, found: Lines, head: tuple[int, int]) -> str:
    """A header's name, even if its line goes on past the range."""
    line = found.raw[head[0] : head[1]].tobytes()
    if head[1] == len(found.raw):
        f.seek(r.start + head[1])
        while b"\n" not in line and (more := f.read(FURTHER)):
            line += more
    return _name(line.split(b"\n")[0])


def _count(raw: np.ndarray) -> int:
    return int(np.count_nonzero(_BASE[raw]))


def _counted(ranges: list[Range]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with opened(ranges[k].path) as f:
                    found = _lines(f, ranges[k])
                    stops = [*(h[0] for h in found.heads), len(found.raw)]
                    row = {
                        "k": k, "lead": _count(found.raw[: found.lead]), "open": found.open, "known": found.known, "body": _count(found.raw[found.lead : stops[0]]),
                        "names": [_whole_name(f, ranges[k], found, h) for h in found.heads],
                        "bases": [_count(found.raw[h[1] : stop]) for h, stop in zip(found.heads, stops[1:], strict=True)],
                        "heading": bool(found.heads) and found.heads[-1][1] == len(found.raw),
                    }
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("k", pa.int32()), ("lead", pa.int64()), ("open", pa.bool_()), ("known", pa.bool_()), ("body", pa.int64()), ("names", pa.list_(pa.string())), ("bases", pa.list_(pa.int64())), ("heading", pa.bool_())]))

    return run


def _placed(ranges: list[Range], counts: list) -> None:
    """Tells each range what it begins with, from what was counted in those before it."""
    path, chrom, before, heading = None, None, 0, False
    for r, c in zip(ranges, counts, strict=True):
        if r.path != path:
            path, chrom, before, heading = r.path, None, 0, False
        r.chrom, r.before, r.heading = chrom, before, heading
        if not heading:
            before += c["lead"]
        heading = heading and c["open"]
        before += c["body"]
        for name, n in zip(c["names"], c["bases"], strict=True):
            chrom, before = name, n
        heading = heading or c["heading"]


def _read_on(f, at: int, need: int) -> np.ndarray:
    """Up to ``need`` bases from byte ``at`` on, as far as the next header."""
    f.seek(at - 1)
    last, parts, have = f.read(1), [], 0
    while have < need and (raw := f.read(FURTHER)):
        stop = 0 if last == b"\n" and raw[:1] == b">" else raw.find(b"\n>") + 1
        whole = raw if not stop and not (last == b"\n" and raw[:1] == b">") else raw[:stop]
        x = np.frombuffer(whole, np.uint8)
        parts.append(x[_BASE[x]])
        have += len(parts[-1])
        if len(whole) < len(raw):
            break
        last = raw[-1:]
    return np.concatenate(parts)[:need] if parts else np.zeros(0, np.uint8)


def _tiled(ranges: list[Range], tile: int, margin: int):
    def of(f, r: Range) -> Iterator[tuple[str, int, str]]:
        found = _lines(f, r)
        lead = found.lead if r.heading else 0
        stops = [*(h[0] for h in found.heads), len(found.raw)]
        parts = [(r.chrom, r.before, found.raw[lead : stops[0]], stops[0])]
        parts += [(_whole_name(f, r, found, h), 0, found.raw[h[1] : stop], stop) for h, stop in zip(found.heads, stops[1:], strict=True)]
        for chrom, before, raw, stop in parts:
            bases = raw[_BASE[raw]]
            own = len(bases)
            begin = -before % tile  # bases of a tile that began before the range
            if chrom is None or own <= begin:
                continue
            if stop == len(found.raw):  # the last tile may go on past the range
                bases = np.concatenate([bases, _read_on(f, r.end, tile + margin)])
            text = bases.tobytes().upper().decode("ascii", "replace")
            for at in range(begin, own, tile):
                yield chrom, before + at + 1, text[at : at + tile + margin]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with opened(ranges[k].path) as f:
                    rows: list[tuple[str, int, str]] = []
                    for row in of(f, ranges[k]):
                        rows.append(row)
                        if len(rows) == ROWS:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return run


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    chrom, first, bases = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(chrom, pa.string()), pa.array(first, pa.int64()), pa.array(bases, pa.string())], names=["chrom", "first", "bases"])


def genome_tiles(spark: SparkSession, path: str | list[str], tile: int, margin: int, range_bytes: int = RANGE) -> DataFrame:
    """(chrom, first, bases, tile) of plain FASTA files or folders of them, as align.tiles() makes them of whole
    chromosomes; a chromosome's name is its header's first word.  A packed file can't be cut: unpack it first."""
    ranges = []
    for p, size in files_of(path):
        if p.endswith(".gz"):
            raise ValueError(f"{p}: a packed genome can't be read in ranges")
        ranges += [Range(p, a, min(a + range_bytes, size)) for a in range(0, size, range_bytes)]
    if not ranges:
        return spark.createDataFrame([], TILES + ", tile long")
    each = spark.range(0, len(ranges), 1, len(ranges)).select(F.col("id").cast("int"))
    counts = sorted(each.mapInArrow(_counted(ranges), COUNTS).collect(), key=lambda c: c["k"])  # a row a range
    _placed(ranges, counts)
    return each.mapInArrow(_tiled(ranges, tile, margin), TILES).withColumn("tile", F.floor(F.col("first") / tile))
