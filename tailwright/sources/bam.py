"""Binary alignments as a data source: ``spark.read.format("bam").load(path)`` after ``register(spark)``.

A file is a header, names and lengths of chromosomes, and records, in blocks of gzip.  It is cut into byte ranges: a
task finds the first block of its range and, in the unpacked bytes, the first place from which several records follow
each other; it has the records that begin in its range's blocks.  A file without block sizes is one task.

With an index beside the file (``.bai``) and a region, only the ranges between the index's places are read.  The region
is the options ``chrom``, ``start`` and ``end``, or, with the option ``pushed``, what Spark pushes down of a filter on
``chrom`` and ``pos``, for which ``spark.sql.python.filterPushdown.enabled`` must be on; filters are always applied again.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tailwright.sources.bgzf import Unpacked, first_block, is_blocked
from tailwright.sources.paths import files_of, opened, streamed

SCHEMA = "name string, flag int, chrom string, pos long, seq string, qual string, md string, nm int"
#: Bytes of a range, and records handed to Spark at once.
RANGE, ROWS = 64 << 20, 8192
#: Records that have to follow each other before a place counts as the beginning of one.
CHAIN = 4
#: Bases of a window of the linear index, and the shifts and first numbers of its bins: fixed values of the format.
WINDOW = 14
BINS = [(26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)]
#: Letters of the sixteen base codes, and formats of the one-number tag types: fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
NUMBERS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

_PAIRS = [a + b for a in BASES for b in BASES]
_SIGNS = bytes(min(k + 33, 126) for k in range(256))


@dataclass
class Range(InputPartition):
    """Bytes of a file; all of it, as a stream, where ``end`` is None.  ``skip``: unpacked bytes of the first block that
    are known to lie before the first record, or None where the first record has to be found."""

    path: str
    start: int = 0
    end: int | None = None
    skip: int | None = None


@dataclass
class Region:
    chrom: str | None = None
    start: int = 1
    end: int = 1 << 29

    def holds(self, chrom: str | None, pos: int) -> bool:
        return self.chrom is None or (chrom == self.chrom and self.start <= pos <= self.end)


def _tags(raw: bytes) -> dict[str, object]:
    """The tags of a record; arrays are passed over."""
    out: dict[str, object] = {}
    at = 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            out[name] = raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            size, n = struct.calcsize("<" + NUMBERS[chr(raw[at])]), struct.unpack_from("<i", raw, at + 1)[0]
            at += 5 + size * n
        else:
            out[name] = struct.unpack_from("<" + NUMBERS[kind], raw, at)[0]
            at += struct.calcsize("<" + NUMBERS[kind])
    return out


def _taken(f, n: int, path: str) -> bytes:
    raw = f.read(n)
    if len(raw) != n:
        raise ValueError(f"{path}: not a whole BAM file")
    return raw


def chromosomes(f, path: str) -> list[str]:
    """The header's chromosomes; the stream then stands at the first record."""
    if f.read(4) != b"BAM\1":
        raise ValueError(f"{path}: not a BAM file")
    number = lambda: struct.unpack("<i", _taken(f, 4, path))[0]
    _taken(f, number(), path)
    out = []
    for _ in range(number()):
        out.append(_taken(f, number(), path)[:-1].decode())
        _taken(f, 4, path)
    return out


def _record(raw: bytes, chroms: list[str]) -> tuple:
    """One tuple of SCHEMA."""
    chrom, pos, n_name, _, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
    at = 32 + n_name + 4 * n_cigar
    packed = raw[at : at + (n_seq + 1) // 2]
    at += len(packed)
    qual, tags = raw[at : at + n_seq], _tags(raw[at + n_seq :])
    nm = tags.get("NM")
    return raw[32 : 32 + n_name - 1].decode(), flag, chroms[chrom] if chrom >= 0 else None, pos + 1, "".join(map(_PAIRS.__getitem__, packed))[:n_seq], "*" if qual[:1] == b"\xff" else qual.translate(_SIGNS).decode(), tags.get("MD"), None if nm is None else int(nm)


def records(f, path: str, chroms: list[str]) -> Iterator[tuple]:
    """The records of an unpacked stream, to its end or that of its own blocks."""
    own = f.begins_inside if isinstance(f, Unpacked) else lambda: True
    while own() and (size := f.read(4)):
        if len(size) < 4:
            raise ValueError(f"{path}: not a whole BAM file")
        yield _record(_taken(f, struct.unpack("<i", size)[0], path), chroms)


def _could_begin(raw: bytes, at: int, chroms: int) -> int | None:
    """Where a record that begins at ``at`` ends, if one can; ``raw`` may be cut off."""
    if at + 36 > len(raw):
        return None
    size, chrom, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", raw, at)
    if not (-1 <= chrom < chroms and -1 <= mate < chroms and pos >= -1 and mate_pos >= -1 and n_name >= 1 and n_seq >= 0):
        return None
    if size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
        return None
    name = raw[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def _skip_to_record(f: Unpacked, chroms: int) -> bool:
    """Passes over the rest of a record that began before; False if no record begins in the stream's own blocks."""
    at = 0
    while True:
        while len(f.held) < at + 36 and f.more():
            pass
        f.sure_of(at)
        if at >= f.own or at + 36 > len(f.held):
            return False
        here, left = at, CHAIN
        while left:
            while len(f.held) < here + 36 + 255 and f.more():
                pass
            if here == len(f.held):
                break  # the file's last record
            if (end := _could_begin(f.held, here, chroms)) is None:
                here = -1
                break
            here, left = end, left - 1
        if here >= 0:
            f.read(at)
            return True
        at += 1


def index_ranges(path: str, raw: bytes, chroms: list[str], region: Region, size: int) -> list[Range]:
    """The ranges of a file that can hold a region's records, by its index."""
    if raw[:4] != b"BAI\1":
        raise ValueError(f"{path}: not an index")
    n, at = struct.unpack_from("<i", raw, 4)[0], 8
    a, b = max(0, region.start - 1), min(region.end, 1 << 29)
    wanted = {0} | {first + k for shift, first in BINS for k in range(a >> shift, ((b - 1) >> shift) + 1)}
    found: list[tuple[int, int]] = []
    for chrom in range(n):
        own = chrom < len(chroms) and chroms[chrom] == region.chrom
        chunks = []
        n_bins, at = struct.unpack_from("<i", raw, at)[0], at + 4
        for _ in range(n_bins):
            number, n_chunks = struct.unpack_from("<Ii", raw, at)
            if own and number in wanted:
                chunks += [struct.unpack_from("<QQ", raw, at + 8 + 16 * k) for k in range(n_chunks)]
            at += 8 + 16 * n_chunks
        n_windows, at = struct.unpack_from("<i", raw, at)[0], at + 4
        if own and n_windows:
            least = struct.unpack_from("<Q", raw, at + 8 * min(a >> WINDOW, n_windows - 1))[0]
            found = [(max(x, least), y) for x, y in sorted(chunks) if y > least]
        at += 8 * n_windows
    out: list[Range] = []
    for x, y in found:  # places are a block's offset and one inside it
        begin, end = x >> 16, min(size, (y >> 16) + 1)
        if out and begin < out[-1].end:
            out[-1].end = max(out[-1].end, end)
        else:
            out.append(Range(path, begin, end, x & 0xFFFF))
    return out


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE))
        self.region = Region(options.get("chrom"), int(options.get("start", 1)), int(options.get("end", 1 << 29)))

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        every = dict(files_of(self.path))
        indexes = dict(files_of(self.path + ".bai")) if self.path.endswith(".bam") and self._beside() else {p: n for p, n in every.items() if p.endswith(".bai")}
        for path, size in every.items():
            if not path.endswith(".bam") and path != self.path:
                continue
            with opened(path) as f:
                if not is_blocked(f):
                    out.append(Range(path))
                    continue
            if self.region.chrom is not None and f"{path}.bai" in indexes:
                with opened(f"{path}.bai") as g:
                    raw = g.read()
                with opened(path) as f:
                    out += index_ranges(path, raw, chromosomes(Unpacked(f, 0, 1), path), self.region, size)
            else:
                out += [Range(path, a, min(a + self.size, size)) for a in range(0, size, self.size)]
        return out

    def _beside(self) -> bool:
        try:
            return bool(files_of(self.path + ".bai"))
        except FileNotFoundError:
            return False

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end is None:
            with streamed(part.path) as raw, gzip.open(raw) as f:
                chroms = chromosomes(f, part.path)
                yield from self._batches(records(f, part.path, chroms))
            return
        with opened(part.path) as f, opened(part.path) as again:
            head = Unpacked(f, 0, part.end)
            chroms = chromosomes(head, part.path)
            if part.skip is None and head.reached >= part.start:  # the header ends in this range, or after it
                yield from self._batches(records(head, part.path, chroms))
                return
            at = part.start if part.skip is not None else first_block(again, part.start, again.seek(0, 2))
            if at >= part.end:
                return
            body = Unpacked(again, at, part.end)
            if part.skip is not None:
                body.read(part.skip)
            elif not _skip_to_record(body, len(chroms)):
                return
            yield from self._batches(records(body, part.path, chroms))

    def _batches(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        wanted = (r for r in rows if self.region.holds(r[2], r[3]))
        while held := list(islice(wanted, ROWS)):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


class FilteredBamReader(BamReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what a region can tell from ``filters``; Spark applies them all again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",) and self.region.chrom is None:
                self.region.chrom = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("pos",):
                self.region.start = max(self.region.start, f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("pos",):
                self.region.end = min(self.region.end, f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("pos",):
                self.region.start = self.region.end = f.value
            yield f


class Bam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        # Spark takes a reader with filters only where they are enabled, which a source can't see
        return (FilteredBamReader if self.options.get("pushed") == "true" else BamReader)(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Bam)
