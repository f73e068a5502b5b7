"""FASTQ as a data source: ``spark.read.format("fastq").load(path)`` after ``register(spark)``.

Plain files are cut into byte ranges.  A range begins at the first record that starts in it: a line that begins with
``@`` two lines before one that begins with ``+``, which a quality line cannot imitate, as the line two after it is a
sequence.  Files of gzip blocks (as bgzip writes them) are cut at blocks, and records are found in the same way in what
they unpack to.  Any other gzip file can only be read from its beginning and is one task.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tailwright.sources.bgzf import Unpacked, first_block, is_blocked
from tailwright.sources.paths import files_of, opened, streamed

SCHEMA = "name string, seq string, qual string"
#: Bytes of a range, and records handed to Spark at once.
RANGE, ROWS = 64 << 20, 8192
#: Ranges of all files together, above which they grow: tasks for small ranges take longer to start than to read.
RANGES = 2048


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, blocked: bool = False) -> None:
        self.path, self.start, self.end, self.blocked = path, start, end, blocked


def _batches(lines: Iterator[bytes], path: str) -> Iterator[pa.RecordBatch]:
    """Blank lines may end a file; anywhere else they are damage."""
    while block := [x.rstrip(b"\r\n") for x in islice(lines, 4 * ROWS)]:
        block += [b""] * (-len(block) % 4)
        names, seqs, signs, quals = (block[k::4] for k in range(4))
        if b"" in names:
            k = names.index(b"")
            if any(block[4 * k :]) or any(x.strip() for x in lines):
                raise ValueError(f"{path}: not a FASTQ record: a blank line before {next(filter(None, block[4 * k :]), b'')[:80]!r}")
            names, seqs, signs, quals = names[:k], seqs[:k], signs[:k], quals[:k]
        for name, seq, sign, qual in zip(names, seqs, signs, quals, strict=True):
            if name[:1] != b"@" or sign[:1] != b"+" or len(seq) != len(qual):
                raise ValueError(f"{path}: not a FASTQ record: {name[:80]!r}")
        if names:
            yield pa.record_batch([pa.array([x.decode() for x in column], pa.string()) for column in ([n[1:] for n in names], seqs, quals)], names=["name", "seq", "qual"])


def _first_record(f, start: int) -> int:
    """The offset of the first record that starts at ``start`` or later."""
    if start == 0:
        return 0
    f.seek(start - 1)
    f.readline()  # to the next line's beginning, or past the newline right before the range
    at: list[tuple[int, bytes]] = []
    while True:
        place = f.tell()
        line = f.readline()
        if not line:
            return place
        at.append((place, line))
        if len(at) >= 3 and at[-3][1].startswith(b"@") and line.startswith(b"+"):
            return at[-3][0]


def _skip_to_record(f: Unpacked) -> None:
    """Passes over the rest of the line that the first block begins with, whose record is the range's before, and on to
    a record."""
    f.readline()
    held: list[bytes] = []
    while line := f.readline():
        held.append(line)
        if len(held) >= 3 and held[-3].startswith(b"@") and line.startswith(b"+"):
            f.unread(b"".join(held[-3:]))
            return


def _lines(f, inside) -> Iterator[bytes]:
    """Lines of the records that begin inside."""
    count = 0
    while (count % 4 or inside()) and (line := f.readline()):
        count += 1
        yield line


class FastqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Range]:
        out, files = [], list(files_of(self.path))
        step = max(self.size, -(-sum(size for _, size in files) // RANGES))
        for path, size in files:
            blocked = False
            if path.endswith(".gz"):
                with opened(path) as f:
                    blocked = is_blocked(f)
                if not blocked:
                    out.append(Range(path, 0, None))
                    continue
            out += [Range(path, a, min(a + step, size), blocked) for a in range(0, size, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end is None:
            with streamed(part.path) as raw, gzip.open(raw) as f:
                yield from _batches(iter(f.readline, b""), part.path)
        elif part.blocked:
            with opened(part.path) as f:
                at = first_block(f, part.start, f.seek(0, 2))
                if at < part.end:
                    body = Unpacked(f, at, part.end)
                    if part.start:
                        _skip_to_record(body)
                    yield from _batches(_lines(body, body.follows_inside), part.path)
        else:
            with opened(part.path) as f:
                f.seek(_first_record(f, part.start))
                yield from _batches(_lines(f, lambda: f.tell() < part.end), part.path)


class Fastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fastq)
