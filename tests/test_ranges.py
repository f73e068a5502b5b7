"""Files cut into ranges: block gzip, binary alignments with an index, and genomes."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tailwright.operators import align
from tailwright.sources import bam, bgzf, fastq, genome, readers
from tests.test_sources import bam_bytes


def block(data, extra=b""):
    """One block; ``extra`` is a further field before the size."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    fields = extra + b"BC" + struct.pack("<HH", 2, 12 + len(extra) + 6 + len(body) + 8 - 1)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra) + 6) + fields + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocked(raw, rng, most=900):
    """(bytes, [(offset, unpacked offset)]) in blocks of various sizes, with an empty one at the end."""
    out, places, at = b"", [], 0
    while at < len(raw):
        n = rng.randint(1, most)
        places.append((len(out), at))
        out += block(raw[at : at + n], b"XX" + struct.pack("<H", 3) + b"abc" if n % 5 == 0 else b"")
        at += n
    return out + block(b""), places


def read_all(reader):
    out = []
    for part in reader.partitions():
        for batch in reader.read(part):
            out += list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return out


@pytest.fixture(scope="module")
def raw_reads():
    rng = random.Random(1)
    rows = []
    for k in range(700):
        n = rng.randint(0, 60)
        rows.append((f"@r{k}" if k % 7 == 0 else f"r{k} +x", "".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("@+I#\"") for _ in range(n))))
    return rows, "".join(f"@{n}\n{s}\n+{n if len(n) % 2 else ''}\n{q}\n" for n, s, q in rows).encode()


@pytest.mark.parametrize("size", [1, 97, 1000, 20_000, 1 << 30])
def test_blocked_fastq_is_the_same_at_every_range_size(tmp_path, raw_reads, size):
    rows, raw = raw_reads
    for seed in range(3):
        packed, _ = blocked(raw, random.Random(seed), 40 if seed == 2 else 900)
        p = tmp_path / f"{seed}.fq.gz"
        p.write_bytes(packed)
        reader = fastq.FastqReader({"path": str(p), "rangeBytes": str(size)})
        assert read_all(reader) == rows
        assert len(reader.partitions()) == -(-len(packed) // size)


def test_blocked_fastq_as_a_table_and_other_gzip(spark, tmp_path, raw_reads):
    rows, raw = raw_reads
    (tmp_path / "a.fq.gz").write_bytes(blocked(raw, random.Random(4))[0])
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(raw))
    got = readers.fastq(spark, str(tmp_path / "a.fq.gz"), 5000)
    assert got.rdd.getNumPartitions() > 2 and sorted(map(tuple, got.collect())) == sorted(rows)
    one = readers.fastq(spark, str(tmp_path / "b.fq.gz"), 5000)
    assert one.rdd.getNumPartitions() == 1 and sorted(map(tuple, one.collect())) == sorted(rows)


def test_damaged_blocks_are_errors(tmp_path, raw_reads):
    packed, places = blocked(raw_reads[1], random.Random(5))
    for k, damage in enumerate((packed[:-40], packed[: places[3][0] + 30] + b"\x00\x01" + packed[places[3][0] + 32 :])):
        p = tmp_path / f"{k}.gz"
        p.write_bytes(damage)
        with pytest.raises((ValueError, zlib.error)), open(p, "rb") as f:
            list(bgzf.blocks(f, 0))


ALIGNED = [(f"r{k}|1", 16 * (k % 2), k % 2, 1 + k * 37 // 2, "ACGTACGTTT"[: 1 + k % 10], None if k % 3 else "I" * (1 + k % 10), str(1 + k % 10), 0) for k in range(1500)]


def want_rows():
    names = {0: "chr1", 1: "chrX", -1: None}
    return [(n, f, names[c], at, s, q or "*", md, nm) for n, f, c, at, s, q, md, nm in ALIGNED]


@pytest.mark.parametrize("size", [1, 333, 4000, 1 << 30])
def test_bam_is_the_same_at_every_range_size(tmp_path, size):
    raw = bam_bytes(ALIGNED)
    for seed, most in enumerate((900, 60, 5000)):
        packed, _ = blocked(raw, random.Random(seed), most)
        p = tmp_path / f"{seed}.bam"
        p.write_bytes(packed)
        reader = bam.BamReader({"path": str(p), "rangeBytes": str(size)})
        assert read_all(reader) == want_rows()
        assert len(reader.partitions()) == -(-len(packed) // size)


def indexed(raw, places, ends):
    """An index of a file sorted by chromosome and place: (chromosome, first and last place, unpacked offsets) a record."""

    def virtual(at):
        offset, begins = max((p for p in places if p[1] <= at), key=lambda p: p[1])
        return offset << 16 | at - begins

    out = b"BAI\1" + struct.pack("<i", 2)
    for chrom in range(2):
        bins, windows = {}, {}
        for c, a, b, x, y in ends:
            if c == chrom:
                k = next(first + (a >> s) for s, first in reversed(bam.BINS) if a >> s == (b - 1) >> s)
                bins.setdefault(k, []).append((virtual(x), virtual(y)))
                for w in range(a >> 14, ((b - 1) >> 14) + 1):
                    windows.setdefault(w, virtual(x))
        out += struct.pack("<i", len(bins))
        for k, chunks in bins.items():
            out += struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        n, last = max(windows, default=-1) + 1, 0
        out += struct.pack("<i", n)
        for w in range(n):
            last = windows.get(w, last)
            out += struct.pack("<Q", last)
    return out


@pytest.fixture(scope="module")
def sorted_bam(tmp_path_factory):
    rows = sorted(((n, f, c, at * 20, s, q, md, nm) for n, f, c, at, s, q, md, nm in ALIGNED), key=lambda r: (r[2], r[3]))
    raw, ends, at = bam_bytes(rows), [], len(bam_bytes([]))
    for r in rows:
        n = struct.unpack_from("<i", raw, at)[0] + 4
        ends.append((r[2], r[3] - 1, r[3] - 1 + len(r[4]), at, at + n))
        at += n
    packed, places = blocked(raw, random.Random(9))
    p = tmp_path_factory.mktemp("bam") / "a.bam"
    p.write_bytes(packed)
    (p.parent / "a.bam.bai").write_bytes(indexed(raw, places, ends))
    return p, rows, len(packed)


@pytest.mark.parametrize("chrom,start,end", [("chr1", 1, 1 << 29), ("chrX", 100_000, 200_000), ("chrX", 270_000, 271_000), ("chr1", 400_000, 10**8), ("none", 1, 5)])
def test_regions_by_index(sorted_bam, chrom, start, end):
    p, rows, size = sorted_bam
    reader = bam.BamReader({"path": str(p), "chrom": chrom, "start": str(start), "end": str(end)})
    got = sorted(r[0] for r in read_all(reader))
    assert got == sorted(r[0] for r in rows if ("chr1", "chrX")[r[2]] == chrom and start <= r[3] <= end)
    read = sum(x.end - x.start for x in reader.partitions())
    assert read <= size and (end - start > 10**6 or read < size / 3)


def test_a_filter_reads_a_region(spark, sorted_bam):
    p, rows, _ = sorted_bam
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = readers.bam(spark, str(p)).where((F.col("chrom") == "chrX") & (F.col("read_start") >= 100_000) & (F.col("read_start") < 120_000))
        assert sorted(r.read_id for r in got.collect()) == sorted(r[0] for r in rows if r[2] == 1 and 100_000 <= r[3] < 120_000)
        assert got.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def genome_text(rng, ends="\n"):
    chroms = {"chr1": 5200, "chrEmpty": 0, "chr2": 1000, "chr3": 999, "chrOneLine": 4100, "chr5": 1, "chr6": 2001}
    text, out = "", {}
    for c, n in chroms.items():
        seq = "".join(rng.choice("ACGTacgtN") for _ in range(n))
        out[c] = seq.upper()
        width = 10**9 if c == "chrOneLine" else rng.choice([1, 7, 60, 61])
        text += f">{c} a long > description{ends}" + "".join(seq[k : k + width] + ends for k in range(0, n, width)) + (ends if c == "chr2" else "")
    return text, out


@pytest.mark.parametrize("size", [13, 250, 3000, 1 << 30])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_genome_tiles_equal_those_of_whole_chromosomes(spark, tmp_path, size, ends):
    text, want = genome_text(random.Random(size), ends)
    for k, t in enumerate((text, text.rstrip())):
        p = tmp_path / f"{k}.fa"
        p.write_bytes(t.encode())
        tile, margin = 100, 30
        got = {}
        for r in genome_rows(str(p), tile, margin, size):
            got[r[0], r[1]] = r[2]
        assert got == {(c, at + 1): s[at : at + tile + margin] for c, s in want.items() for at in range(0, len(s), tile)}


def genome_rows(path, tile, margin, size):
    """What genome_tiles() does, without Spark."""
    import pyarrow as pa

    n = 0
    ranges = []
    for p, total in genome.files_of(path):
        ranges += [genome.Range(p, a, min(a + size, total)) for a in range(0, total, size)]
    n = len(ranges)
    each = [pa.record_batch([pa.array(range(n), pa.int32())], names=["id"])]
    counts = [r for b in genome._counted(ranges)(iter(each)) for r in b.to_pylist()]
    genome._placed(ranges, counts)
    return [tuple(r.values()) for b in genome._tiled(ranges, tile, margin)(iter(each)) for r in b.to_pylist()]


def test_genome_tiles_as_a_table(spark, tmp_path):
    text, want = genome_text(random.Random(3))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">chr9\nACGT\n")
    got = genome.genome_tiles(spark, str(tmp_path), 100, 30, 999)
    pieces = spark.createDataFrame([(c, 1, s) for c, s in {**want, "chr9": "ACGT"}.items()], "chrom string, offset long, seq string")
    same = align.tiles(pieces, 100, 30).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, same.collect()))
    assert got.rdd.getNumPartitions() > 10
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(text.encode()))
    with pytest.raises(ValueError, match="packed genome"):
        genome.genome_tiles(spark, str(tmp_path / "c.fa.gz"), 100, 30)
