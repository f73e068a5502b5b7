"""Text formats, read and written."""

import gzip

import pytest

from tailwright.operators import hits
from tailwright.sources import readers, writers
from tailwright.streaming import reads as streaming
from tests.test_operators import annos, prio


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_with_wrapped_lines(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">1|12\nACGT\nAC\n>2|3\nGGG\n>3\nTT\n")
    assert sorted(map(tuple, readers.fasta(spark, p).collect())) == [("1|12", 12, "ACGTAC"), ("2|3", 3, "GGG"), ("3", 1, "TT")]


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_fastq_in_ranges(spark, tmp_path, size):
    rows = [(f"r{k} x", "ACGTACGTAC"[: 4 + k % 6], "@+@IIIII#\""[: 4 + k % 6]) for k in range(60)]
    p = put(tmp_path / "a.fq", "".join(f"@{n}\n{s}\n+{n}\n{q}\n" for n, s, q in rows))
    assert sorted(map(tuple, readers.fastq(spark, p, size).collect())) == sorted(rows)


def test_fastq_gzip_and_damage(spark, tmp_path):
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("@a\nAC\n+\nII\n")
    assert [tuple(r) for r in readers.fastq(spark, str(tmp_path / "a.fq.gz")).collect()] == [("a", "AC", "II")]
    with pytest.raises(Exception, match="not a FASTQ record"):
        readers.fastq(spark, put(tmp_path / "b.fq", "@a\nACC\n+\nII\n")).collect()


def test_fastq_blank_lines(spark, tmp_path):
    record = "@{0}\nACGT\n+\nIIII\n"
    whole = "".join(record.format(k) for k in range(9))
    assert readers.fastq(spark, put(tmp_path / "end.fq", whole + "\n\n")).count() == 9
    assert [tuple(r) for r in readers.fastq(spark, put(tmp_path / "none.fq", "@a\n\n+\n")).collect()] == [("a", "", "")]
    for size in (30, 1 << 20):
        with pytest.raises(Exception, match="not a FASTQ record"):
            readers.fastq(spark, put(tmp_path / f"in{size}.fq", whole + "\n" + whole), size).collect()


def test_a_damaged_annotation_line_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.annotations(spark, put(tmp_path / "anno", "chr strand start end class name\nchr1 + 5 x30 piRNA p1\n")).collect()


def test_sniff(spark, tmp_path):
    assert readers.sniff(spark, put(tmp_path / "a", ">x\nACGT\n")) == "fasta"
    assert readers.sniff(spark, put(tmp_path / "b", "@x\nACGT\n+\nIIII\n")) == "fastq"
    assert readers.sniff(spark, put(tmp_path / "c", "@HD\tVN:1\nx\t0\tchr1\t1\t255\t4M\t*\t0\t0\tACGT\tIIII\n")) == "sam"
    with pytest.raises(ValueError):
        readers.sniff(spark, put(tmp_path / "d", "hello\n"))


def test_sam_keeps_odd_qualities(spark, tmp_path):
    p = put(tmp_path / "a.sam", '@SQ\tx\n1|6\t16\tchr5\t157\t255\t4M\t*\t0\t0\tGGAA\t"\\I#\tXA:i:1\tMD:Z:0A3\tNM:i:1\n2|1\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n')
    r = readers.sam(spark, p).collect()
    assert len(r) == 1 and (r[0].read_id, r[0].abundance, r[0].strand, r[0].read_start, r[0].read_end, r[0].qual, r[0].md, r[0].nm) == ("1|6", 6, "-", 157, 160, '"\\I#', "0A3", 1)


def bam_bytes(rows):
    """The binary form of (name, flag, chromosome, place, sequence, qualities or None, md, nm)."""
    import struct

    codes = "=ACMGRSVTWYHKDBN"
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2)
    for name in (b"chr1\0", b"chrX\0"):
        out += struct.pack("<i", len(name)) + name + struct.pack("<i", 10_000)
    for name, flag, chrom, pos, seq, qual, md, nm in rows:
        nibbles = [codes.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
        signs = bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq)
        tags = b"XAAc" + b"XBBc" + struct.pack("<ibb", 2, 1, 2) + b"XFf" + struct.pack("<f", 1.5) + (b"NMC" + bytes([nm]) if nm is not None else b"") + (b"MDZ" + md.encode() + b"\0" if md else b"")
        body = struct.pack("<iiBBHHHiiii", chrom, pos - 1, len(name) + 1, 255, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + signs + tags
        out += struct.pack("<i", len(body)) + body
    return out


def test_bam_equals_sam(spark, tmp_path):
    rows = [("a|6", 16, 1, 157, "GGAA", "II#!", "0A3", 1), ("b|1", 4, -1, 0, "AC", "II", None, None), ("c|2", 0, 0, 1, "ACGTN", None, "5", 0)]
    rows += [(f"r{k}|1", 0, 0, k + 1, "ACGTACG"[: 1 + k % 7], None, str(1 + k % 7), 0) for k in range(9000)]
    raw = bam_bytes(rows)
    (tmp_path / "a.bam").write_bytes(b"".join(gzip.compress(raw[k : k + 5000]) for k in range(0, len(raw), 5000)))  # blocks cut records
    names = {-1: "*", 0: "chr1", 1: "chrX"}
    p = put(tmp_path / "a.sam", "".join(f"{n}\t{f}\t{names[c]}\t{at}\t255\t{len(s)}M\t*\t0\t0\t{s}\t{q or '*'}" + (f"\tMD:Z:{md}\tNM:i:{nm}" if md else "") + "\n" for n, f, c, at, s, q, md, nm in rows))
    want = readers.sam(spark, p)
    assert sorted(map(tuple, readers.bam(spark, str(tmp_path / "a.bam")).select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    for damage in (raw[:-3], b"BAX" + raw):
        (tmp_path / "b.bam").write_bytes(gzip.compress(damage))
        with pytest.raises(Exception, match="BAM file"):
            readers.bam(spark, str(tmp_path / "b.bam")).collect()


def test_native_alignments(spark, tmp_path):
    p = put(tmp_path / "a.txt", "1|2\t+\tchr1\t9\tACGT\tIIII\t0\t1:G>C\n2|1\t-\tchr1\t9\tACGT\tIIII\t0\t0:G>C\n3|1\t+\tchr1\t9\tACGT\tIIII\t0\n")
    assert {r.read_id: (r.read_start, r.read_end, r.nm, r.md) for r in readers.native_alignments(spark, p).collect()} == {"1|2": (10, 13, 1, "1G2"), "2|1": (10, 13, 1, "3G0"), "3|1": (10, 13, 0, "4")}


def test_small_tables(spark, tmp_path):
    a = put(tmp_path / "anno", "chr strand start end class name\nchr1 + 5 30 piRNA p1\nchr2 - 7 40 piRNA p2\n")
    assert [(r.chrom, r.anno_start, r.anno_name) for r in readers.annotations(spark, a).orderBy("aid").collect()] == [("chr1", 5, "p1"), ("chr2", 7, "p2")]
    assert [tuple(r) for r in readers.priority(spark, put(tmp_path / "prio", "mirna\ntRf\n")).orderBy("rnk").collect()] == [("mirna", 0), ("tRf", 1)]
    assert readers.manifest(spark, put(tmp_path / "man", "# x\n/a/b\n/c\n")) == ["/a/b", "/c"]
    s = readers.snps(spark, put(tmp_path / "snp", "chr1 20511 G>C dbSNP\nchr1 20518 T>G dbSNP |gnomAD-exomes\n")).orderBy("pos").collect()
    assert [(r.pos, r.ref, r.alt, r.source) for r in s] == [(20511, "G", "C", "dbSNP"), (20518, "T", "G", "dbSNP")]
    assert readers.library_depth(spark, put(tmp_path / "sum", "total number of reads:\t8123456\nmirna\t5\n")).first().depth == 8123456
    assert [tuple(r)[:3] for r in readers.bed(spark, put(tmp_path / "bed", "#c\nchr1\t4\t9\n")).collect()] == [("chr1", 4, 9)]


def test_psl_to_best_hits(spark, tmp_path):
    line = lambda m, x, name, start: f"{m}\t{x}\t5\t0\t0\t0\t0\t0\t+\t{name}\t22\t0\t22\tchr1.fa\t900\t{start}\t{start + 22}\t1\t22,\t0,\t{start},\n"
    p = put(tmp_path / "a.psl", "psLayout version 3\n\nmatch\tmis\n     \tmatch\n-----\n" + line(22, 0, "q|1", 10) + line(22, 0, "q|1", 50) + line(21, 1, "q|1", 70) + line(20, 1, "p|1", 5))
    best = hits.extended(hits.best_hits(readers.psl(spark, p)))
    assert sorted((r.q_name, r.score, r.t_name, r.full_start, r.full_end) for r in best.collect()) == [("p|1", 19, "chr1", 6, 27), ("q|1", 22, "chr1", 11, 32), ("q|1", 22, "chr1", 51, 72)]
    assert len(writers.best_hits(hits.best_hits(readers.psl(spark, p))).columns) == 16


def test_summary_round_trip(spark, tmp_path):
    row = "m1\tmirna\tchr1\t+\t5\t26\t0\t140\t100\t40\t9333.3\t0\t19\t0\t0\t26:G>T:12|26-27:GA>TT:7\t0"
    p = put(tmp_path / "s", "annotation_name\tspecies\n" + row + "\n")
    s = readers.summary(spark, p)
    assert sorted((r.mod_type, r.pos_from, r.pos_to, r.ref, r.alt, r.n) for r in readers.long_counts(s).collect()) == [(1, 26, 26, "G", "T", 12), (1, 26, 27, "GA", "TT", 7)]
    writers.tsv(writers.annotation_summary(s), str(tmp_path / "out"))
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part*"))
    assert text.splitlines()[1] == row


def test_annotated_reads_round_trip(spark, tmp_path):
    from tailwright.operators import annotate
    from tests.test_operators import aligned

    a = annotate.with_profiles(annotate.annotate(aligned(spark), annos(spark), prio(spark)))
    writers.tsv(writers.annotated_reads(a), str(tmp_path / "out"))
    back = {r.read_id: r for r in readers.annotated_reads(spark, str(tmp_path / "out")).collect()}
    assert back["b|3"].nte3_profile == "chr13:-:7030311-7030310:AA>TT" and back["a|108"].nte3 is None and back["d|11"].nte5_profile == "chr13:-:7030334:A>T" and len(back) == 4


def test_streaming_class_counts(spark, tmp_path):
    from tests.test_operators import aligned

    want = [f.split()[0] for f in streaming.ALIGNED.split(", ")]
    for part in (aligned(spark).limit(2), aligned(spark).subtract(aligned(spark).limit(2))):
        part.select(*want).write.mode("append").parquet(str(tmp_path / "in"))
    q = streaming.class_counts(streaming.aligned(spark, str(tmp_path / "in"), 1), annos(spark), prio(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    total = spark.read.parquet(str(tmp_path / "out")).groupBy("species").sum("reads").collect()
    assert [tuple(r) for r in total] == [("mirna", 132)]
