"""All tables of the analysis from input files, and each writer read back."""

import random

import pytest
from pyspark.sql import functions as F

from tailwright.operators import align, hits
from tailwright.plans import files
from tailwright.plans.pipeline import Settings, cohort_profiles
from tailwright.sources import readers, writers

OTHER = {"A": "C", "C": "A", "G": "T", "T": "G"}


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    """A genome of one chromosome with two annotations, and four reads: perfect ones, an added base, an odd end."""
    d = tmp_path_factory.mktemp("inputs")
    rng = random.Random(21)
    g = "".join(rng.choice("ACGT") for _ in range(3000))
    planted = {"p1|90": g[1500:1522], "p2|12": g[1500:1522] + OTHER[g[1522]], "p3|40": g[2000:2022], "p4|5": g[2000:2021] + OTHER[g[2021]]}
    text = {
        "genome.fa": ">chr1 planted\n" + "\n".join(g[k : k + 60] for k in range(0, 3000, 60)) + "\n",
        "anno.txt": "chr1 + 1501 1522 mirna m1\nchr1 + 2001 2022 mirna m2\n",
        "list.txt": f"# annotations\n{d}/anno.txt\n",
        "prio.txt": "mirna\ntRf\n",
        "reads.fa": "".join(f">{k}\n{s}\n" for k, s in planted.items()),
        "raw.fq": "".join(f"@x{k}\n{planted['p2|12']}\n+\n{'I' * 22 + ('I' if k < 7 else '#')}\n" for k in range(12)),
        "aligner.txt": "# comment\nshort-aligner -v 1 -m 1 --best --strata -S\n",
        "snps.txt": "chr1 99 A>C known\n",
        "hits.psl": "".join(f"{len(s)}\t0\t0\t0\t0\t0\t0\t0\t+\t{k}\t{len(s)}\t0\t{len(s)}\tchr1\t3000\t{g.find(s) if s in g else 1500}\t{(g.find(s) if s in g else 1500) + len(s)}\t1\t{len(s)},\t0,\t{g.find(s) if s in g else 1500},\n" for k, s in planted.items() if k != "p4|5"),
    }
    for name, x in text.items():
        (d / name).write_text(x)
    return d, g


def lines(path):
    return [x for f in sorted(path.glob("part*")) for x in f.read_text().splitlines()]


def test_from_files_to_files(spark, inputs, tmp_path):
    d, g = inputs
    p = files.sample(spark, f"{d}/reads.fa", f"{d}/genome.fa", f"{d}/list.txt", f"{d}/prio.txt", snps=f"{d}/snps.txt", fastq=f"{d}/raw.fq", psl=f"{d}/hits.psl", aligner=f"{d}/aligner.txt")
    paths = files.write(p, str(tmp_path))
    assert {"NTE.sam", "anno_overlap", "summary", "anno_counts", "query.fa", "results", "results.summary", "results.lvl1", "reads.t0.5.canonical_end", "reads.t0.5.canonical_end.summary", "anno_summary", "anno_summary.nosnp", "anno_summary.nosnp.snv-m100M100", "anno_summary.nosnp.snv-m100M100.phred30"} == set(paths)
    assert sorted(x.split("\t")[0] for x in lines(tmp_path / "NTE.sam")) == ["p1|90", "p2|12", "p3|40", "p4|5"]
    assert lines(tmp_path / "summary") == ["total number of reads:\t147", "mirna\t147"]
    ends = [x.split("\t") for x in lines(tmp_path / "reads.t0.5.canonical_end.summary") if not x.startswith("annotation_ID")]
    assert {x[0]: (x[1], x[2], x[8], x[9]) for x in ends} == {"m1": ("102", "102", "chr1:+:1522", "KEEP"), "m2": ("40", "40", "chr1:+:2022", "KEEP")}
    assert all(len(x.split("\t")) >= 19 for x in lines(tmp_path / "reads.t0.5.canonical_end")) and len(lines(tmp_path / "reads.t0.5.canonical_end")) == 3
    for name, n in (("anno_summary", 12), ("anno_summary.nosnp", 12), ("anno_summary.nosnp.snv-m100M100", 12), ("anno_summary.nosnp.snv-m100M100.phred30", 7)):
        s = readers.summary(spark, paths[name])
        assert [(r.anno_name, r.pos_from, r.alt, r.n) for r in readers.long_counts(s).collect()] == [("m1", 1523, OTHER[g[1522]], n)], name
        assert {r.anno_name: r.total_reads for r in s.collect()} == {"m1": 102, "m2": 40}
    out = files.write_cohort(spark, {("g", f"s{k}"): paths["anno_summary"] for k in range(2)}, str(tmp_path / "cohort"), Settings(samples=2))
    assert lines(tmp_path / "cohort" / "sample_count-r2-N2.sample_count")[-1].split("\t")[1:] == ["2", "2", "g"]
    assert any(x.split("\t")[0] == "annotation_name" for x in lines(tmp_path / "cohort" / "anno_summary.credible-r2-N2" / "grp=g" / "sample=s0"))
    assert {"nte5_counts", "nte3_counts", "internal_mm_counts", "internal_mm_compsition"} < set(out)


def test_writers_read_back(spark, inputs, tmp_path):
    d, _ = inputs
    p = files.sample(spark, f"{d}/reads.fa", f"{d}/genome.fa", f"{d}/list.txt", f"{d}/prio.txt")
    writers.tsv(writers.nte_sam(p.alignments), str(tmp_path / "sam"), header=False)
    keep = ["read_id", "abundance", "chrom", "strand", "read_start", "read_end", "seq", "nte5", "nte3", "nm", "md", "trim_step"]
    back = readers.nte_sam(spark, str(tmp_path / "sam"))
    assert sorted(map(tuple, back.select(keep).collect()), key=str) == sorted(map(tuple, p.alignments.select(keep).collect()), key=str)
    best = hits.extended(hits.best_hits(readers.psl(spark, f"{d}/hits.psl")))
    writers.tsv(writers.best_hits(best), str(tmp_path / "hits"), header=False)
    got = readers.best_hit_table(spark, str(tmp_path / "hits")).select("read_id", "chrom", "t_start", "t_end", "strand").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, best.select("q_name", "t_name", "t_start", "t_end", "strand").collect()))
    writers.query_fasta(p.annotated).write.text(str(tmp_path / "fa"))
    assert {(r.read_id, r.seq) for r in readers.fasta(spark, str(tmp_path / "fa")).collect()} == {(r.read_id, r.seq) for r in p.annotated.collect()}
    assert writers.query_fasta(p.annotated.withColumn("anno_name", F.lit("near-mirna-1")).withColumn("species", F.lit("tRf")), compat=True).count() == 4
    assert writers.repeat_bed(p.annotated).where("start0 = 1500").count() == 2
    (tmp_path / "man").write_text("# s\n/a /b\n/c\n")
    assert [tuple(r) for r in readers.sample_manifest(spark, str(tmp_path / "man")).orderBy("sample").collect()] == [(0, "all", "/a", "/b"), (1, "all", "/c", None)]


def test_snp_folders_are_chosen_by_chromosome(spark, tmp_path):
    (tmp_path / "snps").write_text("chr1 20511 G>C x\nchr2 7 A>T y\nchr2 20000007 A>T y\n")
    d = readers.snps(spark, str(tmp_path / "snps"))
    writers.snp_table(d, str(tmp_path / "table"))
    back = readers.snp_table(spark, str(tmp_path / "table"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
    assert "PartitionFilters: [isnotnull(chrom" in back.where("chrom = 'chr2'")._jdf.queryExecution().executedPlan().toString()
    assert back.where("chrom = 'chr2'").count() == 2


def test_aligner_options(spark, inputs, tmp_path):
    d, _ = inputs
    assert readers.aligner_options(spark, f"{d}/aligner.txt") == {"mismatches": 1, "most": 1}
    for bad in ("x -v 3 --best --strata", "x -v 1", "x -m 0 --best --strata"):
        with pytest.raises(ValueError):
            align.options(bad)
    assert [r[0] for r in align.rounds_of(three=True)] == [0, 1, 2] and [r[0] for r in align.rounds_of(five=True)] == [0, 3, 4] and align.rounds_of(both=True) == align.ROUNDS
    with pytest.raises(ValueError):
        align.rounds_of(three=True, five=True)


@pytest.mark.parametrize("bad", [{"level": 4}, {"quality": 43}, {"share": 2}, {"least_percent": 60, "most_percent": 40}, {"reads": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_a_sample_is_aligned_once(spark, inputs):
    """All results but the alignments read the stored alignments, and those of the canonical reads their table."""
    d, _ = inputs
    p = files.sample(spark, f"{d}/reads.fa", f"{d}/genome.fa", f"{d}/list.txt", f"{d}/prio.txt")
    for df in (p.depth, p.summary, p.modifications):
        read = df.inputFiles()
        assert not [f for f in read if "genome.fa" in f or "reads.fa" in f]
    assert all("/canonical-" in f or "/alignments-" in f for f in p.filtered_summary.inputFiles())


def test_a_cohort_s_reads_and_order_dependent_forms(spark, inputs, tmp_path):
    """Reads with nothing but credible modifications; known variants in both forms; the end-inward rule."""
    d, g = inputs
    (tmp_path / "snps.txt").write_text(f"chr1 1523 {g[1522]}>{OTHER[g[1522]]} known\n")
    make = lambda **s: files.sample(spark, f"{d}/reads.fa", f"{d}/genome.fa", f"{d}/list.txt", f"{d}/prio.txt", settings=Settings(**s), snps=f"{tmp_path}/snps.txt")
    p = make()
    assert p.counted.count() == 1 and p.without_snps.count() == 0
    assert make(compat=True).without_snps.select(p.counted.columns).collect() == p.counted.collect()  # the chromosome's first annotation
    assert make(snp_rule="end").without_snps.count() == 0
    with pytest.raises(ValueError, match="variant rule"):
        Settings(snp_rule="some")
    paths = files.write(p, str(tmp_path / "s"))
    name = next(k for k in paths if k.endswith("canonical_end"))
    keys = [("g", "s 1"), ("g", "s+2"), ("h", "s%203")]
    for need, want in ((1, ["p1|90", "p2|12", "p3|40"]), (99, ["p1|90", "p3|40"])):
        out = files.write_cohort(spark, dict.fromkeys(keys, paths["anno_summary"]), str(tmp_path / f"cohort{need}"), Settings(reads=need), reads=dict.fromkeys(keys, paths[name]))
        kept = readers.annotated_reads(spark, [f"{out[f'reads.credible-r{need}-N5']}/grp=g/sample=s 1"])
        assert sorted(r.read_id for r in kept.collect()) == want
        assert {(r.read_id, r.nte3_profile) for r in kept.collect() if r.nte3} == ({("p2|12", f"chr1:+:1523:{g[1522]}>{OTHER[g[1522]]}")} if need == 1 else set())


def test_a_cohort_of_many_samples_is_one_plan(spark, tmp_path):
    row = "m1\tmirna\tchr1\t+\t5\t26\t0\t140\t100\t40\t9333.3\t0\t19\t0\t0\t26:G>T:12|26-27:GA>TT:7\t0\n"

    def made(n):
        (tmp_path / str(n)).mkdir()
        samples = {}
        for k in range(n):
            (tmp_path / str(n) / f"{k}.txt").write_text("annotation_name\tspecies\n" + row)
            samples["g", f"s{k}"] = f"{tmp_path}/{n}/{k}.txt"
        whole = files._by_sample(readers.summary(spark, list(samples.values())), files.cohort_samples(spark, samples))
        return cohort_profiles(readers.long_counts(whole, ("grp", "sample")), Settings(samples=n))

    few, many = made(3), made(500)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert {k: size(v) for k, v in few.items()} == {k: size(v) for k, v in many.items()}
    assert {(r.alt, r.samples, r.total_samples) for r in many["support"].collect()} == {("T", 500, 500), ("TT", 500, 500)}
    assert many["nte3"].count() == 500 and many["credible"].count() == 1000


def test_hits_are_numbered_as_they_stand_in_the_file(spark, tmp_path):
    line = lambda name, start: f"22\t0\t0\t0\t0\t0\t0\t0\t+\t{name}\t22\t0\t22\tchr1\t900\t{start}\t{start + 22}\t1\t22,\t0,\t{start},\n"
    (tmp_path / "a.psl").write_text("".join(line(f"q{k % 50}|1", 7 * (997 * k % 1000)) for k in range(1000)))
    best = hits.best_hits(readers.psl(spark, f"{tmp_path}/a.psl")).repartition(7)
    first = best.groupBy("q_name").agg(F.min_by("t_start", "ordinal").alias("t")).collect()
    assert {r.q_name: r.t for r in first} == {f"q{k}|1": 7 * (997 * k % 1000) for k in range(50)}


def test_the_command_line(spark, inputs, tmp_path):
    from tailwright.__main__ import run

    d, _ = inputs
    got = run(spark, ["sample", "--reads", f"{d}/reads.fa", "--genome", f"{d}/genome.fa", "--annotations", f"{d}/list.txt", "--priority", f"{d}/prio.txt", "--snps", f"{d}/snps.txt", "--share", "0.4", "--out", f"{tmp_path}/a"])
    assert {"NTE.sam", "reads.t0.4.canonical_end", "anno_summary.nosnp"} <= set(got)
    (tmp_path / "g1.txt").write_text(f"{got['anno_summary']}\t{got['reads.t0.4.canonical_end']}\n" * 2)
    (tmp_path / "g2.txt").write_text(f"{got['anno_summary']}\n")
    made = run(spark, ["cohort", "--manifest", f"{tmp_path}/g1.txt", "--manifest", f"{tmp_path}/g2.txt", "--least-reads", "3", "--out", f"{tmp_path}/c"])
    assert {"sample_count-r3-N5.sample_count", "reads.credible-r3-N5", "nte3_counts"} <= set(made)
    assert sorted(x.split("\t")[1:] for x in lines(tmp_path / "c" / "sample_count-r3-N5.sample_count") if not x.startswith("modification")) == [["1", "1", "g2"], ["2", "2", "g1"]]
    for wrong in (["sample"], ["cohort", "--manifest", "x", "--out", "y", "--level", "9"], ["trim"]):
        with pytest.raises((SystemExit, ValueError)):
            run(spark, wrong)
