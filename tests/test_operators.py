"""Operators on planted cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tailwright.operators import align, annotate, cohort, ends, hits, intervals, phred, profiles, reads, summary, variants
from tailwright.plans.pipeline import Pipeline, cohort_profiles
from tests.test_functions import mir_rows


def flip(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute(reads_, chroms, rounds=align.ROUNDS):
    """First round with a unique best place, by comparing with every window."""
    out = {}
    for name, seq in reads_.items():
        for step, five, three, _ in rounds:
            s = seq[five : len(seq) - three]
            found = []
            for c, g in chroms.items():
                for strand, q in (("+", s), ("-", flip(s))):
                    found += [(sum(a != b for a, b in zip(q, g[i : i + len(q)], strict=True)), c, strand, i + 1) for i in range(len(g) - len(q) + 1)]
            found = [f for f in found if f[0] <= 1]
            best = [f for f in found if f[0] == min(found)[0]] if found else []
            if len(best) == 1:
                out[name] = (step, *best[0])
                break
    return out


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(5)
    g = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("chr1", 3100), ("chr2", 1500))}
    g["chr2"] = g["chr2"][:700] + g["chr1"][200:260] + g["chr2"][760:]  # a repeat, so that some reads map twice
    return g


@pytest.fixture(scope="module")
def simulated(genome):
    rng = random.Random(6)
    out = {}
    for k in range(150):
        c = rng.choice(list(genome))
        n = rng.randint(13, 40) if k % 3 == 0 else rng.randint(20, 28)
        a = rng.randrange(0, len(genome[c]) - n)
        s = genome[c][a : a + n] if k % 2 else flip(genome[c][a : a + n])
        if k % 5 == 1:
            s = s + rng.choice(["A", "TT", "AA"])
        if k % 5 == 2:
            s = rng.choice(["G", "TT"]) + s
        if k % 5 == 3:
            i = rng.randrange(3, n - 3)
            s = s[:i] + rng.choice("ACGT") + s[i + 1 :]
        if k % 10 == 9:
            s = "G" + s + "T"
        out[f"r{k}|{k + 1}"] = s
    return out


def test_trim_cascade_equals_brute_force(spark, genome, simulated):
    g = spark.createDataFrame([(c, 1, s) for c, s in genome.items()], "chrom string, offset bigint, seq string")
    r = spark.createDataFrame([(k, int(k.split("|")[1]), s) for k, s in simulated.items()], "read_id string, abundance bigint, seq string")
    got = {x.read_id: (x.step, x.nm, x.chrom, x.strand, x.start) for x in align.trim_cascade(r, align.tiles(g)).collect()}
    assert got == brute(simulated, genome)


def test_short_reads_have_places(spark, genome):
    """Every length from 12 on, at every offset of a tile's end, each place once."""
    g = genome["chr1"]
    t = align.tiles(spark.createDataFrame([("chr1", 1, g)], "chrom string, offset bigint, seq string"))
    want, rows = {}, []
    for n in (12, 13, 15, 16, 19, 22, 27, 28, 45):
        for a in (0, 985, 990, 995, 999, 1000, 1003, len(g) - n):
            for at in (None, 1, n // 2 - 1, n // 2, n - 2):
                s = g[a : a + n]
                s = s if at is None else s[:at] + {"A": "C", "C": "A", "G": "T", "T": "G"}[s[at]] + s[at + 1 :]
                s = s if a % 2 else flip(s)
                rows.append((s, s))
                want[s] = sorted((sum(x != y for x, y in zip(q, g[i : i + n], strict=True)), strand, i + 1) for strand, q in (("+", s), ("-", flip(s))) for i in range(len(g) - n + 1) if sum(x != y for x, y in zip(q, g[i : i + n], strict=True)) <= 1)
    got = {}
    for r in align.places(spark.createDataFrame(rows, "query string, seq string").distinct(), t).collect():
        got.setdefault(r.query, []).append((r.mm, r.strand, r.start))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_resolved_ends(spark, genome):
    g = genome["chr1"]
    t = align.tiles(spark.createDataFrame([("chr1", 1, g)], "chrom string, offset bigint, seq string"))
    other = lambda b: {"A": "C", "C": "A", "G": "T", "T": "G"}[b]
    cases = {
        "plain": g[1000:1022],
        "three": g[1000:1022] + other(g[1022]) + other(g[1023]),
        "five": other(g[998]) + other(g[999]) + g[1000:1022],
        "minus": flip(g[1000:1022]) + flip(other(g[999])),
        "inside": g[1000:1010] + other(g[1010]) + g[1011:1022],
    }
    r = spark.createDataFrame([(k, 1, s) for k, s in cases.items()], "read_id string, abundance bigint, seq string")
    got = {x.read_id: x for x in align.resolve_ends(align.trim_cascade(r, t), t).collect()}
    assert set(got) == set(cases)
    assert (got["plain"].nte5, got["plain"].nte3, got["plain"].md) == (None, None, "22")
    assert got["three"].nte3 == cases["three"][-2:] and got["three"].nte5 is None and got["three"].read_end == 1024
    assert got["three"].md == f"22{g[1022]}0{g[1023]}0"
    assert got["five"].nte5 == cases["five"][:2] and got["five"].read_start == 999
    assert got["minus"].nte3 == cases["minus"][-1] and got["minus"].strand == "-" and got["minus"].read_start == 1000
    assert got["inside"].nte3 is None and got["inside"].md == f"10{g[1010]}11"


def test_a_read_off_the_genome_is_dropped(spark):
    t = align.tiles(spark.createDataFrame([("chr1", 1, "ACGTTGCAACGGTTAACCGGTATT")], "chrom string, offset bigint, seq string"))
    m = spark.createDataFrame([("x", 1, "TTACGTTGCAACGGTTAACCGG", "chr1", "+", 1, 0, 2, 0, "five-trim-2")], "read_id string, abundance bigint, seq string, chrom string, strand string, start bigint, nm int, trim5 int, trim3 int, trim_step string")
    assert align.resolve_ends(m, t).count() == 0


ANNO = "chrom string, strand string, anno_start bigint, anno_end bigint, anno_name string, aid bigint, species string"


def aligned(spark):
    return mir_rows(spark).withColumn("abundance", F.split_part("read_id", F.lit("|"), F.lit(2)).cast("long"))


def annos(spark):
    return spark.createDataFrame([("chr13", "-", 7030312, 7030333, "mir", 0, "mirna"), ("chr13", "-", 7030304, 7030384, "long", 1, "piRNA"), ("chr13", "+", 7030312, 7030333, "wrong strand", 2, "mirna")], ANNO)


def prio(spark):
    return spark.createDataFrame([("mirna", 0), ("tRf", 1), ("piRNA", 2)], "species string, rnk int")


def test_annotation_summary_of_one_mirna(spark):
    reads_ = annotate.with_profiles(annotate.annotate(aligned(spark), annos(spark), prio(spark)))
    depth = reads.library_depth(aligned(spark))
    r = summary.annotation_summary(reads_, depth).collect()
    assert len(r) == 1
    assert (r[0].anno_name, r[0].total_reads, r[0].perfect_reads, r[0].total_nte5, r[0].total_nte3) == ("mir", 132, 108, 11, 24)
    assert r[0].nte3 == "7030311-7030310:AA>TT:3|7030312:A>C:10|7030312:A>T:11" and r[0].nte5 == "7030334:A>T:11" and r[0].rpm == 1e6


def test_priority_falls_back_on_file_order(spark):
    tie = annos(spark).withColumn("species", F.lit("unlisted"))
    assert {r.anno_name for r in annotate.annotate(aligned(spark), tie, prio(spark)).collect()} == {"mir"}


def test_repeated_alignments_and_unlisted_classes(spark):
    """Equal rows stay apart, and a class that isn't listed comes after all that are, however many these are."""
    many = spark.createDataFrame([(f"c{k}", k) for k in range(150)] + [("mirna", 150)], "species string, rnk int")
    two = aligned(spark).union(aligned(spark).where("read_id = 'c|10'"))
    names = annos(spark)
    other = names.where(F.col("species") == "mirna").limit(1).withColumns({"species": F.lit("unlisted"), "aid": F.lit(-1).cast(names.schema["aid"].dataType), "anno_name": F.lit("first in the file")})
    got = annotate.annotate(two, names.unionByName(other), many)
    assert got.where("read_id = 'c|10'").count() == 2 and got.where("species = 'unlisted'").count() == 0


def test_empty_inputs_give_empty_results(spark):
    none = aligned(spark).where("false")
    a = annotate.with_profiles(annotate.annotate(none, annos(spark), prio(spark)))
    assert a.count() == 0 and summary.modification_counts(a).count() == 0 and ends.canonical_reads(a).count() == 0
    assert hits.concordance_summary(hits.concordance(a, spark.createDataFrame([], "read_id string, chrom string, strand string, full_start bigint, full_end bigint, ordinal bigint"))).select("sequences_percent").first()[0] is None


def test_canonical_end(spark):
    rows = [("x|7", 7, "mir", 100, None), ("y|3", 3, "mir", 101, None), ("z|1", 1, "tie", 200, None), ("w|1", 1, "tie", 199, None), ("v|6", 6, "mir", 101, "A")]
    df = spark.createDataFrame([(i, n, a, "chr1", "+", 80, e, t) for i, n, a, e, t in rows], "read_id string, abundance bigint, anno_name string, chrom string, strand string, read_start bigint, read_end bigint, nte3 string")
    s = {r.anno_name: (r.canonical_end, r.canonical_reads, r.total_reads, r.decision) for r in ends.canonical_summary(df).collect()}
    assert s == {"mir": (100, 13, 16, "KEEP"), "tie": (199, 1, 2, "KEEP")}
    assert {r.read_id for r in ends.canonical_reads(df).collect()} == {"x|7", "v|6", "w|1"}


def test_repeats_at_the_edges(spark):
    a = spark.createDataFrame([("in|1", "chr1", 11, 20), ("before|1", "chr1", 1, 10), ("after|1", "chr1", 21, 30), ("far|1", "chr1", 999, 1002)], "read_id string, chrom string, read_start bigint, read_end bigint")
    r = spark.createDataFrame([("chr1", 10, 20), ("chr1", 1000, 1001)], "chrom string, start0 bigint, end0 bigint")
    assert {x.read_id for x in intervals.repeat_reads(a, r).collect()} == {"in|1", "far|1"}
    assert {x.read_id for x in intervals.without_repeats(a, r).collect()} == {"before|1", "after|1"}
    none = r.where("false")
    assert intervals.without_repeats(a, none).count() == 4 and intervals.without_repeats(a, none, compat=True).count() == 0 and intervals.without_repeats(a, r, compat=True).count() == 4


MODS = "anno_name string, mod_type int, chrom string, strand string, pos_from bigint, pos_to bigint, ref string, alt string, n bigint"


def test_variants(spark):
    m = spark.createDataFrame([("a", 1, "chr1", "+", 10, 11, "AC", "TT", 5), ("a", 1, "chr1", "-", 21, 20, "AC", "TT", 4), ("a", 2, "chr1", "+", 30, 30, "A", "G", 10)], MODS)
    snp = spark.createDataFrame([("chr1", 11, "C", "T"), ("chr1", 20, "G", "C")], "chrom string, pos bigint, ref string, alt string")
    assert {r.pos_from for r in variants.without_snps(m, snp).collect()} == {21, 30}
    assert {r.pos_from for r in variants.without_snps(m, spark.createDataFrame([("chr1", 20, "G", "A")], "chrom string, pos bigint, ref string, alt string")).collect()} == {10, 30}
    total = spark.createDataFrame([("a", 10)], "anno_name string, total_reads bigint")
    assert {r.n for r in variants.without_zygous(m, total, 50, 60).collect()} == {4}
    assert {r.n for r in variants.without_zygous(m, total, 100, 100).collect()} == {4, 5}


def test_quality_recount(spark):
    a = annotate.with_profiles(annotate.annotate(aligned(spark), annos(spark), prio(spark)))
    m = summary.modification_counts(a)
    rna = flip("GGACCGATCTTAGGACCATGTT")
    fq = spark.createDataFrame([("q1", rna, "I" * 22), ("q2", rna, "I" * 21 + "#"), ("q3", rna, "#" * 21 + "I"), ("q4", "ACGT", "IIII")], "name string, seq string, qual string")
    got = phred.recount(a, m, fq, 30).collect()
    assert [(r.alt, r.n) for r in got] == [("C", 2)]
    with pytest.raises(ValueError):
        phred.good_mask(F.col("qual"), 43)


def test_cohort_thresholds(spark):
    rows = [("g", s, "a", 5, n) for s, n in (("s1", 3), ("s2", 2), ("s3", 1))] + [("g", "s1", "b", 6, 9), ("h", "s9", "a", 5, 2)]
    df = spark.createDataFrame(rows, "grp string, sample string, anno_name string, pos bigint, n bigint")
    key = ["anno_name", "pos"]
    s = {(r.grp, r.anno_name): (r.samples, r.total_samples) for r in cohort.support(df, key).collect()}
    assert s == {("g", "a"): (2, 3), ("g", "b"): (1, 3), ("h", "a"): (1, 1)}
    assert {(r.grp, r.sample) for r in cohort.credible_counts(df, key, 2, 2).collect()} == {("g", "s1"), ("g", "s2"), ("h", "s9")}


def test_matrices_sum_to_what_they_show(spark):
    m = spark.createDataFrame([("a", "A", "T", 3), ("a", "A", "TT", 2), ("a", "A", "AN", 4), ("a", "A", "CCCC", 8), ("b", "G", "C", 1)], "anno_name string, ref string, alt string, n bigint")
    k = {r.anno_name: r.asDict() for r in profiles.kmer_matrix(m, ["anno_name"]).collect()}
    assert (k["a"]["U"], k["a"]["UU"], k["a"]["Ns"], sum(v for x, v in k["a"].items() if x != "anno_name")) == (3, 2, 4, 9)
    x = {r.anno_name: r.asDict() for r in profiles.substitution_matrix(m, ["anno_name"]).collect()}
    assert x["a"]["A>U"] == 3 and x["b"]["G>C"] == 1


def test_stringency_levels(spark):
    a = annotate.with_profiles(annotate.annotate(aligned(spark), annos(spark), prio(spark)))
    a = a.unionByName(a.where("read_id = 'c|10'").withColumn("read_id", F.lit("e|2")))
    h = spark.createDataFrame([(i, "chr13", "+", s, e, k) for k, (i, s, e) in enumerate([("a|108", 7030312, 7030333), ("c|10", 7030312, 7030333), ("e|2", 1, 22), ("d|11", 7030312, 7030334), ("d|11", 5, 27)])], "read_id string, chrom string, strand string, full_start bigint, full_end bigint, ordinal bigint")
    j = hits.concordance(a, h)
    assert {r.read_id: r.consensus for r in j.collect()} == {"a|108": "CORRECT", "c|10": "CORRECT", "e|2": "DIFF-UNIQ", "d|11": "SAME-MULTIMAPP", "b|3": "NO_BLAT_RESULT"}
    nte = lambda level: {r.read_id: r.nte3 for r in hits.stringency(j, level).collect()}
    assert nte(1) == {"a|108": None, "c|10": "C"} and nte(2) == {"a|108": None, "c|10": None} and nte(3) == nte(2)


def test_planted_truth_end_to_end(spark, genome):
    g = genome["chr1"]
    other = lambda b: {"A": "C", "C": "A", "G": "T", "T": "G"}[b]
    names = spark.createDataFrame([("chr1", "+", 1501, 1522, "m1", 0, "mirna"), ("chr1", "+", 2001, 2022, "m2", 1, "mirna")], ANNO)
    planted = {"p1|90": g[1500:1522], "p2|12": g[1500:1522] + other(g[1522]), "p3|40": g[2000:2022], "p4|5": g[2000:2021] + other(g[2021])}
    r = spark.createDataFrame([(k, int(k.split("|")[1]), s) for k, s in planted.items()], "read_id string, abundance bigint, seq string")
    p = Pipeline.from_reads(r, spark.createDataFrame([("chr1", 1, g)], "chrom string, offset bigint, seq string"), names, prio(spark))
    m = {(x.anno_name, x.pos_from, x.alt): x.n for x in p.modifications.collect()}
    assert m == {("m1", 1523, other(g[1522])): 12}  # p4 ends elsewhere than the commonest end
    assert {x.anno_name: x.total_reads for x in p.summary.collect()} == {"m1": 102, "m2": 40}
    both = F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("sample")
    wide = cohort_profiles(p.modifications.select(F.lit("g").alias("grp"), both, *p.modifications.columns))
    assert wide["credible"].count() == 2 and wide["support"].first().samples == 2


def mods(spark, rows):
    return spark.createDataFrame([("a", *r) for r in rows], "anno_name string, mod_type int, chrom string, strand string, pos_from long, pos_to long, ref string, alt string, n long")


def test_modifications_are_cut_at_variants(spark):
    """From the RNA's end inward the first variant stops; what lies outside it is kept, and equal rests are added up."""
    m = mods(spark, [
        (1, "c", "+", 10, 12, "ACG", "TTT", 5), (1, "c", "+", 11, 12, "CG", "TT", 7), (1, "c", "+", 12, 12, "G", "T", 1), (1, "c", "+", 20, 21, "AC", "GG", 2),
        (1, "c", "-", 32, 30, "ACG", "TTT", 3), (0, "c", "+", 40, 42, "ACG", "TTT", 4), (0, "c", "-", 52, 50, "ACG", "TTT", 6), (2, "c", "+", 60, 60, "A", "T", 8), (2, "c", "+", 61, 61, "A", "T", 9),
    ])
    v = spark.createDataFrame([("c", 10, "A", "T"), ("c", 11, "C", "T"), ("c", 21, "C", "G"), ("c", 31, "G", "A"), ("c", 41, "C", "T"), ("c", 52, "T", "A"), ("c", 60, "A", "T"), ("c", 61, "A", "C"), ("d", 61, "A", "T")], "chrom string, pos long, ref string, alt string")
    got = variants.cut_at_snps(m, v)
    assert got.columns == m.columns
    assert sorted(map(tuple, got.drop("anno_name", "chrom").collect())) == [
        (0, "+", 40, 40, "A", "T", 4),
        (1, "+", 12, 12, "G", "T", 13),
        (1, "-", 30, 30, "G", "T", 3),
        (2, "+", 61, 61, "A", "T", 9),
    ]
    assert sorted(map(tuple, variants.cut_at_snps(m, v.limit(0)).collect())) == sorted(map(tuple, m.collect()))


def slow_pairs(a, b, slack):
    return sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] - slack <= y[3] and y[2] <= x[3] + slack)


@pytest.fixture(scope="module")
def wide_and_narrow(spark):
    rng = random.Random(8)
    lengths = [1, 2, 20, 400, 1023, 1024, 1025, 20_000, 300_000, 5_000_000]
    make = lambda n, long: [(k, f"chr{rng.randint(1, 2)}", a := rng.choice([1, 1024, 1025, 16_384, 1 << 22, rng.randint(1, 8_000_000)]), a + rng.choice(lengths if long else lengths[:6]) - 1) for k in range(n)]
    a, b = make(250, True), make(250, True)
    return a, b, spark.createDataFrame(a, "id long, chrom string, low long, high long"), spark.createDataFrame(b, "b_id long, b_chrom string, b_low long, b_high long")


@pytest.mark.parametrize("slack", [0, 1, 700])
def test_overlaps_equal_brute_force(wide_and_narrow, slack):
    a, b, x, y = wide_and_narrow
    got = intervals.overlap_pairs(x, y, slack)
    assert sorted(map(tuple, got.select("id", "b_id").collect())) == slow_pairs(a, b, slack)
    semi = intervals.overlap_pairs(x, y, slack, "left_semi")
    assert semi.columns == x.columns and sorted(r.id for r in semi.collect()) == sorted({p[0] for p in slow_pairs(a, b, slack)})


def test_nearest_equals_brute_force(wide_and_narrow):
    a, b, x, y = wide_and_narrow
    got = {r.id: (r.distance, tuple(r.near) if r.near else None) for r in intervals.nearest(x, y, 700).collect()}
    for k, c, low, high in a:
        d = [(max(0, bl - high, low - bh), (bl, bh, j)) for j, bc, bl, bh in b if bc == c]
        d = [p for p in d if p[0] <= 700]
        assert got[k] == (min(d) if d else (None, None))


def test_rows_into_interval_joins_grow_with_the_intervals(spark, wide_and_narrow):
    _, b, x, y = wide_and_narrow
    own = intervals.at_own_level(y, F.col("b_low"), F.col("b_high"))
    assert own.count() <= 2 * len(b) and own.groupBy("b_id").count().where("count > 2").count() == 0
    points = intervals.at_levels(x, F.col("low"), intervals.levels_in(own))
    assert points.count() <= len(intervals.SHIFTS) * x.count()
    short = spark.createDataFrame([(1, "chr1", 5, 30)], "b_id long, b_chrom string, b_low long, b_high long")
    assert intervals.at_levels(x, F.col("low"), intervals.levels_in(intervals.at_own_level(short, F.col("b_low"), F.col("b_high")))).count() == x.count()
    for name, df in (("x", x), ("y", y)):
        df.createOrReplaceTempView(f"intervals_{name}")
    plan = intervals.overlap_pairs(x, y)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_packed_words_count_mismatches(spark):
    from tailwright.functions import packed

    rng = random.Random(3)
    rows = []
    for n in (1, 12, 30, 31, 32, 62, 63, 100):
        for letters in ("ACGT", "ACGTN"):
            a = "".join(rng.choice(letters) for _ in range(n))
            b = "".join(rng.choice(letters) if rng.random() < 0.3 else c for c in a)
            rows.append((a, b, sum(p != q or p == "N" for p, q in zip(a, b, strict=True))))
    got = spark.createDataFrame(rows, "a string, b string, want int").withColumn("got", packed.text_mismatches(F.col("a"), F.col("b")))
    assert all(r.got == r.want for r in got.collect())


def test_places_with_letters_that_are_no_bases_and_long_reads(spark, genome):
    g = genome["chr1"][:400] + "NN" + genome["chr1"][402:]
    t = align.tiles(spark.createDataFrame([("chr1", 1, g)], "chrom string, offset bigint, seq string"))
    swap = lambda s, k: s[:k] + {"A": "C", "C": "A", "G": "T", "T": "G"}[s[k]] + s[k + 1 :]
    cases = {"one N": (g[402:430][:9] + "N" + g[402:430][10:], 403, 1), "genome's N": (genome["chr1"][401:425], 402, 1), "both N": (genome["chr1"][395:420], None, None), "long": (g[600:700], 601, 0), "long, last": (swap(g[600:700], 99), 601, 1), "long, first": (swap(g[600:731], 0), 601, 1), "long, two": (swap(swap(g[600:700], 50), 99), None, None), "over the margin": (g[900:1110], None, None)}
    q = spark.createDataFrame([(k, s) for k, (s, _, _) in cases.items()], "query string, seq string")
    got = {r.query: (r.start, r.mm) for r in align.places(q, t).where("strand = '+'").collect()}
    got.pop("over the margin", None)
    assert got == {k: (a, m) for k, (_, a, m) in cases.items() if a}


def test_saved_seeds_are_not_shuffled_again(spark, genome, simulated):
    import tempfile

    g = spark.createDataFrame([(c, 1, s) for c, s in genome.items()], "chrom string, offset bigint, seq string")
    t = align.tiles(g)
    name = "seeds_of_test"
    spark.sql(f"drop table if exists {name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = tempfile.mkdtemp(prefix="seeds-")
        index = align.save_seeds(t, name, 4, path=path)
        q = spark.createDataFrame([(k, s) for k, s in simulated.items()], "query string, seq string")
        want = sorted(map(tuple, align.places(q, t).collect()))
        found = align.places(q, t, index=index)
        assert sorted(map(tuple, found.collect())) == want
        short = found._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount" in short or "Bucketed: true" in short
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table if exists {name}")


def slow_stretch(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(i + 1, len(a) + 1):
            v = sum(1 if x == y else -1 for x, y in zip(a[i:j], b[i:j], strict=True))
            if v > best[0] or v == best[0] and v and (j, j - i) < (best[2], best[2] - best[1]):
                best = (v, i, j)
    return best


def test_hits_without_gaps_equal_brute_force(spark, genome):
    from tailwright.operators import ungapped

    rng = random.Random(12)
    g = {"chr1": genome["chr1"][:600], "chr2": genome["chr2"][600:900]}
    queries = {}
    for k in range(25):
        c = rng.choice(list(g))
        a = rng.randrange(len(g[c]) - 40)
        s = "".join(rng.choice("ACGT") if rng.random() < 0.1 else x for x in g[c][a : a + rng.randint(14, 40)])
        queries[f"q{k}"] = s if k % 2 else flip(s)
    queries["short"], queries["none"] = "ACGTACG", "ACGTN" * 5
    t = align.tiles(spark.createDataFrame([(c, 1, s) for c, s in g.items()], "chrom string, offset bigint, seq string"))
    want = set()
    for q, seq in queries.items():
        for strand, s in (("+", seq), ("-", flip(seq.replace("N", "A")) if "N" not in seq else "")):
            for c, ref in g.items():
                for at in range(len(ref) - len(s) + 1 if s else 0):
                    r = ref[at : at + len(s)]
                    if any(s[i : i + 9] == r[i : i + 9] for i in range(len(s) - 8)):
                        v, b, e = slow_stretch(s, r)
                        if v >= 10:
                            want.add((q, strand, c, at + b, v, e - b))
    got = ungapped.ungapped_hits(spark.createDataFrame(list(queries.items()), "query string, seq string"), t, seed=9, score=10)
    assert {(r.q_name, r.strand, r.t_name, r.t_start, r.matches - r.mismatches, r.t_end - r.t_start) for r in got.collect()} == want
    best = hits.extended(hits.best_hits(got)).groupBy("q_name").count()
    assert best.count() == len({w[0] for w in want}) >= 20


def test_quality_words(spark):
    rng = random.Random(2)
    rows = []
    for n in (1, 20, 61, 62, 63, 124, 125, 150):
        for _ in range(12):
            q = "".join(rng.choice("#5?@I") for _ in range(n))
            at = sorted(rng.sample(range(n + 3), min(n, rng.randint(1, 3))))
            rows.append((q, at, all(i < n and ord(q[i]) - 33 >= 30 for i in at)))
    d = spark.createDataFrame(rows, "q string, at array<int>, want boolean")
    assert all(r.got == r.want for r in d.withColumn("got", phred.all_good(phred.good_words(F.col("q"), 30), phred.needed_words(F.col("at")))).collect())


def test_variants_out_of_reach_are_not_read(spark, tmp_path):
    from tailwright.sources import readers, writers

    snps = spark.range(40_000).select(F.concat(F.lit("chr"), F.col("id") % 4).alias("chrom"), (F.col("id") + 1).alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.lit("known").alias("source"))
    writers.snp_table(snps, str(tmp_path / "snps"))
    known = readers.snp_table(spark, str(tmp_path / "snps"))
    m = mods(spark, [(1, "chr1", "+", 5002, 5002, "A", "T", 5), (1, "chr1", "-", 6007, 6006, "TT", "AA", 5), (1, "chr3", "+", 9000, 9000, "A", "G", 1)])
    near = variants.within_reach(known, m)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((chrom" in plan.replace("isnotnull(chrom#", "") and "GreaterThanOrEqual(pos,5002)" in plan
    assert near.count() == sum(1 for k in range(40_000) if k % 4 == 1 and 5002 <= k + 1 <= 6007 or k % 4 == 3 and k + 1 == 9000)
    assert {f.split("chrom=")[1][:4] for f in near.inputFiles()} <= {"chr0", "chr1", "chr2", "chr3"}
    both = [sorted(map(tuple, variants.without_snps(m, s).collect())) for s in (known, near)]
    assert both[0] == both[1] and [r[0] for r in both[0]] == ["chr3"]
    assert variants.within_reach(known, m.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
def test_second_hits_are_made_of_the_annotated_reads(spark):
    """Not by a join on chromosome and strand alone, and those reads are derived once."""
    from tailwright.plans import queries as q

    d = "/root/testdata/sf0.001"
    own = q.second_hits(q.stored(spark, d))
    want = q.bridge(spark, d, "blat")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.select(*own.columns).collect()))
    for judged in (q.judged(spark, d), q.QUERIES["concordance_compat"](spark, d)):
        assert "lineitem" not in judged._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in judged.inputFiles())


@pytest.mark.parametrize("slack", [0, 1, 200])
def test_nearest_of_crowded_intervals_equals_brute_force(spark, slack):
    rng = random.Random(slack)
    a = [(k, "c", p := rng.randint(-40, 900), p + rng.choice([0, 0, 1, 30, 300])) for k in range(150)]
    b = [(k, "c", p := rng.choice([rng.randint(-60, 60), rng.randint(1000, 1400)]), p + rng.choice([0, 1, 7, 8, 63, 64, 500])) for k in range(60)]
    x, y = spark.createDataFrame(a, "id long, chrom string, low long, high long"), spark.createDataFrame(b, "b_id long, b_chrom string, b_low long, b_high long")
    got = {r.id: (r.distance, tuple(r.near) if r.near else None) for r in intervals.nearest(x, y, slack).collect()}
    for k, _, low, high in a:
        d = [(g, (bl, bh, j)) for j, _, bl, bh in b if (g := max(0, bl - high, low - bh)) <= slack]
        assert got[k] == (min(d) if d else (None, None))


def test_interval_joins_do_not_meet_at_wide_levels(spark):
    """Narrow intervals of both sides are compared in narrow bins only, however wide others are; and the nearest one is
    found without pairs."""
    n = 3000
    a = spark.range(n).selectExpr("id", "'c' chrom", "id * 5000 low", "id * 5000 + 20 high")
    b = spark.range(n).selectExpr("id b_id", "'c' b_chrom", "id * 5000 + 10 b_low", "case when id = 0 then 40000000 else id * 5000 + 30 end b_high")
    keys = intervals.overlap_keys(a, b)
    met = keys[0].groupBy("chrom", "side", "level", "bin").count().withColumnRenamed("count", "n").join(keys[1].groupBy(F.col("b_chrom").alias("chrom"), F.col("b_side").alias("side"), F.col("b_level").alias("level"), F.col("b_bin").alias("bin")).count(), ["chrom", "side", "level", "bin"]).agg(F.sum(F.col("n") * F.col("count"))).first()[0]
    assert met < 20 * n
    assert intervals.overlap_pairs(a, b).count() == 2 * n - 1


def test_diagonals_without_a_score_are_dropped_in_the_join(spark):
    """Hits equal those of every diagonal tried, over tiles' edges and letters that no base is; few rows reach the fetch."""
    from tailwright.operators import ungapped

    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    genome = genome[:200] + "N" + genome[201:]
    turn = str.maketrans("ACGT", "TGCA")
    queries = []
    for k in range(40):
        p, n = rng.randint(0, 330), rng.choice([11, 14, 30, 31, 32, 45, 70])
        text = list(genome[p : p + n])
        for i in rng.sample(range(n), rng.choice([0, 1, 2, 4]) if n > 14 else 0):
            text[i] = rng.choice("ACGTN")
        text = "".join(text)
        queries.append((k, text if k % 2 else text[::-1].translate(turn)))
    tiled = align.tiles(spark.createDataFrame([("c", 1, genome)], "chrom string, offset long, seq string"), 50, 80)
    got = {(r.q_name, r.strand, r.t_start - r.q_start, r.matches - r.mismatches) for r in ungapped.ungapped_hits(spark.createDataFrame(queries, "query long, seq string"), tiled, 11, 13, 50).collect()}
    want = set()
    for k, seq in queries:
        for strand, text in (("+", seq), ("-", seq[::-1].translate(turn))):
            for p in range(len(genome) - len(text) + 1):
                same = [a == b and a in "ACGT" for a, b in zip(text, genome[p : p + len(text)], strict=True)]
                if not any(all(same[i : i + 11]) for i in range(len(same) - 10)):
                    continue
                run = best = 0
                for s in same:
                    run = max(run, 0) + (1 if s else -1)
                    best = max(best, run)
                if best >= 13:
                    want.add((k, strand, p, best))
    assert got == want and len(want) > 30


def test_many_small_ranges_of_fastq_grow(tmp_path):
    from tailwright.sources import fastq

    path = tmp_path / "a.fastq"
    path.write_text("@a\nAC\n+\nII\n" * 5000)
    parts = fastq.FastqReader({"path": str(path), "rangeBytes": "2"}).partitions()
    assert len(parts) <= fastq.RANGES and parts[0].start == 0 and parts[-1].end == path.stat().st_size
    assert all(x.end == y.start for x, y in zip(parts, parts[1:], strict=False))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
def test_the_genome_is_not_sent_whole(spark):
    from tailwright.plans import queries as q

    for name in ("library_depth", "genome_lookup"):
        plan = q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan, name


def test_reads_are_looked_up_once_for_all_rounds(spark):
    """Two probes a read, one a strand, whatever the rounds; short reads one for each; and no more levels than the genome needs."""
    r = spark.createDataFrame([(1, "ACGTTGCAACGTTGCAACGTT"), (2, "ACGTTGCAACGTTGCA")], "row long, seq string")
    got = {x.row: x["count"] for x in align._probes(r, align.ROUNDS, 2).groupBy("row").count().collect()}
    assert got == {1: 2, 2: 12}
    t = align.tiles(spark.createDataFrame([("c", 1, "ACGT" * 500)], "chrom string, offset bigint, seq string"))
    assert align._enough(align.LEVELS, t) == (12,)


def test_trim_cascade_at_edges_equals_that_by_index(spark):
    """Reads of every length around the ends of pieces and tiles, some with letters exchanged, added or that are no bases."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pieces = [("a", 1, text(2300)), ("a", 2301, text(64)), ("b", 500, text(64)), ("b", 2000, text(1003)), ("b", 3500, text(500) + "N" + text(500))]
    t = align.tiles(spark.createDataFrame(pieces, "chrom string, offset bigint, seq string"))
    seqs = set()
    for _, _, g in pieces:
        for at in {0, 1, 2, 3, 490, 497, 985, 996, 998, 999, 1000, 1001, 1002, 1990, len(g) - 24, len(g) - 18}:
            for n in (14, 17, 18, 19, 20, 22, 24, 29, 31, 32, 33, 34, 60):
                s = g[max(at, 0) : at + n] if at >= 0 else ""
                if len(s) < 13:
                    continue
                k = rng.randrange(7)
                if k in (1, 2):
                    i = rng.randrange(len(s))
                    s = s[:i] + rng.choice("ACGTN") + s[i + 1 :]
                s = {3: text(1) + s, 4: s + text(2), 5: text(1) + s + text(1), 6: text(2) + s}.get(k, s)
                seqs.add(s if rng.random() < 0.5 else flip(s))
    r = spark.createDataFrame([(f"r{i}", 1, s) for i, s in enumerate(sorted(seqs))], "read_id string, abundance bigint, seq string")
    found = align.trim_cascade(r, t)
    want = align.trim_cascade(r, t, index=align.seeds(t))
    assert found.columns == want.columns
    a, b = sorted(map(tuple, found.collect())), sorted(map(tuple, want.collect()))
    assert a == b and len(a) > len(seqs) // 2 and len({x[3] for x in a}) == 6


def test_best_ungapped_hits_are_the_best_of_all(spark):
    """Two seeds a strand settle queries with a nearly whole hit, ties and several sequences of one name included; others get every seed."""
    from tailwright.operators import ungapped

    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b = text(700), text(500)
    b = b[:200] + a[100:160] + b[260:300] + "N" + b[301:]  # a repeat, so that some have two best hits
    t = align.tiles(spark.createDataFrame([("c", 1, a), ("c", 701, b), ("d", 1, text(40))], "chrom string, offset long, seq string"), 50, 80)
    rows = []
    for k in range(160):
        g, n = rng.choice((a, b)), rng.choice((14, 18, 19, 20, 21, 24, 30, 33, 36, 48, 70))
        p = rng.randint(0, len(g) - n) if k % 4 else (100 if g is a else 200)
        s = list(g[p : p + n])
        wrong = {0: [], 1: [0], 2: [n - 1], 3: [0, n - 1], 4: [0, 1], 5: [n - 2, n - 1], 6: [n // 2], 7: [n // 2 - 1, n - 2], 8: rng.sample(range(n), 3)}[k % 9]
        for i in wrong:
            s[i] = rng.choice([x for x in "ACGTN" if x != s[i]])
        rows.append((k // 2 * 2 if k % 10 == 9 else k, "".join(s) if k % 2 else flip("".join(s))))
    q = spark.createDataFrame(rows, "query long, seq string")
    full = spark.createDataFrame([(r[0], r[1]) for r in rows if len(r[1]) == 36 and r[0] % 9 < 7], "query long, seq string")
    for some, seed, score in ((q, 9, 12), (full, 9, 12), (q, 11, 34), (q.where(F.length("seq") < 19), 9, 10), (q.limit(0), 9, 12)):
        want = hits.best_hits(ungapped.ungapped_hits(some, t, seed, score, 50))
        got = ungapped.best_ungapped_hits(some, t, seed, score, 50)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 0


def test_a_nearly_whole_hit_is_found_by_two_seeds_a_strand(spark, monkeypatch):
    """Not by every k-mer, whose meetings with the genome's grow with the product of both."""
    from tailwright.operators import ungapped

    rng = random.Random(4)
    g = "".join(rng.choice("ACGT") for _ in range(200))
    t = align.tiles(spark.createDataFrame([("c", 1, g)], "chrom string, offset long, seq string"))
    looked = []
    by_seeds = ungapped._hits_by_seeds
    monkeypatch.setattr(ungapped, "_hits_by_seeds", lambda each, *more: looked.append(each.count()) or by_seeds(each, *more))
    q = spark.createDataFrame([("x", g[20:50]), ("y", flip(g[60:90]))], "query string, seq string")
    got = {(r.q_name, r.strand, r.t_start, r.score) for r in ungapped.best_ungapped_hits(q, t).collect()}
    assert got == {("x", "+", 20, 30), ("y", "-", 60, 30)} and looked == [8]


def test_stretches_of_a_batch_equal_those_of_each(spark):
    from tailwright.operators import ungapped

    rng = random.Random(8)
    rows = []
    for n in (0, 1, 2, 14, 30, 31, 90):
        for _ in range(20):
            a = "".join(rng.choice("ACGTN") for _ in range(n))
            rows.append((a, "".join(x if rng.random() < 0.7 else rng.choice("ACGTN") for x in a)))
    d = spark.createDataFrame(rows, "a string, b string").where("length(a) > 0")
    got = ungapped.with_stretches(d.withColumn("s", ungapped.best_stretch(F.col("a"), F.col("b"))), "a", "b").collect()
    assert len(got) == 120 and all((r.score, r.begin, r.end, r.matches) == (r.s.score, r.s.begin, r.s.end, r.s.matches) for r in got)


def test_the_genome_is_shuffled_for_leading_rounds_only(spark, genome, monkeypatch):
    """Reads that begin with the same bases are looked up once, two rows a base; for those left over there are no seeds but theirs."""
    g = spark.createDataFrame([(c, 1, s) for c, s in genome.items()], "chrom string, offset bigint, seq string")
    t = align.tiles(g)
    a = genome["chr1"]
    other = lambda b: {"A": "C", "C": "A", "G": "T", "T": "G"}[b]
    seqs = [a[900:922], a[900:923] + other(a[923]), a[900:920] + other(a[920]) + other(a[921]), flip(a[1100:1125]), other(a[1500]) + other(a[1501]) + a[1502:1525]]
    r = spark.createDataFrame([(f"r{i}", 1, s) for i, s in enumerate(seqs)], "read_id string, abundance bigint, seq string")
    cores, seeds = [], []
    core_hits, padded = align._core_hits, align._padded_seeds
    monkeypatch.setattr(align, "_core_hits", lambda c, t: cores.append(c.count()) or core_hits(c, t))
    monkeypatch.setattr(align, "_padded_seeds", lambda *x, **y: seeds.append(padded(*x, **y)) or seeds[-1])
    got = {x.read_id: (x.trim_step, x.strand, x.start, x.nm) for x in align.trim_cascade(r, t).collect()}
    assert got == {"r0": ("init-mapping-0", "+", 901, 0), "r1": ("init-mapping-0", "+", 901, 1), "r2": ("three-trim-1", "+", 901, 1), "r3": ("init-mapping-0", "-", 1101, 0), "r4": ("five-trim-1", "+", 1502, 1)}
    assert cores == [3] and len(seeds) == 1 and seeds[0].count() < 20
    assert align._core_seeds(align.tiles(g).withColumn("id", F.monotonically_increasing_id())).count() < 2 * 1.05 * sum(map(len, genome.values()))


def test_leading_rounds_equal_those_by_index(spark, monkeypatch):
    """Both strands, repeats, letters that are no bases in the genome, places at the ends of pieces and tiles, and whole reads that reach over them."""
    rng = random.Random(31)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = text(40)
    pieces = [("a", 1, text(980) + core + text(1010) + core[:25] + text(30)), ("a", 2086, text(64)), ("b", 7, core[:22] + text(500) + "NR" + text(500)), ("c", 1, text(19)), ("c", 20, text(1000))]
    t = align.tiles(spark.createDataFrame(pieces, "chrom string, offset bigint, seq string"))
    seqs = set()
    for _, _, g in pieces:
        for at in {0, 1, 2, 5, 6, 505, 515, 975, 980, 982, 990, 994, 999, 1000, 1003, 1020, len(g) - 31, len(g) - 20, len(g) - 18}:
            for n in (17, 18, 19, 20, 22, 25, 29, 31, 32):
                s = g[at : at + n] if at >= 0 else ""
                if len(s) < 16:
                    continue
                k = rng.randrange(8)
                if k in (1, 2, 6):
                    i = rng.randrange(len(s)) if k < 6 else len(s) - 1
                    s = s[:i] + rng.choice("ACGT") + s[i + 1 :]
                s = {3: text(1) + s, 4: s + text(2), 5: s + text(1)}.get(k, s)
                seqs.add(s if rng.random() < 0.5 else flip(s) if set(s) <= set("ACGT") else s)
    r = spark.createDataFrame([(f"r{i}", 1, s) for i, s in enumerate(sorted(seqs))], "read_id string, abundance bigint, seq string")
    index = align.seeds(t).cache()
    for most, few, mismatches in ((1, align.FEW, 1), (2, 0, 1), (1, 0, 0)):
        monkeypatch.setattr(align, "FEW", few)
        found = align.trim_cascade(r, t, most=most, mismatches=mismatches, reference=True)
        want = align.trim_cascade(r, t, most=most, mismatches=mismatches, index=index)
        a, b = sorted(map(tuple, found.drop("reference").collect())), sorted(map(tuple, want.collect()))
        assert a == b and len(a) > len(seqs) // 3
        whole = sorted(map(str, align.resolve_ends(found, t).collect()))
        assert whole == sorted(map(str, align.resolve_ends(want, t).collect())) and found.where("reference is null").count() > 0
    index.unpersist()
