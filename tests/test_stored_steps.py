"""What queries on stored annotated reads shuffle, and what they find more than once."""

from pyspark.sql import functions as F

from tailwright.functions import modifications as M
from tailwright.operators import annotate, intervals
from tailwright.plans import queries
from tailwright.plans.bridge import bridge

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_raw_reads_go_to_alignments_by_part_alone(spark):
    """One shuffle for both joins of a part's alignments; none by the four columns that tell them apart."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = [line.split("hashpartitioning(", 1)[1] for line in plan(bridge(spark, DIR, "fastq")).splitlines() if "hashpartitioning(pk" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert not [line for line in moved if "jit" in line]


def test_profiled_reads_carry_no_columns_of_second_hits(spark):
    got = queries.stored_profiled(spark, DIR)
    assert not {"pk", "ln"} & set(got.columns)
    assert sorted(got.select("read_id", "anno_name").collect()) == sorted(queries.annotated(spark, DIR).select("read_id", "anno_name").collect())


def test_credible_reads_find_sites_once(spark, monkeypatch):
    """The sites come from a stored table, so that the query's own plan reads no mismatch string."""
    made = []
    keep = annotate.with_profiles
    monkeypatch.setattr(annotate, "with_profiles", lambda *a, **k: made.append(1) or keep(*a, **k))
    got = queries.QUERIES["credible_reads"](spark, DIR)
    assert made == [1]
    assert "regexp" not in plan(got) and "profiled-" in plan(got)


def test_picking_an_annotation_sorts_once(spark):
    """No aggregate of structs, which sorts for each of its halves; equal alignments each keep their row."""
    a = queries.alignments(spark, DIR).drop("pk", "ln").limit(50)
    twice = a.union(a).localCheckpoint()
    got = annotate.annotate(twice, bridge(spark, DIR, "anno"), bridge(spark, DIR, "prio"))
    assert "SortAggregate" not in plan(got)
    rows = sorted((r.read_id, r.aid) for r in got.collect())
    assert rows and rows[::2] == rows[1::2] and len(set(rows)) == len({r[0] for r in rows})


def test_levels_of_places_are_not_made_to_be_dropped(spark):
    """A place becomes a row for each level that occurs, without rows of other levels in between."""
    points = spark.createDataFrame([("c", 700), ("c", 5_000_000)], "chrom string, at long")
    levels = spark.createDataFrame([(0,), (3,)], "level int")
    got = intervals.at_levels(points, F.col("at"), levels)
    assert "Generate" not in plan(got) and "explode" not in plan(got)
    assert sorted((r.at, r.level, r.bin) for r in got.collect()) == [(700, 0, 2), (700, 3, 0), (5_000_000, 0, 19531), (5_000_000, 3, 305)]


def test_mismatch_strings_are_split_once(spark):
    """The text is split once for all its mismatches, and not at all where ends take all of them."""
    rows = [("+", 10, "ACGTACGT", "2A0C4", None, None), ("-", 10, "ACGTACGT", "0C0G3T2", None, "GT"), ("+", 10, "ACGTACGT", "8", None, None), ("+", 10, "ACGTACGT", "6A0C0", None, "GT")]
    df = spark.createDataFrame(rows, "strand string, start long, seq string, md string, nte5 string, nte3 string")
    got = df.select(M.internal_sites("strand", "start", "seq", "md", "nte5", "nte3").alias("s"))
    assert plan(got).split("== Initial")[0].count("split(") == 1
    assert [[tuple(x) for x in r.s] for r in got.collect()] == [[(12, 12, "A", "G"), (13, 13, "C", "T")], [(15, 15, "A", "G")], [], []]


def test_modifications_are_counted_once(spark, monkeypatch):
    """Counts that the summary and the filter of variants both read are stored, with their annotations' order where it is asked for."""
    made, stored = [], []
    count, table = queries.summary.modification_counts, queries.table
    monkeypatch.setattr(queries.summary, "modification_counts", lambda *a, **k: made.append(1) or count(*a, **k))
    monkeypatch.setattr(queries, "table", lambda df, name: stored.append((name, df.columns)) or table(df, name))
    for name in ("summary_without_snps", "snp_filter_compat"):
        queries.QUERIES[name](spark, DIR)
    assert len(made) == 2
    assert [c for n, c in stored if n == "modifications" and "aid" in c]
