"""Column functions on literal cases."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tailwright.functions import modifications as M
from tailwright.functions import sequence as S


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_complements(spark):
    assert tuple(one(spark, S.complement(F.lit("acgtn")), S.reverse_complement(F.lit("AACG")), S.reverse_complement(F.lit("AXC")), S.reverse_complement(F.lit("")))) == ("TGCAN", "CGTT", None, "")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ACGTN", max_size=30), min_size=1, max_size=20))
def test_reverse_complement_is_its_own_inverse(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert all(r.s == r.back for r in df.select("s", S.reverse_complement(S.reverse_complement("s")).alias("back")).collect())


def test_mismatch_strings(spark):
    md = F.lit("MD:Z:0G0T20")
    r = one(spark, S.md_lengths(md), S.md_refs(md), F.to_json(S.md_mismatches(md)), S.md_mismatches(F.lit("22")), S.md_render(S.md_mismatches(md), F.lit(22)))
    assert r[0] == [0, 0, 20] and r[1] == "GT" and r[2] == '[{"offset":0,"ref":"G"},{"offset":1,"ref":"T"}]' and r[3] == [] and r[4] == "0G0T20"


def test_read_ids_and_trimming(spark):
    assert tuple(one(spark, S.abundance(F.lit("57|4")), S.abundance(F.lit("57")), S.trim(F.lit("ACGTA"), 1, 2), S.trim(F.lit("AC"), 2, 2), S.tag_value(F.lit("NM:i:1")), S.tag_value(F.lit("7")))) == (4, 1, "CG", "", "1", "7")


def test_an_end_modification_needs_every_base_to_differ(spark):
    got = one(spark, M.resolved(F.lit("AC"), F.lit("TT")), M.resolved(F.lit("AC"), F.lit("AT")), M.resolved(F.lit("A"), F.lit("a")), M.resolved(F.lit("ACG"), F.lit("CA")), M.resolved(F.lit(""), F.lit("")))
    assert tuple(got) == ("TT", None, None, None, None)


MIR = "chrom string, strand string, read_start bigint, read_end bigint, read_id string, nte5 string, nte3 string, nm int, md string, seq string"


def mir_rows(spark):
    """Reads of one minus-strand miRNA: none, 3' of two bases, 3' of one, both ends."""
    return spark.createDataFrame(
        [
            ("chr13", "-", 7030312, 7030333, "a|108", None, None, 0, "22", "TGACCGATCTTAGGACCATGTT"),
            ("chr13", "-", 7030310, 7030333, "b|3", None, "TT", 2, "0T0T22", "AATGACCGATCTTAGGACCATGTT"),
            ("chr13", "-", 7030312, 7030333, "c|10", None, "C", 1, "0T21", "GGACCGATCTTAGGACCATGTT"),
            ("chr13", "-", 7030312, 7030334, "d|11", "T", "T", 2, "0T21T0", "AGACCGATCTTAGGACCATGTTA"),
        ],
        MIR,
    )


def test_places_on_the_minus_strand(spark):
    df = mir_rows(spark).select("read_id", M.nte3_site("strand", "read_start", "read_end", "nte3", "md").alias("three"), M.nte5_site("strand", "read_start", "read_end", "nte5", "md").alias("five"), M.internal_sites("strand", "read_start", "seq", "md", "nte5", "nte3").alias("inner"), M.end_without_nte3("strand", "read_start", "read_end", "nte3").alias("end"))
    df = df.select("read_id", M.change_text(F.col("three")).alias("three"), M.change_text(F.col("five")).alias("five"), F.size("inner").alias("inner"), "end")
    got = {r.read_id: tuple(r)[1:] for r in df.collect()}
    assert got == {
        "a|108": (None, None, 0, 7030312),
        "b|3": ("7030311-7030310:AA>TT", None, 0, 7030312),
        "c|10": ("7030312:A>C", None, 0, 7030313),
        "d|11": ("7030312:A>T", "7030334:A>T", 0, 7030313),
    }


def test_five_prime_letters_in_the_compat_form(spark):
    site = lambda compat: M.change_text(M.nte5_site(F.lit("+"), F.lit(10), F.lit(30), F.lit("GG"), F.lit("0A0C19"), compat))
    assert tuple(one(spark, site(False), site(True))) == ("10-11:AC>GG", "10-11:CA>GG")


def test_internal_positions_and_the_compat_form(spark):
    args = (F.lit("+"), F.lit(100), F.lit("AACAAAGAAAAA"), F.lit("2T3C5"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    show = lambda compat: F.array_join(F.transform(M.internal_sites(*args, compat), M.change_text), "|")
    assert tuple(one(spark, show(False), show(True))) == ("102:T>C|106:C>G", "102:T>C|103:C>A")


def test_cells_round_trip(spark):
    for cell in ("0", "4417019:T>C:2|4417020:G>A:5|4417020:G>C:31", "9315072-9315073:CT>AA:17|9315072:C>G:8"):
        assert one(spark, M.render_cells(M.parse_cells(F.lit(cell))))[0] == cell


def test_base_indexes(spark):
    places = lambda s, a, b: M.base_indexes(F.lit(s), F.lit(100), F.lit(121), F.lit(a), F.lit(b))
    assert tuple(one(spark, places("+", 120, 121), places("+", 121, 121), places("-", 101, 100))) == ([20, 21], [21], [21, 20])


def test_fixed_names():
    names = S.kmers()
    assert len(names) == 84 and names[:6] == ["A", "U", "G", "C", "AA", "AU"] and len(S.substitutions()) == 12 and S.substitutions()[0] == "A>U"
