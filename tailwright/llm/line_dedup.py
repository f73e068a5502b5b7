"""Line dedup: lines that many documents share are dropped from all of them.

Lines are normalised, hashed to 128 bits and exploded; a document counts once for each of its hashes, and sums are
combined map-side, so a line of a third of all documents is one row a task; its places are found in salted parts.  Only hashes and positions travel: the
positions of frequent lines go back to their document, whose whole text moves once, and are taken out there.

Defined results: every row is a document of its own, whatever its id; rows that agree in id and text get equal
results, and each counts.  A null or empty text is one empty line.  A blank line has the empty key, which is dropped
only where ``min_chars`` is 0.  Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm.session import documents

#: A line goes if so many documents have it, and its key has at least so many code points.
MIN_DOCUMENTS, MIN_CHARS = 10, 1
#: Parts in which a line's documents look it up, so that those of a line that many have don't meet in one task.
SALT = 16
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
HASH = "struct<a:bigint,b:bigint>"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; ASCII texts take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, SMALL))


def hashed(x: Column) -> Column:
    """128 bits as two longs."""
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))


def line_hashes(lines: Column, min_chars: int = MIN_CHARS) -> Column:
    """The hash of each line's key; null where the key is too short to be dropped."""

    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.char_length(key) >= min_chars, hashed(lowered(key)))

    return F.transform(lines, one)


def frequent_lines(hashes: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(a, b, n_docs) of the hashes in at least so many rows of ``hashes(hashes)``."""
    one = hashes.select(F.explode_outer(F.array_distinct("hashes")).alias("h")).where("h is not null").select("h.a", "h.b")
    return one.groupBy("a", "b").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_documents)


def drop_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` as struct ``row``, n_lines, n_dropped and ``kept_text``, the text without its frequent lines."""
    lines = F.split(F.coalesce(F.col(f"row.{text}"), F.lit("")), "\n", -1)
    # ids may be null or repeated: id and text together tell all that a result depends on
    key = F.struct(F.col(f"row.{id_col}").alias("id"), hashed(F.coalesce(F.col(f"row.{text}"), F.lit(""))).alias("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = docs.select(F.struct(F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias("row")).select(key.alias("key"), line_hashes(lines, min_chars).alias("hashes"))
    frequent = frequent_lines(found.select("hashes"), min_documents)
    # outer, as for an inner one the optimizer would test the array's size first and so hash all lines twice
    places = found.select("key", F.posexplode_outer("hashes").alias("pos", "h")).where("h is not null").select("key", "pos", "h.a", "h.b", F.pmod("key.text.a", F.lit(SALT)).alias("salt"))
    salted = frequent.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    gone = places.join(salted, ["a", "b", "salt"], "left_semi").groupBy("key").agg(F.collect_set("pos").alias("gone"))
    whole = rows.select("row", key.alias("key"), lines.alias("lines")).join(gone, "key", "left")
    n = F.size("lines")
    gone_ = F.coalesce("gone", F.array().cast("array<int>"))
    left = whole.select("row", "lines", n.cast("long").alias("n_lines"), F.size(gone_).cast("long").alias("n_dropped"), F.array_except(F.sequence(F.lit(0), n - 1), gone_).alias("left"))
    text_ = F.array_join(F.transform("left", lambda i: F.element_at("lines", i + 1)), "\n")
    return left.select("row", "n_lines", "n_dropped", text_.alias("kept_text"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def sql(min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> str:
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
with docs as (
  select doc_id, row_number() over () row_no, string_split(coalesce(text, ''), chr(10)) lines from documents),
line as (
  select row_no, unnest(range(1, len(lines) + 1)) pos, unnest(lines) line from docs),
keyed as (
  select row_no, pos, line, translate(trim(line, {blanks}), '{UPPER}', '{SMALL}') k from line),
frequent as (
  select k from keyed where length(k) >= {min_chars} group by k having count(distinct row_no) >= {min_documents}),
kept as (
  select row_no, string_agg(line, chr(10) order by pos) text, count(*) n
  from keyed where k not in (select k from frequent) group by row_no)
select doc_id, cast(len(lines) as bigint) n_lines, cast(len(lines) - coalesce(n, 0) as bigint) n_dropped,
       sha256(coalesce(text, '')) kept_sha256
from docs left join kept using (row_no)"""
