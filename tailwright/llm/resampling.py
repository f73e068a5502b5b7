"""Importance resampling: documents drawn so that their word pairs are spread like a target table's.

Runs of words are hashed into buckets; a bucket's gain is the logarithm of how much likelier the target has it.  A
document's weight is its mean gain, scored by looking its buckets up in one array, and its score adds noise that
makes the highest scores a weighted draw without replacement.  Scores are integers: their histogram, with sums over
all higher scores, says where each score's ranks begin, and which score is the last to be drawn.  Only documents of
drawn scores are sorted, by id within their score.

What is sent to all tasks is bounded by parameters: one array of a number a bucket, and the histogram, as a score
lies within 60,000 of 0.  The noise spreads documents of whatever weight over the scores: none has more than 0.04 %.

Defined results: a null text has no words; a null id is drawn by the digest of an empty one.  Every row is a document
of its own; rows of one id and score are ranked by features, then arbitrarily, which changes no column's values but
between equal rows.  A document of no feature has weight 0.  Without documents or target all counts are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailwright.llm.line_dedup import SMALL, UPPER, lowered
from tailwright.llm.session import documents, table

#: Buckets of features, words of the longest run, seed of the draw.
BUCKETS, RUN, SEED = 10_000, 2, 7
#: Documents of fewer words aren't drawn; so many in a hundred of the others are.
MIN_WORDS, PERCENT = 20, 25
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and all that isn't ASCII."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def runs_of(words: Column, longest: int = RUN) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, repeats included."""
    out, level = words, words
    n = F.size(words)
    for k in range(2, longest + 1):
        left = F.greatest(n - (k - 1), F.lit(0))
        level = F.zip_with(F.slice(level, F.lit(1), left), F.slice(words, F.lit(k), left), lambda a, b: F.concat(a, F.lit(" "), b))
        out = F.concat(out, level)
    return out


def bucket_of(run: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(run.cast("binary")) % buckets).cast("int")


def features(docs: DataFrame, text: str = "text", keep: Sequence[Column] = (), buckets: int = BUCKETS, longest: int = RUN) -> DataFrame:
    """``keep``, ``n_words`` and ``buckets``, the bucket of every run of each whole text."""
    words = docs.select(*keep, words_of(F.col(f"`{text}`")).alias("words"))
    kept = [F.col(f"`{c}`") for c in words.columns[:-1]]
    runs = words.select(*kept, F.size("words").alias("n_words"), runs_of(F.col("words"), longest).alias("runs"))
    return runs.select(*kept, "n_words", F.transform("runs", lambda r: bucket_of(r, buckets)).alias("buckets"))


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = RUN) -> DataFrame:
    """(bucket, n) over all texts; a row a bucket and task is shuffled at most."""
    # outer, as for an inner one the optimizer would test the array's size first and so make all runs twice
    each = features(docs, text, (), buckets, longest).select(F.explode_outer("buckets").alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = RUN) -> DataFrame:
    """One row: ``gains``, a long for each bucket in order."""
    have = bucket_counts(docs, buckets=buckets, longest=longest).withColumnRenamed("n", "s")
    want = bucket_counts(target, buckets=buckets, longest=longest).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(have, "bucket", "left").join(want, "bucket", "left")
    every = table(every.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")), "buckets")
    sums = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    gain = F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain")
    listed = every.crossJoin(F.broadcast(sums)).select("bucket", gain)  # one row
    return listed.agg(F.array_sort(F.collect_list(F.struct("bucket", "gain"))).alias("x")).select(F.col("x.gain").alias("gains"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), with u in (0, 1) from the id's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, buckets: int = BUCKETS, longest: int = RUN, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    one = F.lit(np.array(gains(docs, target, buckets, longest).first()["gains"], dtype=np.int64))  # a number a bucket
    f = features(docs, "text", [F.col(f"`{id_col}`").alias("doc_id")], buckets, longest)
    n = F.size("buckets").cast("long")
    summed = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(one, b + 1))
    f = f.select("doc_id", "n_words", n.alias("n_features"), summed.alias("total"))
    # the floor of a quotient of integers, exactly
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return f.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))


def draw(scores: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scores`` with ``rank``, from 1 on, of the floor(percent * N / 100) highest scores among the N documents of at
    least ``min_words`` words, ties to smaller ids; null for all others.  ``scores`` should be a stored table."""
    able = F.col("n_words") >= min_words
    counts = scores.where(able).groupBy("score").agg(F.count("*").alias("n"))
    total = counts.agg(F.floor(F.sum("n") * percent / 100).cast("long").alias("most"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))  # a row a score
    offsets = counts.withColumn("before", F.coalesce(above, F.lit(0))).crossJoin(F.broadcast(total)).where("before < most").select(F.col("score").alias("drawn"), "before", "most")
    hit = scores.join(F.broadcast(offsets), able & (F.col("score") == F.col("drawn")), "left")  # bounded: a row a score
    within = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight"))
    place = F.col("before") + within
    ranked = hit.where("drawn is not null").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank")))
    rest = hit.where("drawn is null").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(*scores.columns, F.col("rank").cast("long").alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return draw(table(scores, "scores")).select("doc_id", "n_features", "weight", "score", "rank")


def sql() -> str:
    return f"""
with crc_table as (
  select list(v order by i) t from (
    select i, list_reduce(list_prepend(cast(i as bigint), cast(range(8) as bigint[])),
                          lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v
    from range(256) r(i))),
text as (
  select 0 kind, row_number() over () row_no, doc_id, translate(coalesce(text, ''), '{UPPER}', '{SMALL}') text from documents
  union all
  select 1, row_number() over (), null, translate(coalesce(text, ''), '{UPPER}', '{SMALL}') from benchmark),
words as (
  select kind, row_no, doc_id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from text),
runs as (
  select kind, row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) run from words),
per_row as (select kind, row_no, run, count(*) n from runs group by all),
hex_runs as (select run, hex(encode(run)) h from (select distinct run from per_row)),
crc as (
  select run, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(0, length(h) // 2),
             lambda i: cast((strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 as bigint))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} bucket
  from hex_runs, crc_table),
counts as (
  select kind, row_no, bucket, cast(sum(n) as bigint) n from per_row join crc using (run) group by all),
sums as (
  select bucket, coalesce(cast(sum(n) filter (kind = 0) as double), 0) s, coalesce(cast(sum(n) filter (kind = 1) as double), 0) t
  from counts group by bucket),
gain as (
  select bucket, cast(floor(1000 * ln((t + 1) * ((select sum(s) from sums) + {BUCKETS}) / ((s + 1) * ((select sum(t) from sums) + {BUCKETS})))) as bigint) gain
  from sums),
weights as (
  select row_no, cast(sum(n) as bigint) n_features, cast(sum(n * gain) as bigint) total
  from counts join gain using (bucket) where kind = 0 group by row_no),
scored as (
  select w.doc_id, len(w.w) n_words, coalesce(n_features, 0) n_features,
         case when n_features > 0 then (total - ((total % n_features) + n_features) % n_features) // n_features else 0 end weight,
         (cast('0x' || substr(sha256('{SEED}:' || coalesce(cast(w.doc_id as varchar), '')), 1, 8) as bigint) + 0.5e0) / 4294967296e0 u
  from words w left join weights g using (row_no) where w.kind = 0),
final as (
  select doc_id, n_words, n_features, cast(weight as bigint) weight, cast(weight + floor(-1000 * ln(-ln(u))) as bigint) score from scored),
ranked as (
  select *, row_number() over (partition by n_words >= {MIN_WORDS} order by score desc, doc_id, n_features, weight) r,
         (select count(*) from final where n_words >= {MIN_WORDS}) able
  from final)
select doc_id, cast(n_features as bigint) n_features, weight, score,
       case when n_words >= {MIN_WORDS} and r <= {PERCENT} * able // 100 then cast(r as bigint) end rank
from ranked"""
