"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwright.llm.session import table


def labelled(docs: DataFrame, labels: DataFrame, name: str, rows: int, size: int, seed: int, text: str = "text", id_col: str = "doc_id", cost: Column | None = None) -> DataFrame:
    """(label, text) of about ``rows`` (twice as many at most) ids of ``labels(doc_id, name)``, chosen by a hash.

    Texts are whole, as bytes (null: empty), and cost ``size`` in all at most, by default a byte each: in order of the
    hashes each one that still has room is taken, and if none has, the cheapest.  Null ids and labels teach nothing; of
    an id labelled twice the higher label counts, and of several rows of an id one is taken, whatever their number.  No
    other column of ``docs`` is read.
    """
    known = labels.select(F.col("doc_id").alias("known"), F.col(name).cast("int").alias("label")).where("known is not null and label is not null").groupBy("known").agg(F.max("label").alias("label"))
    n = known.count()
    known = known.withColumn("lot", F.pmod(F.xxhash64("known", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    chosen = known.where(F.col("lot") < min(1.0, rows / max(1, n))).orderBy("lot", "known").limit(2 * rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("known"))  # at most 2 * rows ids
    one = found.groupBy("known", "label", "lot").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    one = table(one.withColumn("cost", (F.length("text") if cost is None else cost).cast("long")), "labelled")
    costs = sorted((r["lot"], r["known"], r["cost"]) for r in one.select("lot", "known", "cost").collect())
    taken, total = [], 0
    for _, key, own in costs:
        if total + own <= size:
            taken.append(key)
            total += own
    if not taken:
        taken = [key for _, key, own in sorted(costs, key=lambda c: c[2])[:1]]
    if len(taken) < len(costs):
        kept = docs.sparkSession.createDataFrame([(key,) for key in taken], one.select("known").schema)
        one = one.join(F.broadcast(kept), "known", "left_semi")
    return one.select("label", "text")
