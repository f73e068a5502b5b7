"""A second opinion without a second aligner: best local alignments without gaps.

Every k-mer of a read, on both strands, is looked up among the genome's; hits are gathered by diagonal, the place where
the read would begin.  On each diagonal the best-scoring stretch is found, a base that is equal counting one and any
other less one, so what comes out is what best_hits() ranks by.  It stands in for hits of a program that also finds
gaps, which this does not; its rows have the columns of readers.psl() that the later steps use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tailwright.functions import packed
from tailwright.functions.sequence import reverse_complement
from tailwright.operators.align import TILE, fetch
from tailwright.operators.hits import best_hits
from tailwright.plans.store import table

#: Bases of a seed, and the least score of a hit.
SEED, SCORE = 11, 14
#: What a nearly whole hit's score may lack of the query's bases, and the most bases of its seeds.
LACK, LONG = 2, 15


def best_stretch(a: Column, b: Column) -> Column:
    """struct(score, begin, end, matches): the stretch [begin, end) of two texts of one length with the most equal bases
    less others; of equally good ones the first that ends, and of these the shortest."""
    n = F.length(a)
    zero = F.lit(0)
    state = F.struct(zero.alias("run"), zero.alias("from"), zero.alias("score"), zero.alias("begin"), zero.alias("end"))

    def step(s: Column, i: Column) -> Column:
        same = (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & F.substring(a, i, F.lit(1)).isin(*"ACGT")
        fresh = s["run"] <= 0
        run = F.when(fresh, zero).otherwise(s["run"]) + F.when(same, 1).otherwise(-1)
        begin = F.when(fresh, i - 1).otherwise(s["from"])
        better = run > s["score"]
        return F.struct(run.alias("run"), begin.alias("from"), F.when(better, run).otherwise(s["score"]).alias("score"), F.when(better, begin).otherwise(s["begin"]).alias("begin"), F.when(better, i).otherwise(s["end"]).alias("end"))

    last = lambda s: F.struct(s["score"].alias("score"), s["begin"].alias("begin"), s["end"].alias("end"), ((s["score"] + s["end"] - s["begin"]) / 2).cast("int").alias("matches"))
    return F.aggregate(F.sequence(F.lit(1), n), state, step, last)


def with_stretches(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with best_stretch() of two of their columns as ``score``, ``begin``, ``end`` and ``matches``: texts of A, C, G, T and N,
    which never equals anything.  All rows of a batch take each step at once."""

    def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = column.cast(pa.large_binary())
        return np.frombuffer(text.buffers()[2] or b"", np.uint8), np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a_raw, a_ends), (b_raw, b_ends) = texts(batch.column(a)), texts(batch.column(b))
            order = np.argsort(-np.diff(a_ends), kind="stable")  # the longest first, so that what goes on is a prefix
            a_at, b_at, sizes = a_ends[:-1][order], b_ends[:-1][order], np.diff(a_ends)[order]
            sum_, since, score, begin, end = (np.zeros(len(sizes), np.int32) for _ in range(5))
            for i in range(sizes[0] if len(sizes) else 0):
                k = np.searchsorted(-sizes, -i)  # rows of more than i bases
                x = a_raw[a_at[:k] + i]
                fresh = sum_[:k] <= 0
                sum_[:k] = np.where(fresh, 0, sum_[:k]) + np.where((x == b_raw[b_at[:k] + i]) & (x != ord("N")), 1, -1)
                since[:k][fresh] = i
                better = np.flatnonzero(sum_[:k] > score[:k])
                score[better], begin[better], end[better] = sum_[better], since[better], i + 1
            made = {"score": score, "begin": begin, "end": end, "matches": (score + end - begin) // 2}
            back = np.argsort(order, kind="stable")
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v[back]) for v in made.values())], names=[*batch.schema.names, *made])

    schema = StructType([*rows.schema.fields, *(StructField(c, IntegerType()) for c in ("score", "begin", "end", "matches"))])
    return rows.mapInArrow(run, schema)


def _turned(queries: DataFrame) -> DataFrame:
    """(query, strand, plus, letters): ``queries`` as they are and turned; ``letters`` is what can be packed."""
    both = F.array(F.struct(F.lit("+").alias("strand"), F.upper("seq").alias("plus")), F.struct(F.lit("-").alias("strand"), reverse_complement("seq").alias("plus")))
    q = queries.select("query", F.explode(both).alias("x")).select("query", "x.*")
    return q.withColumn("letters", F.regexp_replace("plus", "[^ACGT]", "N"))  # signs included


def _hits_by_seeds(each: DataFrame, tiled: DataFrame, sizes: tuple[int, ...], tile: int) -> DataFrame:
    """The hits of ``each(query, strand, plus, letters, at, size, least)``: with a score of ``least``, on a diagonal on which the
    ``size`` bases (one of ``sizes``) from ``at`` on are equal."""
    heads = {k: packed.span(0, k) for k in sizes}
    w = packed.windows(tiled, tile, min(sizes), before=True)
    held_by = F.array(*[F.when((F.col("room") >= k) & (F.col("odd").bitwiseAND(F.lit(m)) == 0), F.struct(F.lit(k).alias("size"), F.col("word").bitwiseAND(F.lit(m)).alias("key"))) for k, m in heads.items()])
    w = w.withColumn("x", F.explode_outer(held_by)).where("x is not null")
    w = w.select("x.size", "x.key", "chrom", "pos", "room", F.col("word").alias("g_word"), F.col("odd").alias("g_odd"), "back_room", F.col("back").alias("g_back"), F.col("back_odd").alias("g_back_odd"))
    held = F.least("at", F.lit(packed.WORD))
    ahead, behind = F.substring("letters", F.col("at") + 1, F.lit(packed.WORD)), F.substring("letters", F.col("at") - held + 1, held)
    low = lambda x: F.call_function("shiftright", x, (F.lit(2 * packed.WORD) - held * 2).cast("int"))
    each = each.where(~F.substring("letters", F.col("at") + 1, F.col("size")).rlike("[^ACGT]"))
    each = each.withColumns({"word": packed.word_of(ahead), "odd": packed.odd_of(ahead), "back": low(packed.word_of(behind)), "back_odd": low(packed.odd_of(behind))})
    each = each.withColumn("key", F.col("word").bitwiseAND(F.coalesce(*[F.when(F.col("size") == k, F.lit(m)) for k, m in heads.items()])))
    # A hit has at least ``least`` equal bases, so a diagonal with too many others near the seed is dropped inside the join,
    # before its row is written; bases that the words don't hold count as equal
    n, rest = F.length("plus"), F.length("plus") - F.col("at")
    forward = packed.mismatches(F.col("word"), F.col("g_word"), F.col("odd"), F.col("g_odd"), packed.first_bases(F.least(rest, F.col("room"))))
    known = F.least("at", "back_room")
    lowest = F.lit(packed.LOWS).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (known * 2).cast("int")) - 1)
    backward = packed.mismatches(F.col("back"), F.col("g_back"), F.col("back_odd"), F.col("g_back_odd"), lowest)
    near = each.join(w.hint("merge"), ["size", "key"]).where(n - forward - backward >= F.col("least"))
    diagonals = near.select("query", "strand", "letters", "least", "chrom", (F.col("pos") - F.col("at")).alias("start")).distinct()
    found = fetch(diagonals, tiled, F.col("start"), F.length("letters"), "reference").withColumn("reference", F.regexp_replace("reference", "[^ACGT]", "N"))
    found = with_stretches(found, "letters", "reference").where(F.col("score") >= F.col("least"))
    none = lambda c: F.lit(0).alias(c)
    return found.select(F.col("query").alias("q_name"), "strand", F.col("chrom").alias("t_name"), F.col("begin").alias("q_start"), F.col("end").alias("q_end"), F.length("letters").alias("q_size"), (F.col("start") - 1 + F.col("begin")).alias("t_start"), (F.col("start") - 1 + F.col("end")).alias("t_end"), "matches", (F.col("end") - F.col("begin") - F.col("matches")).alias("mismatches"), none("q_num_insert"), none("t_num_insert"))


def ungapped_hits(queries: DataFrame, tiled: DataFrame, seed: int = SEED, score: int = SCORE, tile: int = TILE) -> DataFrame:
    """Hits of ``queries(query, seq)``: q_name, strand, t_name, q_start, q_end, q_size, t_start, t_end, matches,
    mismatches and insertions of 0, for each diagonal with a seed and at least that score.

    Places count from 0 with the end excluded, on the + strand for the target; a hit on - has the query turned.  A
    query that would reach over a piece's end on a diagonal has no hit there; nor has one shorter than a seed.
    """
    if not 1 <= seed <= packed.WORD:
        raise ValueError("a seed is 1 to 31 bases")
    q = _turned(queries).where(F.length("plus") >= seed)
    each = q.withColumns({"at": F.explode(F.sequence(F.lit(0), F.length("plus") - seed)), "size": F.lit(seed), "least": F.lit(score)})
    return _hits_by_seeds(each, tiled, (seed,), tile)


def best_ungapped_hits(queries: DataFrame, tiled: DataFrame, seed: int = SEED, score: int = SCORE, tile: int = TILE) -> DataFrame:
    """best_hits() of ungapped_hits(), ties included, without looking up every k-mer of every query.

    A score of no less than LACK below a query's n bases leaves one exchanged base, or two bases in all beyond its ends.  So of the
    two halves of its bases without the outermost ones, one at least is equal, and these two seeds of each strand find every
    such hit.  Any other has a score of n - LACK - 1 at most: only queries for which that isn't beaten yet are looked up by all seeds,
    as are those too short for the halves to hold a seed.  ``queries`` and what is found are stored.
    """
    if not 1 <= seed <= packed.WORD:
        raise ValueError("a seed is 1 to 31 bases")
    n = F.length("seq")
    half = F.when((n - LACK >= 2 * seed) & (n - LACK >= score), F.least(F.floor((n - LACK) / 2), F.lit(max(seed, LONG))).cast("int"))
    kept = table(queries.select("query", "seq", half.alias("half")), "queries")
    sizes = tuple(sorted(r["half"] for r in kept.select("half").where("half is not null").distinct().collect()))  # a few numbers
    if not sizes:
        return best_hits(ungapped_hits(kept, tiled, seed, score, tile))
    halves = kept.where("half is not null")
    m = F.length("plus")
    ends = F.explode(F.array(F.lit(1), m - 1 - F.col("size")))
    each = _turned(halves).withColumn("size", F.coalesce(*[F.when(F.floor((m - LACK) / 2) >= k, F.lit(k)) for k in reversed(sizes)])).withColumns({"at": ends, "least": m - LACK})
    first = table(_hits_by_seeds(each, tiled, sizes, tile), "hits")
    best = first.groupBy(F.col("q_name").alias("query")).agg(F.max(F.col("matches") - F.col("mismatches")).alias("best"))
    open_to = F.when(F.col("half").isNull(), n).otherwise(n - LACK - 1)
    rest = table(kept.join(best, "query", "left").where(F.col("best").isNull() | (F.col("best") <= open_to)).select("query", "seq"), "queries")
    if rest.isEmpty():
        return best_hits(first)
    return best_hits(first.unionByName(table(ungapped_hits(rest, tiled, seed, score, tile), "hits")))
