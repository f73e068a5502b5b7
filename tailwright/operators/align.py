"""Aligning short reads with at most one mismatch, trimming in rounds, and telling what was added at the ends.

Seeds: the first bases of a read, as many as the largest of LEVELS that it holds, are cut into three parts.  One
mismatch spoils one part, so a read is looked up by each two of its parts, two thirds of a level's bases, among the
genome's seeds of that level: an equi-join of packed integers.  The joined row holds a word of the genome (31 bases),
so mismatches are counted inside the join, by XOR; only what is left of longer reads is compared afterwards.
Complete for one mismatch.

In a cascade without an index, the rounds before the first that trims the 5' end are done at once: reads that begin with the same
SPAN bases are looked up once.  The genome has two rows a base for that: twelve bases in a row, which are a core's first two
thirds as well as another's last two, and the outer thirds.
"""

from __future__ import annotations

from itertools import takewhile

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwright.functions import packed
from tailwright.functions.modifications import resolved
from tailwright.functions.packed import WORD
from tailwright.functions.sequence import md_render, reverse_complement, trim
from tailwright.plans.store import table

#: Bases of a tile's own; it also holds the next MARGIN ones, so that a read that begins in it lies inside.
TILE, MARGIN = 1000, 200
#: Bases that are cut into three parts: a read is looked up by the largest level that it holds, and has no place without.
LEVELS = (12, 15, 18, 21, 24)
#: The parts, of three, that have to be equal, in the order in which they are tried.
SHAPES = ((0, 1), (1, 2), (0, 2))
#: Bases that all rounds of a read must have in common for it to be looked up once for all of them.
JOINT = 15
#: Bases at a read's 5' end by which its leading rounds are looked up, and those of a third of them.
SPAN, THIRD = 18, 6
#: Of as many reads, left over by the leading rounds, the keys are sent to all tasks, rather than all the genome's seeds being shuffled for them.
FEW = 200_000
#: Bits of a place in a tile, or in its margin as far as a read of a word reaches.
INSIDE = (TILE + WORD).bit_length()
#: Rounds of trimming, in their fixed order: (order, bases off the 5' end, bases off the 3' end, name).
ROUNDS = [(0, 0, 0, "init-mapping-0"), (1, 0, 1, "three-trim-1"), (2, 0, 2, "three-trim-2"), (3, 1, 0, "five-trim-1"), (4, 2, 0, "five-trim-2"), (5, 1, 1, "both-trim-1")]
#: A resolved alignment has fewer mismatches than this besides its end modifications.
INTERNAL_LIMIT = 2


def tiles(genome: DataFrame, tile: int = TILE, margin: int = MARGIN) -> DataFrame:
    """(chrom, tile, first, bases) of ``genome(chrom, offset, seq)``, pieces with 1-based offsets.

    Pieces must not overlap; a read that lies across two of them has no place.
    """
    n = F.length("seq")
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / tile).cast("int")), lambda k: F.struct((F.col("offset") + k * tile).alias("first"), F.substring("seq", k * tile + 1, F.lit(tile + margin)).alias("bases")))
    return genome.where(n > 0).select("chrom", F.explode(parts).alias("p")).select("chrom", F.col("p.first").alias("first"), F.upper("p.bases").alias("bases")).withColumn("tile", F.floor(F.col("first") / tile))


def fetch(rows: DataFrame, tiled: DataFrame, start: Column, length: Column, name: str, tile: int = TILE, how: str = "inner") -> DataFrame:
    """``rows`` with the + strand bases from ``start`` on; with an inner join rows off the genome are dropped."""
    # pieces need not begin at multiples of the tile, so a piece's own bases lie in one bin or two
    bins = F.array_distinct(F.array(F.floor(F.col("first") / tile), F.floor((F.col("first") + F.least(F.lit(tile), F.length("bases")) - 1) / tile)))
    t = tiled.select(F.col("chrom").alias("_chrom"), F.col("first").alias("_first"), F.col("bases").alias("_bases"), F.explode(bins).alias("_tbin"))
    r = rows.withColumns({"_start": start, "_length": length}).withColumn("_bin", F.floor(F.col("_start") / tile))
    inside = (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_tbin")) & (F.col("_start") >= F.col("_first")) & (F.col("_start") < F.col("_first") + tile) & (F.col("_start") + F.col("_length") <= F.col("_first") + F.length("_bases"))
    # a merge join is asked for: Spark's estimate knows the genome's file but not how many bytes come of it, and would send it all
    found = r.join(t.hint("merge"), inside, how).withColumn(name, F.substring("_bases", (F.col("_start") - F.col("_first") + 1).cast("int"), F.col("_length").cast("int")))
    return found.drop("_start", "_length", "_bin", "_tbin", "_chrom", "_first", "_bases")


def parts(level: int) -> list[int]:
    """The bits of the three parts of a level's bases."""
    cuts = [0, level // 3, 2 * level // 3, level]
    return [packed.span(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(level: int) -> list[int]:
    """The bits that two words share if the parts of each of SHAPES are equal."""
    p = parts(level)
    return [p[a] | p[b] for a, b in SHAPES]


def seeds(tiled: DataFrame, levels: tuple[int, ...] = LEVELS, tile: int = TILE) -> DataFrame:
    """(shape, seed, chrom, pos, room, word, odd): for every place of the genome's own bases, level and shape the bits of
    its parts.  ``shape`` tells the level too.  A few rows of numbers a base: for a real genome, save_seeds() writes it once."""
    w = packed.windows(tiled, tile, min(levels))
    each = [(level, k, m) for level in sorted(levels) for k, m in enumerate(masks(level))]
    keys = F.array(*[F.struct(F.lit(level * 3 + k).alias("shape"), F.lit(level).alias("level"), F.col("word").bitwiseAND(F.lit(m)).alias("seed")) for level, k, m in each])
    return w.withColumn("x", F.explode_outer(keys)).where("x.level <= room").select("x.shape", "x.seed", "chrom", "pos", "room", "word", "odd")


def save_seeds(tiled: DataFrame, name: str, buckets: int, levels: tuple[int, ...] = LEVELS, tile: int = TILE, path: str | None = None) -> DataFrame:
    """The seeds as a table of the catalog (at ``path``, if given), bucketed and sorted by what they are joined on: reads
    that are looked up in it travel to its buckets, and it is never shuffled again."""
    writer = seeds(tiled, levels, tile).repartition(buckets, "shape", "seed").write.bucketBy(buckets, "shape", "seed").sortBy("shape", "seed")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return tiled.sparkSession.table(name)


def _lookups(queries: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(query, strand, plus, n, word, odd, level, k, shape, seed): three rows for each strand of a query."""
    both = F.array(F.struct(F.lit("+").alias("strand"), F.upper("seq").alias("plus")), F.struct(F.lit("-").alias("strand"), reverse_complement("seq").alias("plus")))
    q = queries.select("query", F.explode(both).alias("x")).select("query", "x.*").where(F.col("plus").rlike("^[A-Z]+$")).withColumn("n", F.length("plus"))
    q = q.withColumns({"word": packed.word_of(F.col("plus")), "odd": packed.odd_of(F.col("plus"))})

    def of(level: int) -> Column:
        return F.array(*[F.struct(F.lit(level).alias("level"), F.lit(k).alias("k"), F.lit(level * 3 + k).alias("shape"), F.col("word").bitwiseAND(F.lit(m)).alias("seed")) for k, m in enumerate(masks(level))])

    found = F.coalesce(*[F.when(F.col("n") >= level, of(level)) for level in sorted(levels, reverse=True)])
    # outer, as for an inner one the optimizer would test the array first, and pack every sequence again for each test
    return q.withColumn("x", F.explode_outer(found)).where("x is not null").select(*q.columns, "x.*")


def _first_shape(levels: tuple[int, ...]) -> Column:
    """Whether no shape before a row's own is equal too, so that no place comes up twice."""
    differ = F.col("word").bitwiseXOR(F.col("g_word"))
    out = F.lit(True)
    for level in levels:
        m = masks(level)
        out = F.when(F.col("level") != level, out).when(F.col("k") == 0, F.lit(True)).when(F.col("k") == 1, differ.bitwiseAND(F.lit(m[0])) != 0).otherwise((differ.bitwiseAND(F.lit(m[0])) != 0) & (differ.bitwiseAND(F.lit(m[1])) != 0))
    return out


def places(queries: DataFrame, tiled: DataFrame, mismatches: int = 1, index: DataFrame | None = None, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """All places of ``queries(query, seq)`` with at most ``mismatches`` (0 or 1): query, chrom, strand, start, mm.

    A query shorter than the least level has none, nor one with signs that are no letters; letters other than A, C, G
    and T are mismatches on either side.
    ``index`` is what save_seeds() gives for the same levels; without one, seeds are made of the levels that these
    queries need.  ``queries`` should be a stored table then, as their lengths are looked at first.
    """
    if mismatches not in (0, 1):
        raise ValueError("seeds of three parts find no more than one mismatch")
    if index is None:
        n = F.length("seq")
        level = F.coalesce(*[F.when(n >= k, F.lit(k)) for k in sorted(levels, reverse=True)]).alias("level")
        used = [r["level"] for r in queries.select(level).where("level is not null").distinct().collect()]  # a few numbers
        index = seeds(tiled, tuple(used) or levels[:1])
    g = index.select("shape", "seed", "chrom", "pos", "room", F.col("word").alias("g_word"), F.col("odd").alias("g_odd"))
    q = _lookups(queries, levels)
    mm = packed.mismatches(F.col("word"), F.col("g_word"), F.col("odd"), F.col("g_odd"), packed.first_bases(F.col("n")))
    near = (F.col("room") >= F.least("n", F.lit(WORD))) & (mm <= mismatches) & _first_shape(levels)

    def hits(some: DataFrame) -> DataFrame:
        # Spark's estimate knows the genome's file but not how many seeds come of it, so a merge join is asked for
        return some.join(g.hint("merge"), ["shape", "seed"]).where(near).select("query", "strand", "plus", "n", "chrom", F.col("pos").alias("start"), mm.alias("mm"))

    out = ["query", "chrom", "strand", "start", "mm"]
    short = hits(q.where(F.col("n") <= WORD))
    rest = fetch(hits(q.where(F.col("n") > WORD)), tiled, F.col("start"), F.col("n"), "reference")
    tail = lambda c: F.substring(c, F.lit(WORD + 1), F.col("n") - WORD)
    rest = rest.withColumn("mm", F.col("mm") + packed.text_mismatches(tail(F.col("plus")), tail(F.col("reference")))).where(F.col("mm") <= mismatches)
    return short.select(*out).unionByName(rest.select(*out))


def unique_best(found: DataFrame, most: int = 1) -> DataFrame:
    """For each query with at most ``most`` places among those with its fewest mismatches, the least of them."""
    level = found.groupBy("query", "mm").agg(F.count("*").alias("n"), F.min(F.struct("chrom", "strand", "start")).alias("p"))
    best = level.groupBy("query").agg(F.min(F.struct("mm", "n", "p")).alias("b")).where(F.col("b.n") <= most)
    return best.select("query", "b.p.*", F.col("b.mm").alias("nm"))


def rounds_of(three: bool = False, five: bool = False, both: bool = False) -> list[tuple[int, int, int, str]]:
    """The rounds of one kind of trimming; all of them if none is named, and no more than one may be."""
    if three + five + both > 1:
        raise ValueError("choose one of the three kinds of trimming")
    return [r for r in ROUNDS if not (three and r[1]) and not (five and r[2])]


def options(line: str) -> dict[str, int]:
    """``mismatches`` and ``most`` of a short-read aligner's command line, such as ``-v 1 -m 1 --best --strata``.

    Only the best stratum is ever reported, so both of its flags must be there; other flags concern files and formats.
    """
    words = line.split()
    value = lambda flag, default: int(words[words.index(flag) + 1]) if flag in words else default
    out = {"mismatches": value("-v", 1), "most": value("-m", 1)}
    if out["mismatches"] not in (0, 1) or out["most"] < 1:
        raise ValueError("-v is 0 or 1, and -m at least 1")
    if not {"--best", "--strata"} <= set(words):
        raise ValueError("only --best --strata is offered")
    return out


def _cascade_by_index(reads: DataFrame, tiled: DataFrame, rounds: list[tuple[int, int, int, str]], mismatches: int, most: int, index: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """trim_cascade() with seeds that are stored: every distinct trimmed sequence of all reads and rounds is written once and
    aligned once, in one join, and a read's least round with a place wins."""
    reads = table(reads, "reads")
    tries = F.array(*[F.struct(F.lit(o).alias("step"), F.lit(a).alias("trim5"), F.lit(b).alias("trim3"), F.lit(n).alias("trim_step")) for o, a, b, n in rounds])
    r = reads.withColumn("t", F.explode(tries)).select(*reads.columns, "t.*")
    cut = F.coalesce(*[F.when((F.col("trim5") == a) & (F.col("trim3") == b), trim("seq", a, b)) for _, a, b, _ in rounds])
    r = r.withColumn("cut", cut)
    cuts = table(r.select("cut").distinct(), "cuts").select(F.col("cut").alias("query"), F.col("cut").alias("seq"))
    mapped = unique_best(places(cuts, tiled, mismatches, index, levels), most).withColumnRenamed("query", "cut")
    each = r.join(mapped, "cut").drop("cut")
    return each.groupBy(F.col("read_id").alias("_read")).agg(F.min_by(F.struct(*each.columns), "step").alias("m")).select("m.*")


def _enough(levels: tuple[int, ...], tiled: DataFrame) -> tuple[int, ...]:
    """The levels up to the first whose seeds have some eight places of the genome each at most; above it seeds are longer,
    but meet hardly less, and every level is three rows for each base."""
    bases = tiled.agg(F.sum(F.length("bases"))).first()[0] or 0
    rare = [k for k in sorted(levels) if 8 * 4 ** (k - (k + 2) // 3) >= bases]
    return tuple(k for k in sorted(levels) if not rare or k <= rare[0])


def _padded_seeds(tiled: DataFrame, levels: tuple[int, ...], pad: int, tile: int = TILE, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, chrom, pos, info, word, odd): seeds of the genome's own places whose word begins ``pad`` bases before them.

    ``key`` is the seed with its shape in the bits that no level uses.  ``info`` holds the word's room and the least and
    the most bases before the place that it may answer for: a tile's first places don't know all of them, so the tile before also
    gives these places, from its margin, for just the numbers of bases that the tile itself can't.  With keys that are
    ``wanted`` there are only these.
    """
    bits = {level * 3 + k: m for level in sorted(levels) for k, m in enumerate(masks(level))}
    by_shape = None
    if wanted is not None:
        sought = {shape: np.unique(wanted[wanted & 255 == shape] & m) for shape, m in bits.items()}
        bits = {shape: m for shape, m in bits.items() if len(sought[shape])} or {min(bits): bits[min(bits)]}
        by_shape = [(m, sought[shape]) for shape, m in bits.items() if len(sought[shape])]
    w = packed.windows(tiled, tile + pad, min(levels), before=True, wanted=by_shape)
    asked = lambda k: F.lit(True) if wanted is None else F.col("which").bitwiseAND(F.lit(1 << k)) != 0
    before = lambda back, c: F.call_function("shiftleft", back.bitwiseAND(F.lit((1 << 2 * pad) - 1)), F.lit(2 * (WORD - pad))).bitwiseOR(F.call_function("shiftright", c, F.lit(2 * pad)))
    info = F.least(F.col("room") + pad, F.lit(WORD)) + 64 * F.greatest(F.col("inside") - tile + 1, F.lit(0)) + 4096 * F.least(F.col("inside"), F.lit(pad))
    keys = F.array(*[F.when((F.col("room") >= shape // 3) & asked(k), F.col("word").bitwiseAND(F.lit(m)).bitwiseOR(F.lit(shape))) for k, (shape, m) in enumerate(bits.items())])
    w = w.withColumn("key", F.explode_outer(keys)).where("key is not null")
    return w.select("key", "chrom", (F.col("pos") - pad).alias("pos"), info.cast("int").alias("info"), before(F.col("back"), F.col("word")).alias("word"), before(F.col("back_odd"), F.col("odd")).alias("odd"))


def _probes(reads: DataFrame, rounds: list[tuple[int, int, int, str]], pad: int) -> DataFrame:
    """(row, strand, text, only): what of ``reads(row, seq)`` is looked up.

    A read is one probe a strand for all rounds: what they have in common, without ``pad`` bases at either end, is
    sought.  If that is too short for good seeds, each round's sequence is a probe of its own, with ``pad`` signs before
    it that are not compared; ``only`` is that round's place in ``rounds``, else -1.
    """
    up = F.upper("seq")
    both = lambda x, head, only: [F.struct(F.lit("+").alias("strand"), F.concat(F.lit(head), x).alias("text"), F.lit(only).alias("only")), F.struct(F.lit("-").alias("strand"), F.concat(F.lit(head), reverse_complement(x)).alias("text"), F.lit(only).alias("only"))]
    single = [p for j, (_, a, b, _) in enumerate(rounds) for p in both(trim(up, a, b), "A" * pad, j)]
    each = F.when(F.length("seq") - 2 * pad >= JOINT, F.array(*both(up, "", -1))).otherwise(F.array(*single))
    return reads.select("row", F.explode_outer(each).alias("x")).select("row", "x.*").where(F.col("text").rlike("^[A-Z]+$"))


def _level_of(n: Column, levels: tuple[int, ...]) -> Column:
    return F.coalesce(*[F.when(n >= k, F.lit(k)) for k in sorted(levels, reverse=True)])


def _round_hits(reads: DataFrame, tiled: DataFrame, rounds: list[tuple[int, int, int, str]], mismatches: int, levels: tuple[int, ...], few: bool = False) -> DataFrame:
    """(row, strand, chrom, pos, only, codes): the places at which ``reads(row, seq)``, a stored table, align in any round.
    ``pos`` is that of the text's first base and ``codes`` has two bits a round: its mismatches, or 3 for no place.  The keys of
    ``few`` reads are collected, and the genome has no other seeds then."""
    pad = max(max(a, b) for _, a, b, _ in rounds)
    q = _probes(reads, rounds, pad).withColumn("n", F.length("text"))
    core = F.col("n") - pad - F.when(F.col("only") < 0, pad).otherwise(0)
    levels = _enough(levels, tiled)
    if max(levels) + pad > WORD or max(levels) > WORD - 4:
        raise ValueError("the levels leave no room for what is trimmed, or for a seed's shape")
    n = F.length("seq")
    asked = F.when(n - 2 * pad >= JOINT, F.array(_level_of(n - 2 * pad, levels))).otherwise(F.array(*[_level_of(n - a - b, levels) for _, a, b, _ in rounds]))
    seen = reads.select(n.alias("n"), F.explode(asked).alias("level")).groupBy("level").agg(F.max("n").alias("n")).collect()  # a row a level
    used = tuple(sorted(r["level"] for r in seen if r["level"] is not None)) or levels[:1]
    turned = lambda c: F.call_function("shiftleft", c, F.lit(2 * pad)).bitwiseAND(F.lit((1 << 2 * WORD) - 1))
    q = q.withColumns({"word": packed.word_of(F.col("text")), "odd": packed.odd_of(F.col("text")), "level": _level_of(core, used)})
    keys = F.coalesce(*[F.when(F.col("level") == k, F.array(*[turned(F.col("word")).bitwiseAND(F.lit(m)).bitwiseOR(F.lit(3 * k + i)) for i, m in enumerate(masks(k))])) for k in used])
    q = q.withColumn("key", F.explode_outer(keys)).where("key is not null")
    wanted = q.select("key").distinct().toArrow().column(0).to_numpy() if few else None
    g = _padded_seeds(tiled, used, pad, wanted=wanted).withColumnsRenamed({"word": "g_word", "odd": "g_odd"})
    within = lambda left, right: packed.first_bases(F.greatest(F.col("n") - right, F.lit(0))).bitwiseAND(F.bitwise_not(packed.first_bases(left)))
    shape = F.col("key").bitwiseAND(F.lit(255))
    # the core's bases, and the bits of the shapes before a row's own, one of which must differ in each, or a place would come up
    # twice; numbers that are never null, so that the join's own loop stays small
    before = [F.coalesce(*[F.when(shape == 3 * k + later, masks(k)[i] >> 2 * pad) for k in used for later in range(i + 1, 3)], F.lit(0)).cast("long") for i in (0, 1)]
    made = {"core": within(F.lit(pad), F.when(F.col("only") < 0, pad).otherwise(0)), "not0": before[0], "not1": before[1], "word": F.col("word"), "odd": F.col("odd")}
    q = q.withColumns({k: F.coalesce(v, F.lit(0).cast("long")) for k, v in made.items()}).select("row", "strand", "text", "only", "n", *made, "key")
    g = g.withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in ("g_word", "g_odd")})

    x = F.col("word").bitwiseXOR(F.col("g_word"))
    apart = x.bitwiseOR(F.call_function("shiftright", x, F.lit(1))).bitwiseOR(F.col("odd")).bitwiseOR(F.col("g_odd"))
    near = F.bit_count(apart.bitwiseAND(F.col("core"))) <= mismatches
    first = ((F.col("not0") == 0) | (x.bitwiseAND(F.col("not0")) != 0)) & ((F.col("not1") == 0) | (x.bitwiseAND(F.col("not1")) != 0))
    room, least, most = F.col("info").bitwiseAND(F.lit(63)), F.call_function("shiftright", F.col("info"), F.lit(6)).bitwiseAND(F.lit(63)), F.call_function("shiftright", F.col("info"), F.lit(12))

    def code(j: int) -> Column:
        left, right = _trims(rounds, j, pad)
        mm = F.bit_count(F.col("apart").bitwiseAND(within(left, right)))
        held = (room >= F.least(F.col("n") - right, F.lit(WORD))) & (F.lit(pad) - left).between(least, most)
        return F.when(F.col("only").isin(-1, j) & held & (mm <= mismatches), mm.cast("long")).otherwise(F.lit(3).cast("long"))

    none = (1 << 2 * len(rounds)) - 1
    codes = sum((F.call_function("shiftleft", code(j), F.lit(2 * j)) for j in range(len(rounds))), F.lit(0).cast("long")).alias("codes")

    def hits(some: DataFrame) -> DataFrame:
        # Spark's estimate knows the genome's file but not how many seeds come of it, so a merge join is asked for
        # what rounds make of a place comes after the shuffle, so that the join's own loop stays small
        met = some.join(g.hint("merge"), "key").where(near & first).select("row", "strand", "text", "only", "n", "chrom", "pos", "info", apart.alias("apart"))
        return met.repartition("row").withColumn("codes", codes).where(F.col("codes") != none)

    out = ["row", "strand", "chrom", "pos", "only", "codes"]
    short = hits(q.where(F.col("n") <= WORD).withColumn("text", F.lit(None).cast("string"))).select(*out)
    if not any(r["n"] is not None and r["n"] > WORD - pad for r in seen):
        return short
    rest = hits(q.where(F.col("n") > WORD)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(rounds) - 1)))).withColumn("mm", _code("codes", F.col("j"))).where("mm < 3")
    left, right = (F.coalesce(*[F.when(F.col("j") == j, _trims(rounds, j, pad)[k]) for j in range(len(rounds))]) for k in (0, 1))
    rest = fetch(rest.withColumns({"left": left, "right": right}), tiled, F.col("pos") + F.col("left"), F.col("n") - F.col("left") - F.col("right"), "reference")
    length = F.col("n") - F.col("right") - WORD
    tails = [F.when(length > 0, F.substring("text", F.lit(WORD + 1), length)).otherwise(""), F.when(length > 0, F.substring("reference", F.lit(WORD + 1) - F.col("left"), length)).otherwise("")]
    rest = rest.withColumn("mm", F.col("mm") + packed.text_mismatches(*tails)).where(F.col("mm") <= mismatches)
    alone_at = F.lit(none).cast("long") - F.call_function("shiftleft", F.lit(3).cast("long") - F.col("mm"), (F.col("j") * 2).cast("int"))
    return short.unionByName(rest.withColumn("codes", alone_at).select(*out))


def _once(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``rows`` with ``values``, each computed once a row; the optimizer would write them into every use, and those into the
    join before, whose generated methods then grow beyond what the JVM compiles."""
    made = rows.withColumn("_once", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))
    return made.withColumns({k: F.col(f"_once.{k}") for k in values}).drop("_once")


def _trims(rounds: list[tuple[int, int, int, str]], j: int, pad: int) -> tuple[Column, Column]:
    """The bases that a probe's text has before and after what round j compares."""
    _, five, three, _ = rounds[j]
    own = F.col("only") == j
    left = F.when(own, pad).when(F.col("strand") == "+", five).otherwise(three)
    return left, F.when(own, 0).when(F.col("strand") == "+", three).otherwise(five)


def _code(codes: str, j: Column) -> Column:
    return F.call_function("shiftright", F.col(codes), (j * 2).cast("int")).bitwiseAND(F.lit(3))


def _leading(rounds: list[tuple[int, int, int, str]], levels: tuple[int, ...]) -> list[tuple[int, int, int, str]]:
    """The rounds, from the first on, that keep the 5' end and trim no less than the one before."""
    out = list(takewhile(lambda r: r[1] == 0, rounds)) if min(levels) <= SPAN else []
    return [r for k, r in enumerate(out) if all(a[2] <= b[2] for a, b in zip(out[:k], out[1 : k + 1], strict=True))]


def _text_of(word: Column, n: Column) -> Column:
    """The first n bases of a word, of a word at most."""
    digits = F.conv(F.call_function("shiftright", word, (F.lit(2 * WORD) - n * 2).cast("int")).cast("string"), 10, 4)
    return F.translate(F.lpad(digits, n, F.lit("0")), "0123", "ACGT")


def _core_seeds(stored: DataFrame) -> DataFrame:
    """(key, rest, odd, spot): two rows for each place of ``stored(id, bases)``; ``key`` is twelve bases and their kind, ``rest`` up to
    twelve others, of which those that aren't known are all ``odd``; ``spot`` holds the tile's id and the place in it.

    A tile also has the places in its margin at which a read on the - strand may end that begins in its own bases.
    """
    w = packed.windows(stored.select(F.col("id").cast("string").alias("chrom"), F.lit(0).cast("long").alias("first"), "bases"), TILE + WORD - SPAN + THIRD, 2 * THIRD, before=True)
    third = (1 << 2 * THIRD) - 1
    part = lambda c, k: F.call_function("shiftright", c, F.lit(2 * (WORD - THIRD * (k + 1)))).bitwiseAND(F.lit(third))
    pair = lambda hi, lo: F.call_function("shiftleft", hi, F.lit(2 * THIRD)).bitwiseOR(lo)
    all_odd = F.lit(packed.LOWS & third).cast("long")
    after = F.when(F.col("room") >= SPAN, part(F.col("odd"), 2)).otherwise(all_odd)
    behind = F.when(F.col("inside") >= THIRD, F.col("back_odd").bitwiseAND(F.lit(third))).otherwise(all_odd)
    in_row = F.when((part(F.col("odd"), 0) == 0) & (part(F.col("odd"), 1) == 0), F.struct(pair(part(F.col("word"), 0), part(F.col("word"), 1)).cast("int").alias("key"), pair(F.col("back").bitwiseAND(F.lit(third)), part(F.col("word"), 2)).cast("int").alias("rest"), pair(behind, after).cast("int").alias("odd")))
    outer = F.when((F.col("room") >= SPAN) & (part(F.col("odd"), 0) == 0) & (part(F.col("odd"), 2) == 0), F.struct(pair(part(F.col("word"), 0), part(F.col("word"), 2)).bitwiseOR(F.lit(1 << 4 * THIRD)).cast("int").alias("key"), part(F.col("word"), 1).cast("int").alias("rest"), part(F.col("odd"), 1).cast("int").alias("odd")))
    spot = (F.call_function("shiftleft", F.col("chrom").cast("long"), F.lit(INSIDE)) + F.col("pos")).alias("spot")
    return w.withColumn("x", F.explode_outer(F.array(in_row, outer))).where("x is not null").select("x.key", "x.rest", F.col("x.odd").alias("odd"), spot)


def _core_hits(cores: DataFrame, tiled: DataFrame) -> DataFrame:
    """(core, strand, chrom, edge, short, long, word, odd): the places of ``cores(core)``, words of SPAN bases, with a mismatch at most.

    ``edge`` is where a read with that core begins, on the - strand the place after its last base.  A read has a
    place there if the bases that are compared are more than ``short`` and ``long`` at most; ``word`` and ``odd`` are the genome's from its 5' end on.
    """
    stored = table(tiled.repartition("chrom", "first").select(F.monotonically_increasing_id().alias("id"), "chrom", "first", "bases"), "tiles")
    text = _text_of(F.col("core"), F.lit(SPAN))
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("core").alias("word")), F.struct(F.lit("-").alias("strand"), packed.word_of(reverse_complement(text)).alias("word")))
    third = (1 << 2 * THIRD) - 1
    part = lambda k: F.call_function("shiftright", F.col("word"), F.lit(2 * (WORD - THIRD * (k + 1)))).bitwiseAND(F.lit(third))
    pair = lambda hi, lo: F.call_function("shiftleft", hi, F.lit(2 * THIRD)).bitwiseOR(lo)
    probe = lambda key, rest, up, least: F.struct(key.cast("int").alias("key"), F.call_function("shiftleft", rest, F.lit(up)).cast("int").alias("p_rest"), F.lit((packed.LOWS & third) << up).alias("mask"), F.lit(least).alias("least"))
    # the first two thirds equal, the last two, the outer ones: in the latter two cases the third left out differs, or the place would come up twice
    three = F.array(probe(pair(part(0), part(1)), part(2), 0, 0), probe(pair(part(1), part(2)), part(0), 2 * THIRD, 1), probe(pair(part(0), part(2)).bitwiseOR(F.lit(1 << 4 * THIRD)), part(1), 0, 1))
    q = cores.withColumn("x", F.explode(both)).select("core", "x.*").withColumn("x", F.explode(three)).select("core", "strand", "x.*")
    x = F.col("p_rest").bitwiseXOR(F.col("rest"))
    mm = F.bit_count(x.bitwiseOR(F.call_function("shiftright", x, F.lit(1))).bitwiseOR(F.col("odd")).bitwiseAND(F.col("mask")))
    # Spark's estimate knows the genome's file but not how many seeds come of it, so a merge join is asked for
    met = q.join(_core_seeds(stored).hint("merge"), "key").where((mm <= 1) & (mm >= F.col("least")))
    at = F.col("spot") - F.when(F.col("mask") > third, THIRD).otherwise(0)
    met = met.select("core", "strand", F.call_function("shiftright", at, F.lit(INSIDE)).alias("id"), at.bitwiseAND(F.lit((1 << INSIDE) - 1)).cast("int").alias("inside"))
    minus = F.col("strand") == "-"
    end = F.col("inside") + SPAN
    near = met.join(stored.hint("merge"), "id").where(minus | (F.col("inside") < TILE))
    begin = F.when(minus, F.greatest(end - WORD, F.lit(0))).otherwise(F.col("inside"))
    bases = F.regexp_replace(F.substring("bases", begin + 1, F.when(minus, end - begin).otherwise(F.lit(WORD))), "[^ACGT]", "N")
    near = _once(near.select("core", "strand", "chrom", "inside", (F.col("first") + F.when(minus, end).otherwise(F.col("inside"))).alias("edge"), bases.alias("bases")), {"rna": F.when(minus, reverse_complement("bases")).otherwise(F.col("bases"))})
    short = F.when(minus, F.greatest(end - TILE, F.lit(0))).otherwise(0)
    return near.select("core", "strand", "chrom", "edge", short.alias("short"), F.length("rna").alias("long"), packed.word_of(F.col("rna")).alias("g_word"), packed.odd_of(F.col("rna")).alias("g_odd"))


def _lead_rounds(kept: DataFrame, tiled: DataFrame, lead: list[tuple[int, int, int, str]], mismatches: int, most: int) -> DataFrame:
    """``kept(row, seq, ...)`` with what its first round among ``lead`` with a unique best place tells, stored: j, the round's place in
    ``lead`` or null; strand, chrom, start, nm; ``ref_word``, the genome's bases from the whole read's 5' end on, null
    if they aren't known; and ``lost``: the whole read has too many exact places, and so has all that could be left of it."""
    n = F.length("seq")
    up = F.upper("seq")
    easy = n.between(SPAN, WORD) & up.rlike("^[ACGT]+$")
    r = kept.withColumn("word", F.when(easy, packed.word_of(up)))
    core = F.col("word").bitwiseAND(F.lit(packed.span(0, SPAN)))
    hits = _core_hits(r.where("word is not null").select(core.alias("core")).distinct(), tiled)
    # reads without a core have keys of their own, or one task would get them all
    r = r.withColumn("core", F.coalesce(core, -F.col("row") - 1))
    met = r.join(hits.hint("merge"), "core", "left")
    x = F.col("word").bitwiseXOR(F.col("g_word"))
    met = met.withColumn("apart", x.bitwiseOR(F.call_function("shiftright", x, F.lit(1))).bitwiseOR(F.col("g_odd")))

    def code(j: int) -> Column:
        left = n - lead[j][2]
        mm = F.bit_count(F.col("apart").bitwiseAND(packed.first_bases(left)))
        return F.when((left >= SPAN) & (left > F.col("short")) & (left <= F.col("long")) & (mm <= mismatches), mm).otherwise(3)

    met = _once(met, {f"c{j}": code(j) for j in range(len(lead))})
    own = Window.partitionBy("core", "row")
    count = {(j, m): F.sum((F.col(f"c{j}") == m).cast("int")).over(own) for j in range(len(lead)) for m in (0, 1)}
    met = met.withColumns({f"n{j}_{m}": c for (j, m), c in count.items()})
    unique = [F.when(F.col(f"n{j}_0") > 0, F.when(F.col(f"n{j}_0") <= most, 2 * j)).when(F.col(f"n{j}_1").between(1, most), 2 * j + 1) for j in range(len(lead))]
    met = _once(met, {"won": F.coalesce(*unique)})
    own_code = F.coalesce(*[F.when(F.floor(F.col("won") / 2) == j, F.col(f"c{j}")) for j in range(len(lead))])
    minus = F.col("strand") == "-"
    j, nm = F.floor(F.col("won") / 2).cast("int"), (F.col("won") % 2).cast("int")
    kept_bases = n - F.coalesce(*[F.when(j == k, x[2]) for k, x in enumerate(lead)])
    start = F.when(minus, F.col("edge") - kept_bases).otherwise(F.col("edge"))
    # a read without a win is one row, whatever its places; a winner's row is that of its least place
    first = F.row_number().over(own.orderBy(F.coalesce((own_code != nm).cast("int"), F.lit(0)), F.when(F.col("won").isNotNull(), F.col("chrom")), F.when(F.col("won").isNotNull(), F.col("strand")), F.when(F.col("won").isNotNull(), start)))
    met = met.withColumn("first", first).where("first = 1")
    whole = (n > F.col("short")) & (n <= F.col("long")) & (F.col("g_odd") == 0)
    lost = (F.col("n0_0") > most) & F.lit(lead[0][1:3] == (0, 0))
    return table(met.select(*kept.columns, j.alias("j"), "chrom", "strand", start.alias("start"), nm.alias("nm"), F.when(whole, F.col("g_word")).alias("ref_word"), lost.alias("lost")), "leading")


def _all_rounds(kept: DataFrame, columns: list[str], tiled: DataFrame, rounds: list[tuple[int, int, int, str]], mismatches: int, most: int, levels: tuple[int, ...], few: bool = False) -> DataFrame:
    """trim_cascade() of ``kept``, stored reads with their ``row``: each is looked up once for all rounds, by what they have in common."""
    hits = _round_hits(kept.select("row", "seq"), tiled, rounds, mismatches, levels, few)
    # how many places there are of each round with no and with one mismatch, over a read's own places
    own = Window.partitionBy("row")
    n = {(j, m): F.sum((_code("codes", F.lit(j)) == m).cast("int")).over(own) for j in range(len(rounds)) for m in (0, 1)}
    hits = hits.withColumns({f"n{j}_{m}": c for (j, m), c in n.items()})
    unique = [F.when(F.col(f"n{j}_0") > 0, F.when(F.col(f"n{j}_0") <= most, 2 * j)).when(F.col(f"n{j}_1").between(1, most), 2 * j + 1) for j in range(len(rounds))]
    hits = hits.withColumn("won", F.coalesce(*unique)).withColumns({"j": F.floor(F.col("won") / 2).cast("int"), "nm": F.col("won") % 2}).where(_code("codes", F.col("j")) == F.col("nm"))
    pad = max(max(a, b) for _, a, b, _ in rounds)
    start = F.col("pos") + F.coalesce(*[F.when(F.col("j") == j, _trims(rounds, j, pad)[0]) for j in range(len(rounds))])
    best = hits.groupBy("row").agg(F.min(F.struct("chrom", "strand", start.alias("start"), "nm", "j")).alias("b"))
    names = F.array(*[F.struct(F.lit(o).alias("step"), F.lit(a).alias("trim5"), F.lit(b).alias("trim3"), F.lit(x).alias("trim_step")) for o, a, b, x in rounds])
    both = kept.join(best, "row").withColumn("t", F.get(names, F.col("b.j")))
    return both.select(*columns, "t.*", "b.chrom", "b.strand", "b.start", "b.nm")


def trim_cascade(reads: DataFrame, tiled: DataFrame, rounds: list[tuple[int, int, int, str]] = ROUNDS, mismatches: int = 1, most: int = 1, index: DataFrame | None = None, levels: tuple[int, ...] = LEVELS, reference: bool = False) -> DataFrame:
    """Reads by the first round in which they have a unique best place: columns of ``reads``, chrom, strand, start,
    nm, and the round's step, trim5, trim3 and trim_step.

    ``reads(read_id, abundance, seq)``, one row a read, are stored, as they are read twice.  The rounds before the first that trims
    the 5' end are done by the read's first SPAN bases, which many reads share.  What has no place in them, and reads
    that are shorter, longer than a word or have other letters, are looked up once for all
    rounds, by what they have in common, and every place found tells for each round how many mismatches it has there.
    A read's first round with a place wins; a place that is dropped later is not retried in another round.
    With an ``index`` (save_seeds()) every distinct trimmed sequence of all reads and rounds is looked up in it instead.
    ``reference`` adds a column of the whole read's + strand bases where they are known already, for resolve_ends().
    """
    none = F.lit(None).cast("string").alias("reference")
    if index is not None:
        found = _cascade_by_index(reads, tiled, rounds, mismatches, most, index, levels)
        return found.select("*", none) if reference else found
    if mismatches not in (0, 1):
        raise ValueError("seeds of three parts find no more than one mismatch")
    rounds = sorted(rounds)
    kept = table(reads.withColumn("row", F.monotonically_increasing_id()), "reads")
    lead = _leading(rounds, levels)
    if not lead:
        found = _all_rounds(kept, reads.columns, tiled, rounds, mismatches, most, levels)
        return found.select("*", none) if reference else found
    done = _lead_rounds(kept, tiled, lead, mismatches, most)
    names = F.array(*[F.struct(F.lit(o).alias("step"), F.lit(a).alias("trim5"), F.lit(b).alias("trim3"), F.lit(x).alias("trim_step")) for o, a, b, x in lead])
    rna = _text_of(F.col("ref_word"), F.length("seq"))
    known = F.when(F.col("ref_word").isNotNull(), F.when(F.col("strand") == "-", reverse_complement(rna)).otherwise(rna)).alias("reference")
    out = done.where("j is not null").withColumn("t", F.get(names, F.col("j"))).select(*reads.columns, "t.*", "chrom", "strand", "start", "nm", *([known] if reference else []))
    rest = table(done.where("j is null and not lost").select(*kept.columns), "reads")
    left = rest.count()
    if not left:
        return out
    more = _all_rounds(rest, reads.columns, tiled, rounds, mismatches, most, levels, left <= FEW)
    return out.unionByName(more.select("*", none) if reference else more)


def resolve_ends(mapped: DataFrame, tiled: DataFrame) -> DataFrame:
    """Adds nte5, nte3, the whole read's start, end, + strand sequence and mismatch string; drops what lies off the
    genome or has two or more mismatches besides its end modifications.

    An end's candidate bases are those trimmed there and, inward of them, a mismatch at the aligned part's own end.
    All of them must differ from the genome, or the end has no modification and its mismatches count as internal.
    ``mapped`` may have a column ``reference`` of the whole read's + strand bases; where it is null they are fetched.
    """
    minus = F.col("strand") == "-"
    left = F.when(minus, F.col("trim3")).otherwise(F.col("trim5"))
    m = mapped.withColumns({"read_start": F.col("start") - left, "rna": F.upper("seq"), "plus": F.when(minus, reverse_complement("seq")).otherwise(F.upper("seq"))})
    if "reference" in mapped.columns:
        unknown = table(m.where("reference is null").drop("reference"), "mapped")
        known = m.where("reference is not null")
        m = known if unknown.isEmpty() else known.unionByName(fetch(unknown, tiled, F.col("read_start"), F.length("plus"), "reference"))
    else:
        m = fetch(m, tiled, F.col("read_start"), F.length("plus"), "reference")
    m = m.withColumn("read_end", F.col("read_start") + F.length("plus") - 1)
    m = _once(m, {"reference": F.col("reference"), "rna_ref": F.when(minus, reverse_complement("reference")).otherwise(F.col("reference"))})
    n = F.length("rna")
    differs = lambda i: F.substring("rna", i, F.lit(1)) != F.substring("rna_ref", i, F.lit(1))
    k3 = F.col("trim3") + F.when(differs((n - F.col("trim3")).cast("int")), 1).otherwise(0)
    k5 = F.col("trim5") + F.when(differs((F.col("trim5") + 1).cast("int")), 1).otherwise(0)
    m = m.withColumns({"k3": k3, "k5": k5})
    m = _once(m, {"k3": F.col("k3"), "k5": F.col("k5")})
    ends = {"nte3": resolved(F.right("rna_ref", F.col("k3")), F.right("rna", F.col("k3"))), "nte5": resolved(F.left("rna_ref", F.col("k5")), F.left("rna", F.col("k5")))}
    plus_differs = F.when(F.col("plus") == F.col("reference"), F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring("plus", i, F.lit(1)) != F.substring("reference", i, F.lit(1))))
    m = _once(m, ends | {"mismatches": F.transform(plus_differs, lambda i: F.struct((i - 1).cast("int").alias("offset"), F.substring("reference", i, F.lit(1)).alias("ref")))})
    inner = F.size("mismatches") - F.coalesce(F.length("nte5"), F.lit(0)) - F.coalesce(F.length("nte3"), F.lit(0))
    out = m.where(inner < INTERNAL_LIMIT).withColumn("md", md_render(F.col("mismatches"), n))
    return out.select("read_id", "abundance", "chrom", "strand", "read_start", "read_end", F.col("plus").alias("seq"), "nte5", "nte3", "nm", "md", "trim_step")
