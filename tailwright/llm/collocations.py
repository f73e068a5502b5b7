"""Phrase collocations by hierarchical pair naming.

Texts become chunks: arrays of codes with a dictionary each, a break between pieces.  Level by level every element is
replaced by the name of the frequent gram that begins there: words by joining the chunks' dictionaries with the table
of frequent words, k-grams by joining a chunk's distinct pairs of adjacent (k-1)-gram names with the table of frequent
pairs.  A pair's parts are its parents, so counts of the parts of every cut, and the grams within a gram, are found by
joins on names; no phrase is counted as text but words.

What is shuffled is a chunk's distinct words and pairs with their counts, summed map-side, so a word or phrase of a
third of all tokens is a row a chunk.  Pairs that no frequent pair's bits allow stay out of the naming join; the bit
table has a fixed size and changes no result.  A chunk, the only group that a task takes whole, has CHUNK tokens, or
one text more.

Defined results: a null or empty text has no words, a null language is ``und``; every row is a document of its own.
Without words there is no row.  Columns other than text and language aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailwright.llm.line_dedup import SMALL, UPPER
from tailwright.llm.session import bounded, documents, table

#: Words of the longest phrase, its least count, the share of a phrase's count (%) in a longer one that drops it.
WORDS, LEAST, INSIDE = 3, 10, 50
#: Phrases of each language that are returned.
TOP = 2_000
SCALE = 1_000_000
#: Tokens of a chunk.
CHUNK = 1 << 20
#: Bits of the table that tells which pairs can be frequent (a power of two of at least 2^15).
BITS = 1 << 26
#: Parts in which each language's best are found before they are ranked.
PARTS = 32
UNKNOWN = "und"
#: Ends of pieces, and blanks between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_ONE_CASE = bytes.maketrans(UPPER.encode() + ENDS + BLANKS, SMALL.encode() + b"." * len(ENDS) + b" " * len(BLANKS))

CHUNKS = "chunk long, langs array<string>, words array<string>, codes binary"
NAMED = "chunk long, codes binary, names binary"
PAIRS = "chunk long, code int, left long, right long, n long"


def _packed(x: np.ndarray) -> bytes:
    """Numbers as bytes, those of one rank together, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True) + len(x).to_bytes(8, "little")


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[-8:], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw[:-8], n * size, "zstd"), np.uint8).reshape(size, n).T).view(kind).reshape(n)


def _chunks(size: int):
    """Codes are counted from 1 within a chunk; 0 ends a piece."""
    schema = pa.schema([("chunk", pa.int64()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = count(TaskContext.get().partitionId() << 32)
        seen: dict[tuple[str, bytes], int] = {}
        of_lang: dict[str, dict[bytes, int]] = {}
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            rows = {"chunk": next(names), "langs": [lang for lang, _ in seen], "words": [w.decode() for _, w in seen], "codes": _packed(np.concatenate(parts))}
            return pa.RecordBatch.from_pylist([rows], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = text.as_py().encode().translate(_ONE_CASE).replace(b".", b" . ").split()
                if not tokens:
                    continue
                lang = lang.as_py()
                known = of_lang.setdefault(lang, {b".": 0})
                for t in set(tokens).difference(known):
                    known[t] = len(seen) + 1
                    seen[lang, t] = known[t]
                parts.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
                parts.append(np.zeros(1, np.int32))
                held += len(tokens) + 1
                if held >= size:
                    yield close()
                    seen, of_lang, parts, held = {}, {}, [], 0
        if parts:
            yield close()

    return run


def chunks(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = CHUNK) -> DataFrame:
    """The stored table CHUNKS of all whole texts."""
    bounded(docs.sparkSession)
    said = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text")).where("text is not null")
    return table(said.mapInArrow(_chunks(size), CHUNKS), "chunks")


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's words with their counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            chunk, langs, words, codes = (batch.column(j)[k] for j in range(4))
            size = len(words)
            n = np.bincount(_unpacked(codes.as_py(), np.int32), minlength=size + 1)[1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, chunk.as_py())), pa.array(np.arange(1, size + 1, dtype=np.int32)), langs.values, words.values, pa.array(n.astype(np.int64))], names=["chunk", "code", "lang", "word", "n"])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, with ``name``: 1, 2, 3, ... without gaps."""
    stored = table(df.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a task that wrote
    before, rows = 1, []
    for k, n in sizes:
        rows.append((k, before))
        before += n
    begins = df.sparkSession.createDataFrame(rows, "part long, begin long")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("part", part).join(F.broadcast(begins), "part").withColumn("name", F.col("begin") + within).drop("part", "begin", "at")


def _together(left: DataFrame, right: DataFrame, f) -> DataFrame:
    """Chunks with what was found for them; a chunk's rows on either side are bounded by its size."""
    schema = pa.schema([("chunk", pa.int64()), ("codes", pa.binary()), ("names", pa.binary())])

    def run(of: pa.Table, found: pa.Table) -> pa.Table:
        codes, names = f(of, found["code"].to_numpy(), found["name"].to_numpy())
        return pa.Table.from_pylist([{"chunk": of["chunk"][0].as_py(), "codes": codes, "names": names}], schema=schema)

    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, NAMED)


def _placed(of: pa.Table, code: np.ndarray, name: np.ndarray) -> tuple[bytes, bytes]:
    """A chunk's codes, and the names of its codes' words, 0 for those that aren't frequent."""
    names = np.zeros(of["size"][0].as_py() + 1, np.int64)
    names[code] = name
    return of["codes"][0].as_py(), _packed(names)


def named_words(chunked: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, named): (lang, total) words of each language; (name, lang, word, n) of the frequent ones; and NAMED."""
    tallied = chunked.mapInArrow(_tallies, "chunk long, code int, lang string, word string, n long")
    counts = table(tallied.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    words = numbered(counts.where(F.col("n") >= least), "frequent_words")
    found = tallied.select("chunk", "code", "lang", "word").join(words.select("name", "lang", "word"), ["lang", "word"]).select("chunk", "code", "name")
    return totals, words, table(_together(chunked.select("chunk", F.size("words").alias("size"), "codes"), found, _placed), "named_words")


def _hashes(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (right.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(29))) & np.uint64(bits - 1)).astype(np.int64)


def _adjacent(codes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, key): the places where a named element is followed by one; equal pairs have equal keys, and the quotient and
    remainder of a key by the number of codes are those of its parts."""
    has = (names != 0)[codes]
    at = np.flatnonzero(has[:-1] & has[1:])
    return at, codes[at].astype(np.int64) * len(names) + codes[at + 1]


def _pairs(allowed: bytes | None):
    """A chunk's distinct adjacent pairs of names with their counts; only those that ``allowed`` has bits for.  Their
    code is their rank among all of the chunk's pairs, from 1 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = None if allowed is None else np.frombuffer(allowed, np.uint8)
        for batch in batches:
            for k in range(batch.num_rows):
                names = _unpacked(batch.column(2)[k].as_py(), np.int64)
                _, key = _adjacent(_unpacked(batch.column(1)[k].as_py(), np.int32), names)
                key, n = np.unique(key, return_counts=True)
                code = np.arange(1, len(key) + 1, dtype=np.int32)
                left, right = names[key // len(names)], names[key % len(names)]
                if room is not None:
                    h = _hashes(left, right, len(room) * 8)
                    can = (room[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
                    code, left, right, n = code[can], left[can], right[can], n[can]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), batch.column(0)[k].as_py())), pa.array(code), pa.array(left), pa.array(right), pa.array(n.astype(np.int64))], names=["chunk", "code", "left", "right", "n"])

    return run


def _paired(of: pa.Table, code: np.ndarray, name: np.ndarray) -> tuple[bytes, bytes]:
    """A chunk's places by codes of the frequent pairs that begin there, 0 for all else, and the names of the codes."""
    codes = _unpacked(of["codes"][0].as_py(), np.int32)
    at, key = _adjacent(codes, _unpacked(of["names"][0].as_py(), np.int64))
    own, inverse = np.unique(key, return_inverse=True)
    new = np.zeros(len(own), np.int32)
    new[code - 1] = np.arange(1, len(code) + 1, dtype=np.int32)
    out = np.zeros(len(codes), np.int32)
    out[at] = new[inverse]
    return _packed(out), _packed(np.concatenate([np.zeros(1, np.int64), name.astype(np.int64)]))


def _bits(pairs: DataFrame, bits: int) -> bytes:
    """A bit for each pair's hash: ``bits`` / 8 bytes, whatever the number of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits))], names=["h"])

    hashed = pairs.select("left", "right").mapInArrow(run, "h long")
    maps = hashed.groupBy(F.floor(F.col("h") / 32768).alias("k")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("m"))
    out = bytearray(bits // 8)
    for r in maps.toLocalIterator():
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = r["m"]
    return bytes(out)


def levels(docs: DataFrame, longest: int = WORDS, least: int = LEAST, text: str = "text", lang: str = "lang", size: int = CHUNK, bits: int = BITS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, total) words of each language, and for k = 1 to ``longest`` a table of the phrases of k words found at
    least ``least`` times: name, lang, phrase, last (its last word), n, ``left`` and ``right`` (names of the phrases
    without its last and without its first word), heads and tails (counts of its first and last 1 to k-1 words)."""
    spark = docs.sparkSession
    totals, words, named = named_words(chunks(docs, text, lang, size), least)
    none, empty = F.lit(0).cast("long"), F.array().cast("array<long>")
    found = [words.select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("left"), none.alias("right"), empty.alias("heads"), empty.alias("tails"))]
    for k in range(2, longest + 1):
        counts = named.mapInArrow(_pairs(None), PAIRS).groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        pairs = numbered(counts, "pairs")
        before = found[-1]
        a = before.select(F.col("name").alias("left"), "lang", "phrase", F.concat("heads", F.array("n")).alias("heads"))
        b = before.select(F.col("name").alias("right"), "last", F.concat("tails", F.array("n")).alias("tails"))
        joined = pairs.join(a, "left").join(b, "right")
        found.append(table(joined.select("name", "lang", F.concat("phrase", F.lit(" "), "last").alias("phrase"), "last", "n", "left", "right", "heads", "tails"), "grams"))
        if k < longest:
            likely = named.mapInArrow(_pairs(_bits(pairs, bits)), PAIRS).select("chunk", "code", "left", "right")
            named = _together(named, likely.join(pairs.select("name", "left", "right"), ["left", "right"]).select("chunk", "code", "name"), _paired)
            named = table(named, "named_pairs") if k + 1 < longest else named  # the last level is read once
    return totals, found


def _scored(grams: DataFrame, k: int) -> DataFrame:
    """With a, l, r and score of the lowest-scoring cut; all in decimals of 38 digits."""
    a = F.col("n").cast("decimal(16,0)")

    def cut(j: int):
        l, r = F.element_at("heads", j), F.element_at("tails", k - j)
        product = (l.cast("decimal(16,0)") * r.cast("decimal(16,0)")).cast("decimal(38,0)")
        score = F.call_function("div", (a * a).cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(7,0)"), product)
        return F.struct(score.alias("score"), F.lit(j).alias("k"), l.alias("l"), r.alias("r"))

    cuts = [cut(j) for j in range(1, k)]
    least = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return grams.withColumn("cut", least).select("name", "lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")


def phrases(docs: DataFrame, longest: int = WORDS, least: int = LEAST, inside: int = INSIDE, top: int = TOP, parts: int = PARTS, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words."""
    totals, found = levels(docs, longest, least, **options)
    kept = []
    for k in range(2, longest + 1):
        one = _scored(found[k - 1], k)
        if k < longest:  # any longer phrase around it holds one of k + 1 words that is found as often
            over = found[k].select(F.explode(F.array("left", "right")).alias("name"), F.col("n").alias("over")).groupBy("name").agg(F.max("over").alias("over"))
            one = one.join(over, "name", "left").where(~(F.coalesce("over", F.lit(0)) * 100 >= F.col("a") * inside)).drop("over")
        kept.append(one)
    every = reduce(DataFrame.unionByName, kept).drop("name")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    best = every.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(documents(spark, sf_dir))


def sql() -> str:
    lower = f"translate(text, '{UPPER}', '{SMALL}')"
    return f"""
with pieces as (
  select coalesce(lang, '{UNKNOWN}') lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\\x0A-\\x0D]')) piece from documents where text is not null),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from pieces),
g1 as (select lang, x, count(*) f from (select lang, unnest(w) x from words) group by all),
g2 as (select lang, x, y, count(*) f from (select lang, unnest(w[:-2]) x, unnest(w[2:]) y from words where len(w) >= 2) group by all),
g3 as (select lang, x, y, z, count(*) f from (select lang, unnest(w[:-3]) x, unnest(w[2:-2]) y, unnest(w[3:]) z from words where len(w) >= 3)
       group by all having count(*) >= {LEAST}),
totals as (select lang, cast(sum(f) as bigint) n from g1 group by lang),
p2 as (
  select lang, x || ' ' || y phrase, g.f a, l.f l, r.f r,
         cast(({SCALE}::hugeint * g.f * g.f) // (l.f::hugeint * r.f) as bigint) score
  from (select * from g2 where f >= {LEAST}) g join g1 l using (lang, x) join (select lang, x y, f from g1) r using (lang, y)
  where not exists (select 1 from g3 t where t.lang = g.lang and ((t.x = g.x and t.y = g.y) or (t.y = g.x and t.z = g.y)) and 100 * t.f >= {INSIDE} * g.f)),
c3 as (
  select g.lang, g.x || ' ' || g.y || ' ' || g.z phrase, g.f a, l1.f l1, r1.f r1, l2.f l2, r2.f r2,
         cast(({SCALE}::hugeint * g.f * g.f) // (l1.f::hugeint * r1.f) as bigint) s1,
         cast(({SCALE}::hugeint * g.f * g.f) // (l2.f::hugeint * r2.f) as bigint) s2
  from g3 g join g1 l1 on l1.lang = g.lang and l1.x = g.x join g2 r1 on r1.lang = g.lang and r1.x = g.y and r1.y = g.z
            join g2 l2 on l2.lang = g.lang and l2.x = g.x and l2.y = g.y join g1 r2 on r2.lang = g.lang and r2.x = g.z),
every as (
  select lang, phrase, a, l, r, score from p2
  union all
  select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from c3),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from every)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= {TOP}"""
