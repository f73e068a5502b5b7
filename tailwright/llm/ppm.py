"""Language-model scores by prediction by partial matching over bytes.

A document is the token sequence of its text: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end.  The
byte model sees the words joined by one space and closed by a newline, which no word can hold.

Training counts every (context of ``ORDER`` bytes, next byte) of all training documents; shorter contexts are sums
of longer ones.  The counts form a trie by context suffix.  A byte is coded in the longest context known, with
escape probability d / 2n (d kinds seen, n times) to the next shorter one, where symbols already refused are
excluded; below order 0 the rest are equally likely.  The probabilities of each context thus sum to one.

All counts cover the whole corpus, and no context is left out: every distinct (context, next byte) of all documents
gets its probability once, in tasks that hold all contexts with the same last three bytes.  What is sent to the
executors is bounded: counts of up to two bytes of context, the ``MAX_GRAMS`` most frequent (context, next byte) with
their probabilities, and the ``MAX_HOT`` most frequent words, longer ones by a hash.  The rarer of both are joined by
shuffle, which has no hot key left, so the bounds change the cost and not the scores.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm.session import bounded, documents, remainder, table

#: Bytes of context.
ORDER = 5
#: (context, next byte) whose probabilities are sent to every executor; the others are joined.
MAX_GRAMS = 1_000_000
#: Orders up to this one are sent whole; tasks hold the longer contexts by their last LOW + 1 bytes.
LOW = 2
#: Rows of the trie that a task turns into probabilities at a time, and as many more as end the last three bytes.
TRIE_ROWS = 200_000
#: Words whose counts are sent to every executor; a word of more than HOT_BYTES bytes is counted by its hash.
MAX_HOT, HOT_BYTES = 200_000, 64
#: Additive smoothing of the base.
ADD = 0.1
#: Distinct words, and (context, next byte), that a task counts before it passes their counts on.
HELD_WORDS, HELD_GRAMS = 250_000, 1_000_000
#: Bytes of text per numpy step.
STEP_BYTES = 1 << 20

PAD = b"\n" * ORDER


def normalised(raw: bytes | None) -> list[bytes]:
    """The words of a text."""
    return (raw or b"").lower().split()


def keys_of(words: list[bytes]) -> list[bytes]:
    """The words, long ones by 192 bits of a hash after a space, with which no word begins."""
    if not words or max(map(len, words)) <= HOT_BYTES:
        return words
    return [w if len(w) <= HOT_BYTES else b" " + hashlib.blake2b(w, digest_size=24).digest() for w in words]


def stream(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as bytes, each text after ORDER newlines and closed by one; where each text begins and how long it is."""
    parts = [b" ".join(w) for w in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + ORDER + 1
    buf = np.frombuffer(b"".join([x for p in parts for x in (PAD, p, b"\n")]), np.uint8)
    return buf, np.cumsum(size) - size, size


def grams(buf: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each predicted byte, its context and itself as one integer."""
    wide = buf.astype(np.int64)
    out = wide[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= wide[ORDER - k : len(wide) - k] << (8 * k)
    real = np.ones(len(buf), bool)
    for k in range(ORDER):
        real[begin + k] = False
    return out[real[ORDER:]]


def steps(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of successive texts, about STEP_BYTES at a time, with the index of the first."""
    held: list[list[bytes]] = []
    size = first = 0
    for i, t in enumerate(texts):
        if held and size + len(t or b"") > STEP_BYTES:
            yield first, held
            held, size, first = [], 0, i
        held.append(normalised(t))
        size += len(t or b"")
    if held:
        yield first, held


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[bytes] = Counter()
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(back, np.concatenate(times)).astype(np.int64)

    def word_rows() -> pa.RecordBatch:
        n = len(words)
        return pa.record_batch([pa.array(np.full(n, -1)), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["gram", "word", "n"])

    def gram_rows(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(k), 100_000):
            part = k[at : at + 100_000]
            yield pa.record_batch([pa.array(part), pa.array([b""] * len(part), pa.binary()), pa.array(n[at : at + 100_000])], names=["gram", "word", "n"])

    for batch in batches:
        away = batch.column(1).to_pylist()
        for first, texts in steps(batch.column(0).to_pylist()):
            sides: tuple[list, list] = ([], [])
            for w, out in zip(texts, away[first : first + len(texts)], strict=True):
                sides[out].append(w)
            for w in sides[0]:
                words.update(keys_of(w))
            if sides[0]:
                words[b"\n"] += len(sides[0])
            for out, side in enumerate(sides):
                if side:
                    buf, begin, _ = stream(side)
                    k, n = np.unique(grams(buf, begin), return_counts=True)
                    keys.append(k), times.append(n * (1 - out))
                    held += len(k)
            if held > 2 * HELD_GRAMS:
                k, n = merged()
                keys, times, held = [k], [n], 0
                if len(k) > HELD_GRAMS:
                    yield from gram_rows(k, n)
                    keys, times = [], []
            if len(words) > HELD_WORDS:
                yield word_rows()
                words.clear()
    if words:
        yield word_rows()
    if keys:
        yield from gram_rows(*merged())


def train_counts(docs: DataFrame) -> DataFrame:
    """(gram, word, n): counts of words (gram -1; the end is a newline) and of ORDER + 1 bytes (word empty).

    Only rows of ``docs(text, held_out)`` that aren't held out count; those that only held-out texts have are there
    with n = 0 if they are bytes, and absent if they are words.
    """
    bounded(docs.sparkSession)
    found = docs.select("text", "held_out").mapInArrow(_counts, "gram long, word binary, n long")
    return found.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def at_least(counts: DataFrame, column: str, most: int) -> int:
    """The least power-of-1.25 count such that at most ``most`` rows have it or more."""
    h = counts.groupBy(F.floor(F.log(F.col(column).cast("double")) / math.log(1.25)).alias("b")).agg(F.count("*").alias("k"), F.min(column).alias("least")).collect()  # one row a power
    total, least = 0, 1 << 62
    for r in sorted(h, key=lambda r: -r["b"]):
        total += r["k"]
        if total > most:
            break
        least = r["least"]
    return least


class Level:
    """The contexts of one order: cells (context, next byte) as one integer, with their counts, and sums by context."""

    def __init__(self, cells: np.ndarray, n: np.ndarray) -> None:
        """Distinct cells in order; those of no count are left out."""
        self.cells, self.n = cells[n > 0], n[n > 0]
        self.nodes, self.of, self.kinds = np.unique(self.cells >> 8, return_inverse=True, return_counts=True)
        self.total = np.bincount(self.of, self.n, minlength=len(self.nodes))
        self.above = np.zeros(len(self.nodes))

    def refuse(self, shorter: Level, order: int) -> Level:
        """Keeps for each context how often the shorter one has its bytes."""
        self.above = np.bincount(self.of, shorter.counts(self.cells & ((1 << 8 * order) - 1)), minlength=len(self.nodes))
        return self

    def counts(self, cells: np.ndarray) -> np.ndarray:
        at, found = _find(self.cells, cells)
        return np.where(found, self.n[at], 0.0) if len(self.n) else np.zeros(len(cells))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` would be in the ordered ``keys``, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def level(cells: np.ndarray, n: np.ndarray, order: int) -> Level:
    """The level of contexts of ``order`` bytes, from cells of longer ones."""
    key, back = np.unique(cells & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
    return Level(key, np.bincount(back, n, minlength=len(key)))


def low_levels(cells: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels of orders 0 to LOW, from the cells of order LOW."""
    out = [level(cells, n, k) for k in range(LOW + 1)]
    return [out[0]] + [out[k].refuse(out[k - 1], k) for k in range(1, LOW + 1)]


def gram_scores(gram: np.ndarray, n: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 probability of each gram's last byte after its context.

    ``gram`` are distinct and hold all grams of each context of LOW + 1 last bytes that they hold; n = 0 is unseen.
    The bytes seen after a context were seen after every shorter one too, so what is excluded is always what the next
    longer known context has.
    """
    levels = list(low)
    for k in range(LOW + 1, ORDER + 1):
        levels.append(level(gram, n, k).refuse(levels[-1], k))
    out = np.zeros(len(gram))
    open_ = np.ones(len(gram), bool)
    kinds_before, above = np.zeros(len(gram)), np.zeros(len(gram))
    for k in range(ORDER, -1, -1):
        own = levels[k]
        cell = gram & ((1 << 8 * (k + 1)) - 1)
        at, known = _find(own.nodes, cell >> 8)
        if not len(own.nodes):
            continue
        c = own.counts(cell)
        total, kinds = own.total[at] - above, own.kinds[at] - kinds_before
        whole = own.kinds[at] == 256
        hit, miss = open_ & known & (c > 0), open_ & known & (c == 0) & (total > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[hit] += np.log10(np.where(whole, c / total, (2 * c - 1) / (2 * total)))[hit]
            out[miss] += np.log10(kinds / (2 * total))[miss]
        open_ &= ~hit
        above, kinds_before = np.where(known, own.above[at], 0), np.where(known, own.kinds[at], 0)
    out[open_] -= np.log10(256 - kinds_before[open_])
    return out


def gram_keys(gram: np.ndarray) -> pa.Array:
    """Grams as keys of a join with words: a newline, which no word begins with, and six bytes."""
    n = len(gram)
    rows = np.empty((n, ORDER + 2), np.uint8)
    rows[:, 0] = 10
    rows[:, 1:] = gram.astype(">i8").view(np.uint8).reshape(n, 8)[:, 8 - ORDER - 1 :]
    ends = np.arange(n + 1, dtype=np.int32) * (ORDER + 2)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def scored_grams(counts: DataFrame) -> DataFrame:
    """(gram, word, n, value): every gram of ``counts``, its key as a word, and its log10 probability."""
    five = counts.where("gram >= 0").select("gram", "n")
    spark = counts.sparkSession
    short = five.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1)).alias("cell")).agg(F.sum("n").alias("n")).toArrow()  # a row for three bytes that follow each other
    sent = spark.sparkContext.broadcast((short.column("cell").to_numpy(), short.column("n").to_numpy()))
    bounded(spark)
    tail, most = (1 << 8 * (LOW + 1)) - 1, TRIE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = low_levels(*sent.value)

        def rows(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            value = gram_scores(gram, n, low)
            for a in range(0, len(gram), 50_000):
                own = slice(a, a + 50_000)
                yield pa.record_batch([pa.array(gram[own]), gram_keys(gram[own]), pa.array(n[own]), pa.array(value[own])], names=["gram", "word", "n", "value"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= most:
                gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
                suffix = (gram >> 8) & tail
                cut = int(np.searchsorted(suffix, suffix[-1]))
                if cut:
                    yield from rows(gram[:cut], n[:cut])
                held, size = [(gram[cut:], n[cut:])], 0
        if held:
            yield from rows(*(np.concatenate(x) for x in zip(*held, strict=True)))

    suffix = F.shiftright("gram", 8).bitwiseAND(F.lit(tail))
    ready = five.withColumn("suffix", suffix).repartition("suffix").sortWithinPartitions("suffix").select("gram", "n")
    return table(ready.mapInArrow(run, "gram long, word binary, n long, value double"), "grams")


class Hot:
    """Probabilities of the most frequent grams: a table with one place a hash, and the rest in order."""

    BITS = 22

    def __init__(self, gram: np.ndarray, n: np.ndarray, value: np.ndarray) -> None:
        order = np.argsort(n, kind="stable")  # the most frequent one keeps the place
        gram, value = gram[order], value[order]
        self.keys, self.values = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS)
        slot = self.slots(gram)
        self.keys[slot], self.values[slot] = gram, value
        lost = np.flatnonzero(self.keys[slot] != gram)
        lost = lost[np.argsort(gram[lost])]
        self.more, self.more_values = gram[lost], value[lost]

    def slots(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each gram, 0 where it has none, and the places of those."""
        slot = self.slots(gram)
        value = self.values.take(slot)
        left = np.flatnonzero(self.keys.take(slot) != gram)
        value[left] = 0
        if len(self.more) and len(left):
            at, found = _find(self.more, gram[left])
            value[left[found]] = self.more_values[at[found]]
            left = left[~found]
        return value, left


class Model:
    """The whole trie as dense rows: log10 of each byte after each context.  Tests compare gram_scores() with it."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        order, context, symbol, n = (counts[c] for c in ("k", "context", "symbol", "n"))
        self.keys, dense = [], []
        for k in range(ORDER + 1):
            own = order == k
            key, at = np.unique(context[own], return_inverse=True)
            if k == 0 and not len(key):
                key = np.zeros(1, np.int64)
            d = np.zeros((len(key), 256), np.float32)
            np.add.at(d, (at, symbol[own]), n[own])
            self.keys.append(key), dense.append(d)
        self.start = np.cumsum([0] + [len(k) for k in self.keys])[: ORDER + 1]
        parent = [None] + [np.searchsorted(self.keys[k - 1], self.keys[k] & ((1 << 8 * (k - 1)) - 1)) for k in range(1, ORDER + 1)]
        self.log10 = np.empty((sum(map(len, self.keys)), 256), np.float32)
        for k in range(ORDER + 1):
            for a in range(0, len(self.keys[k]), 2048):
                at = np.arange(a, min(a + 2048, len(self.keys[k])))
                self.log10[self.start[k] + at] = np.log10(self._row(dense, parent, k, at))

    @staticmethod
    def _row(dense: list, parent: list, k: int, at: np.ndarray) -> np.ndarray:
        """The probability of each byte after each context."""
        out, mass, refused = np.zeros((len(at), 256)), np.ones((len(at), 1)), np.zeros((len(at), 256), bool)
        for j in range(k, -1, -1):
            c = np.where(refused, 0, dense[j][at]).astype(float)
            seen = c > 0
            n, kinds = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            more = ~(refused | seen).all(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(seen, mass * np.where(more, (2 * c - 1) / (2 * n), c / n), 0)
                mass = mass * np.where(more, np.where(n > 0, kinds / (2 * n), 1), 0)
            refused |= seen
            if j:
                at = parent[j][at]
        left = ~refused
        return out + np.where(left, mass / np.maximum(left.sum(1, keepdims=True), 1), 0)


_MODEL: dict[str, tuple[Hot, dict[bytes, float]]] = {}


def score_documents(docs: DataFrame, held_out: Column, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Scores every whole text by a model of the rows where ``held_out`` is false.

    One row per row of ``docs``, repeated ids included: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (additively smoothed unigram words) and score (PPM), both log10.  A null text is empty: one token, the
    end.  With no training rows every token has base log10(1) = 0 and bytes are equally likely.  Only the id and the
    text are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    counts = table(train_counts(base), "counts")
    words = counts.where("gram < 0").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == b"\n", F.col("n"))), F.lit(0)).alias("ends")).first()
    n, floor = total["n"], total["n"] + ADD * (total["v"] + 1)
    least = at_least(words, "n", MAX_HOT)
    hot = words.where(F.col("n") >= least).toArrow()
    scored = scored_grams(counts)
    often = at_least(scored.where("n > 0"), "n", MAX_GRAMS)
    top = scored.where(F.col("n") >= often).select("gram", "n", "value").toArrow()
    plain = tuple(top.column(c).to_numpy() for c in ("gram", "n", "value"))
    sent = spark.sparkContext.broadcast((plain, hot.column("word").to_pylist(), np.log10((hot.column("n").to_numpy() + ADD) / floor)))
    key, end_known, end_base = uuid.uuid4().hex, int(total["ends"] > 0), math.log10((total["ends"] + ADD) / floor)

    def model() -> tuple[Hot, dict[bytes, float]]:
        if key not in _MODEL:
            _MODEL.clear()
            frequent, name, value = sent.value
            _MODEL[key] = Hot(*frequent), dict(zip(name, value.tolist(), strict=True))
        return _MODEL[key]
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm, known = model()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, held = batch.column(0), batch.column(1)
            for first, texts in steps(batch.column(2).to_pylist()):
                buf, begin, size = stream(texts)
                gram = grams(buf, begin)
                score, cold = ppm.find(gram)
                size = size - ORDER
                cold_text = np.repeat(np.arange(len(texts)), size)[cold]
                score = np.add.reduceat(score, np.cumsum(size) - size)
                cold_row, cold_gram = row + cold_text, gram[cold]
                uid, word, times = [], [], []
                tokens, sure, sums = [], [], []
                for w in map(keys_of, texts):
                    rare = Counter([x for x in w if x not in known])
                    uid += [row] * (len(rare) + 1)
                    word += rare
                    times += rare.values()
                    word.append(b" %d" % row)  # no word begins with a space, and a hash is longer
                    times.append(0)
                    tokens.append(len(w) + 1)
                    inside = len(w) - sum(rare.values())
                    sure.append(inside + end_known)
                    sums.append(math.fsum([known[x] for x in w if x in known] if rare else map(known.__getitem__, w)) + end_base)
                    row += 1
                at = np.flatnonzero(np.array(times) == 0)
                order = np.lexsort((cold_gram, cold_row))
                cold_row, cold_gram = cold_row[order], cold_gram[order]
                new = np.flatnonzero(np.concatenate(([True], (cold_row[1:] != cold_row[:-1]) | (cold_gram[1:] != cold_gram[:-1])))[: len(order)])
                uid, times = np.append(uid, cold_row[new]), np.append(times, np.diff(np.append(new, len(order))))
                keys = pa.concat_arrays([pa.array(word, pa.binary()), gram_keys(cold_gram[new])])
                spread = np.full(len(uid), -1)
                spread[at] = np.arange(len(texts))
                pick = pa.array(spread, mask=spread < 0)
                own = slice(first, first + len(texts))
                columns = [ids[own].take(pick), held[own].take(pick), pa.array(tokens, pa.int64()).take(pick), pa.array(sure, pa.int64()).take(pick), pa.array(sums, pa.float64()).take(pick), pa.array(score).take(pick)]
                yield pa.record_batch([pa.array(uid, pa.int64()), keys, pa.array(times, pa.int32()), *columns], names=["uid", "word", "times", "id", "held_out", "n_tokens", "sure", "sums", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    parts = base.mapInArrow(run, f"uid long, word binary, times int, id {kind}, held_out boolean, n_tokens long, sure long, sums double, score double")
    rare = words.where(F.col("n") < least).select("word", F.col("n").alias("c"), F.lit(None).cast("double").alias("value"))
    rare = rare.unionByName(scored.where(F.col("n") < often).select("word", F.lit(None).cast("long").alias("c"), "value"))
    joined = parts.join(rare, "word", "left")
    value = F.log10((F.coalesce(F.col("c"), F.lit(0)) + F.lit(ADD)) / F.lit(floor))
    out = joined.groupBy("uid").agg(
        F.max("id").alias(id_col),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("sure") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("times").cast("long"))), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.max("sums") + F.sum(F.when(F.col("value").isNull(), F.col("times") * value).otherwise(0.0))).alias("base_score"),
        (F.max("score") + F.coalesce(F.sum(F.col("times") * F.col("value")), F.lit(0.0))).alias("score"),
    )
    return out.drop("uid")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), remainder("doc_id", 10) == 0)
