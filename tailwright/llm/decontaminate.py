"""Benchmark decontamination by latent semantic retrieval.

Passages are 24 words long and begin every 12 words, in documents and in benchmark items alike; items of fewer
than 36 words are looked for by passages of 12 words every 6.  Their vectors hold TF-IDF weights of the benchmark's terms, with
document frequencies over all documents; every term weighs something, however common it is.  A randomised SVD of the
passages of all documents (range finder with one power iteration, products summed over tasks) gives latent
directions; every passage of every document is projected and compared with all item passages by cosine.  A candidate
must also hold a share of the item passage's IDF weight.  Neighbouring candidates form a segment, and the longest
common subsequence of its words with the item's decides: a leak has 0.7 of the item in order, or half of it together
with 0.8 of its last sentence, the answer.  The words shared must also hold a good part of the item's IDF weight, so
that common words alone make no leak.

Texts are hashed once: their words, as numbers of the benchmark's terms, are written to the shared folder, and the
frequencies, both products of the SVD and the search read those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tailwright.llm.session import bounded, documents, table
from tailwright.llm.textkernel import Block, bare, blocks

#: Words of a unit; passages are whole units: (units, units between beginnings).
UNIT = 6
LONG_SCALE, SHORT_SCALE = (4, 2), (2, 1)
#: Items of fewer words are searched for at the short scale, where a passage lies at most three words off.
LONG_ITEM = 36
#: Least weight of a term, that of one in every document.
LEAST_IDF = 0.1
#: Latent directions, and further ones that the range finder carries.
RANK, SPARE = 64, 16
#: Least cosine of a candidate.
COSINE = 0.5
LEAK, LEAK_WITH_ANSWER, ANSWER = 0.7, 0.5, 0.8
#: Least share of the item's IDF weight in the words shared, without and with its answer.
WEIGHT, WEIGHT_WITH_ANSWER = 0.5, 0.65
#: An item of fewer words must be there whole.
SHORT = 8
#: Least share of an item passage's IDF weight that a candidate passage must have in the item's terms.
SHARED = 0.3
#: Items whose passages are compared at once.
ITEMS = 1000
#: Units of text that are projected at a time, and about so many words are read at a time.
STEP, WORDS = 2048, 50_000


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bare words (A-Z lower-cased), and the number of each text's first word."""
    starts, ends, first = block.words()
    return block.hashes(*bare(block, starts, ends), lower=True), first


class Terms:
    """The benchmark's terms by number."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.keys = np.unique(hashes)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def number(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at) and len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == h[at], k, -1)
        return out


def passages(first: np.ndarray, scale: tuple[int, int] = LONG_SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, text and first unit (counted within the text) of each passage; the last one of a text may be
    shorter, and a text without words has none."""
    units, step = scale
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(1, -(-(n - units * UNIT) // (step * UNIT)) + 1), 0)
    doc = np.repeat(np.arange(len(n)), many)
    unit = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * step
    begin = first[doc] + unit * UNIT
    return begin, np.minimum(begin + units * UNIT, first[doc + 1]), doc, unit


def layout(term: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms as (UNIT, units), n where there is none, and the number of each text's first unit.

    Each text's units are followed by three empty ones, so that no passage reaches into the next text.
    """
    size = np.diff(first)
    room = -(-size // UNIT) + 3
    slot = np.cumsum(room) - room
    out = np.full(int(room.sum()) * UNIT, n, np.int32)
    out[np.arange(len(term)) + np.repeat(slot * UNIT - first[:-1], size)] = np.where(term < 0, n, term)
    return np.ascontiguousarray(out.reshape(-1, UNIT).T), slot


def bags(rows: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The sums of the ``rows`` that each column of ``index`` names, in pieces that stay in the cache."""
    out = np.empty((index.shape[1], rows.shape[1]), np.float32)
    room = np.empty((min(STEP, index.shape[1]), rows.shape[1]), np.float32)
    for a in range(0, index.shape[1], STEP):
        own = out[a : a + STEP]
        more = room[: len(own)]
        np.take(rows, index[0, a : a + STEP], axis=0, out=own, mode="clip")
        for k in range(1, len(index)):
            np.take(rows, index[k, a : a + STEP], axis=0, out=more, mode="clip")
            np.add(own, more, out=own)
    return out


def sums_by(key: np.ndarray, index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and for each the sum of its ``rows[index]``; ``key`` is in order and the last row is zero.

    Up to UNIT rows of a key are added at once, then up to UNIT of these sums, until each key has one.
    """
    while True:
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        room = -(-size // UNIT)
        slot = np.cumsum(room) - room
        at = np.full(int(room.sum()) * UNIT, len(rows) - 1, np.int64)
        at[np.arange(len(key)) + np.repeat(slot * UNIT - begin, size)] = index
        out = bags(rows, np.ascontiguousarray(at.reshape(-1, UNIT).T))
        if (room == 1).all():
            return key[begin], out
        key, index = np.repeat(key[begin], room), np.arange(len(out))
        rows = np.concatenate((out, np.zeros((1, out.shape[1]), np.float32)))


def weighted(basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The rows of terms times their weight, and one of zeros for what is no term."""
    return np.concatenate((basis * idf[:, None], np.zeros((1, basis.shape[1])))).astype(np.float32)


def unit_length(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by whole rows of bits; masks: the places of each word in the item."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


class Items:
    """Benchmark items: their words and answers as term numbers, and their passages."""

    def __init__(self, rows: list) -> None:
        texts = [(r["text"] or "").encode() for r in rows]
        self.ids = [r["item_id"] for r in rows]
        last = [re.split(r"(?<=[.!?])\s+|\n", t.decode().strip())[-1].encode() for t in texts]
        flat, self.first = word_hashes(Block(texts, 0)) if texts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        answers, self.answer_first = word_hashes(Block(last, 0)) if texts else (flat, self.first)
        self.terms = Terms(flat)
        self.term, self.answer = self.terms.number(flat), self.terms.number(answers)
        self.begin, self.end, self.item, _ = passages(self.first)

    def words(self, i: int) -> np.ndarray:
        return self.term[self.first[i] : self.first[i + 1]]

    def last_words(self, i: int) -> np.ndarray:
        """Those of the answer; of an item without one, all."""
        own = self.answer[self.answer_first[i] : self.answer_first[i + 1]]
        return own if len(own) else self.words(i)


class Queries:
    """What the passages of some items are at each scale: vectors, items (counted from the first of them) and the IDF
    weight that a candidate must hold; and the terms of these items by a number of their own."""

    def __init__(self, items: Items, lo: int, hi: int, basis: np.ndarray, idf: np.ndarray) -> None:
        self.lo, self.hi = lo, hi
        first = items.first[lo : hi + 1] - items.first[lo]
        term = items.term[items.first[lo] : items.first[hi]]
        own, self.local = np.unique(term, return_inverse=True)
        self.number = np.full(len(idf) + 1, len(own), np.int32)
        self.number[own] = np.arange(len(own))
        self.idf, self.first = idf[own], first
        t, slot = layout(term, first, len(idf))
        latent = bags(weighted(basis, idf), t)
        weight = np.concatenate(([0], np.cumsum(idf[term])))
        self.scales = []
        for scale in (LONG_SCALE, SHORT_SCALE):
            begin, end, item, unit = passages(first, scale)
            fits = np.diff(first)[item] >= LONG_ITEM
            use = fits if scale == LONG_SCALE else ~fits
            at = (slot[item] + unit)[use]
            if len(at):
                vector = unit_length(sum(latent[at + k] for k in range(scale[0])))
                self.scales.append((scale, vector, item[use], (SHARED * (weight[end] - weight[begin]))[use].astype(np.float32)))

    def member(self) -> np.ndarray:
        """(terms and one that is none, items): a term's weight in the items that have it."""
        out = np.zeros((len(self.idf) + 1, self.hi - self.lo), np.float32)
        out[self.local, np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))] = self.idf[self.local]
        return out


class Searcher:
    """All that a search needs: items, directions, weights, and queries for ITEMS items at a time."""

    def __init__(self, items: Items, basis: np.ndarray, idf: np.ndarray) -> None:
        self.items, self.idf, self.rows = items, idf, weighted(basis, idf)
        n = len(items.ids)
        self.member: tuple[Queries | None, np.ndarray | None] = None, None
        self.queries = [Queries(items, a, min(n, a + ITEMS), basis, idf) for a in range(0, n, ITEMS)]

    def candidates(self, t: np.ndarray, slot: np.ndarray, first: np.ndarray, q: Queries, member: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """At each scale: passages' begins, ends and texts, and the candidates' passage numbers, items and cosines."""
        found: list[list] = [[] for _ in q.scales]
        made = [(passages(first, scale), scale) for scale, *_ in q.scales]
        units = [slot[p[2]] + p[3] for p, _ in made]
        for a in range(0, t.shape[1], STEP):
            part = t[:, a : a + STEP + 3]
            latent = bags(self.rows, part)
            pair = latent[:-1] + latent[1:]
            held: np.ndarray | None = None
            for k, (scale, vector, item, need) in enumerate(q.scales):
                lo, hi = np.searchsorted(units[k], (a, a + STEP))
                u = units[k][lo:hi] - a
                x = pair.take(u, axis=0)
                if scale == LONG_SCALE:
                    x += pair.take(u + 2, axis=0)
                c = x @ vector.T
                flat = np.flatnonzero(c >= np.maximum(COSINE * np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None])
                if not len(flat):
                    continue
                if held is None:
                    own = bags(member, q.number.take(part))
                    held = own[:-1] + own[1:]
                shared = held.take(u, axis=0)
                if scale == LONG_SCALE:
                    shared += held.take(u + 2, axis=0)
                x_at = flat // len(item)
                y_at = flat - x_at * len(item)
                ok = np.flatnonzero(shared.ravel().take(x_at * shared.shape[1] + item.take(y_at)) >= need.take(y_at))
                if len(ok):
                    x_at, y_at = x_at[ok], y_at[ok]
                    cosine = c.ravel()[flat[ok]] / np.linalg.norm(x, axis=1)[x_at]
                    found[k].append((x_at + lo, item[y_at], cosine))
        for (p, scale), hits in zip(made, found, strict=True):
            if hits:
                yield p[0], p[1], p[2], scale[0] * UNIT, *(np.concatenate(h) for h in zip(*hits, strict=True))

    def search(self, term: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, coverage, answer coverage) of the leaks in some texts."""
        items, idf = self.items, self.idf
        t, slot = layout(term, first, len(idf))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        masks: dict[int, dict[int, int]] = {}
        for q in self.queries:
            if self.member[0] is not q:
                self.member = q, q.member()
            member = self.member[1]
            for begin, end, doc, reach, at, item, cosine in self.candidates(t, slot, first, q, member):
                order = np.lexsort((at, item, doc[at]))
                at, item, cosine = at[order], item[order] + q.lo, cosine[order]
                cut = np.ones(len(at), bool)
                cut[1:] = (item[1:] != item[:-1]) | (doc[at[1:]] != doc[at[:-1]]) | (at[1:] - at[:-1] > 2)
                starts = np.flatnonzero(cut)
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                    d, i = int(doc[at[a]]), int(item[a])
                    n = int(items.first[i + 1] - items.first[i])
                    # the item may reach a passage's length beyond the passages that hit
                    segment = term[max(first[d], begin[at[a]] - reach) : min(first[d + 1], end[at[b - 1]] + reach)]
                    segment = segment[member[q.number.take(segment), i - q.lo] > 0]
                    if len(segment) < LEAK_WITH_ANSWER * n:
                        continue
                    if i not in masks:
                        masks[i] = places(items.words(i).tolist())
                    coverage = common(masks[i], n, segment.tolist()) / n
                    if coverage < LEAK_WITH_ANSWER:
                        continue
                    own, answer = items.words(i), items.last_words(i).tolist()
                    shared = float(idf[own][np.isin(own, segment)].sum()) / max(float(idf[own].sum()), 1e-9)
                    told = common(places(answer), len(answer), segment.tolist()) / len(answer)
                    plain = coverage >= (1 if n < SHORT else LEAK) and shared >= WEIGHT
                    if plain or n >= SHORT and told >= ANSWER and shared >= WEIGHT_WITH_ANSWER:
                        best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (coverage, told, float(cosine[a:b].max())))
        return [(d, i, c, v, t) for (d, i), (v, t, c) in best.items()]


def numbered(docs: DataFrame, items: Items, *keep: str) -> DataFrame:
    """``keep`` columns and ``words``: every word of ``text`` as a term's number (int32, -1 for what is no term)."""
    sent = docs.sparkSession.sparkContext.broadcast(items.terms)
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(len(keep)).to_pylist()):
                h, first = word_hashes(block)
                term = sent.value.number(h).astype("<i4")
                words = pa.array([term[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())
                yield pa.record_batch([*(c.slice(block.first, block.n) for c in batch.columns[:-1]), words], names=[*keep, "words"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{kinds}words binary")


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, terms, and where each text's begin; about WORDS words at a time."""
    size = [len(x) // 4 for x in column.to_pylist()]
    at = 0
    while at < len(size):
        end, total = at + 1, size[at]
        while end < len(size) and total + size[end] <= WORDS:
            total += size[end]
            end += 1
        term = np.frombuffer(b"".join(column.slice(at, end - at).to_pylist()), "<i4")
        yield at, term, np.concatenate(([0], np.cumsum(size[at:end])))
        at = end


def document_frequencies(words: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """For each of n terms the texts that have it, and the number of texts; over all of ``words``."""
    bounded(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros(n + 1, np.int64), 0
        for batch in batches:
            many += batch.num_rows
            for _, term, first in texts_of(batch.column(0)):
                cell = np.sort(np.repeat(np.arange(len(first) - 1), np.diff(first)) * (n + 1) + term + 1)
                total += np.bincount(cell[np.concatenate(([True], cell[1:] != cell[:-1]))[: len(cell)]] % (n + 1), minlength=n + 1)
        seen = np.flatnonzero(total[1:])
        yield pa.record_batch([pa.array(np.append(seen, -1)), pa.array(np.append(total[1:][seen], many))], names=["term", "df"])

    rows = words.select("words").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # one row a benchmark term
    term, df = rows.column("term").to_numpy(), rows.column("df").to_numpy()
    out = np.zeros(n, np.int64)
    out[term[term >= 0]] = df[term >= 0]
    return out, int(df[term < 0].sum())


def gram(term: np.ndarray, first: np.ndarray, q: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'(A q) for the TF-IDF rows A of all long passages of the texts, each of length one.

    A word's share is that of its unit, and a unit's the sum over the passages that hold it.
    """
    n = len(idf)
    out = np.zeros(q.shape, np.float32)
    t, slot = layout(term, first, n)
    latent = bags(weighted(q, idf), t)
    square = np.append(idf**2, 0).astype(np.float32)[t].sum(0)
    _, _, doc, unit = passages(first)
    at = slot[doc] + unit
    pair, square = latent[:-1] + latent[1:], square[:-1] + square[1:]
    z = pair.take(at, axis=0) + pair.take(at + 2, axis=0)
    back = np.zeros((len(latent) + 1, latent.shape[1]), np.float32)
    back[at] = z / np.maximum(square[at] + square[at + 2], 1e-9)[:, None]
    for k in (1, 2):  # what a passage has goes to its four units
        back[k:-1] += back[: -1 - k].copy()
    flat = t.ravel()
    own = np.flatnonzero(flat < n)
    if len(own):
        key = flat[own]
        order = np.argsort(key.astype(np.uint16) if n < 1 << 16 else key, kind="stable")
        key, total = sums_by(key[order], own[order] % t.shape[1], back)
        out[key] = total * idf[key, None]
    return out


def directions(docs: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """The leading right singular directions (terms, RANK) of all passages of all ``docs(text)`` and items."""
    return latent_directions(numbered(docs, items), items, idf)


def latent_directions(words: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """By a randomised SVD: what the tasks have is added up in the executors, so that the driver gets a row a term."""
    n = len(items.terms.keys)
    width = min(RANK + SPARE, n)
    sc = words.sparkSession.sparkContext
    y = np.random.default_rng(3).normal(size=(n, width)).astype(np.float32)
    names = [f"y{k}" for k in range(width)]
    for _ in range(2):
        q, _ = np.linalg.qr(y)
        q = np.ascontiguousarray(q, np.float32)
        sent = sc.broadcast((q, idf))
        bounded(words.sparkSession)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, idf = sent.value
            total = np.zeros(q.shape)
            for batch in batches:
                for _, term, first in texts_of(batch.column(0)):
                    total += gram(term, first, q, idf)
            own = np.flatnonzero(total.any(1))
            for a in range(0, len(own), 5000):
                yield pa.record_batch([pa.array(own[a : a + 5000]), *(pa.array(total[own[a : a + 5000], k]) for k in range(width))], names=["term", *names])

        summed = words.select("words").mapInArrow(run, "term long, " + ", ".join(f"{c} double" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        y = gram(items.term, items.first, q, idf).astype(np.float64)
        y[summed.column("term").to_numpy()] += np.stack([summed.column(c).to_numpy() for c in names], 1)
    _, vector = np.linalg.eigh(((g := q.T @ y) + g.T) / 2)
    return np.ascontiguousarray(q @ vector[:, ::-1][:, :RANK], np.float32)


def searcher(words: DataFrame, items: Items) -> Searcher:
    """Fitted on all of ``words``."""
    df, n_docs = document_frequencies(words, len(items.terms.keys))
    idf = (np.log((n_docs + 20) / (df + 1)) + LEAST_IDF).astype(np.float32)
    return Searcher(items, latent_directions(words, items, idf), idf)


def items_of(benchmark: DataFrame) -> Items:
    """The benchmark, which comes to the driver whole: a row an item."""
    return Items(benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").collect())


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, cosine, coverage, answer_coverage): the benchmark items that each document holds.

    One row per row of ``docs`` and item found, the item's best place; a row without a leak gives none.  Items are
    ``benchmark(item_id, text)``; null, empty or wordless ones and documents match nothing, repeated ones are all
    reported.  Only the id and the text are read, so other columns may have any name.
    """
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema["item_id"].dataType
    schema = f"`{id_col}` {kind.simpleString()}, item_id {item_kind.simpleString()}, cosine double, coverage double, answer_coverage double"
    item_arrow = to_arrow_type(item_kind)
    items = items_of(benchmark)
    if not len(items.term):
        return docs.sparkSession.createDataFrame([], schema)
    words = table(numbered(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), items, "id"), "words")
    sent = docs.sparkSession.sparkContext.broadcast(searcher(words, items))
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at, term, first in texts_of(batch.column(1)):
                found = model.search(term, first)
                if found:
                    d, i, c, v, t = zip(*found, strict=True)
                    own = batch.column(0).take(pa.array(np.array(d) + at))
                    yield pa.record_batch([own, pa.array([model.items.ids[k] for k in i], item_arrow), pa.array(c, pa.float64()), pa.array(v, pa.float64()), pa.array(t, pa.float64())], names=[id_col, "item_id", "cosine", "coverage", "answer_coverage"])

    return words.select("id", "words").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; judged row by row, without a join.

    Rows with a null, empty or wordless text stay, repeated rows are judged alike, and without items all rows stay.
    """
    items = items_of(benchmark)
    if not len(items.term):
        return docs
    words = table(numbered(docs.select(F.col(text).alias("text")), items), "words")
    sent = docs.sparkSession.sparkContext.broadcast(searcher(words, items))
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for block in blocks(batch.column(1).to_pylist(), 1 << 19):
                h, first = word_hashes(block)
                keep[[block.first + f[0] for f in model.search(model.items.terms.number(h), first)]] = False
            yield batch.select([0]).filter(pa.array(keep))

    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("binary").alias("text"))
    return ready.mapInArrow(run, ready.select("row").schema).select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
