"""Byte-level BPE by a hierarchical-bitmap rank queue.

Every merge rank has a bucket of linked-list positions.  Three levels of 64-bit words say which buckets hold
anything; find-first-set from the top gives the lowest rank.  A position whose pair has changed since it was
queued is stale and skipped.  A merge costs O(1) queue work, however long the pre-token.

Two drivers share that queue.  ``merge_one`` takes one very long pre-token.  ``merge_many`` puts all distinct
pre-tokens of a block of documents into a single linked list with breaks between them: one pop yields every
position with that rank, and numpy merges the leftmost one of each pre-token.  Pre-tokens never touch, so the
lowest rank over all of them is also the lowest of each one that has it, and the result is that of one at a time.

Ids equal those of the tiktoken library for the same ranks and pattern, without special tokens: a pre-token that
is a vocabulary entry is that id; else the pair whose joined bytes have the lowest rank, leftmost first, merges.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import islice
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm.session import bounded, documents

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text whose distinct pre-tokens are encoded together.
GROUP_BYTES = 6 << 20
#: Distinct pre-tokens that a worker remembers; beyond it the memory starts afresh (results stay the same).
REMEMBERED = 100_000
#: A pre-token of more bytes is merged on its own.
LONG = 192
#: Characters of a text from which on its pre-tokens are not listed all at once.
AT_ONCE = 1 << 22


class RankQueue:
    """Buckets by rank under three levels of 64-bit words."""

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.bucket: dict[int, list] = {}

    def put(self, rank: int, item: Any) -> None:
        held = self.bucket.get(rank)
        if held is not None:
            held.append(item)
            return
        self.bucket[rank] = [item]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The lowest rank whose bucket holds anything, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        w = self.mid[a]
        b = a << 6 | (w & -w).bit_length() - 1
        w = self.low[b]
        return b << 6 | (w & -w).bit_length() - 1

    def take(self, rank: int) -> list:
        """The bucket of ``rank``, which is then empty."""
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))
        return self.bucket.pop(rank)


class Encoder:
    """Ranks, and the pairs of ids whose joined bytes have a rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.n = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = array("q"), array("q"), array("q")
        get = ranks.get
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a = get(token[:cut])
                if a is not None and (b := get(token[cut:])) is not None:
                    left.append(a), right.append(b), rank.append(r)
        keys = np.array(left, np.int64) * self.n + np.array(right, np.int64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slot_key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.slot_rank = np.full(len(self.slot_key), -1, np.int32)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slot_key[at[todo]] < 0]
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.slot_key[at[placed]], self.slot_rank[at[placed]] = keys[placed], np.array(rank, np.int64)[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] += 1
            if len(todo) and at[todo].max() >= len(self.slot_key):
                self.slot_key, self.slot_rank = np.append(self.slot_key, np.full(64, -1)), np.append(self.slot_rank, np.full(64, -1, np.int32))

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The same table as a dict, for one pre-token at a time."""
        full = self.slot_key >= 0
        return dict(zip(self.slot_key[full].tolist(), self.slot_rank[full].tolist(), strict=True))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left.astype(np.int64) * self.n + right
        at = self._slot(key)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_rank[at], -1)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at[todo] += 1
            found = self.slot_key[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; buckets are heaps of positions, so that the leftmost goes first."""
        n = len(piece)
        sym = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before, pairs, base = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs, self.n
        queued = [-1] * n
        queue = RankQueue(base)
        for i in range(n - 1):
            r = pairs.get(sym[i] * base + sym[i + 1], -1)
            queued[i] = r
            if r >= 0:
                queue.put(r, i)  # ascending positions already form a heap
        while (r := queue.first()) >= 0:
            heap = queue.bucket[r]
            while heap:
                i = heapq.heappop(heap)
                if queued[i] != r:
                    continue  # stale
                j = after[i]
                k = after[j]
                sym[i], after[i], queued[j] = r, k, -1
                lowest = r
                if k < n:
                    before[k] = i
                    q = pairs.get(r * base + sym[k], -1)
                else:
                    q = -1
                for at, rank in ((i, q), (before[i], pairs.get(sym[before[i]] * base + r, -1) if before[i] >= 0 else -1)):
                    if at < 0:
                        continue
                    queued[at] = rank
                    if rank >= 0:
                        if rank == r:
                            heapq.heappush(heap, at)
                        elif (held := queue.bucket.get(rank)) is not None:
                            heapq.heappush(held, at)
                        else:
                            queue.put(rank, at)
                        lowest = min(lowest, rank)
                if lowest < r:
                    break
            if not heap:
                queue.take(r)
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens, end to end, and where each begins (length ``len(pieces) + 1``)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        after = np.arange(1, total + 1, dtype=np.int32)
        after[end - 1] = -1
        before = np.arange(-1, total - 1, dtype=np.int32)
        before[end - size] = -1
        alive = np.ones(total, bool)
        queued = np.full(total, -1, np.int32)
        inner = np.flatnonzero(after >= 0).astype(np.int32)
        queued[inner] = self.rank_of(sym[inner], sym[inner + 1])
        queue = RankQueue(self.n)

        def put(at: np.ndarray) -> None:
            rank = queued[at]
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if len(at) <= 6:
                for r, i in zip(rank.tolist(), at, strict=True):
                    queue.put(r, np.array([i], np.int32))
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cut.tolist(), len(at)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                queue.put(int(rank[a]), at[a:b])

        put(inner)
        while (r := queue.first()) >= 0:
            held = queue.take(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[queued[at] == r]  # the rest is stale
            if len(at) > 1:
                at = np.sort(at)
                same = word[at[1:]] == word[at[:-1]]
                if same.any():
                    later = np.concatenate(([False], same))
                    wait = at[later]
                    at = at[~later]
                    if len(wait := wait[~np.isin(wait, at)]):
                        queue.put(r, wait)
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            sym[at], after[at] = r, far
            alive[gone] = False
            queued[gone] = queued[at] = -1
            has = far >= 0
            left, right = at[has], far[has]
            before[right] = left
            queued[left] = self.rank_of(sym[left], sym[right])
            prior = before[at]
            mine = at[prior >= 0]
            prior = prior[prior >= 0]
            queued[prior] = self.rank_of(sym[prior], sym[mine])
            put(np.concatenate((left, prior)))
        kept = np.flatnonzero(alive)
        begin = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.bincount(word[kept], minlength=len(pieces)), out=begin[1:])
        return sym[kept], begin

    def encode_pieces(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each pre-token, in order."""
        get = self.ranks.get
        many = [p for p in pieces if p not in self.ranks and len(p) <= LONG]
        ids, begin = self.merge_many(many) if many else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        k = 0
        for p in pieces:
            r = get(p)
            if r is not None:
                yield [r]
            elif len(p) > LONG:
                yield self.merge_one(p)
            else:
                yield ids[begin[k] : begin[k + 1]].tolist()
                k += 1

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Memory:
    """What a worker has encoded already: the distinct pre-tokens, numbered as they came.

    Of each it keeps the ids as text and the bytes that they decode to, as lists of ids would take far more room.
    """

    def __init__(self, encoder: Encoder, pattern: str) -> None:
        self.encoder, self.pattern = encoder, regex.compile(pattern)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(lambda: len(self.number))
        self.shown: list[str] = []
        self.plain: list[bytes] = []
        self.size = array("i")

    def tidy(self) -> None:
        """Between groups of documents: forgets everything if there is too much."""
        if len(self.number) > REMEMBERED:
            self.clear()

    def numbers(self, text: str) -> array:
        """The number of each pre-token of ``text``."""
        # of a very long text no list of all pieces is made
        found = self.pattern.findall(text) if len(text) < AT_ONCE else (m[0] for m in self.pattern.finditer(text))
        return array("i", map(self.number.__getitem__, found))

    def fill(self) -> None:
        """Encodes what numbers() has met since, and decodes it again."""
        have = len(self.shown)
        if len(self.number) > have:
            fresh = [t.encode() for t in islice(self.number, have, None)]
            for ids in self.encoder.encode_pieces(fresh):
                self.shown.append(",".join(map(str, ids)))
                self.plain.append(self.encoder.decode(ids))
                self.size.append(len(ids))

    def ids(self, numbers: array) -> list[int]:
        return [int(i) for k in numbers for i in self.shown[k].split(",")]

    def count(self, numbers: array) -> int:
        return int(np.frombuffer(self.size, np.int32)[np.frombuffer(numbers, np.int32)].sum()) if len(numbers) else 0


_MEMORY: dict[str, Memory] = {}


def memory(raw: bytes, pattern: str) -> Memory:
    """One per worker process and vocabulary."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = Memory(Encoder(parse_ranks(raw)), pattern)
    return _MEMORY[key]


def grouped(batches: Iterator[pa.RecordBatch], column: int, limit: int = GROUP_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Batches, cut and gathered so that each group has about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if held and size + part.column(column).nbytes > limit:
                yield held
                held, size = [], 0
            held.append(part)
            size += part.column(column).nbytes
    if held:
        yield held


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in batch.column(column).to_pylist()]


def read_ranks(path: str, limit: int = 64 << 20) -> bytes:
    """A vocabulary file; it goes to the executors, so its size is checked."""
    with open(path, "rb") as f:
        raw = f.read(limit + 1)
    if len(raw) > limit:
        raise ValueError(f"{path} has over {limit} bytes")
    return raw


def token_counts(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens) of every row: the number of ids of its whole text (null: 0)."""
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(RANKS)))
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mem = memory(raw.value, pattern)
        for group in grouped(batches, 1):
            docs = [[mem.numbers(t) for t in texts_of(b, 1)] for b in group]
            mem.fill()
            for b, numbers in zip(group, docs, strict=True):
                n = list(map(mem.count, numbers))
                yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])
            mem.tidy()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def encode_documents(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", id_col: str = "doc_id", output: str = "digest") -> DataFrame:
    """Encodes every whole text, one row out per row in (a null text counts as empty: no ids, digests of nothing).

    ``output='ids'``: (id, ids array<int>).  ``'digest'``: (id, n_tokens, ids_sha256, decoded_sha256), where the
    ids have been decoded again.  Other columns of ``df`` are not read, whatever their names; a null id stays null.
    """
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(RANKS)))
    sha = hashlib.sha256
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mem = memory(raw.value, pattern)
        for group in grouped(batches, 1):
            docs = [[mem.numbers(t) for t in texts_of(b, 1)] for b in group]
            mem.fill()
            for b, numbers in zip(group, docs, strict=True):
                if output == "ids":
                    yield pa.record_batch([b.column(0), pa.array(list(map(mem.ids, numbers)), pa.list_(pa.int32()))], names=["id", "ids"])
                    continue
                n = list(map(mem.count, numbers))
                ids = [sha(",".join(map(mem.shown.__getitem__, x)).encode()).hexdigest() for x in numbers]
                back = [sha(b"".join(map(mem.plain.__getitem__, x))).hexdigest() for x in numbers]
                yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            mem.tidy()

    kind = df.schema[id_col].dataType.simpleString()
    out = "ids array<int>" if output == "ids" else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, {out}").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, path: str | None = None, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, text binary): the bytes that each row's ids stand for (null ids: empty)."""
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(RANKS)))
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memory(raw.value, public_tokenizers.PATTERN).encoder
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([encoder.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, text binary").withColumnRenamed("id", id_col)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
