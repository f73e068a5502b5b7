"""Document quality by a linear-chain conditional random field over lines.

Every ``\\n``-split line is labelled good or bad.  Its potentials come from features of the line and of its two
neighbours; transitions tie successive lines.  The field is fitted by conditional likelihood on documents whose
lines all carry the document's label.  Forward-backward gives each line's probability of being good, and a
document's score is their mean weighted by line length in bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm.samples import labelled
from tailwright.llm.session import bounded, documents, extended, remainder
from tailwright.llm.textkernel import Block, blocks

#: The field is fitted on about so many labelled documents, chosen by a hash, of at most so many bytes in all, where a
#: line counts as LINE bytes at least, as its features are sent.
FIT_DOCS, FIT_BYTES, LINE = 4000, 32 << 20, 64
EPOCHS, RATE, RIDGE = 500, 0.1, 1e-5
#: A document is predicted good from this score on.
GOOD = 0.3


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_UPPER = _kind(bytes(range(65, 91)))
_LETTER = _kind(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_KINDS = [_UPPER, _LETTER, _kind(b"0123456789"), _kind(b"#*$%&|<>"), _kind(b"!?"), _kind(b".,;:'\"()-"), _kind(b"|")]
OWN = 14
NAMES = [
    *("upper", "letters", "digits", "symbols", "exclaimed", "punctuation", "bars", "capitals_beyond_ascii"),
    *("log_bytes", "log_words", "word_length", "same_as_last_word", "same_as_earlier_line", "empty"),
]
EARLIER = NAMES.index("same_as_earlier_line")
#: Bytes of the lines whose features are made at a time, and lines of a text's piece at least.
LINES_BYTES, PIECE = 1 << 20, 64
#: Constant, the line's own features, and those of the line before and after.
WIDTH = 1 + 3 * OWN


def _ranges(block: Block, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, Block]]:
    """Lines a to b of about LINES_BYTES at a time, whichever texts they are of, as a block of their own."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + LINES_BYTES)))
        yield a, b, Block([block.buf[starts[a] : ends[b - 1]].tobytes()], 0)
        a = b


def own_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' own features but "same_as_earlier_line", whether they have words, and their hashes."""
    starts, ends, _ = block.lines()
    size = ends - starts
    n = len(starts)
    own = np.zeros((n, OWN), np.float32)
    count = lambda table: np.add.reduceat(table[block.buf], starts)  # noqa: E731  a newline is of no kind
    per = np.maximum(size, 1)
    for k, table in enumerate(_KINDS):
        own[:, k] = count(table) / per
    pair = (block.buf[:-1] == 0xC3) & (block.buf[1:] >= 0x80) & (block.buf[1:] <= 0x9E)
    own[:, 7] = np.add.reduceat(np.append(pair, False).astype(np.float32), starts) / per
    own[:, 0] += own[:, 7]
    own[:, [3, 4, 6]] = np.sqrt(own[:, [3, 4, 6]])  # a few such signs already tell
    ws, we, _ = block.words()
    line = np.searchsorted(starts, ws, side="right") - 1
    words = np.bincount(line, minlength=n)
    own[:, 8] = np.log1p(size) / 5
    own[:, 9] = np.log1p(words) / 4
    own[:, 10] = np.bincount(line, np.minimum(we - ws, 40), minlength=n) / np.maximum(words, 1) / 10
    h = block.hashes(ws, we, lower=True)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    own[:, 11] = np.bincount(line, same, minlength=n) / np.maximum(words, 1)
    own[:, 13] = words == 0
    return own, words > 0, block.hashes(starts, ends)


def repeated(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a line equals an earlier one of its text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((key, doc))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return again


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, WIDTH), line lengths in bytes, and the number of each text's first line."""
    starts, ends, first = block.lines()
    n = len(starts)
    own, some, key = np.zeros((n, OWN), np.float32), np.zeros(n, bool), np.zeros(n, np.uint64)
    for a, b, part in _ranges(block, starts, ends):
        own[a:b], some[a:b], key[a:b] = own_features(part)
    own[:, EARLIER] = repeated(key, first) & some
    out = np.zeros((n, WIDTH), np.float32)
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = own
    out[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    out[first[:-1], 1 + OWN : 1 + 2 * OWN] = 0
    out[:-1, 1 + 2 * OWN :] = own[1:]
    out[first[1:] - 1, 1 + 2 * OWN :] = 0
    return out, ends - starts, first


def ragged(first: np.ndarray) -> list[np.ndarray]:
    """For each line position the lines at it, those of texts with more lines first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    have = n[order]
    begin = first[:-1][order]
    levels = []
    alive = len(order)
    for t in range(int(have[0]) if len(have) else 0):
        while have[alive - 1] <= t:
            alive -= 1
        levels.append(begin[:alive] + t)
    return levels


def pieces(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into pieces of about as many lines as the longest text has pieces, and of PIECE lines at least: each
    piece's first line, and each text's first piece."""
    n = np.diff(first)
    size = max(PIECE, math.isqrt(int(n.max(initial=0))))
    of_text = np.concatenate(([0], np.cumsum(-(-n // size))))
    begin = np.repeat(first[:-1] - of_text[:-1] * size, np.diff(of_text)) + np.arange(of_text[-1]) * size
    return np.append(begin, first[-1]), of_text


class Field:
    """Weights of the good state against the bad one, and log transition potentials [from, to]."""

    def __init__(self, weight: np.ndarray, move: np.ndarray) -> None:
        self.weight, self.move = weight, move

    def _ends(self, e: np.ndarray, step: np.ndarray, levels: list[np.ndarray], begin: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a piece is entered with, before its first line's potential, and what its last line is left with: each
        piece's lines are multiplied into one matrix, all pieces at once, and a text's matrices are passed through."""
        enter, leave = np.ones((len(begin) - 1, 2)), np.ones((len(begin) - 1, 2))
        across = ragged(of_text)
        if len(across) < 2:
            return enter, leave
        number = np.searchsorted(begin, levels[0], side="right") - 1
        whole = np.zeros((len(number), 2, 2))
        for t, rows in enumerate(levels):
            m = np.eye(2) * e[rows][:, None, :] if t == 0 else (whole[: len(rows)] @ step) * e[rows][:, None, :]
            whole[: len(rows)] = m / m.sum((1, 2))[:, None, None]
        whole = whole[np.argsort(number)]
        for here, after in zip(across, across[1:], strict=False):
            here = here[: len(after)]
            v = np.einsum("pi,pij->pj", enter[here], whole[here])
            enter[after] = v / v.sum(1)[:, None] @ step
        for here, after in zip(reversed(across[:-1]), reversed(across[1:]), strict=True):
            v = np.einsum("pij,pj->pi", whole[after], leave[after]) @ step.T
            leave[here[: len(after)]] = v / v.sum(1)[:, None]
        return enter, leave

    def chain(self, u: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line; log partition of every text; summed pair marginals [from, to].

        Forward-backward goes through all pieces of all texts at once, so a text of n lines takes some sqrt(n) steps.
        """
        u = np.clip(u, -30, 30).astype(np.float64)
        e = np.stack([np.ones(len(u)), np.exp(u)], 1)
        step = np.exp(self.move)
        begin, of_text = pieces(first)
        levels = ragged(begin)
        enter, leave = self._ends(e, step, levels, begin, of_text)
        fwd, scale = np.zeros((len(u), 2)), np.ones(len(u))
        for t, rows in enumerate(levels):
            a = (enter[np.searchsorted(begin, rows, side="right") - 1] if t == 0 else fwd[rows - 1] @ step) * e[rows]
            s = a.sum(1)
            fwd[rows], scale[rows] = a / s[:, None], s
        logz = np.add.reduceat(np.log(scale), first[:-1]) if len(first) > 1 else np.zeros(0)
        back = np.ones((len(u), 2))
        last = begin[1:] - 1
        back[last] = leave / (fwd[last] * leave).sum(1)[:, None]
        pairs = np.zeros((2, 2))
        for rows in reversed(levels[1:]):
            m = e[rows] * back[rows] / scale[rows][:, None]
            back[rows - 1] = m @ step.T
            pairs += (fwd[rows - 1].T @ m) * step
        inner = np.setdiff1d(begin[:-1], first[:-1])  # pieces that go on with a text
        pairs += (fwd[inner - 1].T @ (e[inner] * back[inner] / scale[inner][:, None])) * step
        p = fwd * back
        return p[:, 1] / p.sum(1), logz, pairs

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.chain(x @ self.weight, first)

    def potentials(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``line_features`` give times the weights, without holding them for all lines; line lengths; first lines."""
        starts, ends, first = block.lines()
        n = len(starts)
        weight = self.weight[1:].reshape(3, OWN).T
        to, some, key = np.zeros((n, 3)), np.zeros(n, bool), np.zeros(n, np.uint64)
        for a, b, part in _ranges(block, starts, ends):
            own, some[a:b], key[a:b] = own_features(part)
            to[a:b] = own @ weight
        to[repeated(key, first) & some] += weight[EARLIER]
        u = self.weight[0] + to[:, 0]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[first[:-1]] = after[first[1:] - 1] = False
        u[before] += to[np.flatnonzero(before) - 1, 1]
        u[after] += to[np.flatnonzero(after) + 1, 2]
        return u, ends - starts, first

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> Field:
        """Conditional likelihood of every line bearing its text's label, each text weighing the same, by Adam."""
        n = np.diff(first)
        y = np.repeat(label, n).astype(np.float64)
        share = np.repeat(1 / n, n)
        m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
        stay = np.array([[(label == 0) @ (n - 1), 0], [0, (label == 1) @ (n - 1)]])
        for step in range(1, EPOCHS + 1):
            p, _, pairs = self.marginals(x, first)
            g = np.concatenate((x.T @ ((p - y) * share) / len(n) + RIDGE * self.weight, ((pairs - stay) / n.sum()).ravel() + 0.02 * self.move.ravel()))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.weight = self.weight - move[:WIDTH]
            self.move = self.move - move[WIDTH:].reshape(2, 2)
        return self

    def scores(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Each text's score, and its number of lines that are rather bad."""
        u, size, first = self.potentials(block)
        p, _, _ = self.chain(u, first)
        weight = np.maximum(size, 1e-6)
        return np.clip(np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1), np.add.reduceat((p < 0.5).astype(np.int64), first[:-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Field:
    """Fits on ``labels(doc_id, quality)`` of ``docs``; null ids or labels teach nothing, and of an id that is
    labelled twice the higher label counts.  With no labelled row the field is neutral: every score is one half.
    Repeated ids count once, null texts are empty ones, and other columns of ``docs`` are not read."""
    chars = F.col("text").cast("string")
    lines = F.length(chars) - F.length(F.replace(chars, F.lit("\n"), F.lit(""))) + 1
    picked = labelled(docs, labels, "quality", FIT_DOCS, FIT_BYTES, 8, text, cost=F.greatest(F.length("text"), LINE * lines))
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for block in blocks(batch.column(1).to_pylist()):
                x, _, first = line_features(block)
                made += [x[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["label", "x"])

    rows = sorted((int(r["label"] > 0), bytes(r["x"])) for r in picked.mapInArrow(run, "label int, x binary").collect())  # of FIT_BYTES of text at most
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)))
    if not rows:
        return field
    parts = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for _, b in rows]
    return field.fit(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.array([k for k, _ in rows]))


def score(docs: DataFrame, field: Field, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` columns with score, predicted and bad_lines for every whole text, one row out per row in.

    A null or empty text is one empty line, whose score is that of any other empty line.  Repeated rows are scored
    alike; other columns of ``docs`` are not read, and those of ``keep`` may have any name but ``__text`` and those added.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    ready = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            s, bad = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for block in blocks(batch.column(batch.num_columns - 1).to_pylist()):
                own = slice(block.first, block.first + block.n)
                s[own], bad[own] = model.scores(block)
            yield pa.record_batch([*batch.columns[:-1], pa.array(s), pa.array((s >= GOOD).astype(np.int32)), pa.array(bad)], names=[*batch.schema.names[:-1], "score", "predicted", "bad_lines"])

    return ready.mapInArrow(run, extended(ready.schema.fields[:-1], "score double, predicted int, bad_lines long"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 5) == 0
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held).select("doc_id", "quality"))
    return score(docs, field, [F.col("doc_id"), held.alias("held_out")])
