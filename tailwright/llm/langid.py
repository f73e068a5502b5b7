"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes (A-Z lower-cased) are classes; filters of several widths run over windows of ``WINDOW`` bytes; each filter's
maximum over a window feeds a softmax over the languages.  A document's distribution is the mean of its windows',
weighted by their lengths; every byte of the text lies in a window.

The filters act on one-hot bytes, so a filter of width w is a sum of w table rows.  Applied, the tables of
adjacent bytes are joined in pairs, which halves the look-ups.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailwright.llm.session import bounded, documents, extended, remainder
from tailwright.llm.textkernel import LOWER, blocks

#: Widths of the filters in bytes, and filters of each width.
WIDTHS, FILTERS = (2, 3, 4), 8
#: Bytes of a window.
WINDOW = 256
#: The network is fitted on up to so many distinct texts of each language, chosen by a hash.
FIT_DOCS = 600
#: Windows of one document that are fitted on at most, spread evenly over the whole text.
FIT_WINDOWS = 4
EPOCHS, BATCH, RATE = 6, 64, 0.02

UNKNOWN = "und"


def classes() -> np.ndarray:
    """Byte to class: digits share one, control bytes and spaces share one; A-Z are lower-cased."""
    c = LOWER.copy()
    c[48:58] = 48
    c[:33] = 32
    _, out = np.unique(c, return_inverse=True)
    return out.astype(np.int64)


CLASS = classes()
KINDS = int(CLASS.max()) + 1
GAP = int(CLASS[32])


def cut(text: bytes) -> np.ndarray:
    """A text as rows of WINDOW classes, the last one filled up with spaces; an empty text has one row."""
    c = CLASS[np.frombuffer(text, np.uint8)]
    n = max(1, -(-len(c) // WINDOW))
    out = np.full(n * WINDOW, GAP)
    out[: len(c)] = c
    return out.reshape(n, WINDOW)


class Network:
    """Filter tables by width (w, KINDS, FILTERS), biases, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, KINDS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.weight = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled features (rectified) and where each maximum lay."""
        pooled, where = [], []
        for w, t in zip(WIDTHS, self.tables, strict=True):
            out = t[0][rows[:, : WINDOW - w + 1]]
            for j in range(1, w):
                out = out + t[j][rows[:, j : WINDOW - w + 1 + j]]
            at = out.argmax(1)
            pooled.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0])
            where.append(at)
        return np.tanh(np.concatenate(pooled, 1)), where

    def fit(self, rows: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Network:
        """Cross-entropy by Adam; the gradient of a maximum goes to the bytes under it."""
        rng = np.random.default_rng(seed)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (*self.tables, self.weight, self.bias)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), BATCH):
                x, y = rows[order[a : a + BATCH]], label[order[a : a + BATCH]]
                h, where = self.forward(x)
                p = softmax(h @ self.weight + self.bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.weight.T) * (1 - h * h)
                grads = []
                for k, (w, t) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                    g = np.zeros_like(t)
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), where[k].shape)
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(x, where[k] + j, 1), f), part)
                    grads.append(g)
                grads += [h.T @ p, p.sum(0)]
                step += 1
                for param, g, (m, v) in zip((*self.tables, self.weight, self.bias), grads, state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def compile(self) -> Compiled:
        return Compiled(self)


class Compiled:
    """Tables of byte pairs for the windows of many documents at once."""

    def __init__(self, net: Network) -> None:
        self.net = net
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS))
        self.plan = []
        for w, t in zip(WIDTHS, net.tables, strict=True):
            parts = [(j, pair(t[j], t[j + 1])) for j in range(0, w - 1, 2)]
            if w % 2:
                parts.append((w - 1, t[w - 1].copy()))
            self.plan.append((w, parts))

    def probabilities(self, c: np.ndarray) -> np.ndarray:
        """A distribution for each WINDOW classes of ``c``."""
        both = c[:-1] * KINDS + c[1:]
        n = len(c) // WINDOW
        pooled = []
        for w, parts in self.plan:
            out = np.full((len(c), FILTERS), -np.inf, np.float32)
            last = len(c) - w + 1
            total = None
            for j, t in parts:
                index = (both if len(t) > KINDS else c)[j : j + last]
                rows = t.take(index, axis=0)
                total = rows if total is None else np.add(total, rows, out=total)
            out[:last] = total
            out = out.reshape(n, WINDOW, FILTERS)
            pooled.append(out[:, : WINDOW - w + 1].max(1))  # no filter reaches over the end of its window
        return softmax(np.tanh(np.concatenate(pooled, 1)) @ self.net.weight + self.net.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sample(docs: DataFrame, per_language: int = FIT_DOCS) -> list:
    """(windows, lang) of up to ``per_language`` distinct texts of every language, those of the least hashes.

    The hash alone decides, so a text counts once however many copies it has, and one language's rows take no other's
    place.  Rows are first thinned out by the language's number of distinct texts, to about four times what is wanted.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text", F.lit(5)).alias("lot"), F.col("text").cast("binary").alias("text"))
    last = F.greatest(F.ceil(F.length("text") / WINDOW), F.lit(1)) - 1
    at = F.array_distinct(F.array(*[F.floor(last * k / max(1, FIT_WINDOWS - 1)) for k in range(FIT_WINDOWS)]))
    hashed = known.select("lang", "lot", F.transform(at, lambda w: F.substring(F.col("text"), (w * WINDOW + 1).cast("int"), F.lit(WINDOW))).alias("windows"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("lot").alias("n")).select(F.col("lang").alias("known_lang"), F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n")).alias("share"))
    thin = hashed.join(F.broadcast(sizes), F.col("lang") == F.col("known_lang")).where(F.pmod("lot", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))  # one row a language
    one = thin.groupBy("lang", "lot").agg(F.min("windows").alias("windows"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("lot", F.lit(1 << 30)), "lot"))
    return one.withColumn("rank", rank).where(F.col("rank") <= per_language).select("windows", "lang").orderBy("lang", F.pmod("lot", F.lit(1 << 30)), "lot").collect()


def train(docs: DataFrame) -> Network | None:
    """A network for the languages of ``docs(text, lang)``; null with no labelled row."""
    rows = sample(docs)
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    number = {name: k for k, name in enumerate(languages)}
    x, y = [], []
    for r in rows:
        for w in r["windows"]:
            x.append(cut(bytes(w))[0]), y.append(number[r["lang"]])
    order = np.lexsort((np.arange(len(y)), y))
    return Network(languages).fit(np.array(x)[order], np.array(y)[order])


_NET: dict[str, Compiled] = {}


def predict(docs: DataFrame, net: Network | None, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns with lang_pred and score for every whole text, one row out per row in.

    lang_pred is the most probable language (on a tie the first by name) and score its mean probability.  A text that
    is null, empty or without a letter gives ``und`` with score 0, and so does every text if nothing was learned.
    Repeated rows are judged alike; other columns of ``docs`` are not read, and those of ``keep`` may have any name but
    ``__letters``, ``__text`` and those added.
    """
    keep = keep if keep is not None else [F.col("doc_id")]
    sent, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    ready = docs.select(*keep, letters.alias("__letters"), F.col(text).cast("binary").alias("__text"))
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _NET:
            _NET.clear()
            _NET[key] = sent.value.compile() if sent.value else None
        model = _NET[key]
        for batch in batches:
            raw = batch.column(batch.num_columns - 1).to_pylist()
            name: list[str] = [UNKNOWN] * len(raw)
            score = np.zeros(len(raw))
            has = np.array(batch.column(batch.num_columns - 2).to_pylist(), bool)
            for block in blocks([t if h else b"" for t, h in zip(raw, has, strict=True)], 1 << 18) if model else ():
                size = np.diff(block.off) - 1
                rows = np.maximum(1, -(-size // WINDOW))
                at = np.cumsum(rows) - rows
                c = np.full(int(rows.sum()) * WINDOW, GAP)
                inside = np.arange(len(block.buf)) + np.repeat(at * WINDOW - block.off[:-1], size + 1)
                real = np.ones(len(block.buf), bool)
                real[block.off[1:] - 1] = False
                c[inside[real]] = CLASS[block.buf[real]]
                weight = np.full(int(rows.sum()), float(WINDOW))
                weight[at + rows - 1] = np.maximum(1, size - (rows - 1) * WINDOW)
                mean = np.add.reduceat(model.probabilities(c) * weight[:, None], at, axis=0) / np.add.reduceat(weight, at)[:, None]
                best = mean.argmax(1)
                for k in range(block.n):
                    if has[block.first + k]:
                        name[block.first + k] = model.net.languages[best[k]]
                        score[block.first + k] = min(1.0, float(mean[k, best[k]]))
            yield pa.record_batch([*batch.columns[:-2], pa.array(name, pa.string()), pa.array(score)], names=[*batch.schema.names[:-2], "lang_pred", "score"])

    return ready.mapInArrow(run, extended(ready.schema.fields[:-2], "lang_pred string, score double"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 4) == 2
    net = train(docs.where(~held).select("text", "lang"))
    return predict(docs, net, keep=[F.col("doc_id"), held.alias("held_out")])
