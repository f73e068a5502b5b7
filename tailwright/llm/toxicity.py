"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(t_k - w.x): one weight vector for all thresholds t_0 < t_1 < ...  Features are words
without outer punctuation and word beginnings of five bytes, by hash, valued log(1 + count); those that don't tell
toxic from other documents are left out, so that a long text gathers no noise.  Labels are 0 or 1: the grades of toxic
documents follow from the evidence that the other half of the sample finds in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm.samples import labelled
from tailwright.llm.session import bounded, documents, extended, remainder
from tailwright.llm.textkernel import Block, bare, blocks

#: The regression is fitted on about so many labelled documents, chosen by a hash, of at most so many bytes in all.
FIT_DOCS, FIT_BYTES = 6000, 64 << 20
#: A feature is used if so many documents have it and its log odds, either way, exceed both the margin and Z standard
#: errors.
LEAST_DOCS, LOG_ODDS, Z = 3, 2.0, 4.0
#: Grades: 0 for documents that aren't toxic, and 1 to GRADES for toxic ones; GRADE_CUTS are the shares of toxic
#: documents, by their evidence, that have grade 1, and 1 or 2.
GRADES, GRADE_CUTS = 3, (0.1, 0.4)
EPOCHS, RATE, RIDGE = 2000, 0.1, 1e-5
TOXIC = 0.5

PREFIX = 5
_WORD, _BEGIN = np.uint64(0), np.uint64(0x5851F42D4C957F2D)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each feature, and the text that it is in.  Words come first, then beginnings, each in text order."""
    starts, ends, first = block.words()
    doc = np.repeat(np.arange(block.n), np.diff(first))
    starts, ends = bare(block, starts, ends)
    longer = ends - starts > PREFIX
    return np.concatenate((block.hashes(starts, ends, lower=True), block.hashes(starts[longer], starts[longer] + PREFIX, lower=True) ^ _BEGIN)), np.concatenate((doc, doc[longer]))


class Ordinal:
    """Sorted feature hashes, their weights, and the thresholds."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray, cuts: np.ndarray) -> None:
        self.keys, self.weight, self.cuts = keys, weight, cuts
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def look_up(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature number and count of the features used."""
        at = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        cell, n = np.unique(doc[at[ok]] * len(self.keys) + k[ok], return_counts=True)
        return cell // len(self.keys), cell % len(self.keys), n

    def at_most(self, z: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every k but the last."""
        return 1 / (1 + np.exp(np.clip(z[:, None] - self.cuts[None, :], -40, 40)))

    def grades(self, z: np.ndarray) -> np.ndarray:
        """The distribution over grades."""
        c = self.at_most(z)
        return np.diff(np.concatenate((np.zeros((len(z), 1)), c, np.ones((len(z), 1))), 1), axis=1)

    def fit(self, doc: np.ndarray, key: np.ndarray, n: np.ndarray, grade: np.ndarray) -> Ordinal:
        """Maximum likelihood with a ridge by Adam; thresholds are a first one and positive steps, so they stay ordered."""
        value = np.log1p(n)
        free = np.concatenate((self.weight, self.cuts[:1], np.log(np.diff(self.cuts))))
        w = len(self.weight)
        m, v = np.zeros_like(free), np.zeros_like(free)
        for step in range(1, EPOCHS + 1):
            self.weight, self.cuts = free[:w], np.cumsum(np.concatenate((free[w : w + 1], np.exp(free[w + 1 :]))))
            z = np.bincount(doc, value * self.weight[key], minlength=len(grade))
            c = np.concatenate((np.zeros((len(z), 1)), self.at_most(z), np.ones((len(z), 1))), 1)
            slope = c * (1 - c)
            rows = np.arange(len(grade))
            p = np.maximum(c[rows, grade + 1] - c[rows, grade], 1e-9)
            dz = (slope[rows, grade + 1] - slope[rows, grade]) / p
            dcut = np.zeros((len(grade), c.shape[1]))
            dcut[rows, grade + 1] -= slope[rows, grade + 1] / p
            dcut[rows, grade] += slope[rows, grade] / p
            dcuts = dcut[:, 1:-1].sum(0)
            g = np.concatenate((np.bincount(key, value * dz[doc], minlength=w), [dcuts.sum()], np.exp(free[w + 1 :]) * dcuts[::-1].cumsum()[::-1][1:])) / len(grade)
            g[:w] += RIDGE * self.weight
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            free = free - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def log_odds(key: np.ndarray, toxic: np.ndarray, label: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n features its log odds of being in a toxic document rather than another one, and whether it is
    used; ``key`` and ``toxic`` are those of each (document, feature), ``label`` that of each document."""
    bad, all_ = np.bincount(key, toxic, minlength=n), np.bincount(key, minlength=n)
    good, n_bad, n_good = all_ - bad, label.sum(), (1 - label).sum()
    odds = np.log((bad + 0.5) / (n_bad - bad + 0.5)) - np.log((good + 0.5) / (n_good - good + 0.5))
    error = np.sqrt(1 / (bad + 0.5) + 1 / (n_bad - bad + 0.5) + 1 / (good + 0.5) + 1 / (n_good - good + 0.5))
    return odds, (all_ >= LEAST_DOCS) & (np.abs(odds) > LOG_ODDS) & (np.abs(odds) > Z * error)


def severities(doc: np.ndarray, key: np.ndarray, count: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """A grade from 1 to GRADES for each document, by the evidence in it.

    Labels tell only toxic from other documents.  A document's evidence is the sum of the log odds of the features
    that the other half of the documents marks, each times the log of its count; what a document itself has can't
    mark it.  Toxic documents are cut by GRADE_CUTS; equal evidence has the lower grade.
    """
    half = np.arange(len(label)) % 2
    value = np.zeros(len(label))
    for k in (0, 1):
        other = half[doc] != k
        odds, used = log_odds(key[other], label[doc[other]], label[half != k], n)
        own = (half[doc] == k) & used[key]
        value += np.bincount(doc[own], (odds[key] * np.log1p(count))[own], minlength=len(label))
    return 1 + np.searchsorted(np.quantile(value[label > 0], GRADE_CUTS), value, side="left")


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Ordinal:
    """Fits on ``labels(doc_id, toxic)`` of ``docs``; nulls teach nothing, and of an id labelled twice the higher label
    counts.  Without a toxic row no feature is used and every document has the same small severity.  Repeated ids
    count once, null texts are empty ones, and other columns of ``docs`` are not read."""
    rows = labelled(docs, labels, "toxic", FIT_DOCS, FIT_BYTES, 6, text)
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for block in blocks(batch.column(1).to_pylist()):
                h, doc = features(block)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(h)))
                cut = np.searchsorted(doc[at], np.arange(block.n + 1))
                made += [h[at[a:b]].tobytes() + size[a:b].astype(np.uint64).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["label", "x"])

    got = sorted((int(r["label"] > 0), bytes(r["x"])) for r in rows.mapInArrow(run, "label int, x binary").collect())
    label = np.array([a for a, _ in got], np.int64)
    flat = [np.frombuffer(x, np.uint64).reshape(2, -1) for _, x in got]
    neutral = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.arange(4.0, GRADES + 4))
    if not label.any() or label.all():
        return neutral
    h, count = np.concatenate([x[0] for x in flat]), np.concatenate([x[1] for x in flat]).astype(np.int64)
    doc = np.repeat(np.arange(len(flat)), [x.shape[1] for x in flat])
    keys, at = np.unique(h, return_inverse=True)
    odds, used = log_odds(at, label[doc], label, len(keys))
    if not (used & (odds > 0)).any():
        return neutral
    model = Ordinal(keys[used], np.zeros(int(used.sum())), np.arange(1.0, GRADES + 1))
    number = np.full(len(keys), -1)
    number[used] = np.arange(int(used.sum()))
    own = number[at] >= 0
    grade = np.where(label > 0, severities(doc, at, count, label, len(keys)), 0)
    return model.fit(doc[own], number[at][own], count[own], grade)


def score(docs: DataFrame, model: Ordinal, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` columns with severity (the expected grade), p_toxic, grade (the most probable; on a tie the lower),
    toxic and marked (features found) of every whole text, one row out per row in; null and empty texts have none.
    Repeated rows are scored alike; other columns of ``docs`` are not read, and those of ``keep`` may have any name but
    ``__text`` and those added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            z, marked = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for block in blocks(batch.column(batch.num_columns - 1).to_pylist()):
                doc, key, n = model.look_up(*features(block))
                own = slice(block.first, block.first + block.n)
                if len(doc):
                    z[own] = np.bincount(doc, np.log1p(n) * model.weight[key], minlength=block.n)
                    marked[own] = np.bincount(doc, n, minlength=block.n)
            p = model.grades(z)
            severe = p @ np.arange(p.shape[1])
            yield pa.record_batch([*batch.columns[:-1], pa.array(severe), pa.array(1 - p[:, 0]), pa.array(p.argmax(1).astype(np.int32)), pa.array(1 - p[:, 0] >= TOXIC), pa.array(marked)], names=[*batch.schema.names[:-1], "severity", "p_toxic", "grade", "toxic", "marked"])

    return ready.mapInArrow(run, extended(ready.schema.fields[:-1], "severity double, p_toxic double, grade int, toxic boolean, marked long"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; labels of those whose crc32(doc_id) mod 5 is 0 are not learned from."""
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 5) == 0
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held).select("doc_id", "toxic"))
    return score(docs, model, [F.col("doc_id"), held.alias("held_out")])
