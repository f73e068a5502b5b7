"""Quality rules: plain counts, and what public vocabularies make of a text (tokeniser fertility).

A text that passes the base rules is judged by bands for its script: characters per token of two vocabularies, the
share of tokens that are raw bytes of a broken-up character (byte fallback), and token entropy, both Shannon's
against the most that the length allows and that of the commonest token alone (-log2 of its share).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm.bpe import Encoder, parse_ranks, read_ranks
from tailwright.llm.session import bounded, documents
from tailwright.llm.textkernel import Block, blocks, windows

#: Vocabulary files: the first one also gives fallback share and entropy.
VOCABULARIES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")
#: The base rules' limits: fixed values of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


class Band(NamedTuple):
    """What is accepted: both ends of characters per token of either vocabulary, then the most fallback and the least
    entropies."""

    chars_low: float
    chars_high: float
    second_low: float
    second_high: float
    fallback: float
    entropy_ratio: float
    commonest_bits: float


#: Scripts by the code points of their letters.
SPANS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x740, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "southeast": [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF)],
    "cjk": [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x323AF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
#: The bands of each script; a text without a letter is of script 'none'.  Those of Latin script leave room around what
#: labelled documents have; the others are set from short samples, for want of a corpus, and wide.
BANDS = {
    "none": Band(0.5, 5.5, 0.5, 5.5, 0.2, 0.4, 2.5),
    "latin": Band(2.05, 5.5, 1.0, 5.5, 0.06, 0.46, 2.8),
    "greek": Band(1.0, 5.0, 0.55, 2.5, 0.2, 0.4, 2.5),
    "cyrillic": Band(1.0, 5.5, 0.55, 2.5, 0.2, 0.4, 2.5),
    "hebrew": Band(0.7, 4.5, 0.45, 2.5, 0.4, 0.4, 2.5),
    "arabic": Band(0.7, 4.5, 0.55, 2.5, 0.3, 0.4, 2.5),
    "indic": Band(0.3, 4.0, 0.35, 2.0, 0.75, 0.35, 2.0),
    "southeast": Band(0.3, 4.0, 0.3, 2.0, 0.75, 0.35, 2.0),
    "cjk": Band(0.4, 3.0, 0.35, 2.0, 0.6, 0.35, 2.0),
    "hangul": Band(0.4, 3.0, 0.3, 2.0, 0.6, 0.35, 2.0),
}
SCRIPTS = list(BANDS)


def _script_table() -> np.ndarray:
    """Script by the first two bytes of a character; any second byte follows an ASCII letter."""
    t = np.zeros(1 << 16, np.int8)
    for name, spans in SPANS.items():
        for low, high in spans:
            for point in range(low, high + 1) if low < 0x800 else range(low & ~63, high + 1, 64):
                raw = chr(point).encode()
                at = raw[0] << 8
                t[at : at + 256] = SCRIPTS.index(name) if len(raw) == 1 else t[at : at + 256]
                if len(raw) > 1:
                    t[at | raw[1]] = SCRIPTS.index(name)
    return t


_SCRIPT = _script_table()


def script_of(text: bytes) -> int:
    """The script that most letters are of, by its number; on a tie the first one."""
    buf = np.frombuffer(text + b"\0", np.uint8).astype(np.int64)
    n = np.bincount(_SCRIPT[buf[:-1] << 8 | buf[1:]], minlength=len(SCRIPTS))[1:]
    return int(n.argmax()) + 1 if n.any() else 0


_SIGN = np.zeros(256, np.int64)
_SIGN[list(b"#*$%&|<>")] = 1
_POINT = np.ones(256, np.int64)  # begins a code point inside a word
_POINT[0x80:0xC0] = 0
_POINT[[9, 10, 11, 12, 13, 32]] = 0


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """The base counts of each text of a block."""
    starts, ends, first = block.words()
    n = np.diff(first)
    out = {"n_words": n, "word_chars": np.add.reduceat(_POINT[block.buf], block.off[:-1]), "n_symbols": np.add.reduceat(_SIGN[block.buf], block.off[:-1])}
    ls, le, lf = block.lines()
    doc = np.repeat(np.arange(block.n), np.diff(lf))
    line = block.hashes(ls, le)
    has = np.bincount(np.searchsorted(ls, starts, side="right") - 1, minlength=len(ls)) > 0
    order = np.lexsort((line, doc))
    again = np.zeros(len(ls), bool)
    again[1:] = (line[order[1:]] == line[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])  # all but one of each
    out["n_dup_lines"] = np.bincount(doc[order[again & has[order]]], minlength=block.n)
    w, at = windows(block.hashes(starts, ends), first, 3)
    doc = np.repeat(np.arange(block.n), np.diff(at))
    order = np.lexsort((w, doc))
    same = (w[order[1:]] == w[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    begin = (np.arange(len(w)) - np.repeat(at[:-1] - first[:-1], np.diff(at)))[twice]
    covered = np.zeros(len(starts) + 1, bool)
    for k in range(3):
        covered[begin + k] = True
    out["n_repeat_words"] = np.add.reduceat(np.append(covered[:-1], [False]).astype(np.int64), np.minimum(first[:-1], len(starts))) * (n > 0)
    return out


#: White space on which the library's pattern may run out of stack: texts with it are cut into pieces here instead.
LONG_BLANKS = re.compile(r"\s{4096}")


class Vocabulary:
    def __init__(self, raw: bytes, pattern: str) -> None:
        ranks = parse_ranks(raw)
        self.raw, self.pattern, self.encoder = raw, regex.compile(pattern), None
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.broken = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.broken[i] = True


    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, the same either way."""
        return self.by_pieces(text) if LONG_BLANKS.search(text) else self.library(text)

    def by_pieces(self, text: str) -> np.ndarray:
        self.encoder = self.encoder or Encoder(parse_ranks(self.raw))
        number: dict[str, int] = {}
        order = array("i", (number.setdefault(m[0], len(number)) for m in self.pattern.finditer(text)))
        ids = [np.array(x, np.int64) for x in self.encoder.encode_pieces([t.encode() for t in number])]
        return np.concatenate([ids[k] for k in order])


_VOCABULARY: dict[str, Vocabulary] = {}


def vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _VOCABULARY:
        _VOCABULARY[key] = Vocabulary(raw, pattern)
    return _VOCABULARY[key]


def fertility(text: bytes, vocabularies: list[Vocabulary]) -> tuple[int, float, float, float, float, float]:
    """Script, characters per token of the first and second vocabulary, fallback share, entropy ratio, commonest bits.

    Characters are code points, spaces included; a text without tokens has zeros.
    """
    shown = text.decode("utf-8", "replace")
    script = script_of(text)
    if not text:
        return script, 0.0, 0.0, 0.0, 0.0, 0.0
    ids = vocabularies[0].encode(shown)
    _, n = np.unique(ids, return_counts=True)
    p = n / len(ids)
    ratio = float(-(p * np.log2(p)).sum() / np.log2(max(2, len(ids))))
    return script, len(shown) / len(ids), len(shown) / len(vocabularies[1].encode(shown)), float(vocabularies[0].broken[ids].mean()), ratio, float(-np.log2(p.max()))


def judge(script: int, chars: float, second: float, fallback: float, ratio: float, commonest: float) -> bool:
    """Whether the bands of the script accept it."""
    b = BANDS[SCRIPTS[script]]
    return b.chars_low <= chars <= b.chars_high and b.second_low <= second <= b.second_high and fallback <= b.fallback and ratio >= b.entropy_ratio and commonest >= b.commonest_bits


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_token double, chars_per_token_second double, fallback_share double, entropy_ratio double, commonest_bits double"


def measure(docs: DataFrame, paths: list[str] | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts and verdict of every whole text, one row out per row in; other columns are not read.

    A null or empty text has no words, fails the base rules, and has zero counts and fertility.
    """
    sent = docs.sparkSession.sparkContext.broadcast([read_ranks(p) for p in paths or map(public_tokenizers.path, VOCABULARIES)])
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = [vocabulary(raw, pattern) for raw in sent.value]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for block in blocks(raw):
                base = base_counts(block)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                own = [fertility(t or b"", vocabularies) for t in raw[block.first : block.first + block.n]]
                kept = [not f and judge(*x) for f, x in zip(failed, own, strict=True)]
                columns = [pa.array(base[c].astype(np.int64)) for c in names[:5]] + [pa.array(failed), pa.array(kept, pa.bool_()), pa.array([SCRIPTS[x[0]] for x in own])] + [pa.array([x[k] for x in own], pa.float64()) for k in range(1, 6)]
                yield pa.record_batch([batch.column(0).slice(block.first, block.n), *columns], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))
