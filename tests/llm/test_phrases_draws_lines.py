"""Phrase collocations, importance resampling and line dedup against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwright.llm import collocations, line_dedup, resampling
from tailwright.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import prose

DIR = "/root/testdata/sf0.001"
OWN = ["op11_collocations", "op12_importance", "op13_line_dedup"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", OWN)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(map(tuple, QUERIES[name](spark, DIR).select(names).collect()), key=str) == sorted(want.select(*names).fetchall(), key=str)


# 11


def slow_phrases(rows, longest, least, inside, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        can = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows_ = []
        for p, a in can.items():
            if any(len(q) > len(p) and within(p, q) and 100 * b >= inside * a for q, b in can.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows_)[:top])]
    return out


def phrase_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["a", "Bb", "ccc", "é", "É", "dd\x1c", "-", "zz", "0"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(70)]
    rows += [("en", "one two three four")] * 25 + [("en", "two three")] * 20 + [("und", "same words here")] * 12 + [("en", None), (None, ""), ("fr", " . ,\n")]
    return rows


@pytest.mark.parametrize("longest,least,inside,top,size", [(3, 10, 50, 2000, 1 << 18), (4, 5, 50, 40, 64), (2, 10, 0, 7, 1), (5, 8, 100, 2000, 500)])
def test_phrases_equal_brute_force(spark, longest, least, inside, top, size):
    rows = phrase_rows()
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.phrases(d, longest, least, inside, top, parts=3, size=size, bits=1 << 15).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(slow_phrases(rows, longest, least, inside, top))


def test_phrase_counts_of_a_long_text_and_of_nothing(spark):
    d = spark.createDataFrame([("en", "a b " * 150_000), ("en", "\n" * 200_000), ("en", "x" * 300_000)], "lang string, text string")
    got = {r.phrase: r for r in collocations.phrases(d, size=1000).collect()}
    assert set(got) == {"a b a", "b a b"} and (got["a b a"].a, got["a b a"].n) == (149_999, 300_001)
    assert collocations.phrases(d.where("false")).count() == 0
    assert collocations.phrases(d.where("text like 'x%'")).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    n = 30_000_000_011
    g = spark.createDataFrame([(1, "en", "a b", n, [n + 7], [n + 9])], "name long, lang string, phrase string, n long, heads array<long>, tails array<long>")
    assert collocations._scored(g, 2).first().score == 1_000_000 * n * n // ((n + 7) * (n + 9))


def test_bits_never_lose_a_pair():
    rng = np.random.default_rng(1)
    left, right = rng.integers(1, 1 << 40, 5000), rng.integers(1, 1 << 40, 5000)
    h = collocations._hashes(left, right, 1 << 16)
    assert h.min() >= 0 and h.max() < 1 << 16 and len(np.unique(h)) > 4500
    assert (collocations._hashes(left[:10], right[:10], 1 << 16) == h[:10]).all()


# 12


def slow_draw(docs, bench, percent=25, least=20, seed=7, buckets=10_000, longest=2):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    at = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(at, runs(text)[1]))
    for text in bench:
        t.update(map(at, runs(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        w, f = runs(text)
        weight = sum(gain[at(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0]))
    rank = {x[0]: k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return sorted(((i, n, w, sc, rank.get(i)) for i, _, n, w, sc in out), key=str)


@pytest.mark.parametrize("percent,longest,buckets", [(25, 2, 10_000), (100, 3, 50), (0, 1, 7), (33, 2, 1)])
def test_the_draw_equals_brute_force(spark, percent, longest, buckets):
    rng = random.Random(4)
    docs = [(k, prose(rng, rng.randint(0, 90), rng.choice(["en", "fr", "de"]))) for k in range(150)] + [(150, None), (151, ""), (152, "A-Z ÀÉ 𝒳y\x00z 09")]
    bench = [prose(rng, 50, "fr") for _ in range(9)] + [None, ""]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in bench], "text string")
    scores = resampling.scored(d, b, buckets=buckets, longest=longest)
    got = resampling.draw(scores, percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == slow_draw(docs, bench, percent, buckets=buckets, longest=longest)


def test_tied_scores_are_ranked_by_id(spark):
    s = spark.createDataFrame([(k, 30, 5, 0, 1000 - k // 40) for k in range(200)] + [(k, 19, 5, 0, 5000) for k in range(200, 210)], "doc_id long, n_words int, n_features long, weight long, score long").repartition(5)
    got = {r.doc_id: r["rank"] for r in resampling.draw(s, 33).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {k: k + 1 for k in range(66)} and len(got) == 210


def test_a_draw_from_odd_rows(spark, odd):
    b = spark.createDataFrame([(1, "thon reer in ed"), (2, None)], "item_id long, text string")
    got = resampling.draw(resampling.scored(odd, b)).collect()
    assert len(got) == 11 and {r.n_features for r in got if r.doc_id in (1, 2, 3)} == {0} and {r.weight for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert sum(r["rank"] is not None for r in got) == 0  # a quarter of two documents
    assert resampling.draw(resampling.scored(odd.where("false"), b.where("false"))).count() == 0
    assert resampling.draw(resampling.scored(odd, b.where("false")), 100).where("rank is not null").count() == 2
    long = spark.createDataFrame([(1, "w " * 1_000_000), (2, "\n" * 1_000_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_features) for r in resampling.scored(long, b).collect()) == [(1, 1_999_999), (2, 0)]


# 13


def slow_lines(texts, least, chars):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for lines in split for k in {key(x) for x in lines})
    gone = {k for k, c in n.items() if c >= least and len(k) >= chars}
    kept = [[x for x in lines if key(x) not in gone] for lines in split]
    return [(len(a), len(a) - len(b), hashlib.sha256("\n".join(b).encode()).hexdigest()) for a, b in zip(split, kept, strict=True)]


@pytest.mark.parametrize("least,chars", [(10, 1), (2, 0), (1, 3), (3, 5)])
def test_line_dedup_equals_brute_force(spark, least, chars):
    rng = random.Random(5)
    lines = ["Menu", " menu\t", "ÀB", "àb", "", "  ", "x" * 5000, "Accept all", "a\rb", "accept ALL\x0b"]
    texts = [None, "", "\n", "\n\n"] + ["\n".join(rng.choice([*lines, str(rng.random())]) for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["Menu\none"] * 9
    d = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, lines string").repartition(4)
    got = line_dedup.drop_lines(d, least, chars)
    found = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()}
    assert [found[k] for k in range(len(texts))] == slow_lines(texts, least, chars)


def test_line_dedup_of_odd_rows(spark, odd):
    got = line_dedup.drop_lines(odd, 2)
    assert got.select("row.*").columns == odd.columns
    by = got.select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert len(by) == 11 and {(r.n_lines, r.n_dropped, r.kept_text) for r in by if r.doc_id == 5} == {(1, 1, "")}
    assert {(r.n_lines, r.n_dropped) for r in by if r.doc_id in (1, 2)} == {(1, 0)}
    assert line_dedup.drop_lines(odd.where("false")).count() == 0
    many = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("again\n"), 100_000), F.repeat(F.lit("\n"), 100_000), F.col("id")).alias("text"))
    assert {(r.n_lines, r.n_dropped, len(r.kept_text)) for r in line_dedup.drop_lines(many).collect()} >= {(200_001, 100_000, 100_001)}
