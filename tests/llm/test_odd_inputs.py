"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from tailwright.llm import bpe, decontaminate, langid, line_crf, near_dedup, ppm, quality_rules, token_counts, toxicity, url_filter
from tailwright.llm.samples import labelled
from tailwright.llm.session import remainder


def operators(spark):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (8, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "thon reer in ed ing an nd he th on er re"), (None, "some text")], "item_id long, text string")
    return {
        "ppm": lambda d: ppm.score_documents(d, remainder("doc_id", 10) == 0),
        "langid": lambda d: langid.predict(d, langid.train(d.select("text", "lang")), keep=[F.col("doc_id")]),
        "bpe": lambda d: bpe.encode_documents(d),
        "bpe ids": lambda d: bpe.decode_documents(bpe.encode_documents(d, output="ids")),
        "near_dedup": lambda d: near_dedup.near_classes(d),
        "quality_rules": lambda d: quality_rules.measure(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels.select("doc_id", "toxic")), [F.col("doc_id")]),
        "line_crf": lambda d: line_crf.score(d, line_crf.train(d, labels.select("doc_id", "quality")), [F.col("doc_id")]),
        "token_counts": lambda d: bpe.token_counts(d),
        "leaks": lambda d: decontaminate.leaks(d, bench),
        "clean": lambda d: decontaminate.clean(d, bench),
    }


NAMES = ["ppm", "langid", "bpe", "bpe ids", "near_dedup", "quality_rules", "toxicity", "line_crf", "token_counts", "leaks", "clean"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_out_per_row_in(spark, odd, name):
    got = operators(spark)[name](odd).collect()
    assert len(got) == (0 if name == "leaks" else 11)
    if name != "leaks":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, odd, name):
    assert operators(spark)[name](odd.where("false")).count() == 0


def test_defined_results(spark, odd):
    by = lambda rows: {r.doc_id: r for r in rows}
    p = by(ppm.score_documents(odd, F.lit(False)).collect())
    assert p[1].n_tokens == p[2].n_tokens == p[3].n_tokens == 1 and p[1].score < 0
    lang = by(langid.predict(odd, langid.train(odd.select("text", "lang")), keep=[F.col("doc_id")]).collect())
    assert {lang[k].lang_pred for k in (1, 2, 3, 7)} == {"und"} and lang[1].score == 0
    near = by(near_dedup.near_classes(odd).collect())
    assert near[1].class_id == near[2].class_id == near[3].class_id == 1 and near[5].class_size == 2 and near[4].class_size == 1
    q = by(quality_rules.measure(odd).collect())
    assert (q[1].n_words, q[1].base_failed, q[1].kept) == (0, True, False) and q[6].word_chars == 300_000
    assert decontaminate.clean(odd, spark.createDataFrame([], "item_id long, text string")).columns == odd.columns
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 11 - 2 - 1


def test_an_id_repeated_often_is_one_labelled_row(spark):
    d = spark.createDataFrame([(1, "good words here"), (2, "bad bad !!")], "doc_id long, text string").union(spark.range(3000).select(F.lit(2).cast("long"), F.concat(F.lit("text "), F.col("id"))))
    got = labelled(d, spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, quality int"), "quality", 10, 1 << 20, 1).collect()
    assert sorted(r.label for r in got) == [0, 1]


def test_the_sample_of_labelled_rows_is_bounded_in_bytes(spark):
    d = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    labels = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    pick = lambda size: labelled(d, labels, "toxic", 100, size, 1).collect()
    assert len(pick(1 << 20)) == 50 and len(pick(1050)) == 10 and len(pick(1)) == 1 and all(len(r.text) == 100 for r in pick(1050))


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://X.EXAMPLE.com/en/1?a=http://b"), (4, "http://X.EXAMPLE.com/en/1?a=http://b"), (None, "https://a.net/es/" + "q" * 50_000), (5, "https://a.net"), (6, "https://anet/es/")]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, template string")
    got = url_filter.judge_urls(d).collect()
    assert len(got) == 8
    by = {r.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in got}
    assert by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("x.example.com", "/en/1", "example.com/en/", "block") and by[None] == ("a.net", "/es/qqqqq", "net/es/", "block")
    assert by[5] == ("a.net", "", None, "allow") and by[6] == ("anet", "/es/", None, "allow")
    assert url_filter.judge_urls(d.where("false")).count() == 0


def test_histograms(spark):
    h = spark.createDataFrame([(None,), (3,), (3,), (5000,)], "n_tokens long")
    got = {r.context_limit: r for r in token_counts.context_answers(token_counts.length_histogram(h), spark.createDataFrame([(4,), (3,)], "limit long")).collect()}
    assert set(got) == {0, 3, 4, 5000} and got[4].truncated_total == 10 and got[4].n_docs == 0 and got[5000].total_tokens == 5006
    assert token_counts.context_answers(token_counts.length_histogram(h.where("false"))).count() == 0
    assert [tuple(r) for r in token_counts.quantiles(token_counts.length_histogram(h), [0.5, 0.8]).collect()] == [(0.5, 3), (0.8, 5000)]


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 1), (8, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "thon reer")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.where("false")):
            got = stage(spark, docs, str(tmp_path))
            assert name == "encode" or got.columns == odd.columns
            assert got.count() <= docs.count()


def test_tables_are_read_again_and_dropped(spark):
    from tailwright.llm.session import drop_tables, shared_dir, table

    made = table(spark.range(5).withColumnRenamed("id", "doc_id"), "numbers")
    assert made.count() == 5 and "/numbers-" in made.inputFiles()[0]
    drop_tables(spark)
    import os

    assert not os.path.exists(shared_dir(spark).removeprefix("file://") + "/tailwright/" + spark.sparkContext.applicationId)
