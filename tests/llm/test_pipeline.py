"""The pipeline against plain counterparts of its stages."""

import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_quality_secrets import plain as measures
from test_simhash import brute as components

from longitrack.llm import secrets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_all_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]

    def kept(t):
        words, chars, symbols, dup, rep, lines, upper = measures(t)
        return not (words < 50 or 100 * rep > 50 * words or 100 * symbols > 10 * words or 100 * dup > 30 * lines or chars > 12 * words or 100 * upper > 30 * chars)

    left = [(i, r.text) for i, r in sorted(docs.items()) if kept(r.text)]
    parts = components(left)
    left = [(i, t) for i, t in left if parts[i][1] == i]
    bad = {i for i, _ in leaks(left, items)}
    left = [(i, t) for i, t in left if i not in bad and not secrets.base_spans(t)]
    rows = corpus_pipeline.run(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in left]
    assert sum(r["size"] for r in rows) == sum(measures(t)[0] for _, t in left)
    assert abs(sum(r.taken for r in rows) - sum(r["size"] for r in rows)) < 129 * 20
    assert len(corpus_pipeline.STAGES) == 5


def tables(spark, folder, rows, items=(), extra=()):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(extra))).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def words(seed, n):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_nulls_repeats_and_extra_columns(spark, tmp_path):
    item = words(99, 30)
    rows = [(1, words(1, 60), "en", "a", 9), (1, words(1, 60), "en", "a", 9), (2, None, None, None, None), (3, words(1, 60), "en", "b", 9), (4, f"{words(4, 60)} {item}", "en", "a", 9), (5, f"{words(5, 60)} password: hunter2hunter", "en", None, 9), (6, words(6, 90_000), None, None, None), (None, words(7, 70), "de", "b", 1)]
    folder = tables(spark, tmp_path / "t", rows, [(1, item), (2, None)], ["_id", "_same", "_bad", "_ledger", "size", "fp"])
    got = sorted(((r.doc_id, r["size"]) for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    assert got == [(1, 60), (6, 90_000), (None, 70)]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "t", [])).count() == 0
