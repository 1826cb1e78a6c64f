"""Texts of very many lines or matches take time in proportion; rows that share a hash split."""

import time

from pyspark.sql import functions as F

from framewise.llm import line_dedup, mixing, pii


def seconds(run):
    run()
    began = time.time()
    run()
    return time.time() - began


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_many_dropped_lines(spark):
    def run(n):
        row = line_dedup.deduplicated(one(spark, "\n".join(f"line number {i % (n // 2)} of them" for i in range(n))), near=False).first()
        assert (row.n_lines, row.n_dropped) == (n, n // 2) and row.text.count("\n") == n // 2 - 1

    assert seconds(lambda: run(32_000)) < 6 * max(1.0, seconds(lambda: run(8_000)))


def test_many_matches(spark):
    def run(n):
        text = " ".join(f"user{i}@mail.example.org" for i in range(n))
        spans = pii.base_spans(one(spark, text)).first().spans
        assert len(spans) == n and all(text[s.start : s.end] == s.value for s in spans[:: n // 7])
        assert one(spark, text.replace("@", " ")).select(F.size(pii._places(F.col("text")))).first()[0] == 3 * n

    assert seconds(lambda: run(32_000)) < 6 * max(1.0, seconds(lambda: run(8_000)))


def test_rows_that_share_an_id_split(spark):
    rows = [(None, "a b c d", "x", i) for i in range(400)] + [(i, "w " * 8, "y", i) for i in range(300)] + [(7, f"t{i} u", "z", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at long")
    got = {r.source: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()}
    assert all(abs(r.taken - r.target) <= r.size and r.most <= 3 for r in got.values())
    again = mixing.mixed_documents(docs)
    assert {r.source: r.n for r in again.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()} == {k: r.taken // r.size for k, r in got.items()}
    assert again.select("source", "at").distinct().count() > 300
