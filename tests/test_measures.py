"""Measures against literal rows, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from evidenza.operators import measures


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lengths(spark):
    rows = spark.createDataFrame([("a", "xx"), ("a", "xxxx"), ("a", None), ("b", None), (None, "")], "k string, t string")
    assert rows_of(measures.lengths(rows, "t", ["k"])) == sorted([("a", 2, 3.0, 4, 3), ("b", 0, 0.0, 0, 1), (None, 0, 0.0, 0, 1)], key=str)
    assert rows_of(measures.lengths(rows.filter("false"), "t", [])) == [(0, 0.0, 0, 0)]
    assert measures.lengths(rows.filter("false"), "t", ["k"]).count() == 0


def test_norms(spark):
    rows = spark.createDataFrame([([0.6, 0.8],), ([3.0, 4.0],), ([1.0],), (None,), ([1.0, None],)], "v array<double>")
    got = measures.norms(rows, "v", 2).first()
    assert (got.n, got.least, got.most, got.n_bad) == (5, 1.0, 5.0, 4)
    assert got["mean"] == pytest.approx(7 / 3)
    assert rows_of(measures.norms(rows.filter("false"), "v", 2)) == [(0, 0.0, 0.0, 0.0, 0)]


def test_status_counts_and_tags(spark):
    rows = spark.createDataFrame([(1, "high"), (1, "low"), (1, "high"), (2, None), (2, "normal")], "k int, status string")
    assert rows_of(measures.status_counts(rows, ["k"])) == [(1, 2, 1, 0, 0), (2, 0, 0, 1, 1)]
    assert rows_of(measures.tag_sets(rows, ["k"], "status", ["low", "normal"])) == [(1, 3, ["high", "low"], 1), (2, 2, ["normal"], 1)]
    assert rows_of(measures.tag_sets(rows, ["k"], "status", []).select("n_shared")) == [(0,), (0,)]


def test_page_range(spark):
    rows = spark.range(1, 8).withColumn("page", F.when(F.col("id") < 7, F.col("id")))
    pages = lambda *a: [r.page for r in measures.page_range(rows, "page", *a).orderBy("page").collect()]
    assert pages(2, 4) == [2, 3, 4] and pages(5) == [5, 6] and pages(None, 1) == [1] and pages(3, 3) == [3]
    assert None in pages() and len(pages()) == 7
    with pytest.raises(ValueError):
        measures.page_range(rows, "page", 4, 2)
