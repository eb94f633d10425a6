"""Line numbers across splits, typed casts with rejected rows, the remote encoder, and stores that differ."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenza.operators import remote, retrieval
from evidenza.sources import files
from evidenza.sources.typed import Field, quarantined, typed


def test_line_numbers_survive_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join("" if i % 7 == 0 else f"not json {i}" if i % 5 == 0 else json.dumps({"k": i}) for i in range(1, 2001)) + "\n")
    (tmp_path / "b.jsonl").write_text('{"k": -1}\n[1]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        good, bad = files.jsonl_strict(spark, str(tmp_path), "k long", ordinals=True)
        rows = [(r.file.rsplit("/", 1)[1], r.line, r.k) for r in good.collect()]
        wrong = {(r.file.rsplit("/", 1)[1], r.line, r.value) for r in bad.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(rows) == sorted([("a.jsonl", i, i) for i in range(1, 2001) if i % 7 and i % 5] + [("b.jsonl", 1, -1)])
    assert wrong == {("a.jsonl", i, f"not json {i}") for i in range(1, 2001) if i % 7 and i % 5 == 0} | {("b.jsonl", 2, "[1]")}


FIELDS = {
    "chunk_id": Field("string", longest=8), "pdf_page": Field("int"), "score": Field("double", required=False), "tags": Field("array<string>", default=[]),
    "searchable": Field("boolean", default=True), "author": Field("string", required=False), "absent": Field("int", required=False, default=3),
}


def test_typed_rows_and_rejected_ones(spark, tmp_path):
    rows = [
        ("a", "12", "1.5", '["x", "y"]', "true", None, "mine"), ("b", " 7 ", None, None, None, "", "mine"), (None, "1", "x", "nope", "maybe", None, "mine"),
        ("", "1.5", None, "[]", "false", None, "mine"), ("much too long", None, None, "[]", None, None, "mine"), ("a", "12", "1.5", '["x", "y"]', "true", None, "mine"),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, pdf_page string, score string, tags string, searchable string, author string, reasons string")
    good, bad = quarantined(typed(df, FIELDS), str(tmp_path / "out"))
    assert dict(good.dtypes) == {n: f.type for n, f in FIELDS.items()}
    assert [tuple(r) for r in good.orderBy("chunk_id").collect()] == [("a", 12, 1.5, ["x", "y"], True, None, 3)] * 2 + [("b", 7, None, [], True, "", 3)]
    found = {json.loads(r.record).get("chunk_id"): set(r.reasons) for r in bad.collect()}
    assert found == {
        None: {"chunk_id is missing", "score is no double", "searchable is no boolean", "tags is no array<string>"},
        "": {"chunk_id is missing", "pdf_page is no int"},
        "much too long": {"chunk_id is too long", "pdf_page is missing"},
    }
    assert good.count() + bad.count() == df.count()
    numbers = spark.createDataFrame([(1.9,), (-1.9,), (float("nan"),), (1e300,), (None,)], "n double")
    got = typed(numbers, {"n": Field("int"), "more": Field("int")}).collect()
    assert [r.n for r in got] == [1, -1, None, None, None] and all("more is missing" in r.reasons for r in got)
    assert [r.reasons[0] for r in got[2:]] == ["n is no int", "n is no int", "n is missing"]
    assert typed(df.limit(0), FIELDS).count() == 0


def test_remote_embeddings(spark):
    def connect(fail=0):
        calls = []

        def transport(texts):
            calls.append(len(texts))
            if len(calls) <= fail:
                raise OSError("busy")
            return [{"index": i, "embedding": [float(len(t)), 0.0 if t == "" else 3.0]} for i, t in reversed(list(enumerate(texts)))]

        return transport

    df = spark.createDataFrame([(2**60 + 1, "abcd"), (None, "abcd"), (3, None), (4, "")], "k long, t string").coalesce(1)
    got = {r.k: r.embedding for r in remote.embedded_remotely(df, "t", lambda: connect(2), 2, wait=0.0).collect()}
    assert got[2**60 + 1] == got[None] == pytest.approx([0.8, 0.6]) and got[3] is None and got[4] == [0.0, 0.0]
    with pytest.raises(Exception, match="failed 3 times"):
        remote.embedded_remotely(df, "t", lambda: connect(3), 2, wait=0.0).collect()
    waits = []
    with pytest.raises(remote.ProviderError):
        remote.asked(["a"], connect(9), 4, 0.5, waits.append)
    assert waits == [0.5, 1.0, 2.0]
    for items in ([], [{"index": 0, "embedding": [1.0]}, {"index": 0, "embedding": [1.0]}], [{"index": 1, "embedding": [1.0]}, {"index": 2, "embedding": [1.0]}], [{"embedding": [1.0]}, {"embedding": [1.0, 2.0]}], [{"embedding": [np.nan]}] * 2):
        with pytest.raises(remote.ProviderError):
            remote.vectors_of(["a", "b"], items, None)


def test_hybrid_checks_both_stores(spark):
    rows = [(i, f"t{i}", "s", "c" if i < 3 else "d", "word", "doc", f"h{i}", i, "m") for i in range(1, 5)]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, section string, category string, content string, document_id string, content_hash string, pdf_page int, model_name string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)], "doc", f"h{i}", i) for i in range(1, 5)], "chunk_id long, vector array<double>, document_id string, content_hash string, pdf_page int")
    asked = spark.createDataFrame([(1, "word", [1.0, 1.0])], "question_id long, question string, vector array<double>")
    plain = retrieval.hybrid_search(asked, chunks, vectors, 10)
    checked = retrieval.hybrid_search(asked, chunks, vectors, 10, model="m")
    assert checked.columns == plain.columns and sorted(map(tuple, checked.collect())) == sorted(map(tuple, plain.collect()))
    only = retrieval.hybrid_search(asked, chunks, vectors, 10, category="c", model="m").collect()
    assert {r.chunk_id for r in only} == {1, 2} and {r.rank for r in only} == {1, 2}
    for changed in (vectors.withColumn("content_hash", F.lit("x")), vectors.withColumn("pdf_page", F.lit(9)), vectors.withColumn("document_id", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="stores differ for chunk"):
            retrieval.hybrid_search(asked, chunks, changed, 10, model="m").collect()
    with pytest.raises(Exception, match="model_name"):
        retrieval.hybrid_search(asked, chunks, vectors, 10, model="other").collect()
