"""Page guards, previews, citation details, raw records and cached vectors, on literal rows."""

import glob

import pytest
from pyspark.sql import functions as F

from evidenza.operators import pages


def test_guards(spark):
    files = spark.createDataFrame([("/r/a", bytearray(b"3")), ("/r/bad", bytearray(b"x")), ("/r/none", None)], "path string, content binary")
    counted = pages.counted_pages(files, lambda: lambda data: int(data))
    assert {r.path: r.n_pages for r in counted.collect()} == {"/r/a": 3, "/r/bad": None, "/r/none": None}
    known = counted.withColumn("is_file", F.lit(True)).unionByName(spark.createDataFrame([("/r", None, False)], "path string, n_pages int, is_file boolean"))
    rows = [(0, "a", 1, 3), (1, "b", 1, 1), (2, "/r", 1, 1), (3, "a", 0, 2), (4, "a", 3, 2), (5, "bad", 1, 1), (6, "a", 2, 4), (7, "a", None, 1), (8, "/r/a", 2, 2)]
    asked = spark.createDataFrame(rows, "k int, path string, first_page int, last_page int").withColumn("path", pages.resolved(F.col("path"), "/r/"))
    got = pages.guarded(asked, known)
    assert {r.k: r.reason for r in got.collect()} == {0: None, 1: "no_file", 2: "not_a_file", 3: "page_below_one", 4: "range_reversed", 5: "unreadable", 6: "beyond_last_page", 7: "page_below_one", 8: None}
    assert sorted((r.k, r.page_number) for r in pages.pages_of(got).collect()) == [(0, 1), (0, 2), (0, 3), (8, 2)]
    named = spark.createDataFrame([("s3a://b/x",), ("x",), (None,)], "p string").select(pages.resolved(F.col("p"), "/r").alias("p"))
    assert [r.p for r in named.collect()] == ["s3a://b/x", "/r/x", None]


def test_previews(spark):
    documents = spark.createDataFrame([("d", 3, "/s/d"), ("gone", 2, "/s/gone")], "document_id string, page_count int, source_path string")
    drawn = spark.createDataFrame([("d", 1, "/p/1"), ("d", 2, "/p/lost"), ("gone", 1, "/p/1"), ("d", 3, "")], "document_id string, page_number int, preview_path string")
    files = spark.createDataFrame([("/p/1",), ("/p/1",), ("/s/d",)], "path string")
    asked = spark.createDataFrame([(0, "x", 1), (1, "d", 0), (2, "d", 4), (3, "d", 1), (4, "d", 2), (5, "gone", 1), (6, "gone", 2), (7, "d", None), (8, None, 1), (9, "d", 3)], "k int, document_id string, page_number int")
    got = {r.k: (r.status, r.path) for r in pages.previews(asked, documents, drawn, files, "/out/").collect()}
    assert got == {0: ("no_document", None), 1: ("no_page", None), 2: ("no_page", None), 3: ("cached", "/p/1"), 4: ("to_render", "/out/d/2.png"), 5: ("cached", "/p/1"), 6: ("no_source", None), 7: ("no_page", None), 8: ("no_document", None), 9: ("to_render", "/out/d/3.png")}


def test_citation_details(spark):
    kind = "chunk_id string, document_id string, section_title string, heading_path array<string>, page_start int, page_end int, source_excerpt string, source_bboxes array<struct<page:int,bbox:array<double>>>"
    boxes = [(2, [10.0, 20.0, 300.0, 40.0]), (None, [0.0, 0.0, 50.0, 100.0]), (2, [1.0]), (2, None)]
    chunks = spark.createDataFrame([("a", "d", "s", ["h"], 2, 3, "x", boxes), ("b", "lost", "s", [], 1, 1, "x", []), ("c", "d", "s", None, 9, 9, None, None), ("e", "d", "s", [], 4, 4, "", boxes[1:2])], kind)
    documents = spark.createDataFrame([("d", "T", "0123456789abcdef", 9)], "document_id string, title string, source_sha256 string, page_count int")
    paper = spark.createDataFrame([("d", 2, 100.0, 200.0), ("d", 4, 0.0, None)], "document_id string, page_number int, width double, height double")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("nobody",), ("a",), ("e",)], "chunk_id string")
    got = pages.citation_details(ids, chunks, documents, paper).collect()
    assert sorted((r.chunk_id, r.is_found) for r in got) == [("a", True), ("a", True), ("b", False), ("c", True), ("e", True), ("nobody", False)]
    by = {r.chunk_id: r for r in got}
    assert [(b.page, b.bbox) for b in by["a"].source_bboxes] == [(2, [10.0, 10.0, 100.0, 20.0]), (2, [0.0, 0.0, 50.0, 50.0])]
    assert (by["a"].document_version, by["a"].document_title, by["a"].page_count, by["a"].preview_url) == ("0123456789ab", "T", 9, "/api/v1/content/documents/d/pages/2/preview")
    assert by["c"].source_bboxes == [] and by["b"].document_title is None
    assert [b.bbox for b in by["e"].source_bboxes] == [[0.0, 0.0, 100.0, 100.0]]


def test_raw_records_replace_their_pages_only(spark, tmp_path):
    scans = "document_id string, pdf_page int, model_name string, processed_at string, image_width int, image_height int"
    lines = "document_id string, pdf_page int, position int, text string, confidence double, box array<array<double>>"
    said = spark.createDataFrame([("d", 1, 1, "second", 0.5, None), ("d", 1, 0, "first", 0.9, [[1.0, 2.0]])], lines)
    path = str(tmp_path / "raw")
    pages.write_raw(pages.raw_records(spark.createDataFrame([("d", p, "m", "t", 10, 20) for p in (1, 2)], scans), said), path)
    pages.write_raw(pages.raw_records(spark.createDataFrame([("d", 2, "new", "t", 10, 20)], scans), said), path)
    assert len(glob.glob(f"{path}/document_id=d/pdf_page=*/part-*.json")) == 2
    got = pages.read_raw(spark, path, f"{scans}, ocr_lines array<struct<text:string,confidence:double,box:array<array<double>>>>").collect()
    by = {r.pdf_page: r for r in got}
    assert [(x.text, x.confidence, x.box) for x in by[1].ocr_lines] == [("first", 0.9, [[1.0, 2.0]]), ("second", 0.5, None)]
    assert (by[1].model_name, by[2].model_name, by[2].ocr_lines) == ("m", "new", [])


def test_cached_vectors(spark):
    chunks = spark.createDataFrame([(1, "h1", "a"), (2, "h2", "b"), (3, "h2", "b"), (4, "h3", "c")], "k int, content_hash string, content string")
    cache = spark.createDataFrame([("h1", "m", [1.0]), ("h2", "other", [9.0])], "content_hash string, model_name string, embedding array<double>")
    missing = pages.cache_missing(chunks, cache, "m")
    assert sorted(map(tuple, missing.collect())) == [("h2", "b"), ("h3", "c")]
    grown = cache.unionByName(missing.select("content_hash", F.lit("m").alias("model_name"), F.array(F.ascii("content").cast("double")).alias("embedding")))
    assert sorted((r.k, r.embedding) for r in pages.with_cached(chunks, grown, "m").collect()) == [(1, [1.0]), (2, [98.0]), (3, [98.0]), (4, [99.0])]
    with pytest.raises(Exception, match="no row for h"):
        pages.with_cached(chunks, cache, "m").collect()
