"""Views of application tables and page texts, on literal rows."""

import json

from pyspark.sql import functions as F

from evidenza.operators import views
from evidenza.sources import files


def test_orders_and_counts(spark):
    chunks = spark.createDataFrame([("b", 1, 0), ("a", 2, 1), ("a", 2, 0), ("a", 1, 5)], "document_id string, pdf_page int, chunk_index int")
    assert [tuple(r) for r in views.sorted_chunks(chunks).collect()] == [("a", 1, 5), ("a", 2, 0), ("a", 2, 1), ("b", 1, 0)]
    vectors = spark.createDataFrame([("a",), ("c",), ("c",)], "document_id string")
    assert {tuple(r) for r in views.document_counts(chunks, vectors, condition=F.col("pdf_page") == 2).collect()} == {("a", 2, 1), ("b", 0, 0), ("c", 0, 2)}
    left, seen = views.deleted_counted(chunks, F.col("pdf_page") == 2)
    assert left.count() == 2 and seen.get["n"] == 2
    rows = spark.createDataFrame([("u", 1, 5), ("u", 2, 9), ("u", 3, None), ("u", 4, 9)], "user_id string, k int, at int")
    assert [r.k for r in views.recent_first(rows, "user_id", "at", "k").orderBy("place").collect()] == [2, 4, 1, 3]
    new = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3), (None, 4), (None, 5)], "mail string, k int")
    got = views.unique_inserts(spark.createDataFrame([("y",), (None,)], "mail string"), new, ["mail"], [F.col("k")])
    assert {(r.k, r.is_accepted) for r in got.collect()} == {(1, True), (2, False), (3, False), (4, True), (5, True)}


def test_titles_and_reports(spark):
    conversations = spark.createDataFrame([(1, views.NEW_TITLE, 1), (2, "own", 9), (3, None, 1), (4, "", 1)], "conv_id int, title string, updated_at int")
    messages = spark.createDataFrame([(1, 0, "assistant", "hi", 2), (1, 1, "user", " " + "q" * 40, 3), (1, 2, "assistant", "a" * 90, 4), (2, 0, "user", "new", 5), (3, 0, "assistant", "x", 2), (4, 0, "user", " ", 7)], "conv_id int, turn int, role string, text string, at int")
    got = {r.conv_id: (r.title, r.preview, r.updated_at) for r in views.titled(conversations, messages).collect()}
    assert got == {1: ("q" * 24, "a" * 80, 4), 2: ("own", "new", 9), 3: (None, "x", 2), 4: ("", None, 1)}
    items = spark.createDataFrame([("r", 1, "B", 2.0, "u", None, None, "unknown"), ("r", 0, "A", 1.0, "u", 0.0, 3.0, "normal"), ("s", 0, "OCR pending", None, "", None, None, "unknown")], "report_id string, position int, name string, value double, unit string, low double, high double, status string")
    cited = spark.createDataFrame([("r", 0, ["c1"])], "report_id string, position int, citations array<string>")
    out = {r.report_id: json.loads(r.json) for r in views.report_views(spark.createDataFrame([("r",), ("s",)], "report_id string"), items, cited).collect()}
    assert out["s"]["items"] == [] and [i["name"] for i in out["r"]["items"]] == ["A", "B"]
    assert out["r"]["items"][0]["citations"] == ["c1"] and "low" not in out["r"]["items"][1]


def test_page_texts(spark):
    def extractor():
        def pages(data):
            if data.startswith(b"bad"):
                raise ValueError("no pages")
            return data.decode().split("\f")

        return pages

    df = spark.createDataFrame([("a", bytearray(b"one\f \ftwo  x"), "t"), ("b", bytearray(b"bad"), "t"), ("c", None, "t")], "path string, content binary, page_ string")
    got = sorted((r.path, r.page, r.text, r.error) for r in files.page_texts(df, extractor).collect())
    assert got == [("a", 1, "one", None), ("a", 3, "two x", None), ("b", None, None, "ValueError: no pages")]


def test_layout_of_trees(spark, tmp_path):
    for tree, name, text in (("d1/x/y", "z.json", "no"), ("d1/x", "content_list.json", "yes"), ("d2", "a.json", "a"), ("d2/b", "b.json", "b")):
        (tmp_path / "in" / tree).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / tree / name).write_text(json.dumps([{"type": "text", "text": text}]))
    path = str(tmp_path / "in")
    assert sorted(r.text for r in files.layout_blocks(spark, path).collect()) == ["a", "b", "no", "yes"]
    assert sorted(r.text for r in files.layout_blocks(spark, path, trees=True).collect()) == ["a", "yes"]
