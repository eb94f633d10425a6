"""Tables that change together: commits, writers that die, conflicts, buckets rewritten, old versions removed."""

import pytest
from pyspark.sql import functions as F

from evidenza.operators.stores import Conflict, Stores, Table

TABLES = {
    "chunks": Table("document_id string, chunk_id long, text string", ["chunk_id"], ["document_id"]),
    "vectors": Table("document_id string, chunk_id long, vector array<double>", ["chunk_id"], ["document_id"]),
    "pages": Table("page_id long, text string", ["page_id"]),
}


def document(spark, name, ids, word):
    rows = spark.createDataFrame([(name, i, f"{word}{i}") for i in ids], TABLES["chunks"].schema)
    return {"chunks": rows, "vectors": rows.select("document_id", "chunk_id", F.array(F.col("chunk_id").cast("double")).alias("vector"))}


def held(stores):
    state = stores.state()
    return [sorted((r.document_id, r.chunk_id) for r in stores.read(n, state).collect()) for n in ("chunks", "vectors")]


def test_replaced_document_is_seen_whole_or_not(spark, tmp_path, monkeypatch):
    stores = Stores(spark, str(tmp_path), TABLES, 8)
    assert stores.read("chunks").count() == 0
    stores.replace_document(document(spark, "a", [1, 2, 3], "x"))
    stores.replace_document(document(spark, "b", [7], "x"))
    old = held(stores)
    assert old[0] == old[1] == [("a", 1), ("a", 2), ("a", 3), ("b", 7)]

    # A writer that dies after the first table, and one that dies before its commit.
    real, calls = Stores._rewritten, []

    def dies(self, name, *rest):
        calls.append(name)
        if len(calls) == 2:
            raise OSError("lost")
        return real(self, name, *rest)

    monkeypatch.setattr(Stores, "_rewritten", dies)
    with pytest.raises(OSError, match="lost"):
        stores.replace_document(document(spark, "a", [4], "y"))
    monkeypatch.undo()
    assert held(stores) == old
    monkeypatch.setattr(Stores, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        stores.replace_document(document(spark, "a", [4], "y"))
    monkeypatch.undo()
    assert held(stores) == old

    stores.replace_document(document(spark, "a", [4, 1], "y"))
    assert held(stores) == [[("a", 1), ("a", 4), ("b", 7)]] * 2
    assert {r.text for r in stores.read("chunks").collect()} == {"y1", "y4", "x7"}
    assert stores.vacuum(1) > 0 and held(stores) == [[("a", 1), ("a", 4), ("b", 7)]] * 2


def test_replacement_is_of_one_document(spark, tmp_path):
    stores = Stores(spark, str(tmp_path), TABLES, 8)
    for bad in (
        {"chunks": document(spark, "a", [1], "x")["chunks"], "vectors": document(spark, "b", [1], "x")["vectors"]},
        {"chunks": document(spark, "a", [], "x")["chunks"]},
        {"chunks": document(spark, "a", [1], "x")["chunks"].union(document(spark, "b", [2], "x")["chunks"])},
        {"chunks": document(spark, None, [1], "x")["chunks"]},
    ):
        with pytest.raises(ValueError, match="exactly one document"):
            stores.replace_document(bad)
    with pytest.raises(ValueError, match="bucketed by"):
        stores.replace_document({"pages": document(spark, "a", [1], "x")["chunks"]})
    with pytest.raises(ValueError, match="the key decides"):
        stores.merge("chunks", document(spark, "a", [1], "x")["chunks"])
    assert stores.state()["number"] == 0


def test_two_writers(spark, tmp_path):
    one, two = Stores(spark, str(tmp_path), TABLES, 8), Stores(spark, str(tmp_path), TABLES, 8)
    base = one.state()
    two.replace_document(document(spark, "b", [2], "x"))
    with pytest.raises(Conflict):
        one._commit(base, {"chunks": {}})
    assert held(one) == [[("b", 2)]] * 2
    with pytest.raises(ValueError, match="8 buckets"):
        Stores(spark, str(tmp_path), TABLES, 4).state()


def test_merge_rewrites_the_buckets_that_it_hits(spark, tmp_path):
    stores = Stores(spark, str(tmp_path), TABLES, 16)
    pages = lambda ids, word: spark.createDataFrame([(i, f"{word}{i}") for i in ids], TABLES["pages"].schema)
    stores.merge("pages", pages(range(400), "old"))
    before = stores.state()["tables"]["pages"]
    new = pages([3, 3, 5, 1000], "new").withColumn("n", F.monotonically_increasing_id())
    hit = {str(b) for b in stores._hit("pages", new)}
    stores.merge("pages", new, [F.desc("n")])
    after = stores.state()["tables"]["pages"]
    assert len(before) == 16 and 1 <= len(hit) <= 3
    assert {b for b in after if after[b] != before.get(b)} == hit
    got = {r.page_id: r.text for r in stores.read("pages").collect()}
    assert got == {i: f"old{i}" for i in range(400)} | {i: f"new{i}" for i in (3, 5, 1000)} and stores.read("pages").count() == 401
    # The same batch again, and a later one.
    n = stores.merge("pages", pages([9], "b1"), batch=1)
    assert stores.merge("pages", pages([9], "again"), batch=1) == n == stores.merge("pages", pages([9], "again"), batch=0)
    assert stores.merge("pages", pages([9], "b2"), batch=2) == n + 1
    assert stores.read("pages").filter("page_id = 9").first().text == "b29"
    empty = stores.merge("pages", pages([], "x"))
    assert stores.read("pages").count() == 401 and empty == n + 2
    assert stores.read("pages", stores.state(1)).filter("page_id = 3").first().text == "old3"
    stores.vacuum()
    assert stores.read("pages").count() == 401


def test_repeated_keys_and_equal_times(spark):
    from evidenza.operators import ledger, tables

    old = spark.createDataFrame([(1, "a", "b"), (2, "a", None)], "k long, x string, y string")
    new = spark.createDataFrame([(1, "n1", "z"), (1, "n2", "z"), (3, "n", "z"), (3, "m", "z")], old.schema)
    assert sorted(tuple(r) for r in tables.upsert_columns(old, new, ["k"], ["x"], [F.col("x")]).collect()) == [(1, "n1", "b"), (2, "a", None), (3, "m", "z")]
    assert sorted(tuple(r) for r in tables.patched(old, new, "k", ["x"], [], ["y"], [F.desc("x")]).collect()) == [(1, "n2", "z"), (2, "a", None)]
    assert tables.patched(old, new, "k", ["x"], [], ["y"]).count() == 2

    schema = "run_id string, document_id string, model_name string, state string, at int, n_chunks long, error string"
    events = [("r", "d", "m", "running", 1, None, None), ("r", None, None, "success", 5, 3, None), ("r", None, None, "failed", 5, 2, "e"), ("q", "d", "m", "running", 9, None, None), ("q", None, None, "success", 9, 4, None)]
    got = {r.run_id: (r.state, r.ended, r.n_chunks, r.error) for r in ledger.runs(spark.createDataFrame(events, schema)).collect()}
    assert got == {"r": ("failed", 5, 2, "e"), "q": ("success", 9, 4, None)}
    numbered = spark.createDataFrame([(*e, i) for i, e in enumerate([events[0], events[2], events[1]])], f"{schema}, event_id long")
    assert [(r.state, r.n_chunks, r.error) for r in ledger.runs(numbered).collect()] == [("success", 3, None)]
