"""Keys come back exactly, whatever stands beside them; columns of the operators' own names stay."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenza.llm import media, minhash, mixing, packing, quality, search, secrets, suffixes

BIG = 2**60 + 1
WORDS = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]


@pytest.fixture(scope="module", params=["long", "string"])
def docs(spark, request):
    keys = [BIG, None, 3, -BIG] if request.param == "long" else ["k" * 40, None, "", "007"]
    rows = [(k, w, "s", 1) for k, w in zip(keys, WORDS, strict=True)]
    return spark.createDataFrame(rows, f"doc_id {request.param}, text string, source string, _key int").coalesce(1)


def test_keys_come_back(spark, docs, tmp_path):
    want = sorted((r.doc_id for r in docs.collect()), key=str)
    found = {
        "secrets": secrets.secrets(docs), "redacted": secrets.redacted(docs), "pieces": packing.pieces(docs), "near": minhash.near_duplicates(docs),
        "stored": media.stored(docs, str(tmp_path)), "repeats": suffixes.repeats(docs), "kept": minhash.deduplicated(docs),
    }
    for name, out in found.items():
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
        assert sorted((r.doc_id for r in out.collect()), key=str) == want, name
    assert {(r.doc_id, r.class_id) for r in found["near"].collect()} == {(k, k) for k in want}
    assert found["redacted"].columns == docs.columns and found["kept"].columns == docs.columns


def test_columns_of_the_operators_names(spark, docs):
    names = ["_source", "_sk", "_hash", "_cell", "_words", "_first", "_at", "slope", "_rated", "_rated_", "_w", "_cap", "_level"]
    clash = docs.withColumns({n: F.lit("mine") for n in names})
    for out in (mixing.mixed(clash), quality.scored(clash, quality.fit([], np.zeros(0, np.int64), 3))):
        assert set(clash.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
        rows = out.collect()
        assert len(rows) == 4 and all(r[n] == "mine" for r in rows for n in names)


def test_search_of_null_ids_and_empty_vectors_equals_sql(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(120)] + [(None, [3.0] * 4), (None, [3.0] * 4), (50, []), (121, []), (BIG, [3.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    embeddings = df.toArrow()  # noqa: F841 (the SQL reads it)
    got = sorted((tuple(r) for r in search.top_k(df, lambda i: i % 50 == 0, block=30).collect()), key=str)
    assert got == sorted(duckdb.sql(search.OP9_SQL).fetchall(), key=str) and any(r[2] is None for r in got)
    only = spark.createDataFrame([(50, []), (1, [])], df.schema)
    assert [tuple(r) for r in search.top_k(only, lambda i: i % 50 == 0).collect()] == [(50, 1, 1, 0)]
