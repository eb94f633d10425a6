"""Token counts, code compression and clustering: against the library, plain rounds and SQL, on odd rows."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidenza.llm import clusters, codes, queries, tokens

SF = "/root/testdata/sf0.001"
BIG = 2**60 + 1


def test_token_counts_equal_the_library(spark):
    r = random.Random(3)
    signs = [*"aAbzS's'tJ̌́ͅ'd'll 019٣½²\n\t\x0b\x85\xa0é̸ΣςİıßK中文字。，、!.,:;?)<|>_-👍가\x1c\x00", "<|endoftext|>", "<|STARTOFTEXT|>", "中文。", "12 "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, "a1" * 20000, "中文。" * 9000, "word, " * 30000, "<|endoftext|>" * 900, "é" * 9000, " " * 9000]
    rows = [(BIG if i % 3 == 0 else None if i % 3 == 1 else i, t, "mine", "mine") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], rows[1]], "doc_id long, text string, n_tokens string, _key string").repartition(3)
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    want = Counter()
    for k, t, *_ in [*rows, rows[0], rows[1]]:
        n = len(whole.encode(t or "", add_special_tokens=False))
        want[k, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, tokens.token_counts(docs).collect())) == want
    assert tokens.token_counts(docs.limit(0)).count() == 0
    named = tokens.token_counts(docs.selectExpr("concat('k', doc_id) AS k", "text AS body"), "body", "k", limit=5)
    assert named.columns == ["k", "n_bytes", "n_tokens", "over_limit"] and sum(x.over_limit for x in named.collect()) == sum(n for (_, _, t, _), n in want.items() if t > 5)


@pytest.mark.parametrize("vocabulary", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_other_vocabularies_count_whole_texts(spark, vocabulary):
    texts = ["a  b\n c", "中文 字。", "", " x" * 500]
    got = tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary=vocabulary)
    encode, cuts = tokens.library(vocabulary)
    assert not cuts
    assert {x.doc_id: x.n_tokens for x in got.collect()} == {i: len(encode([t])[0]) for i, t in enumerate(texts)}


def odd_vectors(spark, width=64, n=700):
    r = np.random.default_rng(5)
    centre = r.normal(size=(9, width))
    rows = [(i, (centre[i % 9] + r.normal(size=width) * 0.2).tolist(), None if i % 7 == 0 else i % 3, "mine", "mine") for i in range(n)]
    rows += [(BIG, rows[3][1], 1, "mine", "mine"), (None, rows[4][1], None, "mine", "mine"), (None, rows[4][1], 1, "mine", "mine"), rows[5], rows[5]]
    rows += [(900, None, 1, "a", "b"), (901, [None, *rows[0][1][1:]], 1, "a", "b"), (902, [float("nan"), *rows[0][1][1:]], 1, "a", "b"), (903, [float("-inf"), *rows[0][1][1:]], 1, "a", "b")]
    schema = "vec_id long, embedding array<float>, label int, _v string, code string"
    return spark.createDataFrame(rows, schema).repartition(3)


def whole_numbers(table, factor):
    return [(r.vec_id, [int(np.floor(np.float64(x) * factor)) for x in r.embedding], r.label) for r in table.collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]


def test_codes_equal_plain_rounds(spark):
    table = odd_vectors(spark)
    rows = whole_numbers(table, 1024)
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    x = np.array([r[1] for r in rows])
    books = [np.array([r[1][16 * p : 16 * p + 16] for r in first]) for p in range(4)]
    assign = lambda: [((x[:, None, 16 * p : 16 * p + 16] - books[p][None]) ** 2).sum(2) for p in range(4)]
    for _ in range(4):
        for p, away in enumerate(assign()):
            near = away.argmin(1)
            for i in set(near.tolist()):
                books[p][i] = [int(s) // int((near == i).sum()) for s in x[near == i, 16 * p : 16 * p + 16].sum(0)]
    away = assign()
    want = Counter((k, "".join(f"{a[i].argmin():02x}" for a in away), int(sum(a[i].min() for a in away))) for i, (k, _, _) in enumerate(rows))
    found = codes.fit(table)
    assert (found == np.array(books)).all()
    coded = codes.encoded(table, found)
    assert coded.schema["_row"].dataType.names == ["vec_id", "label", "_v", "code"]
    got = coded.collect()
    assert Counter((r["_row"].vec_id, bytes(r.code).hex(), r.error) for r in got) == want
    by = Counter()
    for r in got:
        by[r["_row"].label] += r.error
    sums = codes.summed_by(coded.selectExpr("_row.label", "error"), "label", "error", "s")
    assert {(r.label, r.s) for r in sums.collect()} == set(by.items())
    back = codes.decoded(coded.limit(3), found).collect()
    assert all(np.allclose(np.array(r.vector) * 1024, np.concatenate([found[p][bytes(r.code)[p]] for p in range(4)])) for r in back)


def test_codes_of_no_few_and_uneven_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([], schema)
    assert codes.encoded(none, codes.fit(none)).count() == 0
    empty = spark.createDataFrame([(1, [], 1)], schema)
    assert [(bytes(r.code).hex(), r.error) for r in codes.encoded(empty, codes.fit(empty)).collect()] == [("00000000", 0)]
    uneven = spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (3, [], None)], schema)
    books = codes.fit(uneven)
    assert books.shape == (4, 3, 2) and {r.error for r in codes.encoded(uneven, books).collect()} == {0}


def plain_clusters(rows, k, rounds):
    hashed = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    at = np.array([r[1] for r in sorted(rows, key=hashed)[:k]])
    x = np.array([r[1] for r in rows])
    for _ in range(rounds):
        near = ((x[:, None] - at[None]) ** 2).sum(2).argmin(1)
        for c in set(near.tolist()):
            at[c] = [int(s) // int((near == c).sum()) for s in x[near == c].sum(0)]
    away = ((x[:, None] - at[None]) ** 2).sum(2)
    return at, Counter((r[0], int(a.argmin()), int(a.min())) for r, a in zip(rows, away, strict=True))


@pytest.mark.parametrize(("width", "tree", "leaf"), [(64, 4096, 32), (64, 50, 1), (3, 300, 4)])
def test_clusters_equal_plain_rounds(spark, width, tree, leaf):
    table = odd_vectors(spark, width)
    rows = [r for r in whole_numbers(table, 64) if len(r[1]) == width]
    at, want = plain_clusters(rows, 16, 3)
    found, centroids = clusters.clustered(table, width=width, tree=tree, leaf=leaf)
    assert (centroids == at).all()
    assert Counter(map(tuple, found.collect())) == want


def test_clusters_prune(spark):
    r = np.random.default_rng(1)
    points = (r.integers(0, 8, (2000, 1)) * 1000 + r.integers(0, 5, (2000, 64))).astype(np.int64)
    built, order = clusters.Tree.built(points)
    assert (built.points == points[order]).all() and built.last[0] == 2000
    centroids = np.arange(8)[:, None] * 1000 + np.zeros((8, 64), np.int64)
    whole, at, _ = built.assigned(centroids)
    assert len(whole) > 0 and len(at) < 500
    sums, counts = built.totals(centroids)
    assert counts.sum() == 2000 and (sums.sum(0) == points.sum(0)).all()


def test_clusters_of_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert clusters.clustered(spark.createDataFrame([], schema))[0].count() == 0
    same = spark.createDataFrame([(1, [1.0] * 64)] * 300 + [(2, [0.5] * 63)], schema)
    assert {tuple(r) for r in clusters.clustered(same)[0].collect()} == {(1, 0, 0)}


@pytest.mark.parametrize("name", ["op12_codes", "op13_clusters"])
def test_vector_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
