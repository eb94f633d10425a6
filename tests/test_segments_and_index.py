"""Segmentation of ideographs on literal rows, and the vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenza.functions.segments import Lexicon, in_pairs
from evidenza.operators import index, profile, retrieval
from evidenza.plans import queries

WORDS = {"糖尿病": 50, "高血压": 60, "血压": 80, "控制": 90, "饮食": 70, "糖尿病人": 5, "病人": 40, "中华": 9, "人民": 9, "共和国": 9, "共和": 4, "中华人民共和国": 20}


def terms(spark, text, cut=None):
    column = retrieval.lexical_terms(F.col("t")) if cut is None else retrieval.lexical_terms(F.col("t"), cut)
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_pairs(spark):
    texts = {"糖尿病": ["糖尿", "尿病"], "血": ["血"], "ab血压x": ["ab", "血压", "x"], "": [], None: None, "abc": ["abc"]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", in_pairs(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == texts


def test_question_terms_of_ideographs(spark):
    assert terms(spark, "糖尿病，Diet and 高血压 diet") == ["糖尿", "尿病", "diet", "and", "高血", "血压"]
    assert terms(spark, "如何 hbA1c偏高 什么") == ["hba1c", "偏高"]
    assert terms(spark, None) is None


def test_lexicon_takes_the_best_path(spark):
    lexicon = Lexicon.of(spark.createDataFrame([*WORDS.items(), ("控制", 1), (None, 3), ("", 3)], "word string, count long"))
    assert lexicon.words("糖尿病人饮食控制abc") == ["糖尿病", "人", "饮食", "控制", "abc"] or lexicon.words("糖尿病人饮食控制abc") == ["糖尿病人", "饮食", "控制", "abc"]
    assert lexicon.words("高血压怎么控制") == ["高血压", "怎么", "控制"]
    assert lexicon.search_terms("高血压") == ["血压", "高血压"]
    assert lexicon.search_terms("中华人民共和国") == ["中华", "人民", "共和", "共和国", "中华人民共和国"]
    assert lexicon.words("") == [] and Lexicon({}).words("血压") == ["血压"]
    cut = lexicon.cutter(spark)
    assert terms(spark, "高血压怎么控制, Diet", cut) == ["血压", "高血压", "控制", "diet"]
    assert terms(spark, "plain words, twice words", cut) == ["plain", "words", "twice"]
    with pytest.raises(ValueError):
        Lexicon.of(spark.createDataFrame([("a", 1), ("b", 1)], "word string, count long"), most=1)


def test_best_path_equals_all_paths(spark):
    """The path's weight is that of the best of all ways to cut a run."""
    lexicon, run = Lexicon(WORDS), "中华人民共和国糖尿病人高血压"

    def ways(rest):
        if not rest:
            yield 0.0
        for n in range(1, len(rest) + 1):
            w = lexicon.weight.get(rest[:n], lexicon.unknown if n == 1 else None)
            if w is not None:
                yield from (w + x for x in ways(rest[n:]))

    got = sum(lexicon.weight.get(w, lexicon.unknown * len(w)) for w in lexicon.path(run))
    assert got == pytest.approx(max(ways(run)))


def test_searches_use_segments(spark):
    chunks = spark.createDataFrame([(1, "高血压 手册", "控制", "血压"), (2, "其他", "", "尿病")], "chunk_id long, title string, section string, content string")
    asked = spark.createDataFrame([(1, "高血压怎么控制")], "question_id long, question string")
    assert [(r.chunk_id, r.score) for r in retrieval.lexical_search(asked, chunks).collect()] == [(1, 8 + 8 + 3 + 9)]
    found = retrieval.lexical_search(asked, chunks, cut=Lexicon(WORDS).cutter(spark)).collect()
    assert [(r.chunk_id, r.score) for r in found] == [(1, 8 + 8 + 3 + 9)]


def test_profile_words_of_a_lexicon(spark):
    lists = {f: None for f in profile.LISTS} | {"chronic_conditions": ["糖尿病人饮食控制", "asthma and cough", None]}
    fields = [*profile.LISTS, *profile.HABITS]
    row = spark.createDataFrame([(1, [], *[lists.get(f) for f in profile.LISTS], *[None] * len(profile.HABITS))], f"k long, tags array<string>, {', '.join(f'{f} ' + ('array<string>' if f in profile.LISTS else 'string') for f in fields)}")
    without = {r.keyword for r in profile.profile_keywords(row, "k").collect()}
    found = {r.keyword for r in profile.profile_keywords(row, "k", cut=Lexicon(WORDS).list_cutter(spark)).collect()}
    assert "糖尿病人饮食控制" in found and found <= without | set(WORDS)


@pytest.fixture(scope="module")
def held(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 24))
    x = np.repeat(centres, 75, 0) + 0.5 * r.normal(size=(3000, 24))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return spark.createDataFrame([(i, v.tolist(), f"c{i % 3}") for i, v in enumerate(x)], "chunk_id long, vector array<double>, category string").repartition(4).cache()


def test_index_recall(spark, held, tmp_path):
    built = index.build(held, str(tmp_path), fields=("category",))
    assert built.rows.count() == 3000 and len(built.centroids) == 55
    asked = held.filter("chunk_id % 60 = 0").select(F.col("chunk_id").alias("question_id"), "vector")
    exact = {(r.question_id, r.chunk_id) for r in retrieval.vector_search(asked, held, 50).collect()}
    assert 1 < built.probes < 40
    found = index.search(built, asked, 50)
    got = {(r.question_id, r.chunk_id) for r in found.collect()}
    assert len(exact) == 2500 and len(got & exact) / len(exact) >= 0.9
    whole = {(r.question_id, r.chunk_id) for r in index.search(built, asked, 50, probes=55).collect()}
    assert whole == exact
    one = index.search(built, asked.limit(1), 5, probes=2)
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString() or "cell#" in one._jdf.queryExecution().toString()
    assert len({r.rank for r in one.collect()}) == 5
    some = index.search(built, asked, 5, where=F.col("category") == "c1").join(held, "chunk_id")
    assert {r.category for r in some.collect()} == {"c1"}


def test_index_is_checked(spark, held, tmp_path):
    path = str(tmp_path)
    index.build(held.limit(50), path, cells=3)
    assert index.opened(spark, path, 24).rows.count() == 50
    index.build(held.limit(80), path, cells=3, fields=("category",))
    assert index.opened(spark, path, 24, ("category",)).rows.count() == 80  # the one named last
    with pytest.raises(ValueError, match="field document_id is missing; vectors have 24 components, not 512"):
        index.opened(spark, path, 512, ("document_id",))
    asked = spark.createDataFrame([(1, [1.0] * 5)], "question_id long, vector array<double>")
    with pytest.raises(ValueError, match="5 components"):
        index.search(index.opened(spark, path, 24), asked, 3).collect()
    for bad in ([], [(1, [0.0, 0.0])], [(1, [1.0, None])], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(ValueError, match="no index"):
            index.build(spark.createDataFrame(bad, "chunk_id long, vector array<double>"), path)
    same = index.build(spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "chunk_id long, vector array<double>"), path)
    assert [r.chunk_id for r in index.search(same, spark.createDataFrame([(1, [2.0, 0.0])], "question_id long, vector array<double>"), 3, probes=3).orderBy("rank").collect()] == [0, 1, 2]


def test_indexed_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.question_id, r.chunk_id) for r in queries.QUERIES["indexed_topk"](spark, sf).collect()}
    exact = {(r.question_id, r.chunk_id) for r in retrieval.vector_search(queries.asked_vectors(spark, sf), queries.vectors(spark, sf), 50).collect()}
    assert len(got & exact) / len(exact) >= 0.9
