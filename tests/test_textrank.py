"""Text rank on literal rows with known covers, and against a plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidenza.operators import textrank


def plain_covers(text, terms):
    """All shortest runs of words that hold every term, found one by one."""
    said = re.findall(r"\w+", text.lower())
    runs = [(i, j) for i in range(len(said)) for j in range(i, len(said)) if set(terms) <= set(said[i : j + 1])]
    shortest = [(i, j) for i, j in runs if not any((a, b) != (i, j) and i <= a and b <= j for a, b in runs)]
    return sum(0.1 / (1 + (j - i + 1 - len(terms))) for i, j in shortest) if terms else 0.0


def plain_trigrams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


def plain_similarity(a, b):
    a, b = plain_trigrams(a), plain_trigrams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_known_covers(spark):
    chunks = [(1, "alpha beta"), (2, "alpha x x beta alpha"), (3, "alpha alpha"), (4, "beta x alpha"), (5, None), (6, "Beta, ALPHA; beta")]
    df = spark.createDataFrame([(i, t, t) for i, t in chunks], "chunk_id long, search_text string, content string")
    asked = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "!")], "question_id long, question string")
    got = {(r.question_id, r.chunk_id): r.rank_score for r in textrank.text_rank(asked, df, k=10).collect()}
    want = {1: 0.1, 2: 0.1 / 3 + 0.1, 3: 0.0, 4: 0.05, 5: 0.0, 6: 0.2}
    assert {c: got[1, c] for c in want} == pytest.approx(want, abs=1e-6)
    assert len(got) == 18 and not any(s for (q, _), s in got.items() if q > 1)


def test_equals_plain_version(spark):
    r = random.Random(2)
    said = ["ab", "abc", "bcd", "cde", "x", "yz", "ba"]
    texts = [" ".join(r.choice(said) for _ in range(r.randint(0, 14))) for _ in range(60)]
    status = ["published" if i % 4 else "draft" for i in range(60)]
    df = spark.createDataFrame([(i, t, t[::-1], s) for i, (t, s) in enumerate(zip(texts, status, strict=True))], "chunk_id long, search_text string, content string, published_status string")
    questions = ["ab abc", "x", "bcd yz ba", "zzz", "ab cde x yz"]
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
    held = textrank.postings(df)
    got = [tuple(x) for x in textrank.text_rank(asked, df, held, k=7, status="published").select("question_id", "rank", "chunk_id", "rank_score", "similarity").collect()]
    want = []
    for q, text in enumerate(questions):
        rows = [(-round(plain_covers(t, set(text.split())), 6), -round(plain_similarity(text, t[::-1]), 6), i) for i, t in enumerate(texts) if status[i] == "published"]
        want += [(q, n + 1, i, -s, -a) for n, (s, a, i) in enumerate(sorted(rows)[:7])]
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in want]
    assert all(a[3:] == pytest.approx(b[3:], abs=2e-6) for a, b in zip(sorted(got), want, strict=True))


def test_terms_of_a_cutter(spark):
    df = spark.createDataFrame([(1, "血压 高 控制", "x"), (2, "控制", "x")], "chunk_id long, search_text string, content string")
    asked = spark.createDataFrame([(1, "血压控制", ["血压", "控制"])], "question_id long, question string, terms array<string>")
    assert [(r.chunk_id, r.rank_score) for r in textrank.text_rank(asked, df).orderBy("rank").collect()] == [(1, 0.05), (2, 0.0)]
    assert {(r.chunk_id, r.term): r.places for r in textrank.postings(df.withColumn("search_text", F.lit("a b a"))).collect()}[1, "a"] == [1, 3]


def test_no_text_is_moved(spark):
    """Without written postings results are the same, and no shuffle holds words, places or trigrams of the chunks."""
    import re

    r = random.Random(4)
    texts = [" ".join(r.choice(["ab", "abc", "bcd", "x", "yz", "ba", "Ab"]) for _ in range(r.randint(0, 20))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(texts)], "chunk_id long, search_text string, content string")
    asked = spark.createDataFrame(list(enumerate(["ab abc", "x", "bcd yz ba", "zzz", "ab ab x yz", "", None])), "question_id long, question string")
    rows = lambda found: sorted(tuple(x) for x in found.select("question_id", "rank", "chunk_id", "rank_score", "similarity").collect())
    found = textrank.text_rank(asked, df, k=9)
    assert rows(found) == rows(textrank.text_rank(asked, df, textrank.postings(df), k=9))
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = set(re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", plan))
    assert keys <= {"question_id", "term"} and "SortMergeJoin [chunk_id" not in plan and "posexplode(regexp_extract_all(lower(search_text" not in plan


def test_searches_hold_few_rows():
    """However large Spark's batches are, a search sees a bounded part of one at a time, and every row."""
    import pyarrow as pa

    from evidenza.operators import retrieval

    seen = []

    def search(parts):
        for part in parts:
            seen.append(len(part))
            yield part[["chunk_id"]].assign(question_id=1, score=2.0)

    schema = pa.schema([("question_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.int32())])
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(2500)), "text": ["x"] * 2500})
    found = list(retrieval.in_parts(search, schema)(iter([batch, batch.slice(0, 3)])))
    assert max(seen) <= retrieval.ROWS < 2500 and sum(seen) == 2503
    assert [i for b in found for i in b["chunk_id"].to_pylist()] == [*range(2500), 0, 1, 2] and all(b.schema == schema for b in found)


def test_texts_are_read_once(spark):
    """Neither words nor trigrams of the chunks are cut by expressions: texts go to the search as they are, in one pass."""
    df = spark.createDataFrame([(1, "alpha beta", "alpha beta")], "chunk_id long, search_text string, content string")
    plan = textrank.text_rank(spark.createDataFrame([(1, "alpha beta")], "question_id long, question string"), df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan and "transform" not in plan


def test_long_text_before_many_short_ones():
    """A task's rows are cut by number and length, in whatever order, and every one is scored; letters of all planes count, halves round up."""
    import sys

    import numpy as np
    import pandas as pd

    letters = np.array([c for c in range(sys.maxunicode + 1) if chr(c).isalnum()], np.int32)
    texts = ["ab " * 150_000, *[f"ab{'_' * (i % 3)} word{i}, 血压 𝒳𝒴" for i in range(1100)], "", "zz"]
    rows = pd.DataFrame({"chunk_id": np.arange(len(texts)), "said": texts, "content": texts})
    asked = ["ab word7", "血压 𝒳𝒴", "yy ab"]
    held = pd.DataFrame({"question_id": [5, 6, 7], "terms": [q.split() for q in asked], "grams": [sorted(plain_trigrams(q)) for q in asked]})
    found = pd.concat(textrank.searcher(held, letters, 9)(iter([rows])))
    for i, q in enumerate(asked):
        whole = [set(q.split()) <= set(re.findall(r"[^\W_]+", t)) for t in texts]
        want = sorted((-0.1 * w, -round(plain_similarity(q, t), 6), n) for n, (t, w) in enumerate(zip(texts, whole, strict=True)))[:9]
        got = found[found["question_id"] == i + 5]
        assert got["chunk_id"].tolist() == [n for _, _, n in want]
        assert got["rank_score"].tolist() == pytest.approx([-s for s, _, _ in want], abs=2e-6) and (got["near"] / 1e6).tolist() == pytest.approx([-a for _, a, _ in want], abs=2e-6)
    assert textrank.millionths(np.array([1, 1, 0]), np.array([128, 640, 0])).tolist() == [7813, 1563, 0] and textrank.rounded(0.1 / 64) == 0.001563


def test_letters_are_those_of_expressions(spark):
    found = set(textrank.letters(spark).tolist())
    assert {ord(c) for c in "aé血𝒳½Ⅷ٣"} <= found and not found & {ord(c) for c in " _-́😀　"}
    said = spark.createDataFrame([("a_b血́é 𝒳½-Ⅷ😀٣",)], "t string").select(textrank.words(F.col("t")).alias("w")).first().w
    assert "".join(said) == "".join(c for c in "a_b血́é 𝒳½-Ⅷ😀٣".lower() if ord(c) in found)
