"""Lexical and vector search for a batch of questions, rank fusion, and hydration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.segments import ideographs, in_pairs
from .tables import top_by

#: Cuts a text column into an array of terms.
Cut = Callable[[Column], Column]

# Words of a question that no search uses.
STOPWORDS = ("有", "有哪些", "哪些", "什么", "是什么", "怎么", "如何", "请问", "一下", "常见", "相关", "可能", "一般", "主要", "表现")
#: A batch of questions goes to every task that searches; more than this many go in several batches.
QUESTIONS = 10_000
#: Rows whose texts a task holds as Python objects at a time.
ROWS = 1024
BRANCH = 50
RRF_K, LEXICAL_WEIGHT = 60, 1.5
#: The rank of a hit in a search that did not find it.
ABSENT = 10_000


def lexical_terms(question: Column, cut: Cut = in_pairs) -> Column:
    """Distinct lower-case terms of two characters or more that are not stopwords, in order of appearance.

    Words that hold ideographs are cut further: into pairs, or as a lexicon's cutter does.
    """
    words = F.split(F.lower(question), "[\\s,，。！？；;、.!?]+")
    if cut is in_pairs:
        terms = F.flatten(F.transform(words, lambda w: F.when(ideographs(w), in_pairs(w)).otherwise(F.array(w))))
    else:
        # A cutter takes whole columns, not elements: it gets the words joined by a blank, which no word holds.
        joined = cut(F.array_join(words, " "))
        terms = F.when(ideographs(question), F.flatten(F.transform(joined, lambda t: F.split(t, " ")))).otherwise(words)
    return F.array_distinct(F.filter(terms, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS)))


def fallback_terms(question: Column) -> Column:
    """Lower-case words, repeats kept, and then runs of ideographs that are not among them."""
    words = F.transform(F.filter(F.split(question, "[\\s,，。！？；;、]+"), lambda w: F.length(F.btrim(w)) >= 2), F.lower)
    runs = F.array_distinct(F.regexp_extract_all(question, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0)))
    return F.concat(words, F.filter(runs, lambda r: ~F.array_contains(words, r)))


def in_batches(asked: DataFrame, batch: int) -> Iterator[pd.DataFrame]:
    """The questions in batches of about `batch` by hash of their id, one at a time on the driver."""
    parts = max(1, -(-asked.count() // batch))
    for part in range(parts):
        held = asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == part).toPandas()
        if len(held):
            yield held


def best_of_all(asked: DataFrame, rows: DataFrame, scorer, k: int, batch: int, score: str = "double", needed=None) -> DataFrame:
    """question_id, chunk_id, score, rank: the k best rows for each question, by score to six places, then id.

    scorer(batch of questions) gives a function of a batch of rows to its scores, a row for each row and a column for each
    question (nan: no hit). Each batch of questions goes to all tasks; a task keeps k for each question. needed(batch of
    questions) is a condition on the rows that can be hits.
    """
    schema = f"question_id {asked.schema['question_id'].dataType.simpleString()}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, score {score}"
    found = None
    for held in in_batches(asked, batch):
        own = rows if needed is None else rows.filter(needed(held))
        one = own.mapInArrow(in_parts(nearest(held["question_id"].to_numpy(), scorer(held), k), to_arrow_schema(T.StructType.fromDDL(schema))), schema)
        found = one if found is None else found.unionByName(one)
    found = rows.sparkSession.createDataFrame([], schema) if found is None else found
    found = found if score != "double" else found.withColumn("score", F.round("score", 6))
    return top_by(found, ["question_id"], [F.desc("score"), F.col("chunk_id")], k)


def in_parts(search, schema: pa.Schema, size: int = ROWS):
    """A search over pandas rows as a function of Arrow batches, of which only `size` rows at a time become Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(lo, size).to_pandas() for batch in batches for lo in range(0, batch.num_rows, size))
        for found in search(parts):
            yield pa.RecordBatch.from_pandas(found, schema=schema, preserve_index=False)

    return run


def nearest(ids: np.ndarray, scores, k: int):
    """A function of a task's batches of rows to the k best of them for every question."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # About a million scores at a time, however many questions there are.
        step, held, best = max(1, (1 << 20) // len(ids)), None, None
        for batch in batches:
            for lo in range(0, len(batch), step):
                rows = batch.iloc[lo : lo + step]
                new, key = scores(rows), np.repeat(rows["chunk_id"].to_numpy()[:, None], len(ids), axis=1)
                if best is not None:
                    key, new = np.vstack([held, key]), np.vstack([best, new])
                order = np.argsort(key, axis=0, kind="stable")
                worth = np.take_along_axis(new, order, axis=0).round(6)
                order = np.take_along_axis(order, np.argsort(-worth, axis=0, kind="stable")[:k], axis=0)
                held, best = np.take_along_axis(key, order, axis=0), np.take_along_axis(new, order, axis=0)
        if best is not None:
            place, question = np.nonzero(~np.isnan(best))
            yield pd.DataFrame({"question_id": ids[question], "chunk_id": held[place, question], "score": best[place, question]})

    return search


def phrase_scores(phrases: list, weights: list[tuple[str, float]], tags: list | None = None):
    """Scores by phrases that stand anywhere in a column of text.

    phrases: for each question pairs (phrase, factor), repeats counted. weights: text columns and what a phrase in each is
    worth, times its factor. tags: for each question tags, 0.5 for each that is among the row's `chunk_tags`. All phrases
    form one automaton, so a text is read once for all questions. Scores of 0 are no hits.
    """
    held: dict[str, list] = {}
    for i, pairs in enumerate(phrases):
        for phrase, factor in pairs:
            held.setdefault(phrase, []).append((i, factor))
    posts = {p: (np.array([i for i, _ in found]), np.array([f for _, f in found], dtype=float)) for p, found in held.items()}
    own = [set(t) if t is not None else set() for t in tags] if tags is not None else None
    kinds = {t: np.array([t in o for o in own], dtype=float) * 0.5 for t in set().union(*own)} if own else {}
    n, machine = len(phrases), []

    def matcher():
        if not machine:
            words = ahocorasick.Automaton()
            for phrase in posts:
                if phrase:
                    words.add_word(phrase, phrase)
            if len(words):
                words.make_automaton()
            machine.append(words)
        return machine[0]

    def scores(rows: pd.DataFrame) -> np.ndarray:
        words, out = matcher(), np.zeros((len(rows), n))
        always = {""} & posts.keys()
        for column, weight in weights:
            for i, hay in enumerate(rows[column]):
                for phrase in always | ({p for _, p in words.iter(hay)} if len(words) else set()):
                    to, factor = posts[phrase]
                    np.add.at(out[i], to, factor * weight)
        if kinds:
            for i, found in enumerate(rows["chunk_tags"]):
                for tag in set(found if found is not None else ()) & kinds.keys():
                    out[i] += kinds[tag]
        return np.where(out > 0, out, np.nan)

    return scores


def searchable(chunks: DataFrame) -> DataFrame:
    """Chunks that may be found: all without a column `searchable`, else those in which it is true."""
    return chunks.filter(F.col("searchable")) if "searchable" in chunks.columns else chunks


def lexical_search(questions: DataFrame, chunks: DataFrame, k: int = BRANCH, batch: int = QUESTIONS, cut: Cut = in_pairs) -> DataFrame:
    """question_id, chunk_id, score, rank: per term 8 in the title, 9 in the section, 3 in the content; ties by id.

    questions: question_id, question. chunks: chunk_id, title, section, content. Terms match anywhere, in any case. A null
    question has no hits, a null column holds no term. cut parts words of ideographs (see `lexical_terms`).
    """
    asked = questions.select("question_id", F.coalesce(lexical_terms(F.col("question"), cut), F.array()).alias("terms"))
    rows = searchable(chunks).select("chunk_id", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "section", "content")])
    scorer = lambda held: phrase_scores([[(t, 1.0) for t in terms] for terms in held["terms"]], [("title", 8), ("section", 9), ("content", 3)])
    return best_of_all(asked, rows, scorer, k, batch, "int")


def checked_questions(questions: DataFrame) -> DataFrame:
    """question_id and _q, the vector as doubles; one that is null, empty, zero or not finite is an error."""
    asked = questions.select("question_id", F.col("vector").cast("array<double>").alias("_q"))
    good = F.coalesce((F.size("_q") > 0) & ~F.exists("_q", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_q", lambda x: x != 0), F.lit(False))
    return asked.withColumn("_q", F.when(good, F.col("_q")).otherwise(F.raise_error(F.lit("a question vector must be finite and not zero"))))


def vector_search(questions: DataFrame, vectors: DataFrame, k: int = BRANCH, batch: int = QUESTIONS) -> DataFrame:
    """question_id, chunk_id, score, rank by cosine of unit vectors; columns question_id and vector, chunk_id and vector.

    Questions go in batches of at most about `batch`, each as one matrix that every task multiplies its vectors with; a
    task keeps k for each question. A question vector that is null, empty, of zero length or not finite is an error, as
    is one of another width than the vectors. Vectors that are null take no part.
    """
    asked = checked_questions(questions)
    rows = vectors.select("chunk_id", "vector").filter("vector IS NOT NULL")

    def scorer(held: pd.DataFrame):
        matrix = np.stack(held["_q"].to_numpy())
        return lambda batch: np.stack(batch["vector"].to_numpy()).astype(float) @ matrix.T

    return best_of_all(asked, rows, scorer, k, batch)


def fused(semantic: DataFrame, lexical: DataFrame, k: int | None = None) -> DataFrame:
    """Weighted reciprocal ranks: 1 / (60 + semantic rank) + 1.5 / (60 + lexical rank), with a full order."""
    a = semantic.select("question_id", "chunk_id", F.col("rank").alias("semantic_rank"))
    b = lexical.select("question_id", "chunk_id", F.col("rank").alias("lexical_rank"))
    part = lambda c, w: F.coalesce(w / (RRF_K + F.col(c)), F.lit(0.0))
    both = a.join(b, ["question_id", "chunk_id"], "full").withColumn("score", part("semantic_rank", 1.0) + part("lexical_rank", LEXICAL_WEIGHT))
    both = both.withColumns({c: F.coalesce(c, F.lit(ABSENT)) for c in ("semantic_rank", "lexical_rank")})
    order = [F.desc("score"), "semantic_rank", "lexical_rank", "chunk_id"]
    return top_by(both, ["question_id"], [F.col(o) if isinstance(o, str) else o for o in order], k or 1 << 30)


def hybrid_search(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, category: str | None = None, cut: Cut = in_pairs, model: str | None = None) -> DataFrame:
    """Both searches, fused, then filtered by category and cut to k (1 to 50); every hit must have a chunk row.

    With a model, each result that the vector search found must agree with its chunk in document_id, content_hash and
    pdf_page, which both tables then hold, and the chunk's model_name must be the model; a difference is an error.
    """
    from .suites import same_in_stores
    from .tables import hydrated

    if not 1 <= k <= 50:
        raise ValueError("k must be from 1 to 50")
    own = chunks if category is None else chunks.filter(F.col("category") == category)
    hits = fused(vector_search(questions, vectors), lexical_search(questions, own, cut=cut)).drop("rank")
    rows = hydrated(hits, chunks.select("chunk_id", "title", "section", "category", "content"), "chunk_id", "content")
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    found = top_by(rows, ["question_id"], [F.desc("score"), F.col("semantic_rank"), F.col("lexical_rank"), F.col("chunk_id")], k)
    if model is None:
        return found
    names = ("document_id", "content_hash", "pdf_page")
    held = found.join(vectors.select("chunk_id", F.lit(True).alias("_held"), *names), "chunk_id", "left")
    checked = same_in_stores(held, chunks, model)
    said = F.concat(F.lit("stores differ for chunk "), F.col("chunk_id").cast("string"), F.lit(" in "), F.array_join("reasons", ", "))
    same = F.col("_held").isNull() | (F.col("semantic_rank") == ABSENT) | (F.size("reasons") == 0)
    return checked.withColumn("rank", F.when(same, F.col("rank")).otherwise(F.raise_error(said))).select(*found.columns)


def fallback_search(questions: DataFrame, chunks: DataFrame, k: int, batch: int = QUESTIONS) -> DataFrame:
    """4 for the whole question in title, section, category, content and tags; 2 a term; 0.5 a shared tag; above 0 only.

    questions: question_id, question, tags. chunks: chunk_id, title, section, category, content, chunk_tags. A null question
    or null tags have no part in a score.
    """
    terms = F.coalesce(fallback_terms(F.col("question")), F.array())
    asked = questions.select("question_id", F.lower("question").alias("whole"), terms.alias("terms"), "tags")
    hay = F.lower(F.concat_ws(" ", "title", "section", "category", "content", F.concat_ws(" ", "chunk_tags")))
    rows = searchable(chunks).select("chunk_id", hay.alias("hay"), "chunk_tags")

    def scorer(held: pd.DataFrame):
        whole = [[(w, 4.0)] if isinstance(w, str) else [] for w in held["whole"]]
        return phrase_scores([w + [(t, 2.0) for t in terms] for w, terms in zip(whole, held["terms"])], [("hay", 1.0)], list(held["tags"]))

    return best_of_all(asked, rows, scorer, k, batch)


def search(questions: DataFrame, chunks: DataFrame, k: int, vectors: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """Both searches where there are vectors, else the fallback; a failure of the first is never hidden by the second."""
    if vectors is not None:
        return hybrid_search(questions, chunks, vectors, k, category)
    return fallback_search(questions, chunks if category is None else chunks.filter(F.col("category") == category), k)


def embedded(df: DataFrame, text: str, encoder, width: int, instruction: str = "") -> DataFrame:
    """Adds embedding: unit vectors of texts by encoder(), made once a task, which gives a matrix for a list of texts.

    instruction stands before each text (questions have one). Another width, a value that isn't finite or a zero vector is an
    error. Null texts are empty.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for batch in batches:
            matrix = np.asarray(model([instruction + (t or "") for t in batch[text]]), dtype="float32").reshape(len(batch), -1)
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            if len(batch) and (matrix.shape[1] != width or not np.isfinite(matrix).all() or not length.all()):
                raise ValueError("vectors must be finite, not zero and of the model's width")
            yield batch.assign(embedding=list(matrix / length))

    return df.mapInPandas(encode, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def hashing_encoder(width: int):
    """A deterministic encoder without a model: words hashed to signed components, and one component that is never zero."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        out[:, 0] = 1.0
        for row, said in zip(out, texts, strict=True):
            for word in said.lower().split():
                h = zlib.crc32(word.encode())
                row[1 + (h >> 1) % (width - 1)] += 1.0 if h & 1 else -1.0
        return out

    return lambda: encode


def reranked(hits: DataFrame, scorer, k: int) -> DataFrame:
    """Hits (question_id, question, chunk_id, content, rank) by the scorer's values for (questions, contents), the best k.

    Without a scorer they keep their order with scores of 0.
    """
    if scorer is None:
        return top_by(hits.withColumn("score", F.lit(0.0)).withColumnRenamed("rank", "_was"), ["question_id"], [F.col("_was")], k).drop("_was")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=np.asarray(scorer(list(batch["question"]), list(batch["content"])), dtype=float))

    rows = hits.drop("rank", "score")
    told = rows.mapInPandas(score, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return top_by(told, ["question_id"], [F.desc("score"), F.col("chunk_id")], k)
