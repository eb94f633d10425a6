"""Text rank: how closely a chunk holds all terms of a question together, then how alike their trigrams are.

Postings name every place of every term. A cover is a shortest run of words that holds all of a question's terms; it
gives a tenth, divided by one more than its words that are none of them. Covers follow from one sweep over the places: at each one the
run reaches back to the least of the terms' last places, and it is a shortest one if that start is new. Without written postings a
task does both in one pass over its texts, and only the first chunks of each question leave it.
"""

from __future__ import annotations

import sys
from collections import OrderedDict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .retrieval import BRANCH, QUESTIONS, in_batches, in_parts
from .tables import top_by

WORD = "[\\p{L}\\p{N}]+"
#: What a cover of the terms alone gives.
COVER = 0.1


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of each word, two blanks before it and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams to all trigrams of both; without any, 0."""
    same = F.size(F.array_intersect(a, b))
    return F.coalesce(same / F.nullif(F.size(a) + F.size(b) - same, F.lit(0)), F.lit(0.0))


def postings(chunks: DataFrame, text: str = "search_text") -> DataFrame:
    """chunk_id, term, places: the places of each word of each chunk, in order, counted from 1."""
    placed = chunks.select("chunk_id", F.posexplode(words(F.col(text))).alias("place", "term"))
    return placed.groupBy("chunk_id", "term").agg(F.array_sort(F.collect_list(F.col("place") + 1)).alias("places"))


def cover_density(places: Column, n: Column) -> Column:
    """The rank of places, an array of place and number (from 0) of a term in order of place, for n terms."""
    start = F.struct(F.array_repeat(F.lit(0), n).alias("last"), F.lit(0).alias("from"), F.lit(0.0).alias("rank"))

    def step(held: Column, x: Column) -> Column:
        last = F.transform(held["last"], lambda p, i: F.when(i == x["term"], x["place"]).otherwise(p))
        first = F.array_min(last)
        new = (first > 0) & (first > held["from"])
        gain = F.when(new, COVER / (1 + (x["place"] - first + 1 - n))).otherwise(0.0)
        return F.struct(last.alias("last"), F.when(new, first).otherwise(held["from"]).alias("from"), (held["rank"] + gain).alias("rank"))

    return F.aggregate(places, start, step, lambda held: held["rank"])


def ranked(questions: DataFrame, held: DataFrame) -> DataFrame:
    """question_id, chunk_id, rank_score of the chunks that hold all terms of a question (question_id, terms), by postings.

    Terms meet postings in a join on the term; what goes on are the places of the question's terms only.
    """
    terms = questions.select("question_id", F.size("terms").alias("n"), F.posexplode("terms").alias("no", "term")).filter("n > 0")
    hits = terms.join(held, "term").groupBy("question_id", "chunk_id", "n").agg(F.count(F.lit(1)).alias("found"), F.collect_list(F.struct("no", "places")).alias("by"))
    each = lambda t: F.transform(t["places"], lambda p: F.struct(p.alias("place"), t["no"].alias("term")))
    places = F.array_sort(F.flatten(F.transform("by", each)))
    return hits.filter("found = n").select("question_id", "chunk_id", F.round(cover_density(places, F.col("n")), 6).alias("rank_score"))


def letters(spark: SparkSession) -> np.ndarray:
    """The code points that words are made of, in order, as Spark's expressions see them."""
    points = spark.range(sys.maxunicode + 1).filter("id NOT BETWEEN 55296 AND 57343")
    said = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    return np.array(points.filter(said.rlike(WORD)).agg(F.array_sort(F.collect_list(F.col("id").cast("int")))).first()[0], np.int32)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def density(said: list[str], terms: set[str]) -> float:
    """`cover_density` of a text's words, of which all terms are some. The term seen longest ago stands first in `last`."""
    last, begun, rank = OrderedDict(), 0, 0.0
    for place, word in enumerate(said, 1):
        if word in terms:
            last[word] = place
            last.move_to_end(word)
            if len(last) == len(terms) and (first := next(iter(last.values()))) > begun:
                begun, rank = first, rank + COVER / (1 + (place - first + 1 - len(terms)))
    return rank


def rounded(x: float) -> float:
    """Six places, halves up, as `round` gives them."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def millionths(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """part / whole in millionths, halves up; without a whole, 0."""
    whole = np.maximum(whole, 1)
    return (2_000_000 * part + whole) // (2 * whole)


#: Bits of a letter's number: Unicode names fewer than 2^18 letters. Three letters and a row make one number.
BITS = 18
#: Rows, characters and scores that a task has in arrays at a time: powers of 2, one row at least, and a row and three letters in 63 bits.
ROWS_HELD, CHARS_HELD, SCORES_HELD = 9, 18, 20


def grams_in(texts: list[str], number: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct trigrams each text has, and of those that are among `known` (codes in order) their rows and places there.

    number: of each character, 0 for those that are no letters.
    """
    at = number[points(f" {' '.join(texts)} ")]
    row = np.repeat(np.arange(len(texts)) << 3 * BITS, [len(t) + 1 for t in texts])[:-1]
    a, b, c = at[:-2], at[1:-1], at[2:]
    # Each letter stands in the middle once; a word's first one also comes after two blanks.
    middle = b > 0
    first = middle & (a == 0)
    each = np.sort(np.concatenate([(a << 2 * BITS | b << BITS | c | row)[middle], (b | row)[first]]))
    each = each[np.diff(each, prepend=-1) > 0]
    row, each = each >> 3 * BITS, each & (1 << 3 * BITS) - 1
    place = np.searchsorted(known, each)
    found = np.append(known, -1)[place] == each
    return np.bincount(row, minlength=len(texts)), row[found], place[found]


def searcher(held: pd.DataFrame, letters: np.ndarray, k: int):
    """A function of a task's rows (chunk_id, said, content; texts in lower case) to the k first of them for each of the held questions."""
    n = len(held)
    size = np.array([len(g) for g in held["grams"]])
    grams, of = np.unique(np.array([g for own in held["grams"] for g in own], dtype="U3"), return_inverse=True)
    # The questions that hold trigram i are who[start[i] : start[i + 1]].
    who, start = np.repeat(np.arange(n), size)[np.argsort(of, kind="stable")], np.append(0, np.cumsum(np.bincount(of, minlength=len(grams))))
    # A text is asked for a question's terms if the longest one stands anywhere in it.
    terms, keys = [set(t) for t in held["terms"]], {}
    for i, own in enumerate(terms):
        if own and not own & {None, ""}:
            keys.setdefault(max(own, key=lambda t: (len(t), t)), []).append(i)

    def shared(row: np.ndarray, gram: np.ndarray, rows: int) -> np.ndarray:
        """How many trigrams each row shares with each question, counted for some of the trigrams at a time."""
        out, step = np.zeros(rows * n, np.int64), max(1, (2 << SCORES_HELD) // n)
        for lo in range(0, len(row), step):
            r, g = row[lo : lo + step], gram[lo : lo + step]
            often = start[g + 1] - start[g]
            ends = np.cumsum(often)
            out += np.bincount(np.repeat(r * n, often) + who[np.arange(ends[-1]) + np.repeat(start[g] - ends + often, often)], minlength=len(out))
        return out.reshape(rows, n)

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Numbers keep the order of characters, and so codes that of trigrams.
        number = np.zeros(sys.maxunicode + 1, np.int64)
        number[letters] = np.arange(1, len(letters) + 1)
        known = (number[grams.view(np.uint32).reshape(-1, 3)] << np.array([2 * BITS, BITS, 0])).sum(axis=1)
        machine = ahocorasick.Automaton()
        for key in keys:
            machine.add_word(key, key)
        if keys:
            machine.make_automaton()

        def covers(texts: list[str]) -> Iterator[tuple[int, int, float]]:
            """Row, question and rank of the texts that hold all terms of a question."""
            for r, text in enumerate(texts):
                if hit := {key for _, key in machine.iter(text)}:
                    said = np.where(number[points(text)] > 0, points(text), ord(" ")).astype("<u4").tobytes().decode("utf-32-le").split()
                    words = set(said)
                    yield from ((r, i, rounded(density(said, terms[i]))) for key in hit for i in keys[key] if terms[i] <= words)

        def scored(rows: pd.DataFrame, least: np.ndarray) -> pd.DataFrame:
            """Pairs that can be among the first: with covers, or as alike as `least` of their question, in millionths."""
            sizes, row, gram = grams_in(list(rows["content"]), number, known)
            rank = np.zeros((len(rows), n))
            for r, i, value in covers(list(rows["said"])) if keys else ():
                rank[r, i] = value
            # Two sets share no more than the smaller one; rows that are so too unlike all questions are not compared.
            may = (millionths(np.minimum.outer(sizes, size), np.maximum.outer(sizes, size)) >= least) | (rank > 0)
            some = may.any(axis=1)
            to = np.cumsum(some) - 1
            both = shared(to[row[some[row]]], gram[some[row]], int(some.sum()))
            near = millionths(both, sizes[some][:, None] + size - both)
            at, question = np.nonzero((near >= least) | (rank[some] > 0))
            return pd.DataFrame({"question": question, "rank_score": rank[some][at, question], "near": near[at, question], "chunk_id": rows["chunk_id"].to_numpy()[some][at]})

        best, least = None, np.full(n, -1)
        for part in parts:
            place, long = np.arange(len(part)), part["content"].str.len().to_numpy()
            cut = np.stack([place >> ROWS_HELD, np.cumsum(long) >> CHARS_HELD, place * n >> SCORES_HELD]).sum(axis=0)
            for _, rows in part.groupby(cut):
                new = scored(rows, least)
                if len(new):
                    best = new if best is None else pd.concat([best, new])
                    best = best.sort_values(["question", "rank_score", "near", "chunk_id"], ascending=[True, False, False, True]).groupby("question").head(k)
                    last = best.groupby("question").nth(k - 1)
                    # Where k have covers, only covers count.
                    least[last["question"]] = np.where(last["rank_score"] > 0, 1_000_001, last["near"])
        if best is not None:
            yield best.assign(question_id=held["question_id"].to_numpy()[best["question"]])[["question_id", "chunk_id", "rank_score", "near"]]

    return search


def closest(asked: DataFrame, chunks: DataFrame, k: int, batch: int) -> DataFrame:
    """question_id, chunk_id, rank_score, similarity: of each task's chunks the k first by covers, similarity and id for each question (question_id, terms, grams).

    A text is read once for all questions of a batch; no word, place or trigram leaves a task.
    """
    rows = chunks.select("chunk_id", *[F.lower(F.coalesce(c, F.lit(""))).alias(to) for c, to in (("search_text", "said"), ("content", "content"))])
    schema = f"question_id {asked.schema['question_id'].dataType.simpleString()}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, rank_score double, near long"
    own, found = letters(rows.sparkSession), None
    for held in in_batches(asked, batch):
        one = rows.mapInArrow(in_parts(searcher(held, own, k), to_arrow_schema(T.StructType.fromDDL(schema))), schema)
        found = one if found is None else found.unionByName(one)
    found = rows.sparkSession.createDataFrame([], schema) if found is None else found
    return found.select("question_id", "chunk_id", "rank_score", (F.col("near") / 1_000_000).alias("similarity"))


def text_rank(questions: DataFrame, chunks: DataFrame, held: DataFrame | None = None, k: int = BRANCH, batch: int = QUESTIONS, status: str | None = None) -> DataFrame:
    """question_id, chunk_id, rank_score, similarity, rank: the k first chunks by cover density, similarity and id.

    questions: question_id, question, and terms if they are cut otherwise than into words. chunks: chunk_id, search_text,
    content, and published_status if `status` says which take part. held: postings of the chunks, if they are written.
    All chunks are ranked: those without all terms have 0 and follow by similarity. A question without words has covers
    of none. Repeated terms count once.
    """
    own = chunks if status is None else chunks.filter(F.col("published_status") == status)
    asked = questions.select("question_id", F.coalesce("question", F.lit("")).alias("question"), *(["terms"] if "terms" in questions.columns else []))
    terms = F.col("terms") if "terms" in questions.columns else words(F.col("question"))
    asked = asked.withColumn("terms", F.array_distinct(F.coalesce(terms, F.array())))
    asked = asked.select("question_id", "terms", trigrams(F.col("question")).alias("grams"))
    order = [F.desc("rank_score"), F.desc("similarity"), F.col("chunk_id")]
    if held is None:
        each = closest(asked, own, 2 * k, batch)
    else:
        hits = ranked(asked, held.join(own.select("chunk_id"), "chunk_id", "left_semi"))
        best = hits.join(asked.select("question_id", "grams"), "question_id").join(own.select("chunk_id", trigrams(F.coalesce("content", F.lit(""))).alias("_c")), "chunk_id")
        best = best.select("question_id", "chunk_id", "rank_score", F.round(similarity(F.col("grams"), F.col("_c")), 6).alias("similarity"))
        best = top_by(best, ["question_id"], order, k).drop("rank")
        # Fewer than k chunks with covers leave k of the others among the 2k most alike ones; a chunk that is in both keeps its covers.
        each = best.unionByName(closest(asked.withColumn("terms", F.array().cast("array<string>")), own, 2 * k, batch))
    each = each.groupBy("question_id", "chunk_id").agg(F.max("rank_score").alias("rank_score"), F.max("similarity").alias("similarity"))
    return top_by(each, ["question_id"], order, k)
