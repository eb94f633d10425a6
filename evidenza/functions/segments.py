"""Segmentation of ideographs, which no blank parts: overlapping pairs, or words of a dictionary by their best path.

Pairs need no dictionary and are Column expressions. A Lexicon holds words and their counts; a run of ideographs is a
lattice of the words that stand in it, and the path with the largest product of frequencies is taken. Search terms are
the words of that path, each after the shorter dictionary words that it holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "[\\u4e00-\\u9fff]+"
#: A lexicon goes to every task, so it has a bound; more words are an error.
MOST_WORDS = 1_000_000


def ideographs(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def pairs(run: Column) -> Column:
    """Overlapping pairs of a run's characters; a run of one is itself."""
    return F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))


def in_pairs(text: Column) -> Column:
    """Runs of ideographs as pairs, what stands between them as it is, in order of appearance. Null gives null."""
    parts = F.regexp_extract_all(text, F.lit(f"{RUN}|[^\\u4e00-\\u9fff]+"), F.lit(0))
    return F.flatten(F.transform(parts, lambda p: F.when(ideographs(p), pairs(p)).otherwise(F.array(p))))


class Lexicon:
    """Words and their counts; those below one count as one. Counts decide between paths."""

    def __init__(self, counts: dict[str, float]):
        total = math.log(sum(max(n, 1) for n in counts.values()) or 1)
        self.weight = {w: math.log(max(n, 1)) - total for w, n in counts.items() if w}
        self.longest = max(map(len, self.weight), default=1)
        #: Of a character that is no word: less likely than any word.
        self.unknown = min(self.weight.values(), default=0.0) - 1

    @staticmethod
    def of(words: DataFrame, word: str = "word", count: str = "count", most: int = MOST_WORDS) -> Lexicon:
        """The lexicon of a table; null and empty words are left out, counts of repeated words added, null counts are 1."""
        rows = words.filter(F.length(word) > 0).groupBy(word).agg(F.sum(F.coalesce(F.col(count), F.lit(1))).cast("double").alias("n")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a lexicon has at most {most} words")
        return Lexicon({r[0]: r["n"] for r in rows})

    def path(self, run: str) -> list[str]:
        """The words of the most likely path, of equals the one of longer words first; neighbours that are no words go together."""
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            ways = [(self.unknown + best[i + 1][0], 1)]
            ways += [(self.weight[run[i:j]] + best[j][0], j - i) for j in range(i + 1, min(len(run), i + self.longest) + 1) if run[i:j] in self.weight]
            best[i] = max(ways)
        out: list[str] = []
        i, loose = 0, False
        while i < len(run):
            word = run[i : i + best[i][1]]
            known = word in self.weight
            if loose and not known:
                out[-1] += word
            else:
                out.append(word)
            loose, i = not known, i + len(word)
        return out

    def words(self, text: str) -> list[str]:
        """The path of each run of ideographs; what stands between runs is one word."""
        return [w for part in re.findall("[一-鿿]+|[^一-鿿]+", text) for w in (self.path(part) if "一" <= part[0] <= "鿿" else [part])]

    def search_terms(self, text: str) -> list[str]:
        """Each word after the dictionary words of two, then of three characters that a longer word holds."""
        out = []
        for word in self.words(text):
            if "一" <= word[0] <= "鿿":
                out += [word[i : i + n] for n in (2, 3) if n < len(word) for i in range(len(word) - n + 1) if word[i : i + n] in self.weight]
            out.append(word)
        return out

    def cutter(self, spark: SparkSession, search: bool = True) -> Callable[[Column], Column]:
        """A function of a text column to its search terms, or to its words, as an array; null gives null."""
        shared = spark.sparkContext.broadcast(self)  # at most MOST_WORDS words

        def cut(texts: pd.Series) -> pd.Series:
            of = shared.value.search_terms if search else shared.value.words
            return texts.map(lambda t: of(t) if isinstance(t, str) else None)

        return F.pandas_udf(cut, "array<string>")

    def list_cutter(self, spark: SparkSession) -> Callable[[Column], Column]:
        """A function of a column of lists of texts to the words of each, as an array of arrays; nulls have no words."""
        shared = spark.sparkContext.broadcast(self)

        def cut(lists: pd.Series) -> pd.Series:
            return lists.map(lambda texts: [shared.value.words(t) if isinstance(t, str) else [] for t in ([] if texts is None else texts)])

        return F.pandas_udf(cut, "array<array<string>>")
