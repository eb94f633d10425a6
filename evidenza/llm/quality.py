"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed word and each word shape, shared by all grades, gives a text its score; ordered thresholds cut
the scores: P(grade >= j) = 1 / (1 + exp(threshold_j - score)). Fitted on a bounded sample of rated documents; every
document is scored on its whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, read, text_or_empty, written

#: Rated documents that the model is fitted on, at most.
SAMPLE = 4000
WORDS, SHAPES = 1 << 17, 1 << 10
#: The slot of words that follow themselves.
AGAIN = 0
#: Texts of the sample that a word stands in at least, to have a weight.
COMMON = 8
#: Standard deviations by which a word's texts must lean to or from some grade, for the word to have a weight. The other
#: words would add noise that grows with the length of a text and hides a single telling word.
TELLING = 6.0
#: Weight of the shapes' shares beside the words.
SHAPE_SCALE = 10.0
STEPS, RATE, DECAY = 150, 0.1, 1e-4
#: Chance of the best grade from which a document is kept.
LEAST = 0.5
REMEMBERED = 300_000
LETTERS = re.compile(r"[^\W\d_]+")


def shape(word: str) -> str:
    """The word with runs of letters and digits as one sign each; other signs stay."""
    low = LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    return re.sub(r"\d+", "0", low)[:12]


def slots(word: str) -> tuple[int, int]:
    return zlib.crc32(word.strip(".,;:!?").lower().encode()) % WORDS, zlib.crc32(shape(word).encode()) % SHAPES


def repeats(words: list[str]) -> int:
    """Words that follow themselves."""
    return sum(map(operator.eq, words, words[1:]))


def features(text: str) -> tuple[list[int], list[float], list[int], list[float]]:
    """Hashed words with the logarithms of their counts, and the shares of word shapes."""
    words, shapes = Counter(), Counter()
    said = text.split()
    for word, n in Counter(said).items():
        w, s = slots(word)
        words[w] += n
        shapes[s] += n
    shapes[AGAIN] += repeats(said)
    total = max(1, len(said))
    return list(words), [1 + float(np.log(n)) for n in words.values()], list(shapes), [SHAPE_SCALE * n / total for n in shapes.values()]


class Model:
    """Weights of words (0 for those that tell nothing) and shapes, and the thresholds of the grades."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray, cuts: np.ndarray):
        self.words, self.shapes, self.cuts = words, shapes, cuts
        self.known: dict[str, tuple[int, float]] = {}

    def score(self, text: str) -> float:
        """The same as the features' product with the weights, with what a word adds remembered."""
        words: dict[int, int] = {}
        shaped = total = 0.0
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        said = text.split()
        for word, n in Counter(said).items():
            at = known.get(word)
            if at is None:
                w, s = slots(word)
                at = known[word] = (w if self.words[w] else -1, float(self.shapes[s]))
            if at[0] >= 0:
                words[at[0]] = words.get(at[0], 0) + n
            shaped += n * at[1]
            total += n
        if not total:
            return 0.0
        shaped += repeats(said) * float(self.shapes[AGAIN])
        told = sum((1 + math.log(n)) * float(self.words[w]) for w, n in words.items())
        return told + SHAPE_SCALE * shaped / total

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))


def telling(words: np.ndarray, grades: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """For each word, whether its texts lean to or from some grade. words, grades: one entry for each word of each text."""
    seen = np.bincount(words, minlength=WORDS)
    leans = np.zeros(WORDS)
    for grade, p in enumerate(shares):
        got = np.bincount(words[grades == grade], minlength=WORDS)
        leans = np.maximum(leans, np.abs(got - seen * p) / np.sqrt(np.maximum(seen * p * (1 - p), 1e-9)))
    return (seen >= COMMON) & (leans >= TELLING)


def fit(rows: list[tuple], grades: np.ndarray, n_grades: int) -> Model:
    """rows: features() of each text. Maximises the likelihood of the grades by Adam, with weight decay."""
    n = max(1, len(rows))
    at_w = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at_s = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    flat = lambda i, kind: np.concatenate([np.asarray(r[i], kind) for r in rows]) if rows else np.zeros(0, kind)
    iw, vw, i_s, vs = flat(0, np.int64), flat(1, float), flat(2, np.int64), flat(3, float)
    vw = vw * telling(iw, grades[at_w], np.bincount(grades, minlength=n_grades) / n)[iw]
    w, s = np.zeros(WORDS), np.zeros(SHAPES)
    share = np.array([np.clip((grades >= j).mean() if len(grades) else 0.5, 0.01, 0.99) for j in range(1, n_grades)])
    start = np.log(1 / share - 1)
    # Thresholds in order: the first, and the logarithms of the steps between them.
    cuts = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, s, cuts)]
    for t in range(1, STEPS + 1 if len(rows) else 1):
        theta = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
        score = np.bincount(at_w, vw * w[iw], len(rows)) + np.bincount(at_s, vs * s[i_s], len(rows))
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -40, 40)))
        upper = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], 1)
        slope = np.concatenate([np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))], 1)
        i = np.arange(len(rows))
        likely = np.maximum(upper[i, grades] - upper[i, grades + 1], 1e-9)
        by_score = (slope[i, grades] - slope[i, grades + 1]) / likely / n
        by_theta = np.zeros((len(rows), n_grades + 1))
        by_theta[i, grades] -= slope[i, grades] / likely / n
        by_theta[i, grades + 1] += slope[i, grades + 1] / likely / n
        g_theta = by_theta[:, 1:n_grades].sum(0)
        g_cuts = np.array([g_theta.sum(), *[g_theta[j:].sum() * np.exp(cuts[j]) for j in range(1, n_grades - 1)]])
        gradients = [np.bincount(iw, vw * by_score[at_w], WORDS) - DECAY * w, np.bincount(i_s, vs * by_score[at_s], SHAPES) - DECAY * s, g_cuts]
        for x, g, m in zip((w, s, cuts), gradients, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += RATE * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
    return Model(w, s, np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))


def train(rated: DataFrame, text: str = "text", key: str = "doc_id", grade: str = "grade", n_grades: int = 3, sample: int = SAMPLE) -> Model:
    """The model of at most `sample` rated texts, chosen by a hash of key and text. Rows without text or grade don't count.

    With no rated rows the model gives every text the same even chances.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(*features(t), g) for t, g in zip(batch["_text"], batch["_grade"], strict=True)], columns=["iw", "vw", "i_s", "vs", "g"])

    rows = rated.filter(F.col(text).isNotNull() & F.col(grade).between(0, n_grades - 1)).select(
        F.xxhash64(F.col(key), F.col(text)).alias("_h"), F.col(text).alias("_text"), F.col(grade).cast("int").alias("_grade")
    )
    part = rows.orderBy("_h").limit(sample).select("_text", "_grade")
    got = part.mapInPandas(extract, "iw array<int>, vw array<double>, i_s array<int>, vs array<double>, g int").toPandas()
    return fit(list(zip(got["iw"], got["vw"], got["i_s"], got["vs"], strict=True)), got["g"].to_numpy(np.int64), n_grades)


def graded(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """At most `sample` labelled documents with their grade: 0 for low quality, 1 for toxic, 2 for good.

    The sample is chosen by a hash of the id among the labels, so texts of others are not moved.
    """
    chosen = (
        labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
        .groupBy(key)
        .agg(F.min("quality").alias("_q"), F.max(F.coalesce("toxic", F.lit(0))).alias("_t"))
        .orderBy(F.xxhash64(key), key)
        .limit(sample)
        .select(F.col(key).alias("_key"), F.when(F.col("_q") < 1, 0).when(F.col("_t") > 0, 1).otherwise(2).alias("grade"))
    )
    return docs.select(key, "text").join(F.broadcast(chosen), F.col(key) == F.col("_key")).drop("_key")


def scored(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with expected_grade, p_ge_1, p_ge_2, ... and keep (the chance of the best grade is at least `least`).

    Null and empty texts score as a text without words and are not kept. Equal texts score alike. Columns of docs with
    the added names are replaced. No rows: none.
    """
    names = [f"p_ge_{j + 1}" for j in range(len(model.cuts))]
    base = docs.drop("expected_grade", "keep", *names)
    rated = fresh("_rated", base.columns)
    return base.withColumn(rated, rating(docs, model, least)(text_or_empty(text))).select(*base.columns, f"{rated}.*")


def kept(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs that `scored` keeps; all columns stay, whatever their names."""
    rated = docs.select(F.struct("*").alias("_row"), rating(docs, model, least)(text_or_empty(text)).alias("_rated"))
    return rated.filter("_rated.keep").select("_row.*")


def rating(docs: DataFrame, model: Model, least: float):
    """A function of a text column to a struct of expected_grade, p_ge_1, p_ge_2, ... and keep."""
    names = [f"p_ge_{j + 1}" for j in range(len(model.cuts))]
    held = model.words, model.shapes, model.cuts
    shared = docs.sparkSession.sparkContext.broadcast(held)  # WORDS and SHAPES fix its size

    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for batch in texts:
            p = model.chances(np.array([model.score(t) for t in batch], float))
            has = np.array([bool(t.strip()) for t in batch], bool)
            out = pd.DataFrame({"expected_grade": p.sum(1), **{n: p[:, j] for j, n in enumerate(names)}})
            yield out.assign(keep=(p[:, -1] >= least) & has)

    return F.pandas_udf(rate, f"expected_grade double, {', '.join(f'{n} double' for n in names)}, keep boolean")


def op3_quality(spark, sf_dir):
    """doc_id, expected_grade, the tail probabilities p_ge_1 and p_ge_2, and keep, of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(written(graded(docs, read(spark, sf_dir, "labels")), "quality-sample"))
    return scored(docs, model).drop("text")
