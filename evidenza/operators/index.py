"""An approximate vector index: vectors in cells around centroids, searched by reading the nearest cells only.

Centroids are fitted on a bounded sample; every row is indexed, in a table partitioned by cell, beside a catalog that
says what the index holds. A search ranks the centroids for each question, reads the files of the cells that any question
of the batch needs, and multiplies each cell's rows with the questions that asked for it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import BRANCH, QUESTIONS, best_of_all, checked_questions

#: Vectors that the centroids are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
#: A cell's rows are written by as many tasks as hold about this many rows each.
ROWS_A_FILE = 1_000_000
METRIC = "cosine"
#: A build measures on this many vectors, searched exactly, how many cells a search must probe for this recall.
MEASURED, RECALL = 128, 0.95


@dataclass
class Index:
    """A catalog entry and where the rows are: cell, chunk_id, vector (of unit length) and the fields asked for."""

    spark: SparkSession
    rows: DataFrame
    centroids: np.ndarray
    fields: dict[str, str]
    probes: int

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-300)


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors, by rounds of nearest centroid and mean; empty cells keep theirs."""
    at = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        near = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        used = np.bincount(near, minlength=len(at)) > 0
        at = np.where(used[:, None], unit(sums), at)
    return at


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, fields: tuple[str, ...] = (), recall: float = RECALL) -> Index:
    """Writes an index of all rows of vectors (chunk_id, vector and `fields`) under path and names it as the one to open.

    Vectors are scaled to unit length. Rows with a null vector are left out; null or non-finite components, zero vectors
    and vectors of several widths are an error. cells: about the square root of the number of rows, if not given. At
    most `sample` rows, by a hash of chunk_id, decide the centroids; every row goes to its nearest one. An index of no
    rows is an error. Readers see the new index once it is written whole, with the number of cells that a search probes to
    find a share of `recall` of the 50 nearest, as measured on MEASURED of its vectors against all others.
    """
    spark = vectors.sparkSession
    x = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), *fields).filter("vector IS NOT NULL")
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("vector", lambda c: c != 0)
    said = x.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad")).first()
    if not said.n or said.low != said.high or said.bad:
        raise ValueError(f"no index: {said.n} vectors of {said.low} to {said.high} components, {said.bad} of them not finite or zero")
    part = x.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toPandas()["vector"]
    centroids = fitted(unit(np.stack(part.to_numpy())), cells or max(1, round(said.n**0.5)))
    shared = spark.sparkContext.broadcast(centroids)  # at most `sample` centroids

    def nearest(column: pd.Series) -> pd.DataFrame:
        at = unit(np.stack(column.to_numpy()))
        return pd.DataFrame({"cell": (at @ shared.value.T).argmax(1).astype(np.int32), "vector": list(at)})

    placed = x.withColumn("_at", F.pandas_udf(nearest, "cell int, vector array<double>")(F.col("vector")))
    placed = placed.select("chunk_id", "_at.vector", *fields, "_at.cell")
    # A cell's rows come together; of a very full cell, in several files.
    files = max(1, -(-said.n // ROWS_A_FILE))
    version = uuid.uuid4().hex
    placed.repartition(F.col("cell"), F.pmod(F.xxhash64("chunk_id"), F.lit(files))).write.partitionBy("cell").parquet(f"{path}/rows/{version}")
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows/{version}")
    entry = (version, METRIC, len(centroids[0]), json.dumps(kinds), json.dumps(centroids.tolist()), probes_for(rows, centroids, recall))
    schema = "version string, metric string, width int, fields string, centroids string, probes int"
    spark.createDataFrame([entry], schema).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/catalog")
    return opened(spark, path, len(centroids[0]))


def probes_for(rows: DataFrame, centroids: np.ndarray, recall: float, k: int = BRANCH, measured: int = MEASURED) -> int:
    """How many of the nearest cells hold a share of `recall` of the k nearest others of `measured` vectors, chosen by a hash of chunk_id."""
    chosen = rows.orderBy(F.xxhash64(F.lit("measured"), "chunk_id"), "chunk_id").limit(measured).select("chunk_id", "vector")
    held = chosen.toPandas()
    asked = rows.sparkSession.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(held["vector"])], "question_id int, vector array<double>")
    found = best_of_all(checked_questions(asked), rows.select("chunk_id", "vector"), lambda part: lambda batch: np.stack(batch["vector"].to_numpy()) @ np.stack(part["_q"].to_numpy()).T, k + 1, QUESTIONS)
    # At most measured * (k + 1) cells.
    cells = found.join(rows.select("chunk_id", "cell"), "chunk_id").filter(F.col("rank") > 1).select("question_id", "cell").toPandas()
    if not len(cells):
        return 1
    order = np.argsort(-(np.stack(held["vector"].to_numpy()) @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[cells["question_id"].to_numpy(), cells["cell"].to_numpy()]
    return int(np.quantile(place, recall, method="higher")) + 1


def opened(spark: SparkSession, path: str, width: int, fields: tuple[str, ...] = ()) -> Index:
    """The index named last under path, checked against what a search needs; whatever differs is an error that says so."""
    entry = spark.read.parquet(f"{path}/catalog").orderBy(F.desc("at"), F.desc("version")).first()
    kinds = json.loads(entry.fields)
    wrong = [f"field {f} is missing" for f in ("chunk_id", "vector", "cell", *fields) if f not in kinds]
    if entry.metric != METRIC:
        wrong.append(f"metric is {entry.metric}, not {METRIC}")
    if entry.width != width:
        wrong.append(f"vectors have {entry.width} components, not {width}")
    if kinds.get("vector") not in (None, "array<double>"):
        wrong.append(f"vector is {kinds['vector']}")
    if wrong:
        raise ValueError(f"index at {path} does not fit: {'; '.join(wrong)}")
    rows = spark.read.schema(", ".join(f"`{c}` {k}" for c, k in kinds.items())).parquet(f"{path}/rows/{entry.version}")
    return Index(spark, rows, np.array(json.loads(entry.centroids)), kinds, entry.probes)


def search(index: Index, questions: DataFrame, k: int = BRANCH, probes: int | None = None, where=None, batch: int = QUESTIONS) -> DataFrame:
    """question_id, chunk_id, score (cosine), rank: the k best rows of the `probes` cells nearest to each question; the index's own number, if not given.

    questions: question_id and vector, checked as in the exact search. where: a condition on the index's fields that is
    pushed to the files. With as many probes as cells the result is that of the exact search.
    """
    centroids = index.centroids
    probes = min(index.probes if probes is None else probes, len(centroids))
    rows = index.rows if where is None else index.rows.filter(where)
    asked = checked_questions(questions)

    def probed(matrix: np.ndarray) -> np.ndarray:
        return np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probes]

    def needed(held: pd.DataFrame):
        return F.col("cell").isin(np.unique(probed(questions_of(held))).tolist())

    def questions_of(held: pd.DataFrame) -> np.ndarray:
        found = unit(np.stack(held["_q"].to_numpy()))
        if found.shape[1] != index.width:
            raise ValueError(f"questions have {found.shape[1]} components, the index {index.width}")
        return found

    def scorer(held: pd.DataFrame):
        matrix = questions_of(held)
        asks = np.zeros((len(centroids), len(matrix)), bool)
        asks[probed(matrix), np.arange(len(matrix))[:, None]] = True

        def scores(batch: pd.DataFrame) -> np.ndarray:
            out = np.full((len(batch), len(matrix)), np.nan)
            vectors, cells = np.stack(batch["vector"].to_numpy()), batch["cell"].to_numpy()
            for cell in np.unique(cells):
                mine, who = np.flatnonzero(cells == cell), np.flatnonzero(asks[cell])
                out[np.ix_(mine, who)] = vectors[mine] @ matrix[who].T
            return out

        return scores

    return best_of_all(asked, rows.select("chunk_id", "vector", "cell"), scorer, k, batch, needed=needed)
