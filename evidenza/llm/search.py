"""Exact top-k inner products: blocks by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are cut into blocks by length. A first pass over the longest block gives each query a score that its k-th best
reaches at least. A block meets a block of queries only if the longest vector in it could beat that score for one of
them; inside, the first rotated components give a partial sum, and the lengths of the rest bound what is missing, so
the exact product is taken only where the bound leaves a chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, read

K = 5
#: Rows of a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Bands of length at most; a band of more than BLOCK vectors is dealt to several blocks.
BANDS = 256
#: Stands for a null id while tasks sort: it comes after all ids.
NO_ID = (1 << 63) - 1
#: Vectors that the rotation is fitted on.
SAMPLE = 2000
#: Share of the components that the partial sums take first.
LEAD = 0.25


def scaled(vectors: DataFrame, key: str, vector: str, factor: float) -> DataFrame:
    """_id, _v (floor of factor * x, as double) and _n (length); rows with null or non-finite parts are left out."""
    x = vectors.select(F.coalesce(F.col(key), F.lit(NO_ID)).alias("_id"), F.col(vector).cast("array<double>").alias("_x")).filter(
        F.col("_x").isNotNull() & ~F.exists("_x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    )
    v = x.select("_id", F.transform("_x", lambda c: F.floor(c * factor).cast("double")).alias("_v"))
    return v.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, c: a + c * c)))


def rotation(rows: DataFrame, sample: int = SAMPLE) -> list[list[float]]:
    """Right singular vectors of at most `sample` vectors of one width: the directions that hold most of their lengths first."""
    part = [r["_v"] for r in rows.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_v").collect()]
    return np.linalg.svd(np.array(part), full_matrices=True)[2].tolist() if part else []


def best(queries: np.ndarray, rows: np.ndarray, floor: np.ndarray, found: np.ndarray, found_rows: np.ndarray, found_ids: np.ndarray, turn: np.ndarray, k: int):
    """Index of query and candidate, and score, of what may be among each query's k best."""
    lead = max(1, int(queries.shape[1] * LEAD))
    q, c = queries @ turn, found @ turn
    rest = lambda x: np.sqrt((x[:, lead:] ** 2).sum(1))
    bound = q[:, :lead] @ c[:, :lead].T + np.outer(rest(q), rest(c))
    # Rotated products are rounded: a hair more than the bound keeps equal scores in.
    slack = 1e-9 * np.outer(np.sqrt((q**2).sum(1)), np.sqrt((c**2).sum(1))) + 1e-6
    at, of = np.nonzero((bound + slack >= floor[:, None]) & (rows[:, None] != found_rows[None, :]))
    if not len(at):
        return at, of, at.astype(float)
    score = np.concatenate([np.einsum("ij,ij->i", queries[at[i : i + 65536]], found[of[i : i + 65536]]) for i in range(0, len(at), 65536)])
    order = np.lexsort((found_rows[of], found_ids[of], -score, at))
    at, of, score = at[order], of[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep = (place < k) & (score >= floor[at])
    return at[keep], of[keep], score[keep]


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, factor: float = 256.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k best of all other rows of each query, ties to the smaller id.

    Takes part: rows with a vector of finite numbers. A row without an id is a candidate, last among ties, and no query;
    an empty vector scores 0. Ids below 2^63 - 1. Vectors of different widths multiply over the components that both have, as zeros would fill the shorter one. Rows that repeat
    an id are rows of their own: each is a query with its own k rows of the result, and a candidate for every other row.
    Fewer than k others: all of them. Exact while products stay below 2^53.
    """
    spark = vectors.sparkSession
    steps = Steps(spark, "topk")
    rows = scaled(vectors, key, vector, factor)
    out = "query_id long, rank int, vec_id long, score long"
    width = rows.agg(F.max(F.size("_v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], out)
    width = max(width, 1)
    filled = F.concat("_v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("_v")))
    rows = steps.written(rows.withColumns({"_v": filled, "_row": F.monotonically_increasing_id()}), "rows")
    turn = np.array(rotation(rows))
    total = rows.count()
    bands = min(BANDS, -(-total // block))
    # Any edges give the same result: they only decide which blocks a bound can skip.
    edges = sorted(set(rows.approxQuantile("_n", [i / bands for i in range(1, bands)], 0.001))) if bands > 1 else []
    number = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: F.col("_n") <= e)) if edges else F.lit(0)
    banded = rows.withColumn("_band", number)
    parts = banded.groupBy("_band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts"))
    dealt = banded.join(F.broadcast(parts), "_band").withColumn("_block", F.col("_band") * F.lit(1 << 32) + F.pmod(F.xxhash64("_row"), F.col("_parts")))
    cut = steps.written(dealt.drop("_band", "_parts"), "blocks")
    steps.drop(rows)
    queries = cut.filter((F.col("_id") != NO_ID) & is_query(F.col("_id")))
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // query_block))
    queries = steps.written(queries.withColumn("_qb", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")).select("_row", "_id", "_v", "_n", "_qb"), "queries")
    longest = cut.groupBy("_block").agg(F.max("_n").alias("_longest"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"_row": [], "query_id": [], "vec_id": [], "_other": [], "score": []})
        if left.empty or right.empty:
            return empty
        rot = turn.T
        q, c = np.stack(left["_v"].to_numpy()), np.stack(right["_cv"].to_numpy())
        rows, ids = left["_row"].to_numpy(), left["_id"].to_numpy()
        found_rows, found_ids = right["_crow"].to_numpy(), right["_cid"].to_numpy()
        pieces, floor = [], left["_floor"].to_numpy(dtype=float).copy()
        order = np.argsort(-right["_cn"].to_numpy(), kind="stable")
        for i in range(0, len(order), 1024):
            part = order[i : i + 1024]
            at, who, score = best(q, rows, floor, c[part], found_rows[part], found_ids[part], rot, k)
            found = part[who]
            pieces.append(pd.DataFrame({"at": at, "_row": rows[at], "query_id": ids[at], "vec_id": found_ids[found], "_other": found_rows[found], "score": score}))
            so_far = pd.concat(pieces)
            so_far = so_far.sort_values(["at", "score", "vec_id", "_other"], ascending=[True, False, True, True]).groupby("at").head(k)
            pieces = [so_far]
            full = so_far.groupby("at")["score"].agg(["size", "min"])
            full = full[full["size"] >= k]
            floor[full.index] = np.maximum(floor[full.index], full["min"])
        return pieces[0][list(empty)]

    def scores(asked: DataFrame, blocks_asked: DataFrame) -> DataFrame:
        """Queries (with _floor and _block: the blocks each block of queries meets) against those blocks, pair by pair."""
        pairs = steps.written(blocks_asked.withColumn("_pair", F.concat_ws("/", "_qb", "_block")), "pairs")
        again = pairs.select(F.col("_pair").alias("_p"), F.col("_block").alias("_b"))
        left = asked.join(pairs, "_qb").select("_pair", "_row", "_id", "_v", "_n", "_floor")
        right = cut.join(again, F.col("_block") == F.col("_b")).select(F.col("_p").alias("_pair"), F.col("_row").alias("_crow"), F.col("_id").alias("_cid"), F.col("_v").alias("_cv"), F.col("_n").alias("_cn"))
        right = right.withColumnRenamed("_pair", "_with")
        return left.groupBy("_pair").cogroup(right.groupBy("_with")).applyInPandas(meet, "_row long, query_id long, vec_id long, _other long, score double")

    def cut_to_k(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id", "_other")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    q_blocks = queries.select("_qb").distinct()
    top = longest.orderBy(F.desc("_longest"), "_block").limit(1)
    first = steps.written(scores(queries.withColumn("_floor", F.lit(float("-inf"))), q_blocks.join(F.broadcast(top.select("_block")))), "first")
    floors = cut_to_k(first).groupBy("_row").agg(F.min("score").alias("_min"), F.count("*").alias("_c"))
    floors = floors.select("_row", F.when(F.col("_c") >= k, F.col("_min")).alias("_min"))
    asked = steps.written(queries.join(floors, "_row", "left").withColumn("_floor", F.coalesce("_min", F.lit(float("-inf")))).drop("_min"), "asked")
    needs = asked.groupBy("_qb").agg(F.min(F.when(F.col("_n") > 0, F.col("_floor") / F.col("_n")).otherwise(F.lit(float("-inf")))).alias("_need"))
    # A block is met unless the longest vector in it falls short for every query of the block (with room for rounding).
    others = needs.join(F.broadcast(longest.join(F.broadcast(top.select("_block")), "_block", "left_anti"))).filter(F.col("_longest") * (1 + 1e-9) + 1e-6 >= F.col("_need"))
    rest = scores(asked, others.select("_qb", "_block"))
    found = cut_to_k(first.unionByName(rest))
    return steps.result(found.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), F.col("score").cast("long").alias("score")))


def op9_topk(spark, sf_dir):
    """query_id, rank, vec_id and score: the five best for every vec_id divisible by 50, among all vectors."""
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
