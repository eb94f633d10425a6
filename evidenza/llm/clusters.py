"""Centroid clustering by kd-tree filtering.

Each partition's vectors are written once as kd-trees of bounded size: vectors in the order of the tree, and for each
node its box, count and integer sum. A round sends the centroids down every tree. At a node the centroid nearest to the
box's middle is set against the others: one that is further off even at the corner of the box that suits it best is
strictly dominated and pruned. A node with one centroid left is assigned as a whole, by its count and sum; a leaf with
several is resolved vector by vector. All numbers are integers, so clusters equal those of plain rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import integers, matrix
from .common import Steps, read

CENTROIDS, ROUNDS, FACTOR, WIDTH = 16, 3, 64, 64
#: Vectors of one tree, and of a leaf at most.
TREE, LEAF = 4096, 32
#: Boxes and vectors compared with all centroids at a time.
AT_ONCE = 256
FAR = np.iinfo(np.int64).max


class Tree:
    """points in the order of the tree; for each node: lo and hi (its box), sums, first and last (its points), left (its children, 0: a leaf)."""

    FIELDS = ("points", "lo", "hi", "sums", "first", "last", "left")

    def __init__(self, *fields: np.ndarray):
        self.points, self.lo, self.hi, self.sums, self.first, self.last, self.left = fields

    @staticmethod
    def built(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree of points, and the number of each of its points in the order given. Boxes are cut in half at the median of their widest side."""
        order = np.arange(len(points))
        nodes, left = [(0, len(points))], [0]
        lo, hi, sums = [], [], []
        for at, (a, b) in enumerate(nodes):  # grows meanwhile
            part = points[order[a:b]]
            lo.append(part.min(0))
            hi.append(part.max(0))
            sums.append(part.sum(0))
            if b - a > leaf and (lo[-1] < hi[-1]).any():
                middle = (b - a) // 2
                side = part[:, (hi[-1] - lo[-1]).argmax()]
                order[a:b] = order[a:b][np.argpartition(side, middle)]
                left[at] = len(nodes)
                nodes += [(a, a + middle), (a + middle, b)]
                left += [0, 0]
        first, last = np.array(nodes, np.int64).T
        return Tree(points[order], np.array(lo), np.array(hi), np.array(sums), first, last, np.array(left, np.int64)), order

    def assigned(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """(node, centroid) of nodes assigned as a whole; numbers and centroids of the points resolved one by one."""
        whole: list[tuple[int, int]] = []
        points, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stack = [(np.zeros(1, np.int64), np.ones((1, len(centroids)), bool))]
        while stack:
            nodes, may = stack.pop()
            if len(nodes) > AT_ONCE:
                stack.append((nodes[AT_ONCE:], may[AT_ONCE:]))
                nodes, may = nodes[:AT_ONCE], may[:AT_ONCE]
            may = may & ~self.dominated(nodes, may, centroids)
            alone = may.sum(1) == 1
            whole += zip(nodes[alone].tolist(), may[alone].argmax(1).tolist(), strict=True)
            nodes, may = nodes[~alone], may[~alone]
            leaf = self.left[nodes] == 0
            if leaf.any():
                at, who = self.resolved(nodes[leaf], may[leaf], centroids)
                points.append(at)
                found.append(who)
            down = self.left[nodes[~leaf]]
            if len(down):
                stack.append((np.concatenate([down, down + 1]), np.concatenate([may[~leaf], may[~leaf]])))
        return whole, np.concatenate(points), np.concatenate(found)

    def dominated(self, nodes: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Which centroids are further from all of a node's box than the one nearest to its middle."""
        lo, hi = self.lo[nodes], self.hi[nodes]
        middle = (lo + hi)[:, None, :] - 2 * centroids[None, :, :]
        off = np.where(may, (middle * middle).sum(2), FAR)
        lead = centroids[off.argmin(1)][:, None, :]
        # The corner of the box that lies furthest from the lead towards the other centroid.
        corner = np.where(centroids[None, :, :] > lead, hi[:, None, :], lo[:, None, :])
        return ((corner - centroids[None, :, :]) ** 2).sum(2) > ((corner - lead) ** 2).sum(2)

    def resolved(self, nodes: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of nodes, and the nearest centroid of each among those that it may have, ties to the smaller number."""
        size = self.last[nodes] - self.first[nodes]
        at = np.repeat(self.first[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        open_, x = np.repeat(may, size, 0), self.points[at]
        off = np.full(open_.shape, FAR)
        for c in range(len(centroids)):
            mine = np.flatnonzero(open_[:, c])
            off[mine, c] = ((x[mine] - centroids[c]) ** 2).sum(1)
        return at, off.argmin(1)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Integer sum and count of the points of each centroid."""
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        whole, at, found = self.assigned(centroids)
        if whole:
            nodes, who = np.array(whole).T
            np.add.at(sums, who, self.sums[nodes])
            np.add.at(counts, who, self.last[nodes] - self.first[nodes])
        np.add.at(sums, found, self.points[at])
        np.add.at(counts, found, 1)
        return sums, counts

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of every point."""
        out = np.zeros(len(self.points), np.int64)
        whole, at, found = self.assigned(centroids)
        for node, who in whole:
            out[self.first[node] : self.last[node]] = who
        out[at] = found
        return out, ((self.points - centroids[out]) ** 2).sum(1)


def trees_of(rows: DataFrame, width: int, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """Kd-trees of the vectors (_v, all of `width` components) of each partition: _keys in the order of the points, and a column for each field."""
    kind = rows.schema["_k"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def grown() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            built, order = Tree.built(matrix(part.column(1).chunk(0), width), leaf)
            keys = part.column(0).chunk(0).take(pa.array(order))
            columns = [pa.array([np.ascontiguousarray(getattr(built, f)).tobytes()], pa.binary()) for f in Tree.FIELDS]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *columns], ["_keys", *Tree.FIELDS])

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                held.append(whole.slice(at, tree - n))
                at += held[-1].num_rows
                n += held[-1].num_rows
                if n == tree:
                    yield grown()
                    held, n = [], 0
        if n:
            yield grown()

    return rows.select("_k", "_v").mapInArrow(build, f"_keys array<{kind}>, {', '.join(f'{f} binary' for f in Tree.FIELDS)}")


def held_in(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, Tree]]:
    """The keys and trees of a batch of rows of `trees_of`."""
    for i in range(batch.num_rows):
        fields = [np.frombuffer(batch.column(f)[i].as_buffer(), np.int64) for f in Tree.FIELDS]
        yield batch.column("_keys")[i].values, Tree(*[f.reshape(-1, width) for f in fields[:4]], *fields[4:])


def round_of(trees: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the vectors nearest to each centroid: one row a task, centroid and component, added up by Spark."""
    shape = centroids.shape
    shared = trees.sparkSession.sparkContext.broadcast(centroids)  # CENTROIDS and the width fix its size

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
        for batch in batches:
            for _, tree in held_in(batch, shape[1]):
                more, n = tree.totals(shared.value)
                sums += more
                counts += n
        used = np.flatnonzero(counts)
        both = np.concatenate([counts[used, None], sums[used]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, shape[1] + 1)), pa.array(np.tile(np.arange(shape[1] + 1), len(used))), pa.array(both.reshape(-1))], ["c", "d", "x"])

    found = trees.mapInArrow(totals, "c long, d long, x long").groupBy("c", "d").agg(F.sum("x").alias("x"))
    both = np.zeros((shape[0], shape[1] + 1), np.int64)
    for r in found.collect():  # at most centroids * (width + 1) numbers
        both[r["c"], r["d"]] = r["x"]
    shared.destroy()
    return both[:, 1:], both[:, 0]


def started(rows: DataFrame, centroids: int, seed: int, width: int) -> np.ndarray:
    """The vectors whose `seed:key` have the smallest SHA-256, null keys last, equal ones by vector."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_k").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "_v").limit(centroids).select("_v").collect()
    return np.array([r[0] for r in first], np.int64).reshape(len(first), width)


def clustered(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, factor: int = FACTOR, width: int = WIDTH, seed: int = 1, tree: int = TREE, leaf: int = LEAF
) -> tuple[DataFrame, np.ndarray]:
    """key, cluster (int) and distance (squared) of every vector of exactly `width` finite components, and the final centroids.

    Components are floors of factor * x. A round assigns every vector to its nearest centroid, ties to the smaller
    number, and moves each centroid to the floor of its vectors' mean; empty ones stay. Fewer vectors than centroids give
    fewer centroids, none no rows. Keys of any type come back as they are; rows that repeat a key or vector are rows of
    their own. Other columns play no part. Exact while squared distances (of doubled components) stay below 2^63.
    """
    spark = vectors.sparkSession
    steps = Steps(spark, "clusters")
    rows = integers(vectors.select(F.col(key).alias("_k"), F.col(vector).alias("_x")).filter(F.size("_x") == width), "_x", factor, "_v").select("_k", "_v")
    kind = rows.schema["_k"].dataType.simpleString()
    at = started(rows, centroids, seed, width)
    schema = f"`{key}` {kind}, cluster int, distance long"
    if not len(at) or not width:
        return spark.createDataFrame([], schema), at
    trees = steps.written(trees_of(rows, width, tree, leaf), "trees", "zstd")
    for _ in range(rounds):
        sums, counts = round_of(trees, at)
        at = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], at)
    shared = spark.sparkContext.broadcast(at)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, tree_ in held_in(batch, width):
                cluster, distance = tree_.labels(shared.value)
                yield pa.RecordBatch.from_arrays([keys, pa.array(cluster.astype(np.int32)), pa.array(distance)], [key, "cluster", "distance"])

    return steps.result(trees.mapInArrow(label, schema)), at


def op13_clusters(spark, sf_dir):
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    rows, centroids = clustered(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    by = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row a centroid
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)
    return rows.withColumns(
        {
            "cluster_inertia": of([by.get(c, 0) for c in range(len(centroids))], "long"),
            "inertia": F.lit(sum(by.values())).cast("long"),
            "centroid_sha256": of([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], "string"),
        }
    )


def _sql() -> str:
    away = "CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS (
  SELECT v.row, arg_min(c.c, ({away}, c.c)) AS c, min({away}) AS away FROM v CROSS JOIN c{r} c GROUP BY v.row
)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (
  SELECT a.c, u.d, sum(v.e[u.d]) AS s, count(*) AS n FROM a{r} a JOIN v ON a.row = v.row, LATERAL (SELECT unnest(range(1, {WIDTH + 1})) AS d) u GROUP BY a.c, u.d
), m{r} AS (
  SELECT c, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) ORDER BY d) AS e FROM s{r} GROUP BY c
), c{r + 1} AS (
  SELECT c.c, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON c.c = m.c
)""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS c, e FROM v QUALIFY c < {CENTROIDS}
), {", ".join(steps)}
SELECT
  v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.away AS distance, CAST(sum(a.away) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.away) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON a.row = v.row JOIN c{ROUNDS} c ON a.c = c.c
"""


OP13_SQL = _sql()
