"""Vector code compression: vectors are cut into parts, each part replaced by the number of its codebook's nearest entry.

Vectors are written once as columnar blocks, a row of numbers for each component. A round is one treeAggregate over the
blocks: a task adds up squared distances component by component, and np.add.at counts and sums the parts of each entry
in int64 tensors, whose size only the codebooks decide; they are merged pairwise up a tree. All numbers are integers, so
any order of merging gives the same codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, read

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024
#: Vectors of a block: its distances to one codebook stay within a core's cache.
BLOCK = 512
#: Levels of the reduction tree: tasks merge at most about the cube root of the number of blocks' partitions each.
DEPTH = 3
#: Copies of a label's sum, so that no task joins all rows of a common label.
SALT = 32


def integers(vectors: DataFrame, vector: str, factor: int, out: str) -> DataFrame:
    """vectors with out, the floor of factor * each component; rows with a null vector, null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    fit = vectors.filter(F.col(vector).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return fit.withColumn(out, F.transform(x, lambda c: F.floor(c * float(factor)).cast("long")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows, shorter ones filled with zeros."""
    ends = np.asarray(column.offsets, np.int64)
    flat, size = np.asarray(column.values, np.int64)[ends[0] : ends[-1]], np.diff(ends)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def nearest(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """columns: a row for each component. The entry of each part of each vector, and the squared distance of all parts."""
    parts, entries, width = books.shape
    n = columns.shape[1]
    codes, error = np.zeros((parts, n), np.int64), np.zeros(n, np.int64)
    away, step = np.empty((n, entries), np.int64), np.empty((n, entries), np.int64)
    for p in range(parts):
        away[:] = 0
        for d in range(width):
            np.subtract(columns[p * width + d][:, None], books[p, :, d][None, :], out=step)
            np.multiply(step, step, out=step)
            away += step
        codes[p] = away.argmin(1)  # the first, so the lowest, of equals
        error += away[np.arange(n), codes[p]]
    return codes, error


def blocks_of(rows: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """_x: the columns of at most `block` vectors (_v) each, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x[i : i + block].T).tobytes() for i in range(0, len(x), block)], pa.binary())], ["_x"])

    return rows.select("_v").mapInArrow(pack, "_x binary")


def round_of(blocks: DataFrame, books: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts that each entry is nearest to."""
    parts, entries, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)  # PARTS, ENTRIES and the vectors' width fix its size

    def add(held, row):
        x = np.frombuffer(row[0], np.int64).reshape(parts * width, -1)
        sums, counts = held or (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64))
        codes, _ = nearest(x, shared.value)
        for p in range(parts):
            np.add.at(counts[p], codes[p], 1)
            for d in range(width):
                np.add.at(sums[p, :, d], codes[p], x[p * width + d])
        return sums, counts

    def merge(a, b):
        return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

    sums, counts = blocks.rdd.treeAggregate(None, add, merge, depth)
    shared.destroy()
    return sums, counts


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> np.ndarray:
    """The codebooks, as integers of shape (parts, entries, components of a part).

    They start as the parts of the `entries` vectors of the smallest keys (equal keys by vector, null keys last). A round
    replaces every entry by the floor of the mean of the parts nearest to it, ties to the lower entry; unused entries
    stay. Fewer vectors give fewer entries, none an empty codebook. Vectors count as filled with zeros up to the longest,
    and to a multiple of parts. Exact while sums of squared distances stay below 2^63.
    """
    spark = vectors.sparkSession
    steps = Steps(spark, "codes")
    rows = integers(vectors, vector, factor, "_v").select(F.col(key).alias("_k"), "_v")
    width = -(-(rows.agg(F.max(F.size("_v"))).first()[0] or 0) // parts)
    first = [r[0] for r in rows.orderBy(F.col("_k").asc_nulls_last(), "_v").limit(entries).select("_v").collect()]
    books = np.array([[*v, *[0] * (parts * width - len(v))] for v in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if not first or not width:
        return books
    blocks = steps.written(blocks_of(rows, parts * width), "blocks", "zstd")
    for _ in range(rounds):
        sums, counts = round_of(blocks, books)
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
    steps.drop(blocks)
    return books


def encoded(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", factor: int = FACTOR) -> DataFrame:
    """vectors that take part, their columns wrapped in _row (whatever their names), with code (a byte a part) and error.

    One pass without a shuffle. Codebooks hold at most 256 entries; vectors are filled with zeros as in `fit`.
    """
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("a code is one byte a part")
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                codes, error = nearest(np.ascontiguousarray(matrix(batch.column(1), parts * width).T), shared.value)
                code = pa.array([c.tobytes() for c in codes.T.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), code, pa.array(error)], ["_row", "code", "error"])

    rows = integers(vectors.select(F.struct("*").alias("_row"), F.col(vector).alias("_x")), "_x", factor, "_v")
    kept = F.struct(*[F.col("_row").getField(c).alias(c) for c in vectors.columns if c != vector])
    rows = rows.select(kept.alias("_row"), "_v")
    return rows.mapInArrow(encode, f"_row {rows.schema['_row'].dataType.simpleString()}, code binary, error long")


def decoded(codes: DataFrame, books: np.ndarray, code: str = "code", factor: int = FACTOR) -> DataFrame:
    """codes with vector, what the code stands for: its entries one after the other, divided by factor."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / factor) for x in entry]) for entry in part]) for part in books.tolist()])
    numbers = [F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int") for p in range(len(books))]
    return codes.withColumn("vector", F.concat(*[F.element_at(F.element_at(table, p + 1), n + 1) for p, n in enumerate(numbers)]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def summed_by(rows: DataFrame, label: str, value: str, out: str, salt: int = SALT) -> DataFrame:
    """rows (written) with the sum of value over rows of equal label, nulls together. A common label is joined by several tasks."""
    sums = rows.groupBy(F.col(label).alias("_l")).agg(F.sum(value).alias(out)).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    dealt = rows.withColumn("_d", F.pmod(F.monotonically_increasing_id(), F.lit(salt)).cast("int"))
    return dealt.join(sums, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_d") == F.col("_s"))).drop("_l", "_s", "_d")


def op12_codes(spark, sf_dir):
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit(vectors)
    steps = Steps(spark, "op12")
    found = encoded(vectors, books).select("_row.vec_id", "_row.label", F.lower(F.hex("code")).alias("code"), "error")
    rows = steps.written(found, "coded")
    return steps.result(summed_by(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def _sql() -> str:
    """The rounds as common tables: assignment to the nearest entry, then floors of means."""
    away = "CAST(list_sum(list_transform(list_zip(v.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS (
  SELECT v.row, v.p, arg_min(b.i, ({away}, b.i)) AS i, min({away}) AS away FROM parts v JOIN b{r} b ON v.p = b.p GROUP BY v.row, v.p
)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (
  SELECT a.p, a.i, u.d, sum(v.e[u.d]) AS s, count(*) AS n
  FROM a{r} a JOIN parts v ON a.row = v.row AND a.p = v.p, LATERAL (SELECT unnest(range(1, 17)) AS d) u GROUP BY a.p, a.i, u.d
), m{r} AS (
  SELECT p, i, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) ORDER BY d) AS e FROM s{r} GROUP BY p, i
), b{r + 1} AS (
  SELECT b.p, b.i, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.i = m.i
)""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT row, p, e[16 * p + 1 : 16 * p + 16] AS e FROM v, LATERAL (SELECT unnest(range({PARTS})) AS p)
), first AS (
  SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS i FROM v QUALIFY i < {ENTRIES}
), b0 AS (
  SELECT p, i, e FROM first JOIN parts USING (row)
), {", ".join(steps)}, hash AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM b{ROUNDS}
), coded AS (
  SELECT row, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (row), hash
"""


OP12_SQL = _sql()
