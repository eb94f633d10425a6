"""Measures of tables: lengths, norms, statuses, tag sets, and rows of a range of pages. Each is one aggregation or filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit vector's length may be off by this much.
TOLERANCE = 0.01


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("double"))


def lengths(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, least, mean, most (characters) and n rows. Null texts count in n alone; without any text the others are 0.

    No keys: one row, of an empty table too.
    """
    n = F.length(text).cast("long")
    measured = [F.coalesce(F.min(n), F.lit(0)).alias("least"), or_zero(F.avg(n)).alias("mean"), F.coalesce(F.max(n), F.lit(0)).alias("most")]
    return rows.groupBy(*keys).agg(*measured, F.count(F.lit(1)).alias("n"))


def norm(vector: Column) -> Column:
    """The Euclidean length; null for null vectors and those that hold a null."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def norms(vectors: DataFrame, vector: str, width: int, tolerance: float = TOLERANCE) -> DataFrame:
    """One row: n vectors, the least, mean and greatest norm (0 without any), n_bad: of another width, or no unit vectors, null ones too."""
    rows = vectors.select(F.size(vector).alias("_width"), norm(F.col(vector)).alias("_norm"))
    good = (F.col("_width") == width) & F.col("_norm").between(1 - tolerance, 1 + tolerance)
    measured = [or_zero(f("_norm")).alias(name) for name, f in (("least", F.min), ("mean", F.avg), ("most", F.max))]
    return rows.agg(F.count(F.lit(1)).alias("n"), *measured, F.count_if(~F.coalesce(good, F.lit(False))).alias("n_bad"))


def status_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n_high, n_low, n_normal, n_unknown; a null status counts as unknown."""
    said = F.coalesce("status", F.lit("unknown"))
    return items.groupBy(*keys).agg(*[F.count_if(said == s).alias(f"n_{s}") for s in ("high", "low", "normal", "unknown")])


def tag_sets(rows: DataFrame, keys: list[str], tag: str, wanted: list[str]) -> DataFrame:
    """keys, n rows, tags (the distinct ones, sorted, no nulls) and n_shared, how many of these are wanted."""
    each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(tag)).alias("tags"))
    return each.withColumn("n_shared", F.size(F.array_intersect("tags", F.array(*[F.lit(w) for w in wanted]).cast("array<string>"))).cast("long"))


def page_range(rows: DataFrame, page: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the pages first to last, both of them included and either left open by None. A range that is reversed is an error."""
    if first is not None and last is not None and first > last:
        raise ValueError("the first page must not come after the last")
    own = rows if first is None else rows.filter(F.col(page) >= first)
    return own if last is None else own.filter(F.col(page) <= last)
