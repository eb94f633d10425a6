"""Keyed tables: first and last wins, upserts, patches, deletes, reconciliation and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in order (put a descending order in for the last)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def one_each(new: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    """One new row a key: the first in order; without an order any one, so that no key comes out twice."""
    return first_by(new, keys, order) if order else new.dropDuplicates(keys)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows, and old rows whose key is not among them. Of new rows that repeat a key, the first in `order`."""
    return one_each(new, keys, order).unionByName(old.join(new.select(*keys), keys, "left_anti"))


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """Old rows with `columns` from the new row of their key, if any; new keys are added. Of new rows that repeat a key, the first in `order`."""
    renamed = one_each(new, keys, order).select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in new.columns if c not in keys])
    rest = [c for c in old.columns if c not in keys]
    pick = lambda c: F.when(F.col("_new") & (F.col("_old").isNull() | F.lit(c in columns)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return old.withColumn("_old", F.lit(True)).join(renamed, keys, "full").select(*keys, *[pick(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Old rows, and new rows of other keys, one a key: the first in `order`."""
    return old.unionByName(one_each(new, keys, order).join(old.select(*keys), keys, "left_anti"))


def deleted(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def patched(old: DataFrame, patches: DataFrame, key: str, keep_if_blank: list[str], keep_if_null: list[str], always: list[str], order: list[Column] | None = None) -> DataFrame:
    """Blank or null patches keep the old value, as listed; columns in `always` are replaced, by null too.

    Of patches that repeat a key, the first in `order`, so rows of old stay as many as they are.
    """
    p = one_each(patches, [key], order).select(key, F.lit(True).alias("_p"), *[F.col(c).alias(f"_{c}") for c in (*keep_if_blank, *keep_if_null, *always)])
    new = {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) for c in keep_if_blank}
    new |= {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in keep_if_null}
    new |= {c: F.when(F.col("_p"), F.col(f"_{c}")).otherwise(F.col(c)) for c in always}
    return old.join(p, key, "left").withColumns(new).select(*old.columns)


def reconciled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of both sides by key, and success where they agree, else verification_failed."""
    a, b = (df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "left_count"), (right, "right_count")))
    both = a.join(b, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left_count", "right_count")])
    return both.withColumn("status", F.when(F.col("left_count") == F.col("right_count"), "success").otherwise("verification_failed"))


def expected(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds reasons: the names of the rules (conditions of good rows) that a row breaks; a null condition breaks too."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def contiguous(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """For each group: rows, and whether its indexes are unique and run from 0 or 1 without a gap."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("_d"), F.min(index).alias("_a"), F.max(index).alias("_b"))
    ok = (F.col("_d") == F.col("n")) & (F.col("_b") - F.col("_a") + 1 == F.col("n")) & F.col("_a").isin(0, 1)
    return g.select(*keys, "n", ok.alias("is_contiguous"))


def aligned(left: DataFrame, right: DataFrame, ordinal: str, columns: list[str]) -> DataFrame:
    """Rows of two inputs by position, with the columns in which they differ; a missing side differs in all."""
    a, b = (df.select(ordinal, F.lit(True).alias(f"_{s}"), *[F.col(c).alias(f"_{s}_{c}") for c in columns]) for df, s in ((left, "l"), (right, "r")))
    differs = [F.when(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")) | F.col("_l").isNull() | F.col("_r").isNull(), F.lit(c)) for c in columns]
    return a.join(b, ordinal, "full").select(ordinal, F.array_compact(F.array(*differs)).alias("differs"))


def missing_columns(df: DataFrame, wanted: dict[str, str]) -> list[str]:
    """Names of wanted columns (name -> type) that df lacks or holds as another type."""
    have = dict(df.dtypes)
    return sorted(n for n, t in wanted.items() if have.get(n) != t)


def hydrated(ids: DataFrame, rows: DataFrame, key: str, needed: str) -> DataFrame:
    """Rows of ids, in which an id without a row is an error, not a dropped row."""
    joined = ids.join(rows, key, "left")
    return joined.withColumn(needed, F.when(F.col(needed).isNotNull(), F.col(needed)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))))
