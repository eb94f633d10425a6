"""Typed casts of loose records, with rows that do not fit set aside in the same pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """The type of a column, whether null or a missing column is an error, the value put in place of null, and the most characters."""

    type: str
    required: bool = True
    default: object = None
    longest: int | None = None


def cast_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column as the type; what does not fit is null. Lists and objects are read from JSON text, or written as it."""
    wanted, c = T.DataType.fromDDL(kind), F.col(f"`{name}`")
    have = df.schema[name].dataType
    if isinstance(have, T.StringType) and isinstance(wanted, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(c, wanted, {"mode": "PERMISSIVE"})
    if isinstance(wanted, T.StringType) and isinstance(have, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(wanted, (T.IntegerType, T.LongType)) and isinstance(have, (T.DoubleType, T.FloatType, T.DecimalType)):
        whole = F.floor(F.abs(c)) * F.signum(c)  # a fraction is cut off, towards zero
        return F.when(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < 2.0**63), whole).try_cast(kind)
    if isinstance(have, T.StringType) and not isinstance(wanted, T.StringType):
        c = F.btrim(c)
    return c.try_cast(kind)


def typed(df: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """The fields in order, as their types, then reasons: what is wrong with a row, and record: the row as it came, as JSON, if anything is.

    Reasons: "x is missing" (null or blank, or no such column, where required), "x is no <type>", "x is too long". Other
    columns are dropped, whatever their names.
    """
    out, reasons = [], []
    for name, f in fields.items():
        if name not in df.columns:
            out.append(F.lit(f.default).cast(f.type).alias(name))
            if f.required and f.default is None:
                reasons.append(F.lit(f"{name} is missing"))
            continue
        given, value = F.col(f"`{name}`"), cast_or_null(df, name, f.type)
        empty = given.isNull() | ((F.btrim(given) == "") if isinstance(df.schema[name].dataType, T.StringType) and f.required else F.lit(False))
        if f.required and f.default is None:
            reasons.append(F.when(empty, F.lit(f"{name} is missing")))
        reasons.append(F.when(~empty & value.isNull(), F.lit(f"{name} is no {f.type}")))
        if f.longest is not None:
            reasons.append(F.when(F.length(value.cast("string")) > f.longest, F.lit(f"{name} is too long")))
        out.append((value if f.default is None else F.coalesce(value, F.lit(f.default).cast(f.type))).alias(name))
    why = F.array_compact(F.array(*reasons, F.lit(None).cast("string")))
    record = F.to_json(F.struct("*"))
    rows = df.select(F.struct(*out).alias("_t"), why.alias("_why"), F.when(F.size(why) > 0, record).alias("_record"))
    return rows.select("_t.*", F.col("_why").alias("reasons"), F.col("_record").alias("record"))


def quarantined(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes rows of `typed` once, good and rejected ones apart, and gives both: good ones typed, rejected ones with record and reasons."""
    bad = F.size("reasons") > 0
    rows.withColumn("_kind", F.when(bad, "rejected").otherwise("good")).write.partitionBy("_kind").parquet(path)
    both = rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("_kind", T.StringType())])).parquet(path)
    good = both.filter("_kind = 'good'").drop("reasons", "record", "_kind")
    return good, both.filter("_kind = 'rejected'").select("record", "reasons")
