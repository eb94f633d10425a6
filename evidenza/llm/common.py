"""Helpers that the operators share: written tables in the cluster's shared folder, and cell ranks."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where checkpoints go if the cluster names no folder (tests on one machine).
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints"
#: Cells that an ordered group is split into, so that no task ranks a whole hot group.
CELLS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or DEFAULT_CHECKPOINT_DIR where that is unset on a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return DEFAULT_CHECKPOINT_DIR


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again: lineage ends here."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this library's own written tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """The written tables of one run of an operator, in a folder of their own: they go when the result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.folder, self.n = spark, name, new_folder(spark, name), 0

    def written(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """The rows of df, written as Parquet in the shared folder and read again: lineage ends here."""
        self.n += 1
        folder = f"{self.folder}/{self.n}-{name}"
        df.write.option("compression", compression).parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, *tables: DataFrame) -> None:
        """Removes written tables that no later step reads; each must have been returned by `written`."""
        for table in tables:
            for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                removed(self.spark, folder)

    def result(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """df, written outside the folder of the steps, which is removed; the caller owns the one table left."""
        out = written(df, self.name, compression)
        removed(self.spark, self.folder)
        return out


def released(spark: SparkSession) -> None:
    """Lets the cleaner delete the shuffle files of steps whose rows are written, which else wait for the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def as_text(key: str) -> Column:
    """A key as pandas workers may hold it: long keys beside nulls would turn into floats there, and lose digits."""
    return F.col(key).cast("string").alias("_key")


def from_text(docs: DataFrame, key: str, column: str = "_key") -> Column:
    """The key that `as_text` gave to a worker, of the type that it has in docs."""
    return F.col(column).cast(docs.schema[key].dataType)


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores until no column of `taken` is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def with_rank(rows: DataFrame, keys: list[str], order: list[str], out: str, cells: int = CELLS) -> DataFrame:
    """Adds out, a gapless rank from 0 within keys, in the order of a hash and then of `order`.

    A hash of `order` deals each group to cells; the cells' counts give each its first rank, and only a cell is sorted
    in one task. Keys must not be null. rows is evaluated twice, so pass rows that are cheap or written.
    """
    celled = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    return (
        celled.join(firsts, [*keys, "_cell"])
        .withColumn(out, (F.col("_first") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_cell", "_first")
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
