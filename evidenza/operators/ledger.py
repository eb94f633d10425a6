"""Bookkeeping of ingests: runs, audit events, versions of a table, manifests, counters, reads by key."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .suites import good_rows, vector_suite
from .tables import first_by, upsert

RUNS = "run_id string, document_id string, model_name string, state string, at timestamp, n_chunks long, error string"
AUDIT = "user_id string, action string, detail string, at timestamp"


def appended(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one of its schema where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def seeded(spark: SparkSession, path: str, schema: str, seed: DataFrame) -> DataFrame:
    """A table, filled with the seed if it is empty."""
    if read_or_empty(spark, path, schema).isEmpty():
        seed.write.mode("append").parquet(path)
    return read_or_empty(spark, path, schema)


def begin_run(spark: SparkSession, path: str, document_id: str, model_name: str, at) -> str:
    run = uuid.uuid4().hex
    appended(spark, path, RUNS, (run, document_id, model_name, "running", at, None, None))
    return run


def complete_run(spark: SparkSession, path: str, run_id: str, at, n_chunks: int | None = None, error: str | None = None) -> None:
    appended(spark, path, RUNS, (run_id, None, None, "failed" if error else "success", at, n_chunks, error))


def runs(events: DataFrame) -> DataFrame:
    """One row a run: its document and model, when it began and ended, and its last state, with that state's count and error.

    A state that ends a run counts more than one that says it runs. Of several, the latest; at one time the one of the
    largest event_id, if events have one, and then failed before success, so a failure is never hidden.
    """
    done = F.col("state") != "running"
    tie = [F.col("event_id")] if "event_id" in events.columns else []
    last_of = F.struct(done.alias("d"), "at", *tie, (F.col("state") == "failed").alias("f"), F.col("state").alias("s"), F.col("n_chunks").alias("n"), F.col("error").alias("e"))
    last = {n: F.max_by(F.when(done, F.col(n)), last_of).alias(n) for n in ("n_chunks", "error")}
    return events.groupBy("run_id").agg(
        F.max("document_id").alias("document_id"), F.max("model_name").alias("model_name"), F.min("at").alias("began"), F.max(F.when(done, F.col("at"))).alias("ended"),
        F.max_by("state", last_of).alias("state"), *last.values(),
    )


def audit_events(changes: DataFrame, user: Column, action: str, at: Column, *detail: str) -> DataFrame:
    """An event for each change, its detail the named columns as JSON; to be appended to the audit table."""
    return changes.select(user.cast("string").alias("user_id"), F.lit(action).alias("action"), F.to_json(F.struct(*detail)).alias("detail"), at.alias("at"))


def write_version(df: DataFrame, path: str, at) -> None:
    """A new version of a table beside the old ones; readers see it once it is written and named as the last."""
    # Names go by the time of writing, so that versions of one time are in the order in which they were written.
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/versions/{version}")
    appended(df.sparkSession, f"{path}/named", "version string, at timestamp", (version, at))


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The version named last: of the latest time, at one time that of the largest name; without one the table's path is an error."""
    last = spark.read.parquet(f"{path}/named").orderBy(F.desc("at"), F.desc("version")).first()
    return spark.read.parquet(f"{path}/versions/{last.version}")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest_row(vectors: DataFrame, source: DataFrame, model: str, width: int, start: int, end: int, input_sha256: str, device: str) -> DataFrame:
    """The manifest of an embedding run: counts of the vectors and of their source, the slice, the input's digest."""
    n = vectors.agg(F.count(F.lit(1)).alias("chunk_count")).join(source.agg(F.count(F.lit(1)).alias("source_chunk_count")))
    fixed = {"model_name": model, "embedding_dimension": width, "normalized": True, "selected_start_index": start, "selected_end_index": end, "input_sha256": input_sha256, "device": device}
    return n.withColumns({name: F.lit(x) for name, x in fixed.items()})


def ingest_counters(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: pages read (repeats too), unique and usable ones, those skipped, with and without chunks, chunks made and repeated.

    pages: document_id, pdf_page, usable. chunks: document_id, pdf_page, chunk_id.
    """
    keys = ["document_id", "pdf_page"]
    unique = pages.groupBy(*keys).agg(F.bool_or("usable").alias("usable"), F.count(F.lit(1)).alias("_rows"))
    made = chunks.groupBy(*keys).agg(F.lit(True).alias("_has"))
    of_pages = unique.join(made, keys, "left").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_source"), F.count(F.lit(1)).alias("n_selected"), F.count_if(~F.col("usable")).alias("n_skipped"),
        F.count_if("_has").alias("n_with_chunks"), F.count_if(F.col("usable") & F.col("_has").isNull()).alias("n_without_chunks"),
    )
    ids = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_rows"))
    return of_pages.join(ids.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("n_duplicates")))


def page_pace(pages: DataFrame) -> DataFrame:
    """Pages and their mean seconds for each document: document_id, began, ended."""
    took = F.col("ended").cast("double") - F.col("began").cast("double")
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"), F.avg(took).alias("mean_seconds"))


def by_key(df: DataFrame, key: str, value, user: str | None = None, user_column: str = "user_id") -> DataFrame:
    """The row of a key; where a user is given, only if it is theirs."""
    found = df.filter(F.col(key) == value)
    return found if user is None else found.filter(F.col(user_column) == user)


def upserted_vectors(old: DataFrame, new: DataFrame, width: int, order: list[Column] | None = None) -> DataFrame:
    """Vectors by chunk_id after a check of width, finite components and norm; of those that repeat an id the first in order."""
    one = first_by(new, ["chunk_id"], order) if order else new
    return upsert(old, good_rows(vector_suite(one, width), "vectors"), ["chunk_id"])


def ordered_union(*lists: Column) -> Column:
    """The values of lists in order, each once; null lists are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def positions(df: DataFrame, start: int, end: int, ordinal: str = "ordinal") -> DataFrame:
    """Rows of the positions from start up to, but without, end."""
    if not 0 <= start <= end:
        raise ValueError("0 <= start <= end is needed")
    return df.filter((F.col(ordinal) >= start) & (F.col(ordinal) < end))
