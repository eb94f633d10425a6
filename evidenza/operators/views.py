"""Views and small changes of application tables: orders, counts, unique inserts, deletes with counts, report and conversation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reports import real_item

#: The title of a conversation that has none yet; characters of a title and of a preview.
NEW_TITLE, TITLE, PREVIEW = "新的咨询", 24, 80


def sorted_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks by document, page and index: a range sort of all rows."""
    return chunks.orderBy("document_id", "pdf_page", "chunk_index")


def recent_first(rows: DataFrame, owner: str, at: str, key: str) -> DataFrame:
    """rows with place, from 1, of each among its owner's, the latest first; ties by key, rows without a time last."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.col(at).desc_nulls_last(), key)))


def document_counts(chunks: DataFrame, vectors: DataFrame, document: str = "document_id", condition: Column | None = None) -> DataFrame:
    """document, n_chunks (those that meet the condition) and n_vectors, of all documents of either table."""
    own = chunks.groupBy(document).agg((F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias("n_chunks"))
    both = own.join(vectors.groupBy(document).agg(F.count(F.lit(1)).alias("n_vectors")), document, "full")
    return both.select(document, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_chunks", "n_vectors")])


def unique_inserts(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """new with is_accepted: the first in order of each key that old does not hold. A null in a key equals nothing, so it is accepted."""
    held = old.select(*keys, F.lit(True).alias("_held")).distinct()
    placed = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    free = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    joined = placed.join(held, keys, "left")
    return joined.withColumn("is_accepted", free | (F.col("_held").isNull() & (F.col("_n") == 1))).drop("_n", "_held")


def deleted_counted(rows: DataFrame, condition: Column) -> tuple[DataFrame, Observation]:
    """rows without those that meet the condition (null: they stay), and how many went: `n` of the observation once they are written."""
    gone, seen = F.coalesce(condition, F.lit(False)), Observation()
    return rows.observe(seen, F.coalesce(F.count_if(gone), F.lit(0)).alias("n")).filter(~gone), seen


def titled(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversations (conv_id, title, updated_at) after messages (conv_id, turn, role, text, at).

    The first user message gives a conversation its title if it has none or the new one's; the last message gives preview and updated_at.
    """
    said = messages.filter(F.btrim(F.coalesce("text", F.lit(""))) != "")
    one = said.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("_first"), F.max_by("text", "turn").alias("_last"), F.max("at").alias("_at")
    )
    blank = F.coalesce(F.btrim("title"), F.lit("")).isin("", NEW_TITLE)
    rows = conversations.join(one, "conv_id", "left")
    return rows.select(
        "conv_id", F.when(blank & F.col("_first").isNotNull(), F.left(F.btrim("_first"), F.lit(TITLE))).otherwise(F.col("title")).alias("title"),
        F.left(F.btrim("_last"), F.lit(PREVIEW)).alias("preview"), F.greatest("updated_at", "_at").alias("updated_at"),
    )


def report_views(reports: DataFrame, items: DataFrame, citations: DataFrame) -> DataFrame:
    """reports with items, an array in order of position: name, value, unit, low, high, status and citations, of real items only.

    items: report_id, position and those columns; citations: report_id, position, citations. As JSON, fields that are null are left out.
    """
    own = items.filter(real_item(F.col("name"))).join(citations.select("report_id", "position", "citations"), ["report_id", "position"], "left")
    item = F.struct("position", *[F.col(c) for c in ("name", "value", "unit", "low", "high", "status")], F.coalesce("citations", F.array().cast(citations.schema["citations"].dataType)).alias("citations"))
    each = own.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("position")).alias("items"))
    return reports.join(each, "report_id", "left").withColumn("json", F.to_json(F.struct("report_id", F.coalesce("items", F.array().cast(each.schema["items"].dataType)).alias("items"))))
