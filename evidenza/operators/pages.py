"""Pages of source documents: guards of page ranges, previews, citation details, raw records of scans, cached vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import percent
from .tables import hydrated


def resolved(path: Column, root: str) -> Column:
    """path as it is where it is absolute or names a store, else below root."""
    return F.when(F.startswith(path, F.lit("/")) | path.rlike("^[A-Za-z][A-Za-z0-9+.-]+://"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def counted_pages(files: DataFrame, counter, content: str = "content") -> DataFrame:
    """files without their bytes, with n_pages: null for a file that the counter fails on.

    counter() gives a function from bytes to a number of pages, and is called in each task.
    """

    def count(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pages_of = counter()
        for column in columns:
            out = []
            for data in column:
                try:
                    out.append(None if data is None else int(pages_of(data)))
                except Exception:  # whatever a foreign reader raises means that the file cannot be opened
                    out.append(None)
            yield pd.Series(out, dtype="Int32")

    return files.withColumn("n_pages", F.pandas_udf(count, "int")(F.col(content))).drop(content)


def guarded(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (path, first_page, last_page, ...) with n_pages and reason: null, or the first rule that the request breaks.

    files: one row for each path, n_pages null where the file can't be opened, and is_file where paths may be folders.
    """
    kind = F.col("is_file") if "is_file" in files.columns else F.lit(True)
    known = files.select("path", "n_pages", kind.alias("_is_file"), F.lit(True).alias("_there"))
    broken = (
        F.when(F.col("_there").isNull(), "no_file").when(~F.col("_is_file"), "not_a_file")
        .when(F.col("first_page").isNull() | F.col("last_page").isNull() | (F.least("first_page", "last_page") < 1), "page_below_one")
        .when(F.col("first_page") > F.col("last_page"), "range_reversed").when(F.col("n_pages").isNull(), "unreadable")
        .when(F.col("last_page") > F.col("n_pages"), "beyond_last_page")
    )
    return requests.join(known, "path", "left").withColumn("reason", broken).drop("_is_file", "_there")


def pages_of(guarded_requests: DataFrame) -> DataFrame:
    """A row with page_number for each page of the requests without a reason."""
    good = guarded_requests.filter("reason IS NULL")
    return good.withColumn("page_number", F.explode(F.sequence("first_page", "last_page")))


def previews(asked: DataFrame, documents: DataFrame, pages: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """asked (document_id, page_number, ...) with status and path.

    no_document, no_page (outside 1 to page_count), cached (the page's preview is among files), no_source (the document's
    source_path is not), else to_render, with the path that the picture is to have below folder. Documents and pages have
    one row for each key.
    """
    there = lambda name, out: files.select(F.col("path").alias(name)).distinct().withColumn(out, F.lit(True))
    known = documents.select("document_id", "page_count", F.col("source_path").alias("_source"))
    drawn = pages.select("document_id", "page_number", F.nullif("preview_path", F.lit("")).alias("_preview"))
    rows = (
        asked.join(known, "document_id", "left").join(drawn, ["document_id", "page_number"], "left")
        .join(there("_preview", "_drawn"), "_preview", "left").join(there("_source", "_held"), "_source", "left")
    )
    status = (
        F.when(F.col("page_count").isNull(), "no_document").when(~F.coalesce(F.col("page_number").between(1, F.col("page_count")), F.lit(False)), "no_page")
        .when(F.col("_drawn"), "cached").when(F.col("_held").isNull(), "no_source").otherwise("to_render")
    )
    target = F.concat_ws("/", F.lit(folder.rstrip("/")), F.col("document_id").cast("string"), F.concat(F.col("page_number").cast("string"), F.lit(".png")))
    path = F.when(F.col("status") == "cached", F.col("_preview")).when(F.col("status") == "to_render", target)
    return rows.withColumn("status", status).withColumn("path", path).select(*asked.columns, "status", "path")


def citation_details(ids: DataFrame, chunks: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """For every chunk_id of ids: is_found, and what a reader needs to open the cited place.

    A chunk whose document is missing is not found; a page without a row, or of size 0, counts as 1 by 1. Boxes without
    four edges are left out; the others come as percents of the page, within 0 to 100, on the chunk's first page if they name none.
    """
    size = lambda c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0))
    paper = pages.select("document_id", F.col("page_number").alias("page_start"), size("width").alias("_w"), size("height").alias("_h"))
    source = documents.select("document_id", F.col("title").alias("document_title"), "page_count", F.left("source_sha256", F.lit(12)).alias("document_version"))
    rows = ids.select("chunk_id").join(chunks, "chunk_id").join(source, "document_id").join(paper, ["document_id", "page_start"], "left")
    rows = rows.withColumns({"_w": F.coalesce("_w", F.lit(1.0)), "_h": F.coalesce("_h", F.lit(1.0))})
    edges = lambda b: F.transform(b["bbox"], lambda x, i: percent(x, F.when(i % 2 == 0, F.col("_w")).otherwise(F.col("_h"))))
    whole = F.filter("source_bboxes", lambda b: F.size(b["bbox"]) == 4)
    boxes = F.transform(whole, lambda b: F.struct(F.coalesce(b["page"], F.col("page_start")).alias("page"), edges(b).alias("bbox")))
    url = F.concat(F.lit("/api/v1/content/documents/"), F.col("document_id").cast("string"), F.lit("/pages/"), F.col("page_start").cast("string"), F.lit("/preview"))
    found = rows.select(
        "chunk_id", F.lit(True).alias("_found"), "document_id", "document_title", "section_title", "heading_path", "page_start", "page_end", "page_count",
        "source_excerpt", "document_version", F.coalesce(boxes, F.array().cast("array<struct<page:int,bbox:array<double>>>")).alias("source_bboxes"), url.alias("preview_url"),
    ).dropDuplicates(["chunk_id"])
    return ids.join(found, "chunk_id", "left").withColumn("is_found", F.coalesce("_found", F.lit(False))).drop("_found")


def raw_records(scans: DataFrame, lines: DataFrame) -> DataFrame:
    """scans (document_id, pdf_page, model_name, processed_at, image_width, image_height) with ocr_lines: text, confidence, box.

    lines: document_id, pdf_page, position, text, confidence, box. A page's lines are one array, in order of position.
    """
    line = F.struct("position", "text", "confidence", "box")
    held = lines.groupBy("document_id", "pdf_page").agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    bare = F.transform("_lines", lambda x: x.dropFields("position"))
    kind = lines.select(F.array(F.struct("text", "confidence", "box")).alias("a")).schema["a"].dataType
    return scans.join(held, ["document_id", "pdf_page"], "left").withColumn("ocr_lines", F.coalesce(bare, F.array().cast(kind))).drop("_lines")


def write_raw(records: DataFrame, path: str) -> None:
    """One JSON file for each page, below its document and page; pages that records do not hold stay as they are.

    A page is the unit that a reader asks for and a new scan replaces; rows of a page meet in one task, so it is one file.
    """
    records.repartition("document_id", "pdf_page").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("document_id", "pdf_page").json(path)


def read_raw(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records below path; a filter on document_id and pdf_page reads those folders only."""
    return spark.read.schema(schema).json(path)


def cache_missing(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """content_hash and content, one row each, of the chunks whose vector of this model is not in cache."""
    held = cache.filter(F.col("model_name") == model).select("content_hash")
    return chunks.join(held, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("content").alias("content"))


def with_cached(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """chunks with embedding from cache, which has one row for each hash and model; a chunk still without one is an error."""
    held = cache.filter((F.col("model_name") == model) & F.col("embedding").isNotNull()).select("content_hash", "embedding")
    return hydrated(chunks, held, "content_hash", "embedding")
