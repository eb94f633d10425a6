"""Whole chains: page records to chunks, and report texts to indicators, what is known about them, and a summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import health, text
from . import chunking, reports

#: Chunks looked up for an item.
CHUNKS = 3
#: What tells a report's items apart where items have no id of their own.
IDENTITY = ["name", "value", "unit"]


def chunked_pages(pages: DataFrame, model: str, budget: chunking.Budget = chunking.Budget(), source: str = "msd") -> tuple[DataFrame, DataFrame]:
    """Chunks of page records, and counts of a run.

    pages: document_id, pdf_page, printed_page, title, body_text, table_text, figure_text, search_text, searchable; one row
    a page. Pages that are not searchable or hold no text are skipped. Chunks: document_id, pdf_page, printed_page,
    section_title, chunk_index, chunk_count, content, content_hash, chunk_id, tags. Counts: document_id, n_pages,
    n_processable, n_skipped, n_with_chunks, n_chunks, longest.
    """
    texts = ["search_text", "body_text", "table_text", "figure_text"]
    rows = pages.withColumn("_ok", text.processable(F.col("searchable"), *[F.coalesce(c, F.lit("")) for c in texts]))
    rows = rows.withColumn("section_title", text.section_title(F.col("title"), F.col("pdf_page")))
    own = text.page_text(F.col("section_title"), *[F.col(c) for c in ("body_text", "table_text", "figure_text", "search_text")])
    # What a page's chunks take over goes along with its text, so that chunks are not joined with pages.
    kept = ("printed_page", "section_title")
    cut = chunking.chunked(rows.filter("_ok").select("document_id", F.col("pdf_page").alias("page"), F.col("section_title").alias("title"), own.alias("text"), *kept), budget, kept)
    tags = text.page_tags(F.col("page"), F.lit(model), F.col("printed_page"), source)
    chunks = cut.select("document_id", F.col("page").alias("pdf_page"), "printed_page", "section_title", "chunk_index", "chunk_count", "content", "content_hash", "chunk_id", tags.alias("tags"))
    of_pages = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("_ok").alias("n_processable"), F.count_if(~F.col("_ok")).alias("n_skipped"))
    of_chunks = chunks.groupBy("document_id").agg(F.count_if(F.col("chunk_index") == F.lit(0)).alias("n_with_chunks"), F.count(F.lit(1)).alias("n_chunks"), F.max(F.length("content")).alias("longest"))
    counts = of_pages.join(of_chunks, "document_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_with_chunks", "n_chunks", "longest")})
    return chunks, counts


def report_items(texts: DataFrame) -> DataFrame:
    """report_id, position, name, value, unit, low, high, status of each indicator on the lines of report_id and text.

    position is the line's number, from 0. Of items that agree in name and unit, in any case, and value, the first stays.
    Reports without an indicator give no rows.
    """
    lines = texts.select("report_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)).alias("position", "_raw"))
    # A line is parsed once: a generator keeps the optimizer from copying the parser into every filter and column that uses it.
    item = health.bound(text.report_line(F.col("_raw")), lambda line: F.when(health.candidate_line(line), health.parse_line(line)))
    found = lines.select("report_id", "position", F.inline(F.filter(F.array(item), lambda i: i.isNotNull()))).filter(~health.metadata_name(F.col("name")))
    return reports.unique_items(found, [F.col("position")])


def report_targets(items: DataFrame) -> DataFrame:
    """The items of `report_items` to look up, at most six a report, with item (their place, from 1) and question; items that repeat count once."""
    real = items.filter(reports.real_item(F.col("name")))
    chosen = reports.targets(real, "report_id", [F.col("position")], identity=IDENTITY).withColumnRenamed("rank", "item")
    return chosen.withColumn("question", reports.knowledge_question(F.col("name"), F.col("status")))


def report_chain(texts: DataFrame, find: Callable[[DataFrame, int], DataFrame], analyses: DataFrame | None = None, items: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a report's text comes to: items, targets, context, citations and summaries, one table each.

    texts: report_id, text; one row a report. find(questions, k) is a search: questions (question_id, question) in, question_id,
    chunk_id and rank out. Items: as `report_items`, or the placeholder. Targets: as `report_targets`. Context: the first chunks
    found, twelve a report at most. Citations: the chunks of each target reached. Summaries: as `reports.interpreted`, by the
    fallback where analyses (report_id, analysis) has none. items: those of `report_items`, if they are written; else each table
    reads the texts again, and so may a search that counts its questions before it begins.
    """
    found = report_items(texts) if items is None else items
    chosen = report_targets(found)
    # A question is asked once, however many reports ask it.
    asked = chosen.select(F.col("question").alias("question_id"), "question").distinct()
    hits = chosen.join(find(asked, CHUNKS).withColumnRenamed("question_id", "question"), "question").select("report_id", "item", "rank", "chunk_id")
    context, citations = reports.context(hits)
    # A summary needs no placeholder: a report without items is rejected.
    return {"items": reports.with_placeholder(texts, found), "targets": chosen, "context": context, "citations": citations, "summaries": reports.interpreted(texts, found, analyses)}
