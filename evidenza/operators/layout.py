"""Chunks of laid-out documents: headings give each block its path, blocks under one heading are packed by length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sha256, uuid5

# Kinds of block that are headings, and those of the first level.
HEADINGS, FIRST = ("title", "heading", "h1", "h2", "h3"), ("title", "h1")
EXCERPT = 360


def heading_paths(blocks: DataFrame) -> DataFrame:
    """document_id, section, path: section 0 is the title alone, each heading opens the next, under those above its level.

    blocks: document_id, title, ordinal, kind, text, level (null or 0: 1 for a first-level kind, else 2).
    """
    depth = F.when(F.col("level") > 0, F.col("level")).otherwise(F.when(F.col("kind").isin(*FIRST), 1).otherwise(2))
    heading = F.when(F.col("kind").isin(*HEADINGS), F.struct("ordinal", depth.cast("int").alias("depth"), "text"))
    found = blocks.groupBy("document_id").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(heading)).alias("_h"))
    start = F.array(F.array("title"))
    under = lambda path, h: F.concat(F.slice(path, 1, F.greatest(F.lit(1), h["depth"])), F.array(h["text"]))
    paths = F.aggregate("_h", start, lambda a, h: F.concat(a, F.array(under(F.element_at(a, -1), h))))
    return found.select("document_id", "title", F.posexplode(paths).alias("section", "path"))


def in_runs(lengths: list[int], full: int) -> list[int]:
    """A run's number for each length: a run ends with the length that fills it."""
    out, run, held = [], 0, 0
    for n in lengths:
        out.append(run)
        held += n
        if held >= full:
            run, held = run + 1, 0
    return out


def pieces(paragraph: str, most: int) -> Iterator[str]:
    """A paragraph in stripped pieces of `most` characters; the last one may be shorter or empty."""
    while len(paragraph) > most:
        yield paragraph[:most].strip()
        paragraph = paragraph[most:].strip()
    yield paragraph


def parts(text: str, most: int) -> list[str]:
    """Paragraphs joined while they fit together; one that is too long is cut, and the next may join its last piece."""
    out = [""]
    for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
        if len(out[-1]) + len(paragraph) + 2 <= most:
            out[-1] = f"{out[-1]}\n\n{paragraph}".strip()
        else:
            out += pieces(paragraph, most)
    return [x for x in out if x]


def layout_chunks(blocks: DataFrame, most: int = 900, chunk_prefix: str = "pdf:", section_prefix: str = "section:") -> DataFrame:
    """Chunks of documents: document_id, section, position, title, section_title, heading_path, page_start, page_end, boxes,
    content, excerpt, content_hash, chunk_id, section_id.

    blocks: document_id, title, ordinal, kind, text, level, page, box (array of four, may be null). Blocks under a heading are
    joined until they hold twice `most` characters, then split by paragraphs; the first part of such a run has the pages and
    boxes of all its blocks, later ones those of the last. A section is the unit of work, however long its document is.
    """
    by_document = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind").isin(*HEADINGS)
    own = blocks.withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(by_document)).filter(~heading)
    own = own.select("document_id", F.col("section").cast("int").alias("section"), "ordinal", "text", "page", F.col("box").cast("array<double>").alias("box"))
    box = "array<struct<page:int,box:array<double>>>"
    document = blocks.schema["document_id"].dataType.simpleString()

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("ordinal"), []
        for _, run in rows.groupby(in_runs([len(x) for x in rows["text"]], 2 * most)):
            for i, part in enumerate(parts("\n\n".join(run["text"]), most)):
                said = run if i == 0 else run.tail(1)
                boxes = [{"page": int(p), "box": list(b)} for p, b in zip(said["page"], said["box"]) if b is not None]
                out.append((rows["document_id"].iat[0], rows["section"].iat[0], len(out), said["page"].min(), said["page"].max(), boxes, part))
        return pd.DataFrame(out, columns=["document_id", "section", "position", "page_start", "page_end", "boxes", "content"])

    made = own.groupBy("document_id", "section").applyInPandas(packed, f"document_id {document}, section int, position int, page_start int, page_end int, boxes {box}, content string")
    rows = made.join(heading_paths(blocks), ["document_id", "section"])
    where = F.array_join("path", " > ")
    digest = sha256(F.concat_ws("|", F.col("document_id").cast("string"), where, F.col("page_start").cast("string"), "content"))
    named = lambda prefix, c: uuid5(F.concat(F.lit(prefix), c))
    rows = rows.withColumn("content_hash", digest)
    return rows.select(
        "document_id", "section", "position", "title", F.element_at("path", -1).alias("section_title"), F.col("path").alias("heading_path"), "page_start", "page_end", "boxes", "content",
        F.left("content", F.lit(EXCERPT)).alias("excerpt"), "content_hash", named(chunk_prefix, F.col("content_hash")).alias("chunk_id"),
        named(section_prefix, F.concat_ws(":", F.col("document_id").cast("string"), where)).alias("section_id"),
    )


def boxes_of_page(boxes: Column, page: Column) -> Column:
    """The boxes that stand on a page."""
    return F.filter(boxes, lambda b: b["page"] == page)
