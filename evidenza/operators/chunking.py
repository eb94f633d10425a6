"""Pages to overlapping, content-addressed chunks, and lines to reading order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import chunk_id, clean_chunk, content_of, sha256

#: Pages that a worker cuts at a time.
PAGES = 256
#: A sentence ends after one of these marks.
ENDS = re.compile(r"(?<=[。！？；])")


@dataclass(frozen=True)
class Budget:
    """Characters of a chunk: closed from target on, never above most, overlap carried into the next."""

    target: int = 600
    most: int = 800
    overlap: int = 100

    def __post_init__(self):
        if not (0 < self.target <= self.most and self.overlap >= 0):
            raise ValueError("a budget needs 0 < target <= most and 0 <= overlap")

    def beside(self, title: int) -> Budget:
        """What a title of so many characters and its newline leave; a title that leaves nothing doesn't count."""
        used = title + 1 if title else 0
        most = self.most - used if self.most > used else self.most
        return Budget(min(self.target, most), most, min(self.overlap, most - 1))


def units(text: str, most: int) -> list[str]:
    """Lines of a clean text; sentences of lines that are too long; windows of sentences that still are."""
    window = re.compile(f".{{1,{most}}}", re.DOTALL)
    sentences = (s for line in text.split("\n") for s in ([line] if len(line) <= most else ENDS.split(line)))
    return [w for s in sentences for x in window.findall(s.strip()) if (w := x.strip())]


def end_of(parts: list[str], first: int, lead: int, budget: Budget) -> int:
    """Where the chunk that begins with so many characters of lead and the unit `first` ends: first, if that finds no room."""
    size, at = lead, first
    while at < len(parts) and size < budget.target + (at == first) * budget.most:
        size += (size > 0) + len(parts[at])
        if size > budget.most:
            break
        at += 1
    return at


def chunks_of(text: str, budget: Budget) -> list[str]:
    """Chunks of a clean text: each is the end of the one before, as far as there is room, and the units that fit."""
    if len(text) <= budget.most:
        return [text] if text else []
    tail = lambda said, room: said[-room:].strip() if room > 0 else ""
    parts, found, lead, first = units(text, budget.most), {}, "", 0
    while first < len(parts):
        end = end_of(parts, first, len(lead), budget)
        room = budget.overlap
        if end > first:
            lead = "\n".join(([lead] if lead else []) + parts[first:end])
            found[lead] = None
        # A chunk that closes for want of room leaves the next only what its first unit leaves free.
        if end == first or (len(lead) < budget.target and end < len(parts)):
            room = min(room, budget.most - len(parts[end]) - 1)
        lead, first = tail(lead, room), end
    return list(found)


def chunked(pages: DataFrame, budget: Budget = Budget(), keep: tuple[str, ...] = ()) -> DataFrame:
    """document_id, page, title, text in; a row a chunk with chunk_index, chunk_count, content, content_hash, chunk_id.

    The title and its newline count against the most, not the target, unless they leave nothing. Pages without text have
    no chunks. keep: further columns of pages that their chunks have too.
    """
    clean = lambda c: clean_chunk(F.coalesce(c, F.lit("")))
    rows = pages.select("document_id", "page", *keep, clean("title").alias("_title"), clean("text").alias("_t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A worker holds the texts and chunks of a few pages as Python strings, however large Spark's batches are.
            for lo in range(0, batch.num_rows, PAGES):
                part = batch.slice(lo, PAGES)
                found = [chunks_of(t, budget.beside(len(n))) for t, n in zip(part["_t"].to_pylist(), part["_title"].to_pylist(), strict=True)]
                own = part.drop_columns(["_t"]).take(pa.array([i for i, c in enumerate(found) for _ in c], pa.int64()))
                more = [pa.array([n for c in found for n in range(len(c))], pa.int32()), pa.array([len(c) for c in found for _ in c], pa.int32()), pa.array([x for c in found for x in c], pa.string())]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, "chunk_index", "chunk_count", "_body"])

    added = [T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_count", T.IntegerType()), T.StructField("_body", T.StringType())]
    each = rows.mapInArrow(cut, T.StructType([*rows.drop("_t").schema.fields, *added]))
    content = each.withColumn("content", content_of(F.col("_title"), F.col("_body"))).withColumn("content_hash", sha256(F.col("content")))
    return content.select(
        "document_id", "page", *keep, "chunk_index", "chunk_count", "content", "content_hash",
        chunk_id(F.col("document_id"), F.col("page"), F.col("chunk_index"), F.col("content_hash")).alias("chunk_id"),
    )


def reading_order(lines: DataFrame, share: float = 0.45, gap: float = 0.03) -> DataFrame:
    """page, left, top, right, width and height (of the page) in; adds position, from 1.

    A line spans if it crosses the middle and takes `share` of the width. A page has two columns if each side of the
    middle holds four other lines and the gap between them is over `gap` of its width: then come spanning lines near the
    top of the columns (20 or 3 % of the height below it at most), the left column, the right one, and other spanning
    lines. Other pages, and those without a width, go from top to bottom. Ties by left.
    """
    w = Window.partitionBy("page")
    middle, center = F.col("width") / 2, (F.col("left") + F.col("right")) / 2
    spans = (F.col("left") < middle) & (middle < F.col("right")) & (F.col("right") - F.col("left") >= F.col("width") * share)
    on_left, on_right = ~spans & (center <= middle), ~spans & (center > middle)
    between = F.min(F.when(on_right, F.col("left"))).over(w) - F.max(F.when(on_left, F.col("right"))).over(w)
    two = (F.count_if(on_left).over(w) >= 4) & (F.count_if(on_right).over(w) >= 4) & (between > F.col("width") * gap) & (F.col("width") > 0)
    near_top = F.col("top") <= F.min(F.when(~spans, F.col("top"))).over(w) + F.greatest(F.lit(20.0), F.coalesce(F.col("height"), F.lit(0.0)) * 0.03)
    section = F.when(~F.coalesce(two, F.lit(False)), 0).when(on_left, 1).when(on_right, 2).when(near_top, 0).otherwise(3)
    order = Window.partitionBy("page").orderBy("_section", "top", "left")
    return lines.withColumn("_section", section).withColumn("position", F.row_number().over(order)).drop("_section")


def row_clusters(lines: DataFrame) -> DataFrame:
    """page, top, bottom, left and text in; adds row, from 1.

    Lines go by top and left. A line joins the last row if its centre is no further from the mean of the row's centres
    than 0.6 of the mean height of the row with it, or 8. A fold over one page, as each row's mean decides on the next line.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["top", "left"], kind="stable").reset_index(drop=True)
        center, height = (page["top"] + page["bottom"]) / 2, (page["bottom"] - page["top"]).clip(lower=1.0)
        starts = [0]
        for i in range(1, len(page)):
            held = slice(starts[-1], i)
            if abs(center[i] - center[held].mean()) > max(8.0, 0.6 * height[starts[-1] : i + 1].mean()):
                starts.append(i)
        return page.assign(row=pd.Series(range(len(page))).map(lambda i: sum(s <= i for s in starts)).astype("int32"))

    return lines.groupBy("page").applyInPandas(fold, T.StructType([*lines.schema.fields, T.StructField("row", T.IntegerType())]))


def row_texts(rows: DataFrame) -> DataFrame:
    """page, row and text: the texts of each row of `row_clusters` from left to right, blank ones left out."""
    said = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("left", "top", "text"))))
    return rows.groupBy("page", "row").agg(F.btrim(F.array_join(F.transform(said, lambda x: x["text"]), " ")).alias("text")).filter("text <> ''")
