"""Readers and writers: strict and lenient JSON lines, manifests, embedding bundles, layout lists, tables by key."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import clean_report, confidence, strip


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines count) and value of text files, which Spark may split.

    A split's lines come in order, so a line's number is its place in the split and the lines of the splits before it in
    its file: one pass counts the lines of splits, another joins the counts.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", at.alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_at.file").orderBy("_at.start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(starts, "_at").select("_at.file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def jsonl_strict(spark: SparkSession, path: str, schema: str, ordinals: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected lines (file, line, value) that are not an object of the schema; blank lines count for neither.

    With ordinals, good rows also carry file and line, the order in which sources hold them.
    """
    fields = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    lines = numbered_lines(spark, path).filter(F.btrim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    own = ["file", "line"] if ordinals else []
    return parsed.filter(~bad).select("_r.*", *own).drop("_bad"), parsed.filter(bad).select("file", "line", "value")


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of the lines; other JSON values and blank lines are dropped, a line that isn't JSON is an error."""
    lines = spark.read.text(path).filter(F.btrim("value") != "")
    checked = F.when(F.try_parse_json("value").isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.left("value", F.lit(80))))).otherwise(F.col("value"))
    rows = lines.select(checked.alias("value")).filter(F.startswith(F.ltrim("value"), F.lit("{")))
    return rows.select(F.from_json("value", schema).alias("_r")).select("_r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def embedding_bundle(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, chunk_id, content_hash, pdf_page, embedding of NumPy bundles; pickled arrays are refused."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    n = len(z["chunk_ids"])
                    yield pd.DataFrame({"file": [file] * n, "ordinal": range(n), "chunk_id": z["chunk_ids"].astype(str), "content_hash": z["content_hashes"].astype(str), "pdf_page": z["pdf_pages"], "embedding": list(z["embeddings"].astype("float32"))})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "file string, ordinal long, chunk_id string, content_hash string, pdf_page long, embedding array<float>")


def layout_blocks(spark: SparkSession, path: str, trees: bool = False) -> DataFrame:
    """Blocks of layout lists, bare or as `content_list`: folder, file, ordinal, kind, text, page (from 1), box, level.

    Of each folder (with trees: of each folder below path and all below that) the first file that has a block is read: content_list.json, then the others by name. Files that aren't such
    lists and blocks without text are skipped. A list as text is joined by newlines; each field has more than one name.
    """
    file = F.input_file_name()
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.regexp_extract(file, f"^(.*/{re.escape(path.rstrip('/').rsplit('/', 1)[-1])}/[^/]+)/" if trees else "^(.*)/", 1).alias("folder"), file.alias("file"), F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.content_list", "array<variant>"))
    b = whole.select("folder", "file", F.posexplode(listed).alias("ordinal", "b"))
    get = lambda n, kind="string": F.try_variant_get("b", f"$.{n}", kind)
    said = lambda n: F.nullif(F.coalesce(F.array_join(get(n, "array<string>"), "\n"), get(n)), F.lit(""))
    text = F.coalesce(*[said(n) for n in ("text", "content", "table_body")], F.lit(""))
    page = F.coalesce(get("page_idx", "int") + 1, get("page_no", "int"), get("page_number", "int"), F.lit(1))
    box = F.coalesce(get("bbox", "array<double>"), get("box", "array<double>"))
    rows = b.select(
        "folder", "file", "ordinal", F.lower(F.coalesce(F.nullif(get("type"), F.lit("")), F.nullif(get("block_type"), F.lit("")), F.lit("text"))).alias("kind"),
        clean_layout_block(text).alias("text"), F.greatest(F.lit(1), page).alias("page"), F.when(F.size(box) == 4, box).alias("box"),
        F.coalesce(F.nullif(get("text_level", "int"), F.lit(0)), get("level", "int")).alias("level"),
    ).filter("text <> ''")
    rank = F.struct(~F.endswith("file", F.lit("/content_list.json")), "file")
    first = rows.groupBy("folder").agg(F.min(rank).alias("_r")).select("folder", F.col("_r.file").alias("file"))
    return rows.join(first, ["folder", "file"], "left_semi")


def clean_layout_block(c: Column) -> Column:
    """Blanks squashed, three or more newlines to two, edges stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "[ \\t]+", " "))


def page_texts(files: DataFrame, extractor, content: str = "content") -> DataFrame:
    """files without their bytes, a row a page with text: page (from 1), text (cleaned) and error.

    extractor() gives a function from bytes to the texts of pages, and is called in each task. Blank pages are left out.
    A file that it fails on is one row without page and text, with the error.
    """
    kind = "array<struct<page:int,text:string,error:string>>"

    def extracted(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pages_of = extractor()
        for column in columns:
            out = []
            for data in column:
                try:
                    out.append([(i, t, None) for i, t in enumerate(pages_of(data), 1) if t and t.strip()] if data is not None else [])
                except Exception as error:  # whatever a foreign extractor raises belongs to its file
                    out.append([(None, None, f"{type(error).__name__}: {error}")])
            yield pd.Series(out)

    pages = F.explode(F.pandas_udf(extracted, kind)(F.col(content))).alias("_p")
    rows = files.select(F.struct(*[c for c in files.columns if c != content]).alias("_row"), pages)
    return rows.select("_row.*", "_p.page", clean_report(F.col("_p.text")).alias("text"), "_p.error").filter("error IS NOT NULL OR text <> ''")


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds text: bytes as UTF-8, GB18030 or Latin-1, the first that reads and holds a digit, cleaned; none or null: empty."""
    from pyspark.sql.functions import pandas_udf

    def reads(data: bytes | None) -> str:
        for name in ("utf-8", "gb18030", "latin-1") if data else ():
            try:
                said = data.decode(name)
            except UnicodeDecodeError:
                continue
            if any(c.isdigit() for c in said):
                return said
        return ""

    read = pandas_udf(lambda s: s.map(reads), "string")
    return files.withColumn("text", clean_report(read(F.col(content))))


def scan_lines(records: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines of scans, records with texts, scores and boxes side by side: position, line, score, box, and all other columns.

    A line without a score has 1. Blank lines and those below `least` are dropped.
    """
    rest = [c for c in records.columns if c not in ("texts", "scores", "boxes")]
    rows = records.select(*rest, F.posexplode("texts").alias("position", "line"), "scores", "boxes")
    at = lambda c: F.try_element_at(c, F.col("position") + 1)
    rows = rows.select(*rest, "position", strip(F.col("line")).alias("line"), confidence(at("scores")).alias("score"), at("boxes").alias("box"))
    return rows.filter((F.col("line") != "") & (F.col("score") >= least))


def rows_in_order(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the ids asked for, in the order asked; the list comes from the caller and is small."""
    wanted = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"{key} {df.schema[key].dataType.simpleString()}, _at int")
    return df.join(F.broadcast(wanted), key).orderBy("_at").drop("_at")


def replaced_partition(df: DataFrame, path: str, key: str) -> None:
    """Rewrites only the partitions of the keys in df."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def rejected(df: DataFrame, path: str) -> DataFrame:
    """Writes rows with reasons beside the good ones and returns the good ones."""
    df.filter(F.size("reasons") > 0).write.mode("append").json(path)
    return df.filter(F.size("reasons") == 0).drop("reasons")
