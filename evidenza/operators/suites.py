"""Suites of rules for chunks, vectors, manifests, uploads, profiles and forms: each adds `reasons`, the rules that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sha256, strip
from .tables import expected

HEX = "^[0-9a-f]{64}$"
#: What may be uploaded, and its most bytes.
SUFFIXES, UPLOAD_BYTES = (".jpg", ".jpeg", ".png", ".pdf"), 15 * 1024 * 1024


def filled(name: str) -> Column:
    return strip(F.col(name).cast("string")) != ""


def grouped(df: DataFrame) -> DataFrame:
    """Adds what a chunk's group rules need: _same (rows of its id), and of its page _n, _distinct, _low, _high, _counts."""
    page = Window.partitionBy("document_id", "pdf_page")
    first = (F.row_number().over(Window.partitionBy("document_id", "pdf_page", "chunk_index").orderBy("chunk_id")) == 1).cast("int")
    rows = df.withColumns({"_same": F.count(F.lit(1)).over(Window.partitionBy("chunk_id")), "_first": first})
    named = {"_n": F.count(F.lit(1)), "_distinct": F.sum("_first"), "_low": F.min("chunk_index"), "_high": F.max("chunk_index"), "_least": F.min("chunk_count"), "_most": F.max("chunk_count")}
    return rows.withColumns({n: c.over(page) for n, c in named.items()})


def chunk_suite(df: DataFrame, max_chars: int | None = None, max_page: int | None = None, url: Column | None = None) -> DataFrame:
    """Chunks with their reasons. One id a row; a page's indexes run from 0 without a gap and its chunk_count is their number.

    max_chars, max_page and url (the address that a row must have) are checked if given.
    """
    rules = {n: filled(n) for n in ("chunk_id", "document_id", "article_title", "section_title", "source_url", "category", "content")}
    rules |= {
        "chunk_id_length": F.length("chunk_id") <= 64,
        "unique": F.col("_same") == 1,
        "pdf_page": (F.col("pdf_page") >= 1) & (F.lit(True) if max_page is None else F.col("pdf_page") <= max_page),
        "chunk_index": (F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("chunk_count")),
        "category_bytes": F.octet_length("category") <= 128,
        "tags": F.col("tags").isNotNull(),
        "searchable": F.col("searchable").isNotNull(),
        "content_hash": F.lower("content_hash").rlike(HEX) & (F.lower("content_hash") == sha256(F.col("content"))),
        "page_indexes": (F.col("_distinct") == F.col("_n")) & (F.col("_low") == 0) & (F.col("_high") == F.col("_n") - 1),
        "page_count": (F.col("_least") == F.col("_n")) & (F.col("_most") == F.col("_n")),
    }
    rules |= {} if max_chars is None else {"length": F.length("content") <= max_chars}
    rules |= {} if url is None else {"url": F.col("source_url") == url}
    return expected(grouped(df), rules).select(*df.columns, "reasons")


def vector_suite(df: DataFrame, width: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Vectors with their reasons: width, finite components, norm near 1, one row a key."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rules = {
        "key": filled(key),
        "unique": F.count(F.lit(1)).over(Window.partitionBy(key)) == 1,
        "width": F.size(vector) == width,
        "finite": ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        "norm": norm.between(0.99, 1.01),
    }
    return expected(df, rules)


def good_rows(checked: DataFrame, what: str = "rows") -> DataFrame:
    """The rows without their reasons; a row that breaks a rule is an error, as when a reader is bound to a suite."""
    said = F.concat(F.lit(f"{what}: "), F.concat_ws(",", "reasons"))
    return checked.withColumn("reasons", F.when(F.size("reasons") > 0, F.raise_error(said)).otherwise(F.col("reasons"))).filter(F.size("reasons") == 0).drop("reasons")


def manifest_suite(manifest: DataFrame, model: str, width: int, chunks: int, input_sha256: str) -> DataFrame:
    """A manifest with the names of those of its eight fields that differ from what they must be."""
    wanted = {
        "model_name": model, "embedding_dimension": width, "normalized": True, "chunk_count": chunks, "source_chunk_count": chunks,
        "selected_start_index": 0, "selected_end_index": chunks, "input_sha256": input_sha256,
    }
    have = {n: F.col(n) if n in manifest.columns else F.lit(None) for n in wanted}
    return expected(manifest, {n: have[n].cast("string") == F.lit(x).cast("string") for n, x in wanted.items()})


def records(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks with their vector, joined by id after a check that id, hash and page agree; otherwise an error.

    chunks: chunk_id, document_id, content_hash, pdf_page, category; vectors: chunk_id, content_hash, pdf_page, embedding.
    """
    v = vectors.select("chunk_id", F.col("content_hash").alias("_hash"), F.col("pdf_page").alias("_page"), "embedding")
    same = F.col("content_hash").eqNullSafe(F.col("_hash")) & F.col("pdf_page").eqNullSafe(F.col("_page"))
    checked = F.when(same, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("chunk and vector differ: "), "chunk_id")))
    cut = lambda n: F.left(F.col(n), F.lit(128)).alias(n)
    return chunks.join(v, "chunk_id", "full").select(cut("chunk_id"), "document_id", cut("content_hash"), "pdf_page", cut("category"), F.left(F.lit(model), F.lit(128)).alias("model_name"), checked.alias("embedding"))


def same_in_stores(hits: DataFrame, rows: DataFrame, model: str) -> DataFrame:
    """Hits (chunk_id, document_id, content_hash, pdf_page) with the columns in which they differ from their row; its model counts too."""
    names = ("document_id", "content_hash", "pdf_page", "model_name")
    kept = rows.select("chunk_id", *[F.col(n).alias(f"_{n}") for n in names])
    both = hits.withColumn("model_name", F.lit(model)).join(kept, "chunk_id", "left")
    return expected(both, {n: F.col(n) == F.col(f"_{n}") for n in names}).select(*hits.columns, "reasons")


def vector_filter(df: DataFrame, document_id: str | None = None, model_name: str | None = None) -> DataFrame:
    """Vectors of a document (64 hexadecimal digits) and a model (letters, digits and ._:/-); other values are an error."""
    import re

    if document_id is not None and not re.fullmatch("[0-9a-f]{64}", document_id):
        raise ValueError("document_id must be 64 hexadecimal digits")
    if model_name is not None and not re.fullmatch(r"[A-Za-z0-9._:/-]{1,128}", model_name):
        raise ValueError("model_name holds characters that it may not")
    for name, value in (("document_id", document_id), ("model_name", model_name)):
        df = df if value is None else df.filter(F.col(name) == value)
    return df


def upload_suite(files: DataFrame, name: str = "path", size: str = "length") -> DataFrame:
    """Uploads with their reasons: a known suffix in any case, not empty, at most 15 MB."""
    suffix = F.lower(F.regexp_extract(name, r"[^/\\](\.[^./\\]+)$", 1))
    return expected(files, {"suffix": suffix.isin(*SUFFIXES), "empty": F.col(size) > 0, "size": F.col(size) <= UPLOAD_BYTES})


def profile_suite(profiles: DataFrame) -> DataFrame:
    """Profiles with their reasons: height 30 to 260 cm and weight 1 to 400 kg, if they are there."""
    within = lambda n, low, high: F.col(n).isNull() | F.col(n).try_cast("double").between(low, high)
    return expected(profiles, {"height_cm": within("height_cm", 30, 260), "weight_kg": within("weight_kg", 1, 400)})


def form_suite(forms: DataFrame) -> DataFrame:
    """Forms (email, password, question) with their reasons; email comes back stripped and in lower case."""
    email = F.lower(strip(F.col("email")))
    rules = {
        "email": F.length("email").between(5, 254) & F.contains(email, F.lit("@")) & F.contains(F.substring_index(email, "@", -1), F.lit(".")),
        "password": F.length("password").between(8, 128) & F.col("password").rlike("\\p{L}") & F.col("password").rlike("\\p{Nd}"),
        "question": F.length("question").between(2, 1000),
    }
    return expected(forms, rules).withColumn("email", email)
