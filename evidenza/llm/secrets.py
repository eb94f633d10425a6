"""Secret scans: a keyword automaton first, anchored patterns only where a keyword stands, then checksums.

Kinds: assign, access and hex are found by shape; github and npm tokens also carry a CRC-32 of themselves, so only
tokens whose checksum is right are reported.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, from_text, read, text_or_empty

# The keywords and shapes of each kind.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
CHECKED_SHAPE = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST = {"assign": 12, "access": 18}


def checksum(body: str) -> str:
    """The six base-62 digits that such a token ends with: the CRC-32 of its body."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE_62[digit] + out
    return out


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in (*ASSIGN_WORDS, "akia", *CHECKED):
        found.add_word(word, word)
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """Lower case with every character in its place, as a few characters grow longer in lower case."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def scan(text: str, words) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret; spans of one kind don't overlap."""
    spans: list[tuple[int, int, str]] = []
    ends = {"assign": 0, "access": 0}
    hits = sorted((end - len(word) + 1, word) for end, word in words.iter(folded(text)))
    for start, word in hits:
        if word in CHECKED:
            m = CHECKED_SHAPE.match(text, start)
            if m and checksum(m[1]) == m[2]:
                spans.append((start, m.end(), CHECKED[word]))
            continue
        kind, shape, part = ("access", ACCESS, 0) if word == "akia" else ("assign", ASSIGN, 2)
        if start < ends[kind]:
            continue
        m = shape.match(text, start)
        if m:
            ends[kind] = m.end()
            if len(m[part]) >= LEAST[kind]:
                spans.append((start, m.end(), kind))
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and spans (start, end, kind; code points, end exclusive) for every row, in one pass without a shuffle.

    Null and empty texts have no spans. Equal rows give equal rows. Whole texts are scanned. Keys come back as they
    are, large ones beside nulls too; other columns play no part. No rows: none.
    """
    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = automaton()
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t, words)] for t in batch["_text"]]
            yield pd.DataFrame({"_key": batch["_key"], "spans": found})

    rows = docs.select(as_text(key), text_or_empty(text).alias("_text"))
    found = rows.mapInPandas(scanned, "_key string, spans array<struct<start:int,end:int,kind:string>>")
    return found.select(from_text(docs, key).alias(key), "spans")


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by the mask; null stays null. Only the text passes through Python."""

    def without(t: str, words) -> str:
        parts, done = [], 0
        for s, e, _ in scan(t, words):
            if s >= done:
                parts += [t[done:s], mask]
            done = max(done, e)
        return "".join([*parts, t[done:]])

    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = automaton()
        for batch in texts:
            yield pd.Series([without(t, words) if isinstance(t, str) else None for t in batch], dtype=object)

    return docs.withColumn(text, F.pandas_udf(masked, "string")(F.col(text)))


def op5_secrets(spark, sf_dir):
    """Counts, digest and list of the secrets of every document, base kinds and those with checksums."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return secrets(docs).select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
        *[count(k) for k in KINDS[3:]],
    )
