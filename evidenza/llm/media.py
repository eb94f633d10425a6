"""Media columns: content-addressed payloads in tar shards, and metadata from header-only range reads.

A payload is stored as an 8-bit grey PNG, 64 samples wide: lossless, and its width, height and depth stand in the first
33 bytes. Each task writes one tar shard and stores a payload once, under its digest; rows carry digest, shard, offset
and length. Shards of several tasks may hold the same payload; all rows then point to the same one of them.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, from_text, new_folder, read, text_or_empty, written

WIDTH = 64
#: Bytes of a stored payload that hold its metadata: signature and header chunk.
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A task begins a new shard beyond this size, so no shard outgrows a download.
SHARD_BYTES = 256 << 20


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """data and zero bytes, up to a positive multiple of width."""
    return data + b"\0" * (-len(data) % width if data else width)


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload as an 8-bit grey PNG."""
    height = len(payload) // width
    rows = b"".join(b"\0" + payload[i : i + width] for i in range(0, len(payload), width))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def header(stored: bytes) -> tuple[int, int, int]:
    """width, height and bits of a sample, from the first HEADER bytes."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", stored[16:25])


def decode(stored: bytes) -> bytes:
    width, height, _ = header(stored)
    (length,) = struct.unpack(">I", stored[HEADER : HEADER + 4])
    rows = zlib.decompress(stored[HEADER + 8 : HEADER + 8 + length])
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, height * (width + 1), width + 1))


def files(folder: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def stored(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, digest (of the payload), shard, offset and length for every row; payloads go to tar shards in folder.

    Null text counts as empty; an empty text is one row of zero samples. Equal texts share digest, shard and offset.
    A task that runs again writes shards of new names; rows only name shards of the run that counted.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = files(folder)
        system.create_dir(path, recursive=True)
        places: dict[bytes, tuple[str, int, int]] = {}
        out = sink = None
        name, used = "", 0
        try:
            for batch in batches:
                rows = []
                for text_ in batch["_text"]:
                    raw = text_.encode()
                    payload = padded(raw)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in places:
                        if sink is None or used > SHARD_BYTES:
                            if sink is not None:
                                sink.close()
                                out.close()
                            name, used = f"{uuid.uuid4().hex}.tar", 0
                            out = system.open_output_stream(f"{path}/{name}")
                            sink = tarfile.open(fileobj=out, mode="w|")
                        data = encode(payload)
                        member = tarfile.TarInfo(f"{digest.hex()}.png")
                        member.size = len(data)
                        sink.addfile(member, io.BytesIO(data))
                        places[digest] = (name, used + tarfile.BLOCKSIZE, len(data))
                        used += tarfile.BLOCKSIZE + -(-len(data) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
                    rows.append((len(raw), digest, *places[digest]))
                yield pd.DataFrame(rows, columns=["n_bytes", "digest", "shard", "offset", "length"]).assign(_key=batch["_key"].to_numpy())
        finally:
            if sink is not None:
                sink.close()
                out.close()

    rows = docs.select(as_text(key), text_or_empty(text).alias("_text"))
    found = written(rows.mapInPandas(write, "n_bytes long, digest binary, shard string, offset long, length long, _key string"), "media-rows", "zstd")
    one = found.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("_at"))
    return (
        found.drop("shard", "offset", "length")
        .join(written(one, "media-index", "zstd"), "digest")
        .select(from_text(docs, key).alias(key), "n_bytes", F.lower(F.hex("digest")).alias("digest"), "_at.shard", "_at.offset", "_at.length")
    )


def ranges(rows: DataFrame, folder: str, columns: str, of, whole: bool) -> DataFrame:
    """A row for each digest: `columns` as `of` computes them from the stored bytes, or from their header only.

    Reads follow shard and offset, so each task goes forward through few files.
    """
    kind = rows.schema["digest"].dataType.simpleString()
    distinct = rows.groupBy("digest", "shard", "offset", "length").agg(F.lit(1).alias("_one"))
    tasks = distinct.select("digest", "shard", "offset", "length").repartition("shard", F.shiftright("offset", 24)).sortWithinPartitions("shard", "offset")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = files(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(batch["digest"], batch["shard"], batch["offset"], batch["length"], strict=True):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, system.open_input_file(f"{path}/{shard}")
                source.seek(int(offset))
                out.append((digest, *of(source.read(int(length) if whole else HEADER))))
            yield pd.DataFrame(out, columns=["digest", *[c.split()[0] for c in columns.split(", ")]])
        if source is not None:
            source.close()

    return tasks.mapInPandas(fetch, f"digest {kind}, {columns}")


def metadata(rows: DataFrame, folder: str) -> DataFrame:
    """digest, width, height and bits of each payload, from its first bytes only."""
    return ranges(rows, folder, "width int, height int, bits int", header, whole=False)


def features(rows: DataFrame, folder: str) -> DataFrame:
    """digest and what the read-back samples give: sizes, digests, and a feature string of their range, sum and edges."""

    def of(data: bytes) -> tuple:
        import numpy as np

        width, height, bits = header(data)
        payload = decode(data)
        x = np.frombuffer(payload, dtype=np.uint8)
        steps = int(np.abs(np.diff(x.astype(np.int16))).sum())
        said = f"{width}x{height}x{bits} min={x.min()} max={x.max()} sum={int(x.sum(dtype=np.int64))} steps={steps}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), said

    return ranges(rows, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", of, whole=True)


def op10_media(spark, sf_dir):
    """Every document's payload as stored in tar shards and read back: sizes, digests, feature and header columns."""
    folder = new_folder(spark, "media")
    # Digests move as bytes, at half the size of their hexadecimal form.
    rows = written(unhexed(stored(read(spark, sf_dir, "documents").select("doc_id", "text"), folder), "digest"), "media-stored", "zstd")
    meta = written(metadata(rows, folder), "media-meta", "zstd")
    found = written(unhexed(features(rows, folder), "payload_sha256", "media_sha256"), "media-features", "zstd")
    hexed = {c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")}
    return rows.join(found.join(meta, "digest"), "digest").withColumns(hexed).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height"
    )


def unhexed(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({c: F.unhex(c) for c in names})
