"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents are tokenised and cut where they exceed a sequence. Documents and gaps are sorted by size, longest first, a
gap before the documents that it just holds. In that order a gap opens a level and a document closes the last level
open, which is its successor: the narrowest gap that no longer document takes. So a round gives every gap one document
at most; documents that propose the same gap are told apart by rank. Levels follow from the counts of each size and a
row's rank within its size, so Spark matches rows by a window over each level, updates the gaps, and goes on until no
document is left. For documents that no gap can take, now or later, as many sequences open as their lengths fill at least.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, as_text, from_text, read, text_or_empty, with_rank, written

CAPACITY = 1024
END = 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@functools.cache
def tokenizer(name: str = TOKENIZER, ranks: str = RANKS):
    """text -> its ids as little-endian 32-bit numbers.

    The vocabulary's ranks give the same ids faster; texts that hold a special token's string go through the vocabulary.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(text: str) -> bytes:
        if any(s in text for s in special):
            found = whole.encode(text, add_special_tokens=False).ids
        else:
            found = fast.encode_ordinary(text)
        return np.array(found, dtype="<u4").tobytes()

    return ids


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, vocabulary: str = TOKENIZER) -> DataFrame:
    """key, piece, start, length and ids_crc32 of every piece, in one pass without a shuffle.

    A document is its ids and the end id, so null and empty texts are one piece of length 1. A document longer than the
    capacity is cut into pieces of it; the first piece takes what is over. Equal rows give equal pieces.
    Keys come back as they are, large ones beside nulls too; other columns play no part.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = tokenizer(vocabulary)
        for batch in batches:
            out = []
            for k, t in zip(batch["_key"], batch["_text"], strict=True):
                packed = ids(t) + end.to_bytes(4, "little")
                n = len(packed) // 4
                first = n - (n - 1) // capacity * capacity
                bounds = [0, *range(first, n + 1, capacity)]
                out += [(k, i, a, b - a, zlib.crc32(packed[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            yield pd.DataFrame(out, columns=["_key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(as_text(key), text_or_empty(text).alias("_text"))
    found = rows.mapInPandas(cut, "_key string, piece int, start long, length long, ids_crc32 long")
    return found.select(from_text(docs, key).alias(key), "piece", "start", "length", "ids_crc32")


def swept(docs: dict[int, int], gaps: dict[int, int], rooms: dict[int, int], capacity: int, per: int) -> list[tuple[int, int, int, int, int]]:
    """(size, level below its gaps, gaps there were, sequences opened, documents matched) for each size, long to short.

    docs, gaps and rooms (gaps before they are cut in parts): rows by size, of which there are at most as many as a
    sequence has tokens; per: documents that a new sequence takes in this round. Documents without a gap wait for what
    longer ones leave of theirs, as far as that can hold them; beyond that as many sequences open as they fill at least.
    Those over half a sequence share none with each other.
    """
    out, level, lost, new = [], 0, 0, 0
    for size in sorted(docs.keys() | gaps.keys(), reverse=True):
        below, n = level, docs.get(size, 0)
        level += gaps.get(size, 0)
        over, opens = max(0, n - level), 0
        lost += over
        if over:
            wait = sum(c * (room // size - 1) for room, c in rooms.items() if room >= 2 * size)
            fill = -(-(max(0, lost - wait) * size) // capacity)
            opens = min(-(-over // per), over if 2 * size > capacity else max(0, fill - new))
            new += opens
            level += opens * per
        matched = min(n, level)
        out.append((size, below, gaps.get(size, 0), opens, matched))
        level -= matched
    return out


#: New sequences that one row of their plan stands for.
CHUNK = 1 << 16
#: Of a size in one round: levels below its gaps, gaps there were, levels with new sequences, the first of these, their number, ranks placed.
CLASS = ["_size", "_below", "_old", "_level", "_first", "_opens", "_from", "_to"]


def packed(parts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """parts (with length, at most capacity) and, for each, sequence_id and offset: places gapless from 0. No rows: none.

    Where the longest document left is less than a quarter of a gap, the gap takes several in a round, one in each part.
    """
    spark = parts.sparkSession
    steps = Steps(spark, "pack")
    ranked = steps.written(with_rank(parts, ["length"], [key, "piece", "ids_crc32"], "_rank"), "ranked")
    left = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    done = dict.fromkeys(left, 0)
    gaps, sequences = spark.createDataFrame([], "_seq long, _room long"), 0
    names = ["_at", "_size", "_kind", "_seq", "_slot", "_room", "length", "_rank"]
    none = {c: F.lit(None).cast("long") for c in ("_seq", "_slot", "_room", "length", "_rank")}
    by_level = Window.partitionBy("_at").orderBy(F.desc("_size"), "_kind")
    before = Window.partitionBy("_seq").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    found: list[str] = []
    while left:
        # A table of at most `capacity` rows, whatever the corpus.
        rooms = {r["_room"]: r["n"] for r in gaps.groupBy("_room").agg(F.count(F.lit(1)).alias("n")).collect()}
        longest, shortest = max(left), min(left)
        times = lambda room: room // longest if room >= 4 * longest else 1
        counts: dict[int, int] = {}
        for room, n in rooms.items():
            counts[room // times(room)] = counts.get(room // times(room), 0) + n * times(room)
        per, so_far, classes = times(capacity), sequences, []
        for n, below, old, opens, m in swept(left, counts, rooms, capacity, per):
            classes.append((n, below, old, below + old + opens * per, sequences, opens, done.get(n, 0), done.get(n, 0) + m))
            sequences += opens
        fresh_ones = sequences > so_far
        # From Arrow the classes are rows of the plan itself: no job of their own.
        plan = spark.createDataFrame(pa.table(dict(zip(CLASS, map(pa.array, zip(*classes, strict=True)), strict=True))))
        size = F.broadcast(plan)
        n_times = F.when(F.col("_room") >= 4 * longest, F.floor(F.col("_room") / longest)).otherwise(1).cast("int")
        slots = gaps.select("_seq", F.lit(0).alias("_slot"), F.col("_room").alias("_size"), "_room")
        several = any(times(room) > 1 for room in rooms)
        if several:
            slots = gaps.withColumn("_times", n_times).select("_seq", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("_slot"), F.floor(F.col("_room") / F.col("_times")).alias("_size"), "_room")
        slots = with_rank(slots, ["_size"], ["_seq", "_slot"], "_gap").join(size.select("_size", "_below"), "_size")
        opens = slots.withColumns(none | {"_at": F.col("_below") + F.col("_gap"), "_kind": F.lit(0), "_seq": F.col("_seq"), "_slot": F.col("_slot").cast("long"), "_room": F.col("_room")})
        chunk = plan.filter("_opens > 0").withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_opens") - 1, F.lit(CHUNK).cast("long"))))
        fresh = chunk.repartition("_size", "_lo").withColumn("_i", F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + CHUNK, F.col("_opens")) - 1)))
        fresh = fresh.select((F.col("_first") + F.col("_i")).alias("_seq"), "_size", (F.col("_below") + F.col("_old") + F.col("_i") * per).alias("_base"))
        news = fresh.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per - 1).cast("long"))) if per > 1 else F.lit(0).cast("long"))
        news = news.withColumns(none | {"_at": F.col("_base") + F.col("_slot"), "_kind": F.lit(0), "_seq": F.col("_seq"), "_slot": F.col("_slot"), "_room": F.lit(capacity).cast("long")})
        docs = ranked.select(F.col("length").alias("_size"), "_rank").join(size, "_size").filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        closes = docs.withColumns(none | {"_at": F.col("_level") - 1 - (F.col("_rank") - F.col("_from")), "_kind": F.lit(1), "length": F.col("_size"), "_rank": F.col("_rank")})
        every = closes.select(*names)
        if rooms:
            every = every.unionByName(opens.select(*names))
        if fresh_ones:
            every = every.unionByName(news.select(*names))
        # The gap comes with its room, so that no join with the gaps is needed; parts of one gap fill it one after another.
        taken = every.withColumns({c: F.lag(c).over(by_level) for c in ("_seq", "_slot", "_room")}).filter("_kind = 1")
        earlier = F.coalesce(F.sum("length").over(before), F.lit(0)) if several or (fresh_ones and per > 1) else F.lit(0)
        if fresh_ones:
            gaps = gaps.unionByName(fresh.select("_seq", F.lit(capacity).cast("long").alias("_room")))
        placed = taken.withColumn("offset", (capacity - F.col("_room") + earlier).cast("long"))
        placed = steps.written(placed.select(F.col("_seq").alias("sequence_id"), "length", "_rank", "offset"), "placed")
        found.append(f"{steps.folder}/{steps.n}-placed")
        for n, *_, start, end in classes:
            if end > start:
                done[n] = end
                left[n] -= end - start
        left = {n: c for n, c in left.items() if c}
        used = placed.groupBy(F.col("sequence_id").alias("_seq")).agg(F.sum("length").alias("_used"))
        now = gaps.join(used, "_seq", "left").withColumn("_room", F.col("_room") - F.coalesce("_used", F.lit(0))).select("_seq", "_room")
        gaps = steps.written(now.filter(F.col("_room") >= min(left, default=shortest)), "gaps")
    schema = "sequence_id long, length long, _rank long, offset long"
    places = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return steps.result(ranked.join(places, ["length", "_rank"]).drop("_rank").select(*[c for c in parts.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset"))


def op7_pack(spark, sf_dir):
    """Every piece of every document with its sequence and its place there."""
    parts = written(pieces(read(spark, sf_dir, "documents").select("doc_id", "text")), "pack-pieces")
    return packed(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
