"""Sharding by Karmarkar-Karp differencing.

Rows with equal text are one group and stay together. The sizes of groups are summed by Spark into items: a group of
its own if it is large, else a hash bucket of small groups. There are at most a fixed number of items, whatever the
input, and differencing them balances the shards; Spark then places every row by its item.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, text_or_empty, with_rank, written

SHARDS = 8
#: Hash buckets of small groups; a group above total / BUCKETS bytes is an item of its own, so both kinds number BUCKETS at most.
BUCKETS = 8192


def difference(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """item id -> shard for (item id, size) pairs.

    Each item starts as a partition with all but one part empty. The two partitions with the largest spread are
    combined, the heaviest part of one with the lightest of the other, until one is left.
    """
    if not items:
        return {}
    heap: list[tuple[int, int, list[tuple[int, list]]]] = []
    for order, (item, size) in enumerate(sorted(items, key=lambda x: (-x[1], x[0]))):
        heap.append((-size, order, [(size, [item]), *[(0, []) for _ in range(shards - 1)]]))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = [(x[0] + y[0], [x[1], y[1]]) for x, y in zip(a, reversed(b), strict=True)]
        parts.sort(key=lambda x: -x[0])
        least = parts[-1][0]
        heapq.heappush(heap, (least - parts[0][0], order, [(s - least, members) for s, members in parts]))
        order += 1
    placed: dict[int, int] = {}
    for shard, (_, members) in enumerate(heap[0][2]):
        stack = [members]
        while stack:
            for x in stack.pop():
                if isinstance(x, list):
                    stack.append(x)
                else:
                    placed[x] = shard
    return placed


def sharded(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """key, size (UTF-8 bytes plus 1), text_crc32, shard and slot (a gapless place in the shard) for every row.

    Null text counts as empty for grouping and has size 1 and crc 0. Equal texts share a shard. No rows: none.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select(
            F.col(key).alias("_key"),
            (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"),
            F.crc32(text_or_empty(text)).alias("text_crc32"),
            F.xxhash64(text_or_empty(text)).alias("_group"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")), "shard-groups")
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    large = groups.filter(F.col("_bytes") > total / buckets).select("_group", F.lit(True).alias("_large"), "_bytes")
    bucket = F.pmod(F.shiftright("_group", 8), F.lit(buckets))
    small = groups.filter(F.col("_bytes") <= total / buckets).groupBy(bucket.alias("_item")).agg(F.sum("_bytes").alias("_bytes"))
    # At most `buckets` rows each: the sums that differencing needs, not the rows.
    heavy = [(r["_group"], r["_bytes"]) for r in large.collect()]
    light = [(r["_item"], r["_bytes"]) for r in small.collect()]
    items = [((0, k), b) for k, b in light] + [((1, k), b) for k, b in heavy]
    ids = {k: i for i, (k, _) in enumerate(items)}
    placed = difference([(ids[k], b) for k, b in items], shards)
    plan = spark.createDataFrame([(kind == 1, k, placed[i]) for (kind, k), i in ids.items()], "_large boolean, _item long, shard int")
    tagged = rows.join(F.broadcast(large.drop("_bytes")), "_group", "left").withColumns(
        {"_large": F.coalesce("_large", F.lit(False))}
    ).withColumn("_item", F.when(F.col("_large"), F.col("_group")).otherwise(bucket))
    out = tagged.join(F.broadcast(plan), ["_large", "_item"]).select("_key", "size", "text_crc32", "shard", "_group")
    return with_rank(out, ["shard"], ["_key", "text_crc32", "_group"], "slot").select(F.col("_key").alias(key), "size", "text_crc32", "shard", "slot")


def op6_shard(spark, sf_dir):
    """Size, shard and slot of every document, by the law of bytes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
