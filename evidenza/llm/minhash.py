"""MinHash near-duplicates with DartMinHash signatures.

A document is a weighted set: its five-word shingles, each weighing as often as it occurs. A unit of weight is a region
that darts hit as a Poisson process over ranks, the same in every document that holds it. Only darts below a rank that
falls with the document's weight are thrown, a few hundred whatever its length; each falls into one of the signature's
coordinates, and the earliest dart of each coordinate is kept. Two documents agree in a coordinate with the chance of
their weighted Jaccard similarity. Bands of coordinates give buckets. Each document is compared, on whole shingle sets,
with the first of its buckets, and what that joins is contracted; buckets that are of one component by then are done, of
the others the rest goes on, at last by the rarest shingles of each set, of which alike sets share one: block by block, so
that no link is lost, alike rows cost a pair for each bucket, and unlike rows of one bucket part without being compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, as_text, from_text, read, text_or_empty, written
from .graphs import components
from .hashing import U, counted, mix, shingles

WIDTH, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a bucket with a chance of 1 - (1 - 0.8^5)^25 = 0.99995.
BANDS, ROWS = 25, 5
#: Documents of a bucket on each side of a tile.
TILE = 128
#: Rows that all others of a bucket larger than a tile are compared with first.
LEADS = 16
#: Cells that the shingles of rows left are counted in.
CELLS = 1 << 20


def darts(elements: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranks up to `most` and identities of the darts that hit the elements' regions."""
    ranks, names = [], []
    if most > 2:
        steps = int(most + 8 * most**0.5 + 16)
        name = mix(elements[:, None] + U(0xE7037ED1A0B428DB) * np.arange(1, steps + 1, dtype=U)[None, :])
        rank = np.cumsum(-np.log(((mix(name) >> U(11)).astype(float) + 0.5) / (1 << 53)), axis=1)
        hit = rank <= most
        return rank[hit], name[hit]
    rank = np.zeros(len(elements))
    j = 0
    while len(elements):
        j += 1
        name = mix(elements + U(0xE7037ED1A0B428DB) * np.array([j], U))
        rank = rank - np.log(((mix(name) >> U(11)).astype(float) + 0.5) / (1 << 53))
        hit = rank <= most
        elements, rank, name = elements[hit], rank[hit], name[hit]
        ranks.append(rank)
        names.append(name)
    return (np.concatenate(ranks), np.concatenate(names)) if ranks else (rank, np.zeros(0, U))


def signature(elements: np.ndarray, size: int) -> np.ndarray:
    """The identity of the earliest dart in each of `size` coordinates."""
    thrown = size * np.log(size) + 2 * size
    while True:
        rank, name = darts(elements, thrown / len(elements))
        order = np.argsort(-rank, kind="stable")
        place = ((name[order] >> U(32)) % U(size)).astype(np.int64)
        out, filled = np.zeros(size, U), np.zeros(size, bool)
        out[place], filled[place] = name[order], True
        if filled.all():
            return out
        thrown *= 2


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=U) * U(0x8EBC6AF09C88C6E3)
    for column in sig.reshape(bands, rows).T:
        h = mix(h + column)
    return h.view(np.int64)


def signed(docs: DataFrame, text: str, key: str, width: int, bands: int, rows: int) -> DataFrame:
    """_id (of the row), _key, _sha (of the text), _bands and _set (of shingles, as 32-bit hashes)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["_text"]:
                elements = counted(shingles(t, width))
                sha = hashlib.sha256(t.encode()).hexdigest()[:32]
                if len(elements):
                    out.append((sha, bands_of(signature(elements, bands * rows), bands, rows), np.unique(elements.astype(np.uint32)).view(np.int32)))
                else:
                    out.append((sha, [], []))
            yield pd.DataFrame(out, columns=["_sha", "_bands", "_set"]).assign(_id=batch["_id"].to_numpy(), _key=batch["_key"].to_numpy())

    rows_ = docs.select(F.monotonically_increasing_id().alias("_id"), as_text(key), text_or_empty(text).alias("_text"))
    found = rows_.mapInPandas(sign, "_sha string, _bands array<long>, _set array<int>, _id long, _key string")
    return found.withColumn("_key", from_text(docs, key))


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of `left` and `right` are at least `threshold` alike."""
    sets = [*left, *right]
    size = np.array([len(s) for s in sets])
    value = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(value, kind="stable")
    value, row, n = value[order], row[order], len(left)
    shared = np.zeros((n, len(right)), np.float32)
    # A bounded number of distinct shingles at a time, as very long texts have very many.
    for lo in range(0, int(value[-1]) + 1, 8192):
        a, b = np.searchsorted(value, [lo, lo + 8192])
        part = np.zeros((len(sets), 8192), np.float32)
        part[row[a:b], value[a:b] - lo] = 1
        shared += part[:n] @ part[n:].T
    return shared >= (threshold - 1e-9) * (size[:n, None] + size[None, n:] - shared)


def forest(links: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links from each label to the smallest of its component: what the links join, without their number."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def to_leads(shared: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links a, b of the rows of shared (_id, _size, _bucket, _lead, _lead_size) that are `threshold` alike to a bucket's lead."""
    near = F.least("_size", "_lead_size") >= (threshold - 1e-9) * F.greatest("_size", "_lead_size")
    pairs = shared.filter(near & (F.col("_id") != F.col("_lead"))).select(F.col("_id").alias("a"), F.col("_lead").alias("b")).distinct()
    sets = lambda end: held.select(F.col("_id").alias(end), F.col("_set").alias(f"_{end}"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b")
    same = F.size(F.array_intersect("_a", "_b"))
    return both.filter(same >= (threshold - 1e-9) * (F.size("_a") + F.size("_b") - same)).select("a", "b")


def with_leads(rows: DataFrame) -> DataFrame:
    """rows (_id, _size, _bucket) of buckets with more than one row, with the bucket's smallest id and its size."""
    leads = rows.groupBy("_bucket").agg(F.min(F.struct("_id", "_size")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.join(leads.select("_bucket", F.col("_first._id").alias("_lead"), F.col("_first._size").alias("_lead_size")), "_bucket")


def several(rows: DataFrame) -> DataFrame:
    """The rows (_id, _size, _bucket, _label) of buckets that hold several labels. Of buckets with the same rows one is enough."""
    mixed = rows.groupBy("_bucket").agg(F.min("_label").alias("_a"), F.max("_label").alias("_b"), F.bit_xor(F.xxhash64("_id")).alias("_x"), F.sum(F.hash("_id").cast("long")).alias("_y"), F.count(F.lit(1)).alias("_n"))
    one = mixed.filter("_a <> _b").groupBy("_x", "_y", "_n").agg(F.min("_bucket").alias("_bucket"))
    return rows.join(one.select("_bucket"), "_bucket").select("_id", "_size", "_bucket", "_label")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the _label of their _id, which is the id itself where labels (node, label) have none."""
    return rows.join(labels.toDF("_id", "_label"), "_id", "left").withColumn("_label", F.coalesce("_label", "_id"))


def still_open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (_id, _size, _bucket, _label) besides the leads of buckets whose other rows are of several components.

    Leads have been compared with all of their bucket.
    """
    return several(labelled(shared.filter("_id <> _lead"), labels))


def by_rare(rest: DataFrame, held: DataFrame, threshold: float, steps: Steps | None = None, cells: int = CELLS) -> DataFrame:
    """The rows of rest (_id, _size, _label) once for each of their rarest shingles, which is the _bucket now.

    Sets that are `threshold` alike share that part of the larger at least, so in any one order of all shingles, one of the
    first size - ceil(threshold * size) + 1 of both is the same. The order here is by how many shingles of rest fall into a
    shingle's cell, of `cells` (a power of 2) by its last bits, then by value: what many rows share comes last, so unlike
    rows part here. Cells that several shingles share change the order only, never what meets. A worker holds the counts,
    8 bytes a cell, and orders a set where it stands: no row is made for a shingle but those that are among the first.
    """
    steps = steps or Steps(rest.sparkSession, "rare")
    ones = steps.written(rest.select("_id", "_size", "_label").distinct().join(held.select("_id", "_set"), "_id"), "unlike")
    cell = F.col("_shingle").bitwiseAND(F.lit(cells - 1))
    counts = ones.select(F.explode("_set").alias("_shingle")).groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).toArrow()
    often = np.zeros(cells, np.int64)
    often[counts["_cell"].to_numpy()] = counts["_n"].to_numpy()
    shared = rest.sparkSession.sparkContext.broadcast(often)  # `cells` fixes its size

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for batch in batches:
            found = [np.zeros(0, np.int32)]
            for shingle in batch["_set"]:
                n = often[shingle & (cells - 1)]
                first = np.lexsort((shingle, n))[: len(shingle) - math.ceil((threshold - 1e-9) * len(shingle)) + 1]
                found.append(shingle[first[n[first] > 1]])
            times = [len(x) for x in found[1:]]
            yield pd.DataFrame({c: np.repeat(batch[c].to_numpy(), times) for c in ("_id", "_size", "_label")} | {"_bucket": np.concatenate(found).astype(np.int64)})

    return ones.mapInPandas(rarest, "_id long, _size int, _bucket long, _label long")


def in_tiles(rest: DataFrame, held: DataFrame, threshold: float, tile: int, steps: Steps) -> DataFrame:
    """Links a, b between the labels of rest (_id, _bucket, _label): every pair in a bucket that no label joins yet.

    Rows of a bucket's largest label are not compared with each other, only with its other rows, block by block; a block
    gives one link at most for each label, so links stay fewer than labels however large the bucket.
    """
    by_label = rest.groupBy("_bucket", "_label").agg(F.count(F.lit(1)).alias("_n"))
    sizes = steps.written(by_label.groupBy("_bucket").agg(F.max(F.struct("_n", "_label")).alias("_most"), F.sum("_n").alias("_n")), "tiles")
    parts = lambda n: F.ceil(n / tile).cast("int")
    cut = sizes.select("_bucket", F.col("_most._label").alias("_major"), parts(F.col("_n") - F.col("_most._n")).alias("_few"), parts(F.col("_n")).alias("_all"))
    rows = rest.select("_id", "_bucket", "_label").join(cut, "_bucket").withColumn("_hash", F.xxhash64("_id"))
    deal = lambda n: F.pmod("_hash", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.filter("_label <> _major").withColumns({"_x": deal("_few"), "_side": F.lit(0)}).withColumn("_y", every("_all"))
    all_ = rows.withColumns({"_y": deal("_all"), "_side": F.lit(1)}).withColumn("_x", every("_few"))
    return compared(few, all_, held, threshold)


def compared(left: DataFrame, right: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links a, b between labels: rows (_id, _bucket, _label, _x, _y, _side) of left with those of right in the same _bucket, _x and _y."""
    names = ["_id", "_bucket", "_label", "_x", "_y", "_side"]
    tiles = left.select(*names).unionByName(right.select(*names)).join(held.select("_id", "_set"), "_id")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        left, right = (part[part["_side"] == side] for side in (0, 1))
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []})
        mine, other = left["_label"].to_numpy(), right["_label"].to_numpy()
        alike = linked(list(left["_set"]), list(right["_set"]), threshold) & (mine[:, None] != other[None, :])
        x, y = np.nonzero(alike)
        return pd.DataFrame(forest(set(zip(mine[x].tolist(), other[y].tolist(), strict=True))), columns=["a", "b"])

    return tiles.groupBy("_bucket", "_x", "_y").applyInPandas(compare, "a long, b long").distinct()


def to_some(large: DataFrame, held: DataFrame, threshold: float, tile: int, turn: int) -> DataFrame:
    """Links a, b between the labels of large (_id, _bucket, _label, _n): each row with up to LEADS rows of its bucket.

    Leads, others each turn, are copied once for each tile of the bucket and rows once, so what moves grows as the bucket.
    """
    rows = large.withColumns({"_all": F.ceil(F.col("_n") / tile).cast("int"), "_x": F.lit(0)})
    slot = F.pmod(F.xxhash64("_id", F.lit(turn)), F.lit(LEADS))
    leads = rows.groupBy("_bucket", "_all", "_x", slot.alias("_slot")).agg(F.min(F.struct(F.xxhash64(F.lit(turn), "_id").alias("h"), "_id", "_label")).alias("_lead"))
    left = leads.select("_lead._id", "_lead._label", "_bucket", "_x", F.lit(0).alias("_side"), F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("_y"))
    return compared(left, rows.withColumns({"_y": F.pmod(F.xxhash64("_id"), "_all").cast("int"), "_side": F.lit(1)}), held, threshold)


def contracted(rest: DataFrame, links: DataFrame, held: DataFrame, threshold: float, tile: int, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """rest (_id, _size, _bucket, _label) and links, after rows of buckets larger than a tile have met some of their bucket.

    That joins most of a large group of alike rows without its pairs; turns go on while each halves the labels there. No
    pair that no label joins yet is left out: rest keeps it.
    """
    before = turn = 0
    while True:
        sizes = rest.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile)
        large = steps.written(rest.join(sizes, "_bucket").select("_id", "_bucket", "_label", "_n"), "large")
        labels = large.select("_bucket", "_label").distinct().count()
        if not labels or before and 2 * labels > before:
            return rest, links
        before, turn = labels, turn + 1
        links = links.unionByName(steps.written(to_some(large, held, threshold, tile, turn), "links"))
        rest = steps.written(several(labelled(rest.drop("_label"), components(links, steps))), "again")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """For every row: key, class_id (the smallest key of its class), class_size, is_kept and _sha.

    Rows are of one class if a chain of links joins them: equal texts, or at least `threshold` alike in shingles. Null
    text counts as empty; texts without words are alike only if equal. is_kept marks one row of each class, the one of
    the smallest key; rows that repeat a key and text are told apart. _sha is of the text. Shingles are compared by 32
    bits of their hashes, so sets of m and n shingles share one by chance m * n / 2^32 times.
    A null key counts as larger than others; a class of null keys only has a null class_id. No rows: none.
    """
    steps = Steps(docs.sparkSession, "minhash")
    all_rows = steps.written(signed(docs, text, key, width, bands, rows), "rows")
    heads = steps.written(all_rows.groupBy("_sha").agg(F.min("_id").alias("_head")), "heads")
    # One row of each text goes on; its copies follow it in the end.
    ones = all_rows.join(heads.select(F.col("_head").alias("_id")), "_id", "left_semi")
    buckets = steps.written(ones.select("_id", F.size("_set").alias("_size"), F.explode("_bands").alias("_bucket")), "buckets")
    shared = steps.written(with_leads(buckets), "shared")
    steps.drop(buckets)
    held = steps.written(all_rows.select("_id", "_set").join(shared.select("_id").distinct(), "_id", "left_semi"), "sets")
    # Sets stand in `held` now where they are needed, so the wide rows go.
    narrow = steps.written(all_rows.select("_id", "_key", "_sha"), "narrow")
    steps.drop(all_rows)
    # Each row against the first of its buckets; then, of buckets that this leaves in several components, against the next.
    links = steps.written(to_leads(shared, held, threshold), "links")
    groups = components(links, steps)
    open_ = steps.written(still_open(shared, groups), "open")
    if not open_.isEmpty():
        second = steps.written(with_leads(open_.drop("_label")), "second")
        links = links.unionByName(steps.written(to_leads(second, held, threshold), "links"))
        open_ = steps.written(still_open(second, components(links, steps)), "open")
        # What is left is compared in full where a rare shingle is shared.
        rare = steps.written(by_rare(open_, held, threshold, steps), "rare")
        last, links = contracted(steps.written(several(rare), "last"), links, held, threshold, tile, steps)
        links = links.unionByName(steps.written(in_tiles(last, held, threshold, tile, steps), "links"))
        groups = components(links, steps)
    classes = heads.join(groups.withColumnRenamed("node", "_head"), "_head", "left").select("_sha", F.coalesce("label", "_head").alias("_class"))
    whole = steps.written(narrow.join(classes, "_sha"), "whole")
    first = F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_sha").alias("s"), F.col("_id").alias("i"))
    best = whole.groupBy("_class").agg(F.min(first).alias("_best"), F.count(F.lit(1)).alias("class_size"))
    return steps.result(whole.join(best, "_class").select(
        F.col("_key").alias(key), F.col("_best.k").alias("class_id"), "class_size", (F.col("_id") == F.col("_best.i")).alias("is_kept"), "_sha"
    ))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each class of near-duplicates, the one of the smallest key; all columns stay, whatever their names."""
    keep = near_duplicates(docs, text, key, **options).filter("is_kept").select("_sha", F.col(key).alias("_keep"))
    sha = F.substring(F.sha2(text_or_empty(text), 256), 1, 32)
    tagged = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), sha.alias("_sha"))
    kept = tagged.join(keep, "_sha").filter(F.col("_key").eqNullSafe(F.col("_keep"))).select("_row", "_key", "_sha")
    again = written(docs.select(F.col(key).alias("_k"), sha.alias("_s")).groupBy("_k", "_s").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "minhash-again")
    if again.isEmpty():
        return kept.select("_row.*")
    # Rows that repeat key and text: any one of them.
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s"))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["_key", "_sha"])).select("_row.*")


def op8_minhash(spark, sf_dir):
    """doc_id, class_id, class_size and is_kept of every document."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("_sha")
