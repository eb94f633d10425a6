"""Suffix-array dedup: bytes that a long enough string covers which also starts somewhere else.

Prefix doubling gives positions ranks of ever longer prefixes and drops a position once its rank is its own. Here a rank
is a class of equal strings, and positions are thinned first: of every `least` bytes, the string of SEED bytes with the
smallest hash is an anchor, so equal strings of that length have equal anchors at equal offsets, and one position in
about eighty is enough. Spark then reranks at growing lengths:

1. anchors by their SEED bytes; those alone in their class are done;
2. the others by all that a string over the anchor can reach; those that share it are covered as a whole;
3. those left by the strings over the anchor: a class that is small is sorted out in one task, a large one is split by
   the bytes that a quarter of its strings share, again and again, until classes are small or a string has full length.

Equal texts are one text here; copies get their result from it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_text, new_folder, read, released, text_or_empty, written
from .hashing import POWERS, Powers, U, between, mix, running, summed

LEAST = 200
SEED = 40
#: Rows of a class that one task compares; larger classes are split.
CLASS = 16384
#: Rows that a task compares at a time.
CHUNK = 4096
SECOND = Powers(0xC2B2AE3D27D4EB4F)


def anchors(data: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the smallest-hash seeds of all strings of `least` bytes."""
    n = len(data)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n - seed + 1)
    h = between(running(data), at, at + seed)
    width = least - seed + 1
    lowest = slid(h, width)
    # A seed is an anchor if it is the lowest of any string over it: the largest of their lowest is its own.
    edge = np.zeros(width - 1, U)
    highest = ~slid(~np.concatenate([edge, lowest, edge]), width)
    found = np.flatnonzero(highest == h)
    return found, h[found]


def slid(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of `width`."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def merged(spans: list, n: int) -> list[tuple[int, int]]:
    """The union of spans, as sorted runs."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, min(e, n)) for s, e in out]


def repeated(h: np.ndarray) -> np.ndarray:
    """Which values stand more than once."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def sorted_out(rows: pd.DataFrame, least: int, seed: int, step: int = 8) -> pd.DataFrame:
    """_uid, _start and _end of what repeats within the classes (_key) of rows, for rows that stand alone.

    rows: _key, _uid, _pos, _alone, _off (of the anchor in _data), _from and _to (string i starts i bytes before it).
    Goes through the strings `step` at a time: what they all share must repeat for any of them to, and if what they
    cover together repeats, all of them do; only in between are they compared one by one.
    """
    size = rows["_data"].map(len).to_numpy()
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    data = np.frombuffer(b"".join(rows["_data"]), np.uint8)
    # Powers by the place in the row, not in all the data: their tables stay as short as a row.
    place = np.arange(len(data), dtype=np.int32) - np.repeat(base.astype(np.int32), size)
    (up, down), (up2, down2) = POWERS.upto(int(size.max())), SECOND.upto(int(size.max()))
    sums, again = summed(data, up[place]), summed(data, up2[place])
    del place
    key, off = rows["_key"].to_numpy().view(U), rows["_off"].to_numpy()
    alone = rows["_alone"].to_numpy().astype(bool)
    first = np.maximum(rows["_from"].to_numpy(), least - (size - off))
    last = np.minimum(rows["_to"].to_numpy() - 1, off)

    def named(at: np.ndarray, back: int, length: int) -> np.ndarray:
        inside = off[at] - back
        start = base[at] + inside
        first_hash = mix((sums[start + length] - sums[start]) * down[inside])
        return first_hash + mix(key[at] ^ mix((again[start + length] - again[start]) * down2[inside]))

    twice = np.zeros((len(rows), least - seed + 3), bool)
    for lo in range(0, least - seed + 1, step):
        hi = min(lo + step, least - seed + 1)
        at = np.flatnonzero((np.maximum(first, lo) <= np.minimum(last, hi - 1)))
        if len(at) < 2:
            continue
        core = named(at, lo, least - (hi - 1 - lo))
        on = repeated(core)
        at, core = at[on], core[on]
        full = np.flatnonzero((first[at] <= lo) & (hi - 1 <= last[at]))
        done = np.zeros(len(at), bool)
        done[full] = repeated(named(at[full], hi - 1, least + hi - 1 - lo))
        twice[at[done], lo + 1 : hi + 1] = True
        open_ = alone[at] & ~done
        if open_.any():
            at = at[np.isin(core, core[open_])]
            for i in range(lo, hi):
                who = at[(first[at] <= i) & (i <= last[at])]
                twice[who[repeated(named(who, i, least))], i + 1] = True
    twice &= alone[:, None]
    edges = np.diff(twice.astype(np.int8), axis=1)
    row, lo = np.nonzero(edges == 1)
    hi = np.nonzero(edges == -1)[1] - 1
    pos, who = rows["_pos"].to_numpy()[row], rows["_uid"].to_numpy()[row]
    return pd.DataFrame({"_uid": who, "_start": pos - hi, "_end": pos - lo + least})


def texts_table(docs: DataFrame, text: str, key: str) -> DataFrame:
    """_uid, _doc, _n, _sha and _z (the compressed bytes) of every row, bucketed by _uid: joins on it leave texts in place."""
    spark = docs.sparkSession

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [t.encode() for t in batch["_text"]]
            yield pd.DataFrame(
                {"_uid": batch["_uid"], "_doc": batch["_doc"], "_n": [len(b) for b in raw], "_sha": [hashlib.sha256(b).hexdigest() for b in raw], "_z": [zlib.compress(b, 1) for b in raw]}
            )

    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(key).cast("string").alias("_doc"), text_or_empty(text).alias("_text"))
    packed = rows.mapInPandas(pack, "_uid long, _doc string, _n long, _sha string, _z binary").withColumn("_doc", from_text(docs, key, "_doc"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    packed.repartition(buckets, "_uid").write.bucketBy(buckets, "_uid").option("path", new_folder(spark, "texts")).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def cut_up(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """The batches in smaller ones: what a batch grows to stays small too."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows].reset_index(drop=True)


def on_texts(texts: DataFrame, rows: DataFrame, of, schema: str) -> DataFrame:
    """Joins rows (one for each _uid) to the texts and maps each text's bytes and row to the columns of `schema`."""
    names = [c.split()[0] for c in schema.split(", ")]
    others = [c for c in rows.columns if c != "_uid"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in cut_up(batches):
            parts = [of(uid, zlib.decompress(z), *rest) for uid, z, *rest in zip(batch["_uid"], batch["_z"], *[batch[c] for c in others], strict=True)]
            columns = [[p[i] for p in parts] for i in range(len(names))]
            yield pd.DataFrame({n: np.concatenate(c) if c and isinstance(c[0], np.ndarray) else [x for y in c for x in y] for n, c in zip(names, columns, strict=True)})

    return texts.select("_uid", "_z").join(rows, "_uid").mapInPandas(each, schema)


def refined(rows: DataFrame, least: int, seed: int, largest: int) -> DataFrame:
    """Spans of rows (written, as sorted_out takes them) whose classes may be of any size."""
    spans: DataFrame | None = None
    width = least - seed + 1

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in cut_up(batches, CHUNK):
            held.append(batch)
            n += len(batch)
            if n >= CHUNK:
                part = pd.concat(held)
                # Rows come by class; the last class may go on in the next batch.
                goes_on = (part["_key"] == part["_key"].iloc[-1]).to_numpy()
                held, n = [part[goes_on]], int(goes_on.sum())
                if not goes_on.all():
                    yield sorted_out(part[~goes_on], least, seed)
        if n:
            yield sorted_out(pd.concat(held), least, seed)

    def split(part: int):
        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in cut_up(batches):
                out = []
                for key, off, data, lo, hi in zip(batch["_key"], batch["_off"], batch["_data"], batch["_from"], batch["_to"], strict=True):
                    first, last = max(lo, least - (len(data) - off)), min(hi - 1, off)
                    for f in range(lo, hi, part):
                        t = min(f + part, hi)
                        if max(f, first) <= min(t - 1, last):
                            core = data[off - f : off - t + 1 + least]
                            name = hashlib.blake2b(core, digest_size=8, key=f"{key}/{f}".encode()).digest()
                            out.append((int.from_bytes(name, "little", signed=True), f, t))
                        else:
                            out.append(None)
                per = [len(range(lo, hi, part)) for lo, hi in zip(batch["_from"], batch["_to"], strict=True)]
                kept = batch.loc[batch.index.repeat(per)].reset_index(drop=True)
                there = [x is not None for x in out]
                kept = kept[there].copy()
                found = [x for x in out if x is not None]
                kept["_key"], kept["_from"], kept["_to"] = ([x[i] for x in found] for i in range(3))
                yield kept

        return cells

    while True:
        large = written(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > largest).drop("_m"), "suffix-large")
        none = large.isEmpty()
        small = rows if none else rows.join(large, "_key", "left_anti")
        found = small.repartition("_key").sortWithinPartitions("_key").mapInPandas(compare, "_uid long, _start long, _end long")
        spans = found if spans is None else spans.unionByName(found)
        if none:
            return spans
        hot = rows.join(large, "_key", "left_semi")
        if width == 1:  # the class shares a whole string
            whole = hot.filter("_alone").select("_uid", (F.col("_pos") - F.col("_from")).alias("_start"))
            return spans.unionByName(whole.withColumn("_end", F.col("_start") + least))
        width = -(-width // 4)
        rows = written(hot.mapInPandas(split(width), rows.schema), "suffix-cells")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, seed: int = SEED, largest: int = CLASS) -> DataFrame:
    """For every row: key, n_bytes, n_removed, n_spans (runs removed), kept_sha256 (of the bytes kept), spans.

    Removes each byte of a string of `least` bytes that starts at another place too, in the same text or another, judged
    on the texts as they come. Null text counts as empty; texts shorter than `least` lose nothing. Rows with equal texts
    of that length lose all of them, rows that repeat each other too. No rows: none.
    """
    texts = texts_table(docs, text, key)
    copies = written(texts.groupBy("_sha").agg(F.min("_uid").alias("_uid"), F.count(F.lit(1)).alias("_copies"), F.max("_n").alias("_n")), "suffix-copies")
    heads = copies.filter(F.col("_n") >= least).select("_uid")

    def seeds(uid, data):
        at, h = anchors(np.frombuffer(data, np.uint8), least, seed)
        return long(h), np.full(len(at), uid, np.int64), at.astype(np.int32)

    spark = docs.sparkSession
    found = written(on_texts(texts, heads, seeds, "_h long, _uid long, _pos int"), "suffix-anchors")
    shared = written(found.groupBy("_h").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m"), "suffix-shared")
    released(spark)
    reach = least - seed

    def contexts(uid, data, pos):
        x = np.frombuffer(data, np.uint8)
        pos = np.asarray(pos, np.int64)
        lo, hi = np.maximum(pos - reach, 0), np.minimum(pos + least, len(x))
        h = between(running(x), pos, pos + seed)
        context = between(running(x, SECOND), lo, hi, SECOND) + ((pos - lo).astype(U) << U(32))
        return long(h), long(mix(h ^ mix(context))), np.full(len(pos), uid, np.int64), pos.astype(np.int32)

    places = found.join(shared, "_h").groupBy("_uid").agg(F.collect_list("_pos").alias("_hits"))
    known = written(on_texts(texts, places, contexts, "_h long, _string long, _uid long, _pos int"), "suffix-contexts")
    released(spark)
    # A row for each different context, of any of its places.
    strings = written(
        known.groupBy("_string").agg(F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in ("_h", "_uid", "_pos")]), "suffix-strings"
    )
    released(spark)
    several = written(strings.groupBy("_h").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m"), "suffix-several")
    open_ = strings.join(several, "_h").groupBy("_uid").agg(F.collect_list("_pos").alias("_places"), F.collect_list(F.col("_c") == 1).alias("_alone"))

    def cut(uid, data, places, alone):
        pos = np.asarray(places, np.int64)
        lo = np.maximum(pos - reach, 0)
        keys = long(between(running(np.frombuffer(data, np.uint8)), pos, pos + seed))
        none = np.zeros(len(pos), np.int32)
        return keys, np.full(len(pos), uid, np.int64), pos, np.asarray(alone, bool), pos - lo, none, none + reach + 1, [data[a : p + least] for a, p in zip(lo, pos, strict=True)]

    columns = "_key long, _uid long, _pos long, _alone boolean, _off long, _from int, _to int, _data binary"
    rows = written(on_texts(texts, open_, cut, columns), "suffix-rows")
    released(spark)
    solved = written(refined(rows, least, seed, largest), "suffix-solved")
    released(spark)
    # Where a whole context repeats, so does all that stands in it; at a text's ends it is shorter.
    whole = written(known.join(strings.filter("_c > 1").select("_string"), "_string").select("_uid", "_pos"), "suffix-whole")
    released(spark)
    around = whole.groupBy("_uid").agg(F.collect_list("_pos").alias("_whole"))
    between_ = solved.groupBy("_uid").agg(F.collect_set(F.struct("_start", "_end")).alias("_spans"))
    by_text = around.join(between_, "_uid", "full")

    def remove(uid, data, places, found):
        around = [] if places is None else [(max(p - reach, 0), min(p + least, len(data))) for p in np.asarray(places).tolist()]
        runs = merged([x for x in around if x[1] - x[0] >= least] + [(s["_start"], s["_end"]) for s in ([] if found is None else found)], len(data))
        kept, done = [], 0
        for s, e in runs:
            kept.append(data[done:s])
            done = e
        kept.append(data[done:])
        left = b"".join(kept)
        return [uid], [len(data) - len(left)], [len(runs)], [hashlib.sha256(left).hexdigest()], [[list(r) for r in runs]]

    changed = written(on_texts(texts, by_text, remove, "_uid long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"), "suffix-changed")
    rows = texts.select("_uid", "_doc", "_n", "_sha").join(copies.select("_sha", "_copies"), "_sha").join(changed, "_uid", "left")
    all_ = (F.col("_copies") > 1) & (F.col("_n") >= least)
    pick = lambda name, gone, same: F.when(all_, gone).otherwise(F.coalesce(name, same)).alias(name)
    return rows.select(
        F.col("_doc").alias(key),
        F.col("_n").alias("n_bytes"),
        pick("n_removed", F.col("_n"), F.lit(0)),
        pick("n_spans", F.lit(1), F.lit(0)),
        pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("_sha")),
        pick("spans", F.array(F.array(F.lit(0).cast("long"), F.col("_n"))), F.array().cast("array<array<long>>")),
    ).withColumns({c: F.col(c).cast("long") for c in ("n_removed", "n_spans")})


def op1_suffix(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document: strings of 200 bytes that repeat go."""
    return repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
