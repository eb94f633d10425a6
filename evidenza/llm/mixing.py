"""Mixing sources to target weights: a time-varying curriculum. DataFrame functions only.

Each source has a target share of all words and a schedule, the relative weight it has at each point of the training
run. The integral of the schedule, scaled to the target, is the source's cumulative demand; a document that begins after
c words of its source is trained on where that demand reaches c, so inverting the demand gives its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CELLS, fresh, text_or_empty, written

WEIGHTS = (5, 2, 1)
#: Slope of each weight's schedule over the run, from -1 to 1: heavy sources gain, light ones fade.
SLOPES = (0.5, 0.0, -0.5)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = MOST_REPEATS) -> DataFrame:
    """One row a source (_sk, _source, source_size) in; adds target and slope.

    Shares all words by weight; a target above cap times its source stops there and the rest is shared again by weight.
    With sources in the order of cap / weight, those that stop form a prefix, so one pass of running sums finds the
    level at which the others fill up.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_source").isNull(), "_source")) - 1
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))
    x = sources.select("*", at(weights).alias("_w"), at(slopes).alias("slope")).withColumn("_cap", F.col("source_size") * float(cap))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_sk")
    everything = Window.partitionBy(F.lit(0))
    stopped = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - stopped) / F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("_level", level)
    fills = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    return x.withColumn("_fill", F.coalesce(F.max(fills).over(everything), F.lit(0.0))).select(
        "_sk", "source_size", F.least("_cap", F.col("_fill") * F.col("_w")).alias("target"), "slope"
    )


def position(used: Column, slope: Column) -> Column:
    """Where the demand u(t) = t + slope * (t^2 - t) reaches the share `used` of its target; 0 to 1."""
    lead = 1 - slope
    root = F.sqrt(F.greatest(lead * lead + 4 * slope * used, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, used).otherwise((root - lead) / (2 * slope))


#: Columns that `mixed` works with; columns of docs that are called so are set aside meanwhile.
OWN = ("_source", "_sk", "_hash", "_cell", "_words", "_first", "_at")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, slopes=SLOPES, cap: int = MOST_REPEATS, cells: int = CELLS) -> DataFrame:
    """All rows of docs with all their columns, and size, source_size, target, taken, taken_by_copy, positions.

    The words of a source come in the order of a hash of key and text, again from the start when they run out, up to
    cap times; taken_by_copy are the words taken in each round through the source and positions the points of the run
    (0 to 1) at which they start. Only the last document of a source is taken in part. Null text: size 0. Null source: a
    source of its own, last in order. Equal rows: any of them may be the one taken in part. No rows: none.
    The columns added win over columns of these names in docs.
    """
    added = ("size", "source_size", "target", "taken", "taken_by_copy", "positions")
    aside = {c: fresh(f"_mix{i}", docs.columns) for i, c in enumerate(docs.columns) if c.lower() in OWN or c.lower() == "slope"}
    docs = docs.withColumnsRenamed(aside)
    text, source, key = (aside.get(c, c) for c in (text, source, key))
    rows = docs.drop(*[c for c in added if c not in (text, source, key)]).withColumns(
        {
            "size": word_count(text),
            "_source": F.col(source),
            "_sk": F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)),
            "_hash": F.xxhash64(F.col(key), F.col(text)),
        }
    ).withColumn("_cell", F.pmod(F.shiftright("_hash", 20), F.lit(cells)).cast("int"))
    by_cell = written(rows.groupBy("_sk", "_source", "_cell").agg(F.sum("size").alias("_words")), "mix-cells")
    goals = targets(by_cell.groupBy("_sk", "_source").agg(F.sum("_words").alias("source_size")), weights, slopes, cap)
    before = Window.partitionBy("_sk").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.select("_sk", "_cell", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_first")).join(goals, "_sk")
    inside = Window.partitionBy("_sk", "_cell").orderBy("_hash", key).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_first") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    out = rows.join(written(starts, "mix-starts"), ["_sk", "_cell"]).withColumn("_at", at)
    begins = [F.col("_at") + i * F.col("source_size") for i in range(cap)]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - b)).cast("long") for b in begins]
    spots = [F.when(t > 0, position(b / F.col("target"), F.col("slope"))) for b, t in zip(begins, takes, strict=True)]
    return (
        out.withColumns({"taken_by_copy": F.array(*takes), "positions": F.array_compact(F.array(*spots))})
        .withColumn("taken", F.aggregate("taken_by_copy", F.lit(0).cast("long"), lambda a, x: a + x))
        .drop(*OWN, "slope")
        .withColumnsRenamed({new: old for old, new in aside.items()})
    )


def schedule(mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix's rows in training order: range-sorted by first position, rows that are not trained on last, by key."""
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))
    return mix.withColumn("_first", first).sort("_first", key).drop("_first")


def trained(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """docs as the mix trains on them, range-sorted by position: a row for each copy, cut after the words taken; others go.

    A copy taken whole keeps its text; one taken in part keeps its leading words with one space between them. Copies at
    one position come by key. No other column changes, whatever its name.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(key).alias("doc_id"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Copies are taken from the first on, so the copies taken and their positions go together.
    copies = mixed(packed, **options).select("_row", "text", "doc_id", "size", "positions", F.posexplode("taken_by_copy").alias("_at", "_copy")).filter("_copy > 0")
    cut = F.when(F.col("_copy") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_copy").cast("int")), " "))
    ordered = copies.sort(F.try_element_at("positions", F.col("_at") + 1), "doc_id")
    return ordered.select(*[(cut if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op2_mix(spark, sf_dir):
    """doc_id, size, source_size, target, taken and positions of every document, in training order."""
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "positions")
    return schedule(written(mix, "mix"))
