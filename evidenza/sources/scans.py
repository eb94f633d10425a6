"""Lines of character-recognition payloads whose shape is not known beforehand, over variant values.

A payload is JSON: objects that nest their fields under "res" or "data", objects with texts, scores and boxes side by side,
lists of any of these, and pairs of a box and a text with its score. Each level of nesting is one generator, so a payload
is walked without a shuffle and in order; what is no line is left out, and deeper nesting than asked for is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_report

# Names that fields go by, the first with a value counts.
TEXTS, SCORES, BOXES = ("rec_texts", "texts", "rec_text"), ("rec_scores", "scores", "rec_score"), ("rec_polys", "dt_polys", "boxes", "rec_boxes")
NOWHERE = [[0.0, 0.0]] * 4
LEVELS = 8


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, or the type of a single value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def items(v: Column) -> Column:
    """The elements of a list; of anything else none."""
    return F.coalesce(F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def member(v: Column, *names: str) -> Column:
    """The first member of an object by these names that has a value."""
    found = [F.try_variant_get(v, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(kind(x) != "VOID", x) for x in found])


def is_pair(v: Column) -> Column:
    """Whether a list is a box and a text: two elements, the second a list that begins with a string."""
    second = items(F.try_element_at(items(v), F.lit(2)))
    return (F.size(items(v)) == 2) & (F.size(second) >= 1) & F.coalesce(kind(F.try_element_at(second, F.lit(1))) == "STRING", F.lit(False))


def parts(v: Column) -> Column:
    """What stands one level below a value; a line, or an object that holds lines, is itself."""
    res, data = member(v, "res"), member(v, "data")
    inside = F.when(kind(res) == "OBJECT", F.array(res)).when(kind(data).isin("OBJECT", "ARRAY"), F.array(data)).otherwise(F.array(v))
    return F.when(kind(v) == "OBJECT", inside).when((kind(v) == "ARRAY") & ~is_pair(v), items(v)).when(kind(v) == "ARRAY", F.array(v)).otherwise(F.array().cast("array<variant>"))


def sequence_of(v: Column) -> Column:
    """A list as it is, a string as a list of one."""
    return F.when(kind(v) == "STRING", F.array(v)).otherwise(items(v))


def score_of(v: Column) -> Column:
    """A score as a number; none is 1, what is no number 0."""
    return F.when(v.isNull() | (kind(v) == "VOID"), 1.0).otherwise(F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0)))


def box_of(v: Column) -> Column:
    """Four points of a box: of flat numbers (eight, or two corners), or of the first four points; else all at 0."""
    own = items(v)
    number = lambda x: F.coalesce(kind(x).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.lit(False))
    flat = (F.size(own) > 0) & F.forall(own, number)
    n = F.transform(own, lambda x: F.try_variant_get(x, "$", "double"))
    at = lambda i: F.try_element_at(n, F.lit(i + 1))
    point = lambda x, y: F.array(x, y)
    pair = F.transform(own, lambda p: F.slice(F.transform(items(p), lambda c: F.try_variant_get(c, "$", "double")), 1, 2))
    good = F.filter(pair, lambda p: (F.size(p) == 2) & F.forall(p, lambda c: c.isNotNull()))
    return (
        F.when(flat & (F.size(own) >= 8), F.array(*[point(at(i), at(i + 1)) for i in (0, 2, 4, 6)]))
        .when(flat & (F.size(own) >= 4), F.array(point(at(0), at(1)), point(at(2), at(1)), point(at(2), at(3)), point(at(0), at(3))))
        .when(~flat & (F.size(good) >= 4), F.slice(good, 1, 4))
        .otherwise(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in NOWHERE]))
    )


def payload_lines(records: DataFrame, payload: str = "payload", levels: int = LEVELS) -> DataFrame:
    """records without payload (JSON text), a row a line: position (from 0, in the order of the payload), line, score, box.

    Texts are cleaned, blank ones left out. Null payloads and what is no JSON have no lines. Payloads nested deeper than
    `levels` are an error. Other columns stay, whatever their names.
    """
    rows = records.select(F.struct(*[c for c in records.columns if c != payload]).alias("_row"), F.monotonically_increasing_id().alias("_id"), F.try_parse_json(payload).alias("_v"), F.array().cast("array<int>").alias("_path"))
    for _ in range(levels):
        rows = rows.select("_row", "_id", "_path", F.posexplode(parts(F.col("_v"))).alias("_at", "_v")).select("_row", "_id", "_v", F.concat("_path", F.array("_at")).alias("_path"))
    v = F.col("_v")
    deeper = (kind(v) == "ARRAY") & ~is_pair(v) | (kind(v) == "OBJECT") & ((kind(member(v, "res")) == "OBJECT") | kind(member(v, "data")).isin("OBJECT", "ARRAY"))
    texts, scores, boxes = (sequence_of(member(v, *names)) for names in (TEXTS, SCORES, BOXES))
    line = lambda t, s, b: F.struct(t.alias("line"), s.alias("score"), b.alias("box"))
    nth = lambda xs, i: F.try_element_at(xs, i + 1)
    beside = F.transform(texts, lambda t, i: line(F.try_variant_get(t, "$", "string"), score_of(nth(scores, i)), box_of(nth(boxes, i))))
    said = items(F.try_element_at(items(v), F.lit(2)))
    pair = F.array(line(F.try_variant_get(nth(said, F.lit(0)), "$", "string"), score_of(nth(said, F.lit(1))), box_of(F.try_element_at(items(v), F.lit(1)))))
    lines = F.when(F.coalesce(deeper, F.lit(False)), F.raise_error(F.lit(f"a payload is nested deeper than {levels} levels"))).when(kind(v) == "OBJECT", beside).otherwise(pair)
    found = rows.select("_row", "_id", "_path", F.posexplode(lines).alias("_n", "_l")).withColumn("line", clean_report(F.col("_l.line"))).filter(F.col("line") != "")
    order = F.concat("_path", F.array("_n"))
    return found.select("_row", "_id", order.alias("_order"), "line", "_l.score", "_l.box").select(
        "_row.*", F.col("_id").alias("record"), F.col("_order").alias("position"), "line", "score", "box"
    )
