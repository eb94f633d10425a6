"""Outputs of models, given as JSON text, checked by rules: a struct of an error (null if none) and the value (null on error)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.health import metadata_name
from ..functions.text import strip

# Levels of risk, and text of an old template that an analysis may not hold.
RISKS = ("low", "medium", "high", "unknown")
OLD_TEMPLATE = ("is not reliably comparable", "Keep the original report", "Do not use a single item", "reference range recorded in this report")
NAME, UNIT = 60, 24


def kind(v: Column) -> Column:
    """The JSON type of a value: null (or missing), text, number, flag, list or object."""
    s = F.schema_of_variant(v)
    number = s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    typed = F.when(s == "STRING", "text").when(s == "BOOLEAN", "flag").when(F.startswith(s, F.lit("ARRAY")), "list").when(F.startswith(s, F.lit("OBJECT")), "object")
    return F.when(v.isNull() | (s == "VOID"), "null").otherwise(F.when(number, "number").otherwise(typed))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def said(v: Column) -> Column:
    """The stripped text of a value that is text, else null."""
    return F.when(kind(v) == "text", strip(F.try_variant_get(v, "$", "string")))


def elements(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def texts(v: Column) -> Column:
    """Texts of a list that aren't blank, stripped; its other values are skipped."""
    return F.filter(F.transform(elements(v), said), lambda x: x.isNotNull() & (x != ""))


def listed(v: Column, name: str) -> Column:
    return F.when(~kind(v).isin("null", "list"), f"{name} must be a list")


def risk(v: Column) -> Column:
    level = said(field(v, "risk_level"))
    return F.when(level.isin(*RISKS), level).otherwise("unknown")


def outcome(error: Column, value: Column) -> Column:
    return F.struct(error.alias("error"), F.when(error.isNull(), value).alias("value"))


def answer(payload: Column) -> Column:
    """An answer: text that isn't blank, up to five suggestions, a level of risk (unknown if not one of them)."""
    v = F.try_parse_json(payload)
    text, hints = said(field(v, "answer")), field(v, "suggestions")
    error = F.coalesce(F.when(kind(v) != "object", "must be an object"), F.when(F.coalesce(text, F.lit("")) == "", "answer must be text"), listed(hints, "suggestions"))
    return outcome(error, F.struct(text.alias("answer"), F.slice(texts(hints), 1, 5).alias("suggestions"), risk(v).alias("risk_level")))


def squashed(v: Column) -> Column:
    return F.regexp_replace(said(v), "\\s+", " ")


def report_items(payload: Column) -> Column:
    """Items of a report: names of 1 to 60 characters, units of up to 24, finite values, low <= high; the report's own
    fields are skipped, and of items that agree in name, value and unit the first stays. The first broken rule is the error."""
    v = F.try_parse_json(payload)
    found = field(v, "items")

    def item(x: Column) -> Column:
        name, value, unit, low, high = (field(x, n) for n in ("name", "value", "unit", "reference_low", "reference_high"))
        number = lambda c: F.try_variant_get(c, "$", "double")
        long_name, long_unit = squashed(name), F.coalesce(squashed(unit), F.lit(""))
        named = F.coalesce(
            F.when(kind(x) != "object", "item must be an object"), F.when(F.coalesce(long_name, F.lit("")) == "", "name must be text"), F.when(F.length(long_name) > NAME, "name is too long")
        )
        rest = F.coalesce(
            F.when(kind(value) != "number", "value must be a number"), F.when(~kind(unit).isin("null", "text"), "unit must be text"), F.when(F.length(long_unit) > UNIT, "unit is too long"),
            F.when(~kind(low).isin("null", "number"), "reference_low must be a number"), F.when(~kind(high).isin("null", "number"), "reference_high must be a number"),
            F.when(number(low) > number(high), "reference_low must be <= reference_high"),
        )
        skip = F.coalesce(metadata_name(long_name), F.lit(False))
        columns = {"name": long_name, "value": number(value), "unit": long_unit, "reference_low": number(low), "reference_high": number(high)}
        return F.struct(F.coalesce(named, F.when(~skip, rest)).alias("error"), skip.alias("skip"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("item"))

    read = F.transform(elements(found), item)
    error = F.coalesce(F.when(kind(v) != "object", "must be an object"), listed(found, "items"), F.try_element_at(F.filter(F.transform(read, lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(1)))
    kept = F.transform(F.filter(read, lambda x: ~x["skip"]), lambda x: x["item"])
    key = lambda x: F.struct(F.lower(x["name"]), x["value"], F.lower(x["unit"]))
    unique = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, 1, i), lambda y: key(y) == key(x)))
    return outcome(error, unique)


def analysis(payload: Column) -> Column:
    """An analysis: assessment and disclaimer are needed; up to 5 findings, 6 pieces of advice, 5 for follow-up, 5 warnings.
    No text may hold a code fence, the assessment no text of the old template."""
    v = F.try_parse_json(payload)
    needed = lambda x, name: F.when(F.coalesce(said(field(x, name)), F.lit("")) == "", f"{name} must be text")
    fence = lambda c, name: F.when(F.contains(c, F.lit("```")), f"{name} must not hold code fences")
    main, overview, end = (said(field(v, n)) for n in ("overall_assessment", "normal_overview", "disclaimer"))
    old = F.exists(F.array(*[F.lit(x.lower()) for x in OLD_TEMPLATE]), lambda x: F.contains(F.lower(main), x))
    raw = elements(field(v, "key_findings"))
    one = lambda x: F.coalesce(
        F.when(kind(x) != "object", "finding must be an object"), *[e for n in ("title", "content") for e in (needed(x, n), fence(said(field(x, n)), n))]
    )
    lists = {"lifestyle_advice": 6, "follow_up_advice": 5, "warning_signs": 5}
    error = F.coalesce(
        F.when(kind(v) != "object", "must be an object"), needed(v, "overall_assessment"), fence(main, "overall_assessment"), F.when(old, "overall_assessment holds an old template"),
        listed(field(v, "key_findings"), "key_findings"), F.try_element_at(F.filter(F.transform(raw, one), lambda e: e.isNotNull()), F.lit(1)),
        F.when(~kind(field(v, "normal_overview")).isin("null", "text"), "normal_overview must be text"), fence(overview, "normal_overview"),
        *[e for n in lists for e in (listed(field(v, n), n), F.when(F.exists(texts(field(v, n)), lambda x: F.contains(x, F.lit("```"))), f"{n} must not hold code fences"))],
        needed(v, "disclaimer"), fence(end, "disclaimer"),
    )
    findings = F.transform(F.slice(raw, 1, 5), lambda x: F.struct(said(field(x, "title")).alias("title"), said(field(x, "content")).alias("content")))
    value = F.struct(
        main.alias("overall_assessment"), risk(v).alias("risk_level"), findings.alias("key_findings"), F.coalesce(overview, F.lit("")).alias("normal_overview"),
        *[F.slice(texts(field(v, n)), 1, most).alias(n) for n, most in lists.items()], end.alias("disclaimer"),
    )
    return outcome(error, value)
