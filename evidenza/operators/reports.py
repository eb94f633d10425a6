"""Interpretation of reports: real items, targets, questions, context and citations, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import health
from ..functions.text import number_text
from .tables import first_by, top_by

# A report without items holds one of this name; texts of a summary.
PLACEHOLDER = "OCR pending"
STATUS_LABELS = {"high": "偏高", "low": "偏低", "normal": "范围内", "unknown": "待确认"}
RISK_LABELS = {"low": "低", "medium": "中", "high": "高", "unknown": "暂无法判断"}
NO_MODEL = "【综合评价】\n本次报告已完成指标整理，但智能综合分析暂时不可用。"
NONE_ABNORMAL = "- 在本次成功提取且具有可比较参考范围的指标中，未发现明显超出报告参考范围的项目。"
NO_MODEL_END = "【建议】\n建议结合原始报告和医生意见进行确认。\n\n【说明】\n本结果仅用于健康信息整理，不构成诊断或治疗建议。"
NONE_FOUND = "本次未发现需要单独提示的项目。"
CONTEXT, TARGETS, LISTED = 12, 6, 8


def labelled(labels: dict[str, str], c: Column) -> Column:
    """The label of a value; that of unknown for all others."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(names[c], F.lit(labels["unknown"]))


def real_item(name: Column) -> Column:
    """Named, and not the placeholder; a null name isn't."""
    said = F.lower(F.btrim(F.coalesce(name, F.lit(""))))
    return (said != "") & (said != PLACEHOLDER.lower())


def unique_items(items: DataFrame, order: list[Column], keys: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """Of a report's items that agree in name and unit (in any case) and value, the first in order."""
    same = items.withColumns({"_name": F.lower("name"), "_unit": F.lower("unit")})
    return first_by(same, [*keys, "_name", "value", "_unit"], order).drop("_name", "_unit")


def with_placeholder(reports: DataFrame, items: DataFrame) -> DataFrame:
    """Items (report_id, position, name, value, unit, low, high, status); a report without any gets the placeholder."""
    none = reports.select("report_id").join(items.select("report_id"), "report_id", "left_anti")
    blank = {"position": F.lit(0), "name": F.lit(PLACEHOLDER), "unit": F.lit(""), "status": F.lit("unknown")}
    types = dict(items.dtypes)
    return items.unionByName(none.select("report_id", *[blank.get(c, F.lit(None)).cast(types[c]).alias(c) for c in items.columns if c != "report_id"]))


def model_or_rules(reports: DataFrame, model: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of the model where it gave any for a report, else those by rules; and reports with a warning if it gave none."""
    failed = reports.join(model.select("report_id"), "report_id", "left_semi").select("report_id", F.lit(None).cast("string").alias("warning"))
    none = reports.join(model.select("report_id"), "report_id", "left_anti").select("report_id", F.lit("model gave no items; rules were used").alias("warning"))
    return model.unionByName(rules.join(none, "report_id", "left_semi")), failed.unionByName(none)


def targets(items: DataFrame, key: str, order: list[Column], k: int = TARGETS, identity: list[str] | None = None) -> DataFrame:
    """The items to look up, at most k for each key: out of range, then near a bound; without those normal ones, else unknown ones.

    items: key, value, low, high and those of order. Adds status and is_near. Of items that agree in the columns of
    identity (an item's id, or what it says) only the first counts.
    """
    v = [F.col(c) for c in ("value", "low", "high")]
    w = Window.partitionBy(key)
    out, ok = F.col("status").isin("low", "high"), F.col("status") == "normal"
    rows = items.withColumns({"status": health.status(*v), "is_near": health.near_boundary(*v)})
    rows = rows.withColumns({"_bad": F.bool_or(out | F.col("is_near")).over(w), "_ok": F.bool_or(ok).over(w)})
    chosen = rows.filter(F.when(F.col("_bad"), out | F.col("is_near")).when(F.col("_ok"), ok).otherwise(True))
    first = F.when(out, 0).when(F.col("is_near"), 1).otherwise(2)
    if identity:
        chosen = first_by(chosen, [key, *identity], [first, *order])
    return top_by(chosen, [key], [first, *order], k).drop("_bad", "_ok")


def knowledge_question(name: Column, status: Column) -> Column:
    """What to search for an item, by its status."""
    said = F.when(status == "high", " 偏高 健康意义").when(status == "low", " 偏低 健康意义").otherwise(" 检查结果 参考范围 健康意义")
    return F.concat(name, said)


def context(hits: DataFrame, most: int = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """Context and citations of each report from hits (report_id, item, rank, chunk_id; in the order of item, rank and chunk).

    Context: report_id, place, chunk_id, each chunk where it is first seen, `most` at the most. Citations: report_id, item
    and its chunks in order, for each item that is reached before the context is full.
    """
    seen = Window.partitionBy("report_id", "chunk_id").orderBy("item", "rank")
    rows = hits.withColumn("_first", (F.row_number().over(seen) == 1).cast("int"))
    so_far = Window.partitionBy("report_id").orderBy("item", "rank", "chunk_id", F.desc("_first")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.sum("_first").over(so_far))
    kept = rows.filter((F.col("_first") == 1) & (F.col("place") <= most)).select("report_id", F.col("place").cast("int").alias("place"), "chunk_id")
    by_item = rows.groupBy("report_id", "item").agg(
        F.min(F.col("place") - F.col("_first")).alias("_before"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("citations")
    )
    return kept, by_item.filter(F.col("_before") < most).drop("_before")


def numbered(c: Column) -> Column:
    """Lines that begin with their number."""
    return F.array_join(F.transform(c, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def analysis_summary(a: Column) -> Column:
    """The text of an analysis: a struct as answers.analysis gives it. Parts without content are left out."""
    part = lambda title, text: F.when(text != "", F.concat(F.lit(f"【{title}】\n"), text))
    found = F.transform(a["key_findings"], lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"], F.lit("\n"), x["content"]))
    parts = [
        part("综合评价", a["overall_assessment"]), part("重点关注", F.when(F.size(found) > 0, F.array_join(found, "\n\n")).otherwise(NONE_FOUND)),
        part("正常指标概览", a["normal_overview"]), part("生活方式建议", numbered(a["lifestyle_advice"])), part("复查与就医建议", numbered(a["follow_up_advice"])),
        part("需要及时关注的情况", numbered(a["warning_signs"])), part("风险等级", labelled(RISK_LABELS, a["risk_level"])), part("说明", a["disclaimer"]),
    ]
    return F.when(a.isNotNull(), F.concat_ws("\n\n", *parts))


def fallback_summaries(items: DataFrame) -> DataFrame:
    """report_id and the text without a model: its first eight items out of range, and how many have no bounds.

    items: report_id, position, name, value, unit, status.
    """
    return counted_summaries(items).select("report_id", "summary")


def counted_summaries(items: DataFrame) -> DataFrame:
    """As `fallback_summaries`, with n_items and n_abnormal: items are read once, and moved once, by report."""
    out = F.coalesce(F.col("status").isin("high", "low"), F.lit(False))
    first = Window.partitionBy("report_id").orderBy(F.desc("_out"), F.col("position"))
    rows = items.withColumn("_out", out).withColumn("_place", F.row_number().over(first))
    # Whole numbers of a whole type are told without a point.
    fraction = isinstance(items.schema["value"].dataType, (T.DoubleType, T.FloatType))
    value = F.coalesce(number_text(F.col("value").cast("double")) if fraction else F.col("value").cast("string"), F.lit("-"))
    line = F.concat(F.lit("- "), "name", F.lit("："), labelled(STATUS_LABELS, F.col("status")), F.lit("，结果 "), value, F.lit(" "), F.coalesce("unit", F.lit("")))
    listed = F.array_sort(F.collect_list(F.when(F.col("_out") & (F.col("_place") <= LISTED), F.struct("_place", line.alias("line")))))
    each = rows.groupBy("report_id").agg(
        listed.alias("_l"), F.count(F.lit(1)).alias("n_items"), F.count_if("_out").alias("n_abnormal"), F.count_if(F.col("status") == "unknown").alias("_n")
    )
    said = F.when(F.size("_l") > 0, F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).otherwise(NONE_ABNORMAL)
    focus = F.concat_ws("\n", said, F.when(F.col("_n") > 0, F.concat(F.lit("- 另有 "), F.col("_n").cast("string"), F.lit(" 项指标缺少完整参考范围，暂不能判断是否超出报告范围。"))))
    return each.select("report_id", F.concat_ws("\n\n", F.lit(NO_MODEL), F.concat(F.lit("【重点关注】\n"), focus), F.lit(NO_MODEL_END)).alias("summary"), "n_items", "n_abnormal")


def interpreted(reports: DataFrame, items: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """report_id, status, summary, risk_level, n_items, n_abnormal.

    Without a real item the status is rejected. analyses: report_id, analysis (a struct as answers.analysis gives it, null if
    the model failed or its output broke a rule), or None; without one the summary is the fallback's and the risk unknown.
    """
    v = [F.col(c) for c in ("value", "low", "high")]
    real = items.filter(real_item(F.col("name"))).withColumn("status", health.status(*v))
    rows = reports.select("report_id").join(counted_summaries(real), "report_id", "left")
    if analyses is None:
        rows = rows.withColumns({"_said": F.lit(None).cast("string"), "_risk": F.lit(None).cast("string")})
    else:
        rows = rows.join(analyses.select("report_id", analysis_summary(F.col("analysis")).alias("_said"), F.col("analysis.risk_level").alias("_risk")), "report_id", "left")
    usable = F.col("n_items").isNotNull()
    return rows.select(
        "report_id", F.when(usable, "completed").otherwise("rejected").alias("status"), F.when(usable, F.coalesce("_said", "summary")).alias("summary"),
        F.when(usable, F.when(F.col("_said").isNotNull(), F.col("_risk")).otherwise("unknown")).alias("risk_level"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_abnormal", F.lit(0)).alias("n_abnormal"),
    )
