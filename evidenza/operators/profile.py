"""Keywords of health profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.segments import ideographs

# Words that are no keyword, labels of tags and of habits, and the weight of each category.
NO_KEYWORDS = ("unknown", "not_applicable", "none", "其他", "未知", "无", "暂无", "没有", "不详")
TAG_LABELS = {
    "age_newborn": "新生儿", "age_child": "儿童", "age_adult": "成人", "age_older_adult": "老年人",
    "bmi_underweight": "体重偏低", "bmi_normal": "BMI正常", "bmi_overweight": "超重", "bmi_obesity": "肥胖",
    "pregnancy_pregnant": "妊娠", "pregnancy_postpartum": "产后", "smoking_current": "当前吸烟", "smoking_former": "既往吸烟",
    "alcohol_frequent": "经常饮酒", "exercise_low": "运动不足", "sleep_poor": "睡眠较差",
    "diet_high_salt": "高盐饮食", "diet_high_sugar": "高糖饮食", "diet_high_fat": "高脂饮食", "diet_irregular": "饮食不规律",
}
HABITS = {
    "smoking_status": {"current": "当前吸烟", "former": "既往吸烟", "never": "不吸烟"},
    "alcohol_use": {"none": "不饮酒", "occasional": "偶尔饮酒", "frequent": "经常饮酒"},
    "exercise_level": {"low": "运动不足", "moderate": "规律运动", "high": "高频运动"},
    "sleep_quality": {"good": "睡眠良好", "fair": "睡眠一般", "poor": "睡眠较差"},
    "diet_pattern": {"balanced": "均衡饮食", "high_salt": "高盐饮食", "high_sugar": "高糖饮食", "high_fat": "高脂饮食", "irregular": "饮食不规律"},
}
WEIGHTS = {"condition": 2.0, "symptom": 1.9, "medication": 1.7, "allergy": 1.6, "family_history": 1.5, "lifestyle": 1.3, "demographic": 1.1, "derived": 1.0}
LISTS = {"chronic_conditions": "condition", "allergies": "allergy", "current_medications": "medication", "family_history": "family_history", "recent_symptoms": "symptom"}
#: What a whole value weighs above its words.
WHOLE = 0.2


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def keyword(c: Column) -> Column:
    """Blanks squashed, edges stripped, 40 characters at most."""
    return F.substring(F.btrim(F.regexp_replace(c, "\\s+", " ")), 1, 40)


def cut_words(values: Column, cut: Callable[[Column], Column]) -> Column:
    """For each of values the words that a lexicon's list cutter finds, of two characters or more; without any, the value itself."""
    plain = F.transform(values, lambda v: F.regexp_replace(F.btrim(v), "[,，;；、/|]+", " "))
    good = lambda ws: F.filter(F.transform(F.flatten(F.transform(ws, lambda w: F.split(w, "\\s+"))), keyword), lambda w: (F.length(w) >= 2) & ~w.isin(*NO_KEYWORDS))
    return F.zip_with(plain, cut(plain), lambda v, ws: F.when(ideographs(v), F.when(F.size(good(ws)) > 0, good(ws)).otherwise(F.array(v))).otherwise(words_of(v)))


def words_of(value: Column) -> Column:
    """Runs of ideographs, letters, digits and _ + - of two characters or more; without any, the value itself."""
    plain = F.regexp_replace(F.btrim(value), "[,，;；、/|]+", " ")
    runs = F.filter(F.regexp_extract_all(plain, F.lit("[\\u4e00-\\u9fffA-Za-z0-9_+-]{2,}"), F.lit(0)), lambda w: ~w.isin(*NO_KEYWORDS))
    return F.when(F.size(runs) > 0, runs).otherwise(F.array(plain))


def candidates(cut: Callable[[Column], Column] | None = None) -> Column:
    """An array of keyword, category, source and score, in the order of tags, lists and habits."""
    entry = lambda k, category, source, more=0.0: F.struct(
        keyword(k).alias("keyword"), category.alias("category"), F.lit(source).alias("source"), F.round(lookup_weight(category) + more, 3).alias("score")
    )
    none = F.array().cast("array<string>")

    def of_tag(t: Column) -> Column:
        kind = F.when(t.rlike("^(smoking|alcohol|exercise|sleep|diet)_"), "lifestyle").when(F.startswith(t, F.lit("age_")), "demographic").otherwise("derived")
        return entry(F.coalesce(F.try_element_at(lookup(TAG_LABELS), t), F.lit("")), kind, "profile_tags")

    def of_list(field: str, category: str) -> Column:
        kind = F.lit(category)
        values = F.filter(F.coalesce(F.col(field), none), lambda v: v.isNotNull() & (F.btrim(v) != ""))
        each = lambda v, words: F.concat(F.array(entry(v, kind, field, WHOLE)), F.transform(words, lambda w: entry(w, kind, field)))
        return F.flatten(F.transform(values, lambda v: each(v, words_of(v))) if cut is None else F.zip_with(values, cut_words(values, cut), each))

    habits = [entry(F.coalesce(F.try_element_at(lookup(labels), F.coalesce(F.col(field), F.lit(""))), F.lit("")), F.lit("lifestyle"), field) for field, labels in HABITS.items()]
    return F.concat(F.transform(F.coalesce(F.col("tags"), none), of_tag), *[of_list(f, c) for f, c in LISTS.items()], F.array(*habits))


def lookup_weight(category: Column) -> Column:
    table = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    return F.coalesce(F.try_element_at(table, category), F.lit(1.0))


def profile_keywords(profiles: DataFrame, key: str, limit: int = 20, cut: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, rank (from 1), keyword, category, score and source of each profile's best keywords; no shuffle.

    profiles: key, tags (as health.profile_tags gives them), and the list and habit columns. Of equal keywords the
    best scored one stays, the first of equals. They go by score, category and keyword; one that a better one of its
    category holds, and is two characters longer at least, is dropped. Null lists count as empty; a profile without
    keywords gives no rows. cut, a lexicon's list cutter, parts values that hold ideographs into words.
    """
    earlier = lambda items, i: F.slice(items, F.lit(1), i)
    by_score = F.transform(
        F.filter("_all", lambda x: (x["keyword"] != "") & ~x["keyword"].isin(*NO_KEYWORDS)), lambda x, i: F.struct((-x["score"]).alias("less"), i.alias("at"), x.alias("x"))
    )
    rows = profiles.select(F.col(key), candidates(cut).alias("_all")).withColumn("_all", F.array_sort(by_score))
    once = F.filter("_all", lambda e, i: ~F.exists(earlier(F.col("_all"), i), lambda k: k["x"]["keyword"] == e["x"]["keyword"]))
    order = F.transform(once, lambda e: F.struct(e["less"], e["x"]["category"].alias("category"), e["x"]["keyword"].alias("keyword"), e["x"]["source"].alias("source")))
    rows = rows.withColumn("_once", order).withColumn("_once", F.array_sort("_once"))
    holds = lambda k, e: (k["category"] == e["category"]) & F.contains(k["keyword"], e["keyword"]) & (F.length(k["keyword"]) >= F.length(e["keyword"]) + 2)
    kept = F.filter("_once", lambda e, i: ~F.exists(earlier(F.col("_once"), i), lambda k: holds(k, e)))
    out = rows.select(key, F.posexplode(F.slice(kept, 1, limit)).alias("_at", "_k"))
    return out.select(key, (F.col("_at") + 1).alias("rank"), "_k.keyword", "_k.category", (-F.col("_k.less")).alias("score"), "_k.source")
