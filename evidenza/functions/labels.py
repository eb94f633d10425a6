"""Readable texts: labels of tags, a profile as text, blocks of history, profile and passages, lines without identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .health import ALLERGIES, CONDITIONS, MEDICATIONS, age, contains_any
from .text import strip

# Fixed values.
SEX = {"female": "女性", "male": "男性", "other": "其他", "unknown": "未说明"}
PREGNANCY = {"not_applicable": "不适用", "pregnant": "妊娠中", "postpartum": "产后", "unknown": "未说明"}
TAGS = {
    "age_newborn": "新生儿", "age_child": "儿童", "age_adult": "成人", "age_older_adult": "老年", "sex_female": "女性", "sex_male": "男性",
    "sex_other": "其他性别", "sex_unknown": "性别未说明", "pregnancy_pregnant": "妊娠中", "pregnancy_postpartum": "产后",
}
KINDS = {"condition_": ("慢病:", CONDITIONS), "allergy_": ("过敏:", ALLERGIES), "med_": ("用药:", MEDICATIONS)}
IDENTITY_WORDS = ("姓名", "身份证", "电话", "手机", "地址", "报告编号", "条形码", "文件名")
UNRECORDED, HISTORY, NO_PROFILE = "未记录", "近期会话记忆（用于理解追问与指代，不得编造未出现内容）：", "用户健康画像：本次未启用或尚未填写。\n\n"
PROFILE = "用户健康画像（来自个人信息表单，请用于个性化科普）：\n"


def looked_up(names: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c]


def tag_label(tag: Column) -> Column:
    """The label of a tag; of a condition, allergy or medicine its kind and name; other tags as they are."""
    known = dict(TAGS)
    for title, names in KINDS.values():
        known |= {tag: title + name for name, tag in names.items()}
    rest = tag
    for prefix, (title, _) in KINDS.items():
        rest = F.when(F.startswith(tag, F.lit(prefix)), F.concat(F.lit(title), F.substr(tag, F.lit(len(prefix) + 1)))).otherwise(rest)
    return F.coalesce(looked_up(known, tag), rest)


def tag_labels(tags: Column) -> Column:
    """Labels of tags in order; null: none."""
    return F.transform(F.coalesce(tags, F.array().cast("array<string>")), tag_label)


def listing(values: Column) -> Column:
    """Values that aren't blank, joined; none or null: the word for not recorded."""
    said = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.when(F.size(said) > 0, F.array_join(said, "、")).otherwise(UNRECORDED)


def profile_text(as_of: Column) -> Column:
    """A profile row as lines of text; fields that aren't there are left out, the three lists always stand."""
    c = lambda name: strip(F.coalesce(F.col(name), F.lit("")))
    with_label = lambda labels, x: F.coalesce(looked_up(labels, x), x)
    years, born = age(F.col("birth_date"), as_of), c("birth_date")
    birth = F.when(years.isNotNull(), F.concat(F.lit("年龄："), years.cast("string"), F.lit(" 岁"), F.when(born != "", F.concat(F.lit("（出生日期 "), born, F.lit("）"))).otherwise("")))
    sex, pregnancy = (F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit("unknown")) for n in ("sex_at_birth", "pregnancy_status"))
    body = F.concat_ws("，", F.concat(F.lit("身高 "), "height_cm", F.lit(" cm")), F.concat(F.lit("体重 "), "weight_kg", F.lit(" kg")))
    return F.concat_ws(
        "\n", F.when(c("nickname") != "", F.concat(F.lit("称呼："), c("nickname"))), F.coalesce(birth, F.when(born != "", F.concat(F.lit("出生日期："), born))),
        F.concat(F.lit("出生性别："), with_label(SEX, sex)), F.when(~pregnancy.isin("unknown", "not_applicable"), F.concat(F.lit("妊娠状态："), with_label(PREGNANCY, pregnancy))),
        F.when(body != "", F.concat(F.lit("体格："), body)),
        *[F.concat(F.lit(f"{title}："), listing(F.col(n))) for n, title in (("chronic_conditions", "已知慢性病或长期健康情况"), ("allergies", "过敏史"), ("current_medications", "当前常用药"))],
    )


def history_block(history: Column, most: int = 420) -> Column:
    """Turns (role, text) of users and assistants as lines; long texts of assistants are cut; none: empty."""
    kept = F.filter(F.transform(history, lambda x: F.struct(x["role"].alias("role"), strip(F.coalesce(x["text"], F.lit(""))).alias("text"))), lambda x: (x["text"] != "") & x["role"].isin("user", "assistant"))

    def line(x: Column) -> Column:
        text = F.when(F.length(x["text"]) > most, F.concat(F.left(x["text"], F.lit(most)), F.lit("…"))).otherwise(x["text"])
        return F.when(x["role"] == "user", F.concat(F.lit("用户："), x["text"])).otherwise(F.concat(F.lit("助手："), text))

    return F.when(F.size(kept) > 0, F.concat(F.lit(HISTORY + "\n"), F.array_join(F.transform(kept, line), "\n"), F.lit("\n\n"))).otherwise("")


def profile_block(profile: Column, tags: Column, keywords: Column) -> Column:
    """Profile text, tags and keywords that aren't blank; the sentence for an empty profile without any of them."""
    said = lambda c: F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(x) != ""), "、")
    text = strip(F.coalesce(profile, F.lit("")))
    part = lambda title, x: F.when(x != "", F.concat(F.lit(title), x))
    whole = F.concat_ws("\n", part(PROFILE, text), part("画像标签：", said(tags)), part("画像关键词：", said(keywords)))
    return F.when(whole != "", F.concat(whole, F.lit("\n\n"))).otherwise(NO_PROFILE)


def passages_block(chunks: Column) -> Column:
    """Numbered passages: structs of article_title, section_title, source_url and content."""
    names = ("article_title", "section_title", "source_url", "content")
    one = lambda x, i: F.concat_ws("\n", F.concat(F.lit("[资料"), (i + 1).cast("string"), F.lit("]")), *[F.concat(F.lit(f"{n}: "), F.coalesce(x[n], F.lit(""))) for n in names])
    return F.array_join(F.transform(chunks, one), "\n\n")


def without_identities(text: Column) -> Column:
    """Lines, their spaces squashed, without blank ones and those that name a person, an address or a number of theirs."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", -1), lambda x: strip(F.regexp_replace(x, "[\\s\\u00a0\\u3000]+", " ")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~contains_any(F.replace(x, F.lit(" "), F.lit("")), IDENTITY_WORDS)), "\n")


def display_tags(category: Column, tags: Column) -> Column:
    """A category, if there is one, and tags, each once in order."""
    return F.array_distinct(F.filter(F.concat(F.array(category), F.coalesce(tags, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))


def shown_name(nickname: Column, email: Column) -> Column:
    """The nickname, or what stands before the @ of the address."""
    return F.coalesce(F.nullif(strip(nickname), F.lit("")), F.substring_index(email, "@", 1))


def message_content(response: Column) -> Column:
    """The text of the first choice of a model's response; null if there is none."""
    return F.get_json_object(response, "$.choices[0].message.content")


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    """Bytes as a data URL; null or no bytes: null."""
    return F.when(F.octet_length(content) > 0, F.concat(F.lit(f"data:{kind};base64,"), F.base64(content)))
