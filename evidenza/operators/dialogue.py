"""Conversations: memory window, query expansion, red flags and the answer policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
RED_FLAGS = (
    "chest pain", "difficulty breathing", "shortness of breath", "loss of consciousness", "unconscious", "severe trauma", "major bleeding",
    "anaphylaxis", "convulsion", "seizure", "胸痛", "呼吸困难", "意识不清", "昏迷", "严重外伤", "大出血", "过敏性休克", "抽搐", "新生儿重度黄疸",
)
FOLLOW_UPS = ("那", "还有", "刚才", "上面", "这个", "那个", "继续", "怎么办", "如何", "呢", "吗", "同上", "之前", "刚刚")
MEMORY, SHORT = 8, 24
JOINER = "；"


def has_red_flag(c: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in RED_FLAGS]), lambda w: F.contains(F.lower(c), w))


def spoken(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants that are not blank, stripped."""
    return messages.withColumn("text", F.btrim("text", F.lit(" \t\n\r"))).filter(F.col("role").isin("user", "assistant") & (F.col("text") != ""))


def memory_window(messages: DataFrame, most: int = MEMORY) -> DataFrame:
    """The last messages of each conversation (conv_id, turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return spoken(messages).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def expanded_questions(messages: DataFrame, most: int = MEMORY) -> DataFrame:
    """For each user turn: its question, with the two last user turns of the window before it if it is short or a
    follow-up, else with the last; without one, the question alone."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-most, -1)
    said = F.collect_list(F.struct("role", "text")).over(w)
    users = F.transform(F.filter("_before", lambda m: m["role"] == "user"), lambda m: m["text"])
    recent = F.slice("_users", F.greatest(F.size("_users") - 1, F.lit(1)), 2)
    hint = F.exists(F.array(*[F.lit(h) for h in FOLLOW_UPS]), lambda h: F.contains(F.col("text"), h))
    query = (
        F.when(F.size("_users") == 0, F.col("text"))
        .when((F.length("text") <= SHORT) | hint, F.concat_ws(JOINER, F.array_join(recent, JOINER), F.col("text")))
        .otherwise(F.concat_ws(JOINER, F.element_at("_users", -1), F.col("text")))
    )
    rows = spoken(messages).withColumn("_before", said).filter("role = 'user'").withColumn("_users", users)
    return rows.select("conv_id", "turn", query.alias("query"))


def answer_policy(asked: DataFrame) -> DataFrame:
    """asked: question and n_citations. Red flags bypass the model; without citations the answer is a refusal."""
    flagged = has_red_flag(F.col("question"))
    none = F.col("n_citations") == 0
    return asked.withColumns(
        {
            "risk_level": F.when(flagged, "high").when(none, "unknown").otherwise("low"),
            "route": F.when(flagged, "fixed").when(none, "refusal").otherwise("model"),
            "evidence_available": F.col("n_citations") > 0,
        }
    )


def conversation_list(messages: DataFrame, title: int = 24, preview: int = 80) -> DataFrame:
    """conv_id, title (start of the first user message), preview (start of the last message), n_messages."""
    rows = spoken(messages)
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return rows.groupBy("conv_id").agg(
        F.substring(first, 1, title).alias("title"), F.substring(F.max_by("text", "turn"), 1, preview).alias("preview"), F.count(F.lit(1)).alias("n_messages")
    )
