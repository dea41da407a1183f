"""Retrieval-augmented prompts: trimmed histories, retrieved contents, assembled text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import knn

#: The headings of a prompt and the names of the roles.
HEADINGS = {"system": "系统指令：", "history": "历史对话：", "knowledge": "知识库内容：", "question": "用户问题："}
ROLES = {"user": "用户", "assistant": "助手"}


def last_turns(messages: DataFrame, n: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` messages of each conversation."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return messages.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def last_tokens(messages: DataFrame, budget: int, by: str = "conv_id", order: str = "turn", tokens: Column | None = None) -> DataFrame:
    """From the newest message back, those whose tokens together stay within ``budget``."""
    n = T.token_estimate(F.col("text")) if tokens is None else tokens
    w = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("_n", F.sum(n).over(w)).where(F.col("_n") <= budget).drop("_n")


def history_text(messages: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``by`` and ``history``: a line for each message, in order."""
    name = F.when(F.col(role) == "assistant", ROLES["assistant"]).otherwise(ROLES["user"])
    line = F.struct(F.col(order).alias("o"), F.concat(name, F.lit("："), F.coalesce(F.col(text), F.lit(""))).alias("l"))
    return messages.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("history"))


def prompt(context: Column, history: Column, question: Column, system: str = "") -> Column:
    """The sections of a prompt; system and history are left out where they are empty."""
    head = F.lit(f"{HEADINGS['system']}{system}\n" if system else "")
    past = F.when(F.coalesce(F.length(history), F.lit(0)) > 0, F.concat(F.lit(HEADINGS["history"] + "\n"), history, F.lit("\n"))).otherwise("")
    return F.concat(head, past, F.lit(HEADINGS["knowledge"] + "\n"), F.coalesce(context, F.lit("")), F.lit("\n" + HEADINGS["question"]), F.coalesce(question, F.lit("")))


def context(found: DataFrame, contents: DataFrame, id_col: str = "id", text: str = "content", order: str = "distance") -> DataFrame:
    """One row: the contents of the ids found, by ``order`` and id, a line each; ids without contents don't count."""
    line = F.struct(F.col(order).alias("o"), F.col(id_col).alias("i"), F.col(text).alias("t"))
    rows = found.join(contents.select(id_col, text), id_col).agg(F.array_sort(F.collect_list(line)).alias("l"))
    return rows.select(F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("context"))


def knowledge(items: DataFrame, query: Sequence[float], threshold: float, limit: int = 3, confidence: str = "confidence", id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Items with a cosine of ``threshold`` or more, by cosine times confidence."""
    some = knn.scored(items, query, "cosine", vec).where(F.col("similarity") >= threshold)
    return some.withColumn("relevance", F.col("similarity") * F.col(confidence)).orderBy(F.desc("relevance"), id_col).limit(limit)


def memories(items: DataFrame, query: Sequence[float], threshold: float, limit: int = 5, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Items with a cosine of ``threshold`` or more, by cosine; ``used_count`` is one more than before."""
    return knn.nearest_above(items, query, threshold, limit, id_col, vec).withColumn("used_count", F.col("used_count") + 1)


def expired_sessions(sessions: DataFrame, now: Column, n: int = 100, time: str = "expires", id_col: str = "session_id") -> DataFrame:
    return sessions.where(F.col(time) <= now).orderBy(time, id_col).limit(n)


def oldest_session(sessions: DataFrame, by: str = "user_id", time: str = "expires", id_col: str = "session_id") -> DataFrame:
    """The session of each user that expires first, ties by id."""
    return sessions.groupBy(by).agg(F.min_by(id_col, F.struct(time, id_col)).alias(id_col))


def latest_versions(rows: DataFrame, by: str = "session_id", version: str = "version") -> DataFrame:
    """The row of each session with the highest version."""
    return rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), version).alias("_r")).select(by, "_r.*")


def session_documents(messages: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``by``, ``keywords`` (array of field and word: the session and its roles), ``content`` (a line a message) and ``score_id``."""
    line = F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = messages.groupBy(by).agg(F.array_sort(F.collect_list(line)).alias("_l"), F.array_sort(F.collect_set(role)).alias("_r"))
    word = lambda field, w: F.struct(F.lit(field).alias("field"), w.cast("string").alias("word"))
    keywords = F.concat(F.array(word("session", F.col(by))), F.transform("_r", lambda r: word("role", r)))
    content = F.array_join(F.transform("_l", lambda x: x["t"]), "\n")
    return out.select(by, keywords.alias("keywords"), content.alias("content"), V.poly_hash(F.col(by).cast("string")).alias("score_id"))
