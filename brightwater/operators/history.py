"""Message history and sessions as tables; sessions are derived, so no write has to keep them in step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import session_title


def messages(table: DataFrame, action: str | None = None, limit: int | None = None) -> DataFrame:
    """Messages of an action, the last ``limit`` of them (0: none), in ascending order of id."""
    kept = table if action is None else table.where(F.col("action") == action)
    if limit is not None:
        kept = kept.orderBy(F.desc("id")).limit(max(0, limit))
    return kept.orderBy("id")


def append(table: DataFrame, message: DataFrame) -> DataFrame:
    """``message`` rows added; one without a session gets ``system_{action}_{ms}``."""
    own = F.concat(F.lit("system_"), F.col("action"), F.lit("_"), F.unix_millis(F.col("timestamp")).cast("string"))
    return table.unionByName(message.withColumn("session_id", F.coalesce(F.nullif(F.trim("session_id"), F.lit("")), own)), allowMissingColumns=True)


def sessions_of_messages(table: DataFrame, action: str | None = None, limit: int | None = None) -> DataFrame:
    """Sessions of the messages of an action, the last active first: count, first_query, first_user, last_timestamp. Messages without a session don't count."""
    kept = table.where("session_id is not null and session_id <> ''")
    if action is not None:
        kept = kept.where(F.col("action") == action)
    out = kept.groupBy("session_id").agg(
        F.count("*").alias("count"), F.min_by("query", "id").alias("first_query"), F.min_by("user_id", "id").alias("user_id"),
        F.max_by("timestamp", "id").alias("timestamp"), F.max("id").alias("last_id"),
    ).orderBy(F.desc("last_id"))
    return out if limit is None else out.limit(max(0, limit))


def sessions_with_messages(sessions: DataFrame, table: DataFrame, action: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored sessions, the latest first and cut to ``limit`` before messages are looked at; those without a message of the action
    stay, with count 0 and their title."""
    shown = sessions.orderBy(F.desc("updated_at"), "session_id")
    shown = shown if limit is None else shown.limit(max(0, limit))
    kept = table if action is None else table.where(F.col("action") == action)
    per = kept.groupBy("session_id").agg(F.count("*").alias("count"), F.min_by("query", "id").alias("query"))
    joined = shown.join(per, "session_id", "left")
    return joined.select("session_id", "user_id", F.coalesce("query", "title").alias("first_query"), "updated_at", F.coalesce("count", F.lit(0)).alias("count"))


def visible_sessions(sessions: DataFrame, user: str) -> DataFrame:
    """No system sessions; the user's own and anonymous ones, or all if there are none of these."""
    chat = sessions.where(~F.col("session_id").startswith("system_"))
    mine = F.col("user_id").isNull() | (F.col("user_id") == user)
    any_mine = chat.agg(F.coalesce(F.max(mine), F.lit(False)).alias("any_mine"))
    shown = chat.crossJoin(F.broadcast(any_mine)).where(mine | ~F.col("any_mine") | F.lit(not user))  # one row
    return shown.drop("any_mine").withColumn("title", session_title(F.col("first_query")))


def chat_context(table: DataFrame, turns: int, cut_first: bool = False) -> DataFrame:
    """(user_id, session_id, seq, role, content): the last ``2 * turns`` messages of every session, queries and answers in turn.

    ``cut_first``: only the newest ``6 * turns`` queries of all sessions are looked at, as if one session asked alone.
    """
    asked = table.where("action = 'query'")
    if cut_first:
        asked = asked.orderBy(F.desc("id")).limit(6 * turns)
    parts = F.filter(F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    flat = asked.select("user_id", "session_id", "id", F.posexplode(parts).alias("p", "m"))
    per = Window.partitionBy("user_id", "session_id")
    numbered = flat.withColumn("back", F.row_number().over(per.orderBy(F.desc("id"), F.desc("p")))).where(F.col("back") <= 2 * turns)
    return numbered.select("user_id", "session_id", F.row_number().over(per.orderBy("id", "p")).alias("seq"), "m.role", "m.content")


def last_messages(table: DataFrame, n: int, session: str = "session_id", order: str = "id") -> DataFrame:
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return table.withColumn("back", back).where(F.col("back") <= n).drop("back")


def delete_message(table: DataFrame, message_id) -> DataFrame:
    return table.where(F.col("id") != message_id)


def delete_session(table: DataFrame, session_id: str) -> DataFrame:
    return table.where(~F.col("session_id").eqNullSafe(session_id))


def restored_answer(answer: Column, messages_json: Column, previews: Column) -> Column:
    """The stored answer, else the last assistant message, else the previews of the sources."""
    parsed = F.from_json(messages_json, "array<struct<role:string,content:string>>")
    said = F.transform(F.filter(F.coalesce(parsed, F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.lower(m["role"]) == "assistant"), lambda m: m["content"])
    return F.coalesce(F.nullif(answer, F.lit("")), F.nullif(F.try_element_at(said, F.lit(-1)), F.lit("")), F.array_join(previews, "\n\n"))


def prompt_text(rows: DataFrame, key: str = "session_id", order: str = "id") -> DataFrame:
    """Messages (role, content) of a key as one text, each behind its role."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("content"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(ordered, "\n").alias("prompt"))


def issue_session_ids(requests: DataFrame, order: str = "id") -> DataFrame:
    """``s_{user}_{n}_{seconds}`` for each request, n counted per user."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(order))
    return requests.withColumn("session_id", F.format_string("s_%s_%d_%d", F.col("user_id"), n, F.unix_seconds("timestamp")))
