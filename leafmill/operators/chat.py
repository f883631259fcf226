"""Conversations: order, titles, history, messages for a model, answers from their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.tables import blank

HISTORY_CHARS = 3000
TITLE_CHARS = 255


def trim_history(messages: DataFrame, most: int = HISTORY_CHARS) -> DataFrame:
    """The newest turns of each conversation within ``most`` characters; the newest always stays."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    summed = messages.withColumns({"sum_chars": F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(w)})
    return summed.where((F.col("sum_chars") <= most) | (F.col("nth") == 1)).drop("sum_chars", "nth")


def session_titles(messages: DataFrame, most: int = TITLE_CHARS) -> DataFrame:
    """(conv_id, title): the start of the first question."""
    return messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by(F.left("text", F.lit(most)), "turn").alias("title"))


def order_messages(messages: DataFrame, time: str = "turn") -> DataFrame:
    """Messages with their position: by time, at the same time users first, then by turn."""
    w = Window.partitionBy("conv_id").orderBy(F.col(time), F.col("role").desc(), "turn")
    return messages.withColumn("position", F.row_number().over(w))


def latest_sessions(sessions: DataFrame, n: int | None = None) -> DataFrame:
    """Sessions, the newest first; untitled ones too."""
    out = sessions.orderBy(F.col("created_at").desc(), "session_id")
    return out.limit(n) if n else out


def assemble_answers(events: DataFrame) -> DataFrame:
    """(message_id, answer, status) from (message_id, seq, kind, text): deltas in order.

    Saved only after ``done`` with a text that is not blank; without ``done`` the answer is interrupted,
    with a blank text it is an error, and neither has an answer.
    """
    parts = F.sort_array(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "text"))))
    per = events.groupBy("message_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("joined"), F.max(F.col("kind") == "done").alias("done"))
    status = F.when(~F.col("done"), "interrupted").when(blank(F.col("joined")), "empty").otherwise("saved")
    return per.select("message_id", F.when(status == "saved", F.col("joined")).alias("answer"), status.alias("status"))


def build_messages(questions: DataFrame, history: DataFrame, system: str = "base") -> DataFrame:
    """(conv_id, messages): system prompt with its context, trimmed history in order, the question.

    questions: conv_id, question, context, manual_request, matched (tags or null).
    """
    trimmed = trim_history(history).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    prompt = F.concat(F.lit(system), F.when(F.col("manual_request"), " +manual").otherwise(""), F.when(F.col("matched").isNotNull(), " +tags").otherwise(""), F.lit("\n\n"), F.col("context"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    past = F.transform(F.coalesce("h", F.array().cast("array<struct<turn:bigint,role:string,content:string>>")), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return questions.join(trimmed, "conv_id", "left").select("conv_id", F.concat(F.array(message("system", prompt)), past, F.array(message("user", F.col("question")))).alias("messages"))


def delete_cascade(sessions: DataFrame, messages: DataFrame, ids: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions and messages without those of the ids, and the ids that no session has."""
    return sessions.join(ids, key, "left_anti"), messages.join(ids, key, "left_anti"), ids.join(sessions, key, "left_anti")


def excerpt(df: DataFrame, column: str, most: int = 100) -> DataFrame:
    """Adds excerpt and truncated: the first characters, with an ellipsis if there are more."""
    more = F.length(column) > most
    return df.withColumns({"excerpt": F.when(more, F.concat(F.left(column, F.lit(most)), F.lit("…"))).otherwise(F.col(column)), "truncated": more})
