"""Chat histories, requests and responses.

A history is kept as rows, one per message with its place, rather than as one
array per conversation: a conversation may be as long as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagemill.constants import (
    DEFAULT_EFFORT,
    DEFAULT_FINISH_REASON,
    DEFAULT_MAX_TOKENS,
    DEFAULT_THINKING,
)
from pagemill.operators.segments import by_position, row_numbers
from pagemill.schemas import COMPLETION, MESSAGE

OPTIONAL = ("reasoning_content", "tool_calls", "tool_call_id", "name")


def build_conversation(messages: DataFrame) -> DataFrame:
    """User and assistant turns of each conversation, numbered from 0 in order."""
    turns = messages.filter(F.col("role").isin("user", "assistant"))
    ranked = row_numbers(turns, ["conv_id"], [F.col("turn")], by_position("turn"), "_n")
    return ranked.withColumn("position", F.col("_n") - 1).drop("_n")


def message_json(messages: DataFrame, out: str = "message") -> DataFrame:
    """Each message as JSON; absent optional fields are left out.

    ``tool_calls`` is held as JSON text and written as JSON.
    """
    fields = [F.col("role"), F.col("content")]
    for name in OPTIONAL:
        if name in messages.columns:
            value = F.try_parse_json(name) if name == "tool_calls" else F.col(name)
            fields.append(value.alias(name))
    return messages.withColumn(out, F.to_json(F.struct(*fields)))


def assemble_request(
    history: DataFrame, prompts: DataFrame, *, conv_id: str = "conv_id"
) -> DataFrame:
    """Messages to send, in order: the system prompt, the history, the new user message.

    ``prompts`` has ``system`` and ``user_message`` per conversation.
    """
    first = prompts.select(
        conv_id, F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("position"),
        F.lit("system").alias("role"), F.col("system").alias("content"),
    )
    middle = history.join(prompts.select(conv_id), conv_id, "left_semi").select(
        conv_id, F.lit(1).alias("section"), F.col("position").cast("bigint"), "role", "content",
        *[c for c in OPTIONAL if c in history.columns],
    )
    last = prompts.select(
        conv_id, F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("position"),
        F.lit("user").alias("role"), F.col("user_message").alias("content"),
    )
    return (
        middle.unionByName(first, allowMissingColumns=True)
        .unionByName(last, allowMissingColumns=True)
    )


def request_params(
    requests: DataFrame,
    *,
    model: str | None = None,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    effort: str = DEFAULT_EFFORT,
    thinking: bool = DEFAULT_THINKING,
) -> DataFrame:
    """Fill in defaults: 0 and '' count as missing, for thinking only null does."""
    if model is not None:
        requests = requests.withColumn("model", F.lit(model))
    enabled = F.coalesce(F.col("thinking_enabled"), F.lit(thinking))
    return requests.withColumns(
        {
            "max_tokens": F.coalesce(F.nullif("max_tokens", F.lit(0)), F.lit(max_tokens)),
            "reasoning_effort": F.coalesce(F.nullif("reasoning_effort", F.lit("")), F.lit(effort)),
            "thinking": F.when(enabled, F.lit("enabled")).otherwise(F.lit("disabled")),
        }
    ).drop("thinking_enabled")


def parse_response(
    responses: DataFrame, *, raw: str = "raw", default_model: str = ""
) -> DataFrame:
    """Stored completion JSON to typed columns, with defaults for what is missing.

    ``parse_error`` says why a response could not be read; it is null for the others.
    """
    r = F.col("_r")
    choice = F.get(r["choices"], F.lit(0))

    def tokens(name: str) -> Column:
        return F.coalesce(r["usage"][name], F.lit(0)).alias(name)

    broken = "_broken"
    schema = StructType([*COMPLETION.fields, StructField(broken, StringType())])
    parsed = responses.withColumn("_r", F.from_json(F.col(raw), schema, {"columnNameOfCorruptRecord": broken}))
    error = (
        F.when(F.col(raw).isNull(), "no response")
        .when(r.isNull() | r[broken].isNotNull(), "not a JSON object")
        .when(F.size(F.coalesce(r["choices"], F.array())) == 0, "no choices")
    )
    return parsed.select(
        *[c for c in responses.columns if c not in (raw, "latency_ms")],
        F.coalesce(choice["message"]["content"], F.lit("")).alias("text"),
        choice["message"]["reasoning_content"].alias("reasoning_content"),
        F.coalesce(F.nullif(r["model"], F.lit("")), F.lit(default_model)).alias("model"),
        F.coalesce(
            F.nullif(choice["finish_reason"], F.lit("")), F.lit(DEFAULT_FINISH_REASON)
        ).alias("finish_reason"),
        tokens("prompt_tokens"),
        tokens("completion_tokens"),
        tokens("total_tokens"),
        F.round("latency_ms", 2).alias("latency_ms"),
        error.alias("parse_error"),
    )


def explode_messages(sessions: DataFrame, *, messages: str = "messages") -> DataFrame:
    """Session rows to one row per message; messages are an array, or JSON text of one.

    A session whose messages can't be read is one row with ``error``; one without
    messages is one row without anything.
    """
    listed = F.col(messages)
    if dict(sessions.dtypes)[messages] == "string":
        listed = F.from_json(listed, f"array<{MESSAGE.simpleString()}>", {"mode": "PERMISSIVE"})
    error = F.when(F.col(messages).isNotNull() & listed.isNull(), "messages are not a JSON array")
    return sessions.select("id", error.alias("error"), F.posexplode_outer(listed).alias("position", "m")).select(
        "id", "position", "m.role", "m.content", "m.timestamp", "error"
    )
