"""Fragments of a streamed answer, put together again; batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tool_arguments

EVENTS = ("reasoning-start", "reasoning-delta", "reasoning-end", "text-start", "text-delta", "reasoning-end", "text-end")


def _joined(value: str, present: Column) -> Column:
    pieces = F.array_sort(F.collect_list(F.when(present, F.struct("seq", F.col(value).alias("v")))))
    return F.array_join(F.transform(pieces, lambda s: s["v"]), "")


def answers(deltas: DataFrame) -> DataFrame:
    """Per step the whole content and reasoning, and the last finish reason (`stop` where there is none)."""
    reason = F.max_by("finish_reason", F.when(F.coalesce("finish_reason", F.lit("")) != "", F.col("seq")))
    return deltas.groupBy("step").agg(
        _joined("content", F.col("content").isNotNull()).alias("content"), _joined("reasoning_content", F.col("reasoning_content").isNotNull()).alias("reasoning"),
        F.coalesce(reason, F.lit("stop")).alias("finish_reason"),
    )


def tool_calls(deltas: DataFrame) -> DataFrame:
    """Per step and slot the call: the last id that isn't empty, and name and arguments joined in order."""
    own = deltas.filter("slot IS NOT NULL")
    call_id = F.coalesce(F.max_by("call_id", F.when(F.coalesce("call_id", F.lit("")) != "", F.col("seq"))), F.lit(""))
    return own.groupBy("step", "slot").agg(call_id.alias("call_id"), _joined("call_name", F.col("call_name").isNotNull()).alias("call_name"), _joined("call_arguments", F.col("call_arguments").isNotNull()).alias("call_arguments"))


def events(deltas: DataFrame) -> DataFrame:
    """(step, seq, ord, type, delta): the start, delta and end events that a reader of the stream sees; seq is null at the end.

    The first content ends the reasoning before it.  Reasoning after that is
    opened again, stays open, and is ended before the text at the end.
    """
    step = Window.partitionBy("step")
    said, thought = F.coalesce("content", F.lit("")) != "", F.coalesce("reasoning_content", F.lit("")) != ""
    rows = deltas.withColumn("fc", F.min(F.when(said, F.col("seq"))).over(step)).withColumn("phase", F.coalesce(F.col("seq") > F.col("fc"), F.lit(False)))
    rows = rows.withColumn("first", F.min(F.when(thought, F.col("seq"))).over(Window.partitionBy("step", "phase"))).withColumn("early", F.max(thought & ~F.col("phase")).over(step))
    event = lambda n, when, delta=None: F.when(when, F.struct(F.lit(n).alias("ord"), F.lit(EVENTS[n]).alias("type"), (F.lit(None).cast("string") if delta is None else delta).alias("delta")))
    at_first = F.col("seq") == F.col("fc")
    inner = F.array_compact(F.array(
        event(0, thought & (F.col("seq") == F.col("first"))), event(1, thought, F.col("reasoning_content")), event(2, at_first & F.col("early")), event(3, at_first), event(4, said, F.col("content")),
    ))
    ends = rows.groupBy("step").agg(F.max("fc").alias("fc"), F.max(thought & F.col("phase")).alias("late"), F.max(thought).alias("any"))
    closing = F.array_compact(F.array(event(5, F.col("late") | (F.col("fc").isNull() & F.col("any"))), event(6, F.col("fc").isNotNull())))
    seen = rows.select("step", "seq", F.explode(inner).alias("e")).unionByName(ends.select("step", F.lit(None).cast("long").alias("seq"), F.explode(closing).alias("e")))
    return seen.select("step", "seq", "e.*")


def parsed_calls(calls: DataFrame) -> DataFrame:
    """Assembled calls in order of slot, with their arguments as JSON ({} where they are none) and their place."""
    place = F.row_number().over(Window.partitionBy("step").orderBy("slot")) - 1
    return calls.withColumn("input", tool_arguments(F.col("call_arguments"))).withColumn("place", place)


def call_results(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """Tool rows of parsed calls: each call meets the result at its place, in the order of the calls.

    results: (step, place, output, error).  An error becomes text, as does a
    call of a tool that isn't in tools (name, ephemeral); the flag of the tool
    goes along.
    """
    known = tools.select(F.col("name").alias("call_name"), "ephemeral").withColumn("__known", F.lit(True))
    met = calls.join(results, ["step", "place"], "left").join(known, "call_name", "left")
    output = F.when(F.col("__known").isNull(), F.format_string("[no tool named %s]", "call_name")).when(F.col("error").isNotNull(), F.concat(F.lit("[tool failed] "), "error")).otherwise(F.coalesce("output", F.lit("")))
    return met.select("step", "place", "call_id", F.col("call_name").alias("name"), "input", output.alias("output"), F.coalesce("ephemeral", F.lit(False)).alias("ephemeral"))


def tool_events(rows: DataFrame) -> DataFrame:
    """(step, phase, place, k, type, call_id, tool_name, input, output): phase 0 is of each call its start and input, phase 1 the outputs; in order of phase, place and k."""
    none = F.lit(None).cast("string")
    event = lambda phase, k, type_, name, value, output: F.struct(
        F.lit(phase).alias("phase"), F.col("place").cast("long").alias("place"), F.lit(k).alias("k"), F.lit(type_).alias("type"), F.col("call_id"), name.alias("tool_name"), value.alias("input"), output.alias("output")
    )
    made = F.array(
        event(0, 0, "tool-input-start", F.col("name"), none, none), event(0, 1, "tool-input-available", F.col("name"), F.col("input"), none), event(1, 0, "tool-output-available", none, none, F.col("output")),
    )
    return rows.select("step", F.explode(made).alias("e")).select("step", "e.*")


#: The event types of the stream protocol.
TYPES = (
    "start-step", "finish-step", "text-start", "text-delta", "text-end", "reasoning-start", "reasoning-delta", "reasoning-end",
    "tool-input-start", "tool-input-available", "tool-output-available", "source-url",
)


def frames(events_: DataFrame, order: list[str], outcomes: DataFrame) -> DataFrame:
    """Events as server-sent frames: a start before each step, and after it what its outcome asks for.

    events: (step, *order, type) and whichever of id, delta, call_id, tool_name,
    input (JSON), output, source_id and url there are; an unknown type fails.
    outcomes: (step, outcome, message) for every step, also those without
    events: ok ends with a finish, cancelled with an abort, failed with an
    error; all end with [DONE].
    """
    column = lambda name: F.col(name) if name in events_.columns else F.lit(None).cast("string")
    known = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), "type")))
    payload = F.struct(
        known.alias("type"), column("id").alias("id"), column("delta").alias("delta"), column("call_id").alias("toolCallId"), column("tool_name").alias("toolName"),
        F.try_parse_json(column("input")).alias("input"), column("output").alias("output"), column("source_id").alias("sourceId"), column("url").alias("url"),
    )
    framed = lambda text: F.concat(F.lit("data: "), text, F.lit("\n\n")).alias("frame")
    body = events_.select("step", F.lit(1).alias("part"), *order, framed(F.to_json(payload)))
    none = [F.lit(None).cast(events_.schema[c].dataType).alias(c) for c in order]
    fixed = lambda part, text: outcomes.select("step", F.lit(part).alias("part"), *none, framed(text))
    start = F.to_json(F.struct(F.lit("start").alias("type"), F.concat(F.lit("msg_"), F.col("step").cast("string")).alias("messageId")))
    end = (
        F.when(F.col("outcome") == "ok", F.lit('{"type":"finish"}'))
        .when(F.col("outcome") == "cancelled", F.to_json(F.struct(F.lit("abort").alias("type"), F.coalesce("message", F.lit("user_cancelled")).alias("reason"))))
        .otherwise(F.to_json(F.struct(F.lit("error").alias("type"), F.coalesce("message", F.lit("")).alias("errorText"))))
    )
    return fixed(0, start).unionByName(body).unionByName(fixed(2, end)).unionByName(fixed(3, F.lit("[DONE]")))
