"""A turn as a loop of steps: which of the recorded steps run, their events in order, and the messages they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import deltas as D

#: What an event may carry besides its type, in the names of `deltas.frames`.
CARRIED = ("delta", "call_id", "tool_name", "input", "output")
ORDER = ("place", "part", "seq", "k")


def loop_steps(steps: DataFrame, deltas: DataFrame, limit: int = 5) -> DataFrame:
    """(turn, step, place, goes_on) of the steps that run; places count from 1.

    steps: (step, turn, number), in order of number; deltas as elsewhere.  A
    step goes on to the next one only if it ends with reason `tool_calls` and
    has slots of calls.  Steps after the first that doesn't, or after `limit`
    steps, don't run; a step without deltas ends its turn.
    """
    ends = deltas.groupBy("step").agg(F.max_by("finish_reason", F.when(F.coalesce("finish_reason", F.lit("")) != "", F.col("seq"))).alias("reason"), F.max(F.col("slot").isNotNull()).alias("slots"))
    order = Window.partitionBy("turn").orderBy("number", "step")
    goes_on = F.coalesce((F.col("reason") == "tool_calls") & F.col("slots"), F.lit(False))
    rows = steps.select("turn", "step", "number").join(ends, "step", "left").withColumn("goes_on", goes_on)
    ended = F.coalesce(F.max(~F.col("goes_on")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("__ended", ended)
    return rows.filter(~F.col("__ended") & (F.col("place") <= limit)).select("turn", "step", "place", "goes_on")


def exhausted(run: DataFrame, limit: int = 5) -> DataFrame:
    """(turn) of the turns whose last step that may run still goes on."""
    return run.filter((F.col("place") == limit) & F.col("goes_on")).select("turn")


def loop_events(run: DataFrame, deltas: DataFrame, calls: DataFrame, limit: int = 5, warning: str = "The answer was not finished within the steps allowed.") -> DataFrame:
    """(turn, place, part, seq, k, type, ...) of turns: all events in order of place, part, seq and k.

    run: what `loop_steps` gives; calls: rows of `deltas.call_results`, of which
    those of steps that go on are called.  Around each step are start-step and
    finish-step (parts 0 and 5); 1 is the streamed answer, 2 its end, 3 the
    calls, 4 their outputs.  A turn that ran out of steps has one more, with a
    warning as its text.
    """
    none = F.lit(None).cast("string")

    def made(rows: DataFrame, part: Column | int, seq: Column, k: Column, **carried: Column) -> DataFrame:
        part = F.lit(part) if isinstance(part, int) else part
        fill = [carried.get(c, none).alias(c) for c in CARRIED]
        return rows.select("turn", "place", part.cast("int").alias("part"), seq.cast("long").alias("seq"), k.cast("int").alias("k"), F.col("type"), *fill)

    zero, at = F.lit(0), run.select("turn", "step", "place")
    typed = lambda rows, name: rows.withColumn("type", F.lit(name))
    said = D.events(deltas.join(run.select("step"), "step", "left_semi")).join(at, "step")
    called = D.tool_events(calls.join(run.filter("goes_on").select("step"), "step", "left_semi")).withColumnRenamed("place", "call_place").join(at, "step")
    late = exhausted(run, limit).withColumn("place", F.lit(limit + 1))
    warned = [typed(late, name) for name in ("start-step", "text-start", "text-delta", "text-end", "finish-step")]
    parts = [
        made(typed(at, "start-step"), 0, zero, zero),
        made(said, F.when(F.col("seq").isNull(), 2).otherwise(1), F.coalesce("seq", zero), F.col("ord"), delta=F.col("delta")),
        made(called, F.col("phase") + 3, F.col("call_place"), F.col("k"), **{c: F.col(c) for c in CARRIED[1:]}),
        made(typed(at, "finish-step"), 5, zero, zero),
        made(warned[0], 0, zero, zero), made(warned[1], 1, zero, zero), made(warned[2], 1, zero, F.lit(1), delta=F.lit(warning)), made(warned[3], 2, zero, zero), made(warned[4], 5, zero, zero),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def loop_messages(run: DataFrame, deltas: DataFrame, calls: DataFrame) -> DataFrame:
    """(turn, place, row, role, content, reasoning_content, tool_calls, tool_call_id, name, ephemeral): what steps that go on add to the conversation.

    Of each such step the assistant's row with its calls (row 0), then a tool
    row for each call, in order.  The last answer of a turn is not a row: it is
    stored by whoever streams it.
    """
    on = run.filter("goes_on").select("turn", "step", "place")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    own = calls.join(on.select("step"), "step", "left_semi")
    call = F.struct(F.col("call_id").alias("id"), "name", F.col("input").alias("arguments"))
    listed = own.groupBy("step").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("place").alias("p"), call.alias("c")))), lambda s: s["c"]).alias("tool_calls"))
    none, kind = F.lit(None).cast("string"), "array<struct<id string, name string, arguments string>>"
    said = on.join(D.answers(deltas), "step").join(listed, "step", "left").select(
        "turn", "place", F.lit(0).cast("long").alias("row"), F.lit("assistant").alias("role"), empty("content").alias("content"), empty("reasoning").alias("reasoning_content"),
        F.col("tool_calls").cast(kind).alias("tool_calls"), none.alias("tool_call_id"), none.alias("name"), F.lit(False).alias("ephemeral"),
    )
    results = on.join(own.select("step", (F.col("place") + 1).cast("long").alias("row"), "call_id", "name", "output", "ephemeral"), "step").select(
        "turn", "place", "row", F.lit("tool").alias("role"), F.col("output").alias("content"), none.alias("reasoning_content"), F.lit(None).cast(kind).alias("tool_calls"),
        F.col("call_id").alias("tool_call_id"), "name", "ephemeral",
    )
    return said.unionByName(results)
